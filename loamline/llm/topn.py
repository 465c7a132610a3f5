"""The N best items of every group, by an aggregation whose state is a bounded heap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.heap import largest


def latest(df: DataFrame, key: str, version: list[str], keep: list[str]) -> DataFrame:
    """The row with the highest version of each key.

    The version columns are compared in turn, nulls lowest; rows that agree in all of them are settled by the other
    columns, so the result doesn't depend on the order of the rows. A null key is no key: such rows are left out.
    The aggregation is partial before the shuffle, so a key that fills a third of the rows arrives as one row a task.
    """
    rest = [c for c in keep if c not in version]
    fields = [*version, *rest]
    row = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    best = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(row).alias("r"))
    return best.select(F.col("k").alias(key), *[F.col(f"r.f{i}").alias(c) for i, c in enumerate(fields) if c != key])


def top_n(df: DataFrame, group: str, score: str, ties: list[str], n: int, rank: str = "rank") -> DataFrame:
    """The ``n`` rows of each group with the highest score; equal scores by the ``ties`` columns, ascending.

    The state of a group is a heap of at most ``n`` entries. Each task fills one heap a group before the shuffle, and
    the heaps are merged after it, so a group of any size costs ``n`` rows a task. Ties must be integers and end in a
    unique one; their order is then total. Rows whose group, score or first tie is null, or whose score is NaN, are no
    candidates; a null in a later tie counts as the largest. Result: group, the rank from 1, score, ties. An empty
    input gives no rows; other columns, whatever their names, are not read.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    s = F.col(score).cast("double")
    # -0.0 and 0.0 are equal scores; -(x) - 1 turns the order of integers round without overflow, and a null stays below all.
    turned: list[Column] = [F.bitwise_not(F.col(c).cast("bigint")) for c in ties]
    entry = F.struct((s + F.lit(0.0)).alias("s"), *[t.alias(f"t{i}") for i, t in enumerate(turned)])
    usable = F.col(group).isNotNull() & s.isNotNull() & ~F.isnan(s) & F.col(ties[0]).isNotNull()
    heap = largest(F.col("e"), n)
    best = df.where(usable).select(F.col(group).alias("g"), entry.alias("e")).groupBy("g").agg(heap.alias("h"))
    row = best.select("g", F.posexplode("h").alias("p", "e"))
    back = [F.bitwise_not(F.col(f"e.t{i}")).alias(c) for i, c in enumerate(ties)]
    return row.select(F.col("g").alias(group), (F.col("p") + 1).alias(rank), F.col("e.s").alias(score), *back)


def top_links(links: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` best links of each entity: the latest revision of each link, positive scores only.

    By score descending, then chunk_no, then link_no. Repeated rows count once; a null rev is older than any other.
    Result: entity_id, rank, score, chunk_no, link_no.
    """
    now = latest(links, "link_no", ["rev", "scored_at"], ["rev", "scored_at", "score", "entity_id", "chunk_no"])
    score = F.col("score")
    return top_n(now.where((score > 0) & ~F.isnan(score)), "entity_id", "score", ["chunk_no", "link_no"], n)
