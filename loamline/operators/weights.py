"""Term weights, sparse vectors as long tables, and their products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Terms whose weights are sent to every task, the most frequent first; rows get the weights of others by a join.
FREQUENT = 200_000


def term_counts(rows: DataFrame, key: str | list[str], tokens: str = "tokens") -> DataFrame:
    """keys, term, tf."""
    keys = [key] if isinstance(key, str) else key
    return rows.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def idf(rows: DataFrame, tokens: str = "tokens", total: int | None = None) -> DataFrame:
    """term, df, idf = ln((n + 1) / (df + 1)) + 1 over the rows, of which there count at least one."""
    df = rows.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = max(1, rows.count() if total is None else total)
    return df.withColumn("idf", F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)


def max_idf(table: DataFrame) -> float:
    """What a term without a weight of its own weighs; 1 for an empty table."""
    found = table.agg(F.max("idf")).first()[0]
    return 1.0 if found is None else found


def tfidf(counts: DataFrame, table: DataFrame, key: str, default: float | None = None) -> DataFrame:
    """key, term, weight = (1 + ln tf) * idf, each key's vector of length 1; one of length 0 stays as it is."""
    default = max_idf(table) if default is None else default
    raw = counts.join(table.select("term", "idf"), "term", "left").select(key, "term", ((F.log("tf") + 1) * F.coalesce("idf", F.lit(default))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return raw.select(key, "term", F.when(norm > 0, F.col("w") / norm).otherwise(F.col("w")).alias("weight"))


def sparse_scores(vectors: DataFrame, query: dict[str, float], key: str) -> DataFrame:
    """key, sparse: the product with one query vector. The terms of the query are pushed down to the scan."""
    if not query:
        return vectors.select(key, F.lit(0.0).alias("sparse")).limit(0)
    weight = F.element_at(F.create_map(*[F.lit(x) for item in query.items() for x in item]), F.col("term"))
    return vectors.where(F.col("term").isin(list(query))).groupBy(key).agg(F.sum(F.col("weight") * weight).alias("sparse"))


def with_vector(rows: DataFrame, table: DataFrame, key: str, default: float, frequent: int = FREQUENT) -> DataFrame:
    """The rows with ``vector``, the weights of ``tfidf`` as a map: counted from ``tokens``, weighed and brought to length 1 within the row.

    ``table``: term, df, idf. The weights of ``frequent`` terms go to the tasks; where there are more, each row gets those of
    its other terms by its key. So a term that nearly all rows have is no key of any join.
    """
    known = table.orderBy(F.desc("df"), "term").limit(frequent).select("term", "idf").toArrow()
    keep = rows.columns
    if known.num_rows < frequent:
        rows = rows.withColumn("_rare", F.create_map().cast("map<string,double>"))
    else:
        last = table.where(F.col("term") == known.column("term")[-1].as_py()).select("df", "term").first()
        rare = table.where((F.col("df") < last.df) | (F.col("df") == last.df) & (F.col("term") > last.term)).select("term", "idf")
        own = rows.select(key, F.explode(F.array_distinct("tokens")).alias("term")).join(rare, "term").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("_rare"))
        rows = rows.join(own, key, "left")
    shared = rows.sparkSession.sparkContext.broadcast((known.column("term").combine_chunks(), known.column("idf").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf_ = shared.value
        for b in batches:
            tokens = b.column("tokens")
            lengths = pa.compute.fill_null(pa.compute.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            words = tokens.flatten().dictionary_encode()
            at = pa.compute.fill_null(pa.compute.index_in(words.dictionary, value_set=terms), -1).to_numpy(zero_copy_only=False)
            weight = np.where(at >= 0, idf_[at] if len(idf_) else default, np.nan)
            n = max(1, len(words.dictionary))
            pair, tf = np.unique(np.repeat(np.arange(b.num_rows, dtype=np.int64), lengths) * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, code = pair // n, pair % n
            w = weight[code]
            lacking = np.flatnonzero(np.isnan(w))
            if len(lacking):
                rare = [dict(x) if x else {} for x in b.column("_rare").to_pylist()]
                w[lacking] = [rare[row[i]].get(t, default) for i, t in zip(lacking, words.dictionary.take(pa.array(code[lacking])).to_pylist(), strict=True)]
            w = (np.log(tf) + 1) * w
            norm = np.sqrt(np.bincount(row, weights=w * w, minlength=b.num_rows))
            w = w / np.where(norm > 0, norm, 1)[row]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))])
            vector = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), words.dictionary.take(pa.array(code)), pa.array(w))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], vector], names=[*keep, "vector"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "_rare").mapInArrow(run, f"{kinds}, vector map<string,double>")


def as_rows(vectors: DataFrame, key: str) -> DataFrame:
    """key, term, weight of rows with a map ``vector``."""
    return vectors.select(key, F.explode("vector").alias("term", "weight"))


def sparse_score(vector: Column, query: dict[str, float]) -> Column:
    """The product of a row's own vector with one query vector: no join, whatever the number of rows."""
    score = F.lit(0.0)
    for term, weight in query.items():
        score = score + F.coalesce(F.element_at(vector, term), F.lit(0.0)) * F.lit(weight)
    return score


def ranked(counts: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key, with ``rank`` from 1. Only so many a task leave it."""
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)


def top_terms(counts: DataFrame, keys: list[str], limit: int = 8) -> DataFrame:
    """The most frequent terms of each key, of equals the first by name."""
    return ranked(counts, keys, [F.desc("tf"), F.col("term")], limit)


def weighted_terms(counts: DataFrame, table: DataFrame, keys: list[str], limit: int = 12) -> DataFrame:
    """The terms of each key that weigh most: count times idf (1 where there is none)."""
    rows = counts.join(table.select("term", "idf"), "term", "left").withColumn("score", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    return ranked(rows, keys, [F.desc("score"), F.col("term")], limit)


def top_vector_terms(vectors: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """The terms of each vector that weigh most, of equals the first by name."""
    return ranked(vectors.withColumn("weight", F.round("weight", 9)), [key], [F.desc("weight"), F.col("term")], limit)


def listed(rows: DataFrame, keys: list[str], term: str = "term", name: str = "terms") -> DataFrame:
    """keys and the terms of each in order of rank."""
    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(term).alias("t")))).alias("x"))
    return got.select(*keys, F.transform("x", lambda e: e["t"]).alias(name))
