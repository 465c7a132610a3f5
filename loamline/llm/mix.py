"""A mix of sources in which each has a given share of the tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamline.llm.tokens import TOKENIZER, TOKENIZER_DIR, counted
from loamline.session import cut

#: Bits of the hash that one histogram tells apart, and the number of histograms, each inside one bucket of the one before.
BITS = 12
LEVELS = 4


def hashed(key: str) -> Column:
    """63 bits that depend on the key alone: the same record is taken or left in every run and at every budget."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(key)), 1)


def bucket(h: Column, level: int, bits: int = BITS) -> Column:
    return F.shiftrightunsigned(h, 63 - bits * (level + 1))


def mix_plan(sizes: DataFrame, targets: DataFrame, total: int | None = None, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """How each source of ``targets`` fills its share: whole repeats, and the hash below which a record comes once more.

    ``sizes``: source, hash, tokens, a row each record. ``targets``: source, weight, max_repeats. The wanted size of a
    source is its weight times ``total``, by default the tokens of all records, those without a source or a target too.
    It is filled by as many whole repeats as go into it and the records whose hash is below a threshold. For the
    threshold the tokens are summed by source and the first ``bits`` bits of the hash, then, inside the one bucket in
    which the budget runs out, by the next ``bits`` bits, and so on for ``levels`` histograms; what is left open is one
    bucket of the last. Thresholds are nested: a larger budget takes all records that a smaller one takes.

    Sums are made before the shuffle, so a source that holds most rows sends ``2**bits`` rows a task at most. Targets
    without a source, weight or max_repeats are left out; of several for one source the largest weight counts. A source
    without records can't fill a share above 0. Result: source, weight, max_repeats, source_tokens, all_tokens,
    wanted, repeats, below, short.
    """
    t = targets.where(F.col("source").isNotNull() & F.col("weight").isNotNull() & F.col("max_repeats").isNotNull())
    t = t.groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("x")).select("source", F.col("x.weight").cast("double").alias("weight"), F.col("x.max_repeats").cast("bigint").alias("max_repeats"))
    by_source = sizes.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    if total is None:
        total = sizes.agg(F.sum("tokens")).first()[0] or 0
    plan = t.join(by_source, "source", "left").na.fill(0, ["source_tokens"]).withColumn("all_tokens", F.lit(total).cast("bigint"))
    plan = plan.withColumn("wanted", F.col("weight") * F.col("all_tokens"))
    plan = plan.withColumn("short", F.col("max_repeats") * F.col("source_tokens") < F.col("wanted"))
    fits = F.when(F.col("source_tokens") > 0, F.floor(F.col("wanted") / F.col("source_tokens"))).otherwise(0)
    plan = plan.withColumn("repeats", F.greatest(F.lit(0), F.least(F.col("max_repeats"), fits)))
    left = F.when(F.col("repeats") < F.col("max_repeats"), F.col("wanted") - F.col("repeats") * F.col("source_tokens"))
    plan = plan.withColumn("budget", F.greatest(F.lit(0.0), F.coalesce(left, F.lit(0.0))))
    plan = cut(plan, "mixplan")

    open_ = plan.select("source", F.col("budget"), F.lit(0).cast("bigint").alias("prefix"))
    for level in range(levels):
        inside = sizes.join(open_, "source").where(bucket(F.col("hash"), level - 1, bits) == F.col("prefix") if level else F.col("budget") > 0)
        bars = inside.groupBy("source", "budget", bucket(F.col("hash"), level, bits).alias("b")).agg(F.sum("tokens").alias("n"))
        so_far = F.sum("n").over(W.partitionBy("source").orderBy("b"))
        over = bars.withColumn("upto", so_far).where(F.col("upto") > F.col("budget"))
        edge = over.groupBy("source").agg(F.min(F.struct("b", "upto", "n", "budget")).alias("e"))
        open_ = cut(edge.select("source", (F.col("e.budget") - (F.col("e.upto") - F.col("e.n"))).alias("budget"), F.col("e.b").alias("prefix")), "mixedge")
    below = open_.select("source", F.shiftleft(F.col("prefix"), 63 - bits * levels).alias("below"))
    return plan.join(below, "source", "left").withColumn("below", F.coalesce("below", F.lit(0).cast("bigint"))).drop("budget")


def sized(docs: DataFrame, key: str = "doc_id", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """key, source, tokens and hash of each record, written once: the texts are encoded once, not in every pass."""
    rows = counted(docs, [key, "source"], "text", "tokens", name, folder)
    return cut(rows.withColumn("hash", hashed(key)), "sizes")


def mixed(sizes: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """The records of the mix: key, source, copies (1 or more), tokens. One pass over the records, no sort."""
    copies = F.col("repeats") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    chosen = sizes.join(plan.select("source", "repeats", "below"), "source").withColumn("copies", copies.cast("int"))
    return chosen.where(F.col("copies") > 0).select(key, "source", "copies", "tokens")


def shares(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """source, weight, source_tokens, wanted_tokens, mix_tokens, share (of the mix reached), share_of_all, short."""
    got = mix.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("mix_tokens"))
    rows = plan.join(got, "source", "left").na.fill(0, ["mix_tokens"])
    reached = F.lit(mix.agg(F.sum(F.col("copies") * F.col("tokens"))).first()[0] or 0)
    part = lambda of: F.when(of > 0, F.col("mix_tokens") / of).otherwise(0.0)
    return rows.select("source", "weight", "source_tokens", F.col("wanted").alias("wanted_tokens"), "mix_tokens", part(reached).alias("share"), part(F.col("all_tokens")).alias("share_of_all"), "short")
