"""Entities of a corpus: what they hold, how active they are, and which come first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loamline.config import IndexConfig
from loamline.functions import markdown as M
from loamline.functions import timefn as T


def activity(rows: DataFrame, keys: list[str], date: str, as_of) -> DataFrame:
    """keys, n, frequency12m, first_seen, last_seen, trend: of the dates of each key. Sums only, so a hot key is summed in every task."""
    age = T.age_days(F.col(date), as_of)
    got = rows.withColumn("_age", age).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("_age") <= 365, 1).otherwise(0)).alias("frequency12m"),
        F.min(date).alias("first_seen"),
        F.max(date).alias("last_seen"),
        F.sum(F.when(F.col("_age") <= 90, 1).otherwise(0)).alias("recent"),
        F.sum(F.when((F.col("_age") > 90) & (F.col("_age") <= 365), 1).otherwise(0)).alias("previous"),
        F.min("_age").alias("freshest"),
    )
    return got.withColumn("trend", T.trend(F.col("recent"), F.col("previous"), F.col("freshest"))).drop("recent", "previous", "freshest")


def summaries(docs: DataFrame, chunks: DataFrame, as_of) -> DataFrame:
    """entity_id, entity_type, name, document_count, chunk_count, frequency12m, first_seen, last_seen, activity_trend, score, first_path.

    Notes and passages are summed apart and joined by entity, so neither multiplies the other.
    """
    by_doc = docs.select(F.explode("entities").alias("entity_id"), "created_at", "relative_path")
    of_docs = activity(by_doc, ["entity_id"], "created_at", as_of)
    first = by_doc.groupBy("entity_id").agg(F.min(F.collate("relative_path", "UNICODE")).alias("first_path"))
    of_chunks = chunks.select(F.explode("entities").alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("chunk_count"))
    rows = of_docs.join(first, "entity_id").join(of_chunks, "entity_id", "left").na.fill(0, ["chunk_count"])
    score = F.col("n") * 2.0 + F.col("chunk_count") + F.col("frequency12m") * 1.5 + T.recency(F.col("last_seen"), 180, as_of) * 2
    return rows.select(
        "entity_id",
        M.entity_type(F.col("entity_id")).alias("entity_type"),
        M.entity_name(F.col("entity_id")).alias("name"),
        F.col("n").alias("document_count"),
        "chunk_count",
        "frequency12m",
        "first_seen",
        "last_seen",
        F.col("trend").alias("activity_trend"),
        score.alias("score"),
        "first_path",
    )


def selected(rows: DataFrame, config: IndexConfig) -> DataFrame:
    """The entities with the highest scores; of equals the one met first. Adds entity_pos from 0."""
    best = rows.where(F.col("document_count") >= config.min_entity_documents)
    # A score decided by the last bit would make the order depend on the order of summing.
    best = best.orderBy(F.desc(F.round("score", 9)), "first_path", "entity_id").limit(config.selected_entity_limit)
    best = best.drop("first_path")
    held = best.collect()
    schema = StructType([*best.schema.fields, StructField("entity_pos", IntegerType())])
    return rows.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(held)], schema)
