"""Queries of the operators of this package: name -> (session, folder of the tables) -> rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import knn, mix, names, split, subjects, tokens, topn


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The notes that must be cut."""
    cut = split.pieces(_t(spark, folder, "garden_documents"), _t(spark, folder, "vault_configs"))
    return cut.where((F.col("piece_no") == 1) & F.col("doc_no").isNotNull()).select("doc_no").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every note in pieces; repeated rows of a note once."""
    cut = split.pieces(_t(spark, folder, "garden_documents"), _t(spark, folder, "vault_configs"))
    return cut.dropDuplicates(["doc_no", "piece_no"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors of a cosine of at least 0.8 of which one is among the 5 nearest of the other."""
    pairs = knn.similar_pairs(knn.collection(_t(spark, folder, "garden_chunks"), _t(spark, folder, "catalysts")), 96)
    return pairs.select(F.col("number_a").alias("vector_no_a"), F.col("number_b").alias("vector_no_b"))


def p2_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest of every vector whose number is divisible by 20, among all vectors, whatever their cosine."""
    vectors = knn.collection(_t(spark, folder, "garden_chunks"), _t(spark, folder, "catalysts"))
    rows = knn.nearest(vectors, 96, 5, recall=0.92, every=20)
    return rows.select(F.col("number").alias("vector_no"), F.col("other").alias("other_no"), F.round("cosine", 6).alias("cosine"), "rank")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of link and tag records of the same person or organisation."""
    return names.spelling_pairs(_t(spark, folder, "entity_summaries"))


def p4_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entity of each such record: the set of spellings it belongs to."""
    return names.spellings(_t(spark, folder, "entity_summaries"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The 8 best links of each entity."""
    return topn.top_links(_t(spark, folder, "catalyst_links"), 8).select("entity_id", "link_no")


def p5_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The same with rank, chunk and score."""
    return topn.top_links(_t(spark, folder, "catalyst_links"), 8).select("entity_id", F.col("rank").cast("bigint").alias("rank"), "link_no", "chunk_no", "score")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every note."""
    return tokens.encoded(_t(spark, folder, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sources that can't fill their share of a mix as large as all notes."""
    plan = mix.mix_plan(mix.sized(_t(spark, folder, "documents")), _t(spark, folder, "mix_targets"))
    return plan.where("short").select("source")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The notes of the mix, and how often each is repeated."""
    sizes = mix.sized(_t(spark, folder, "documents"))
    return mix.mixed(sizes, mix.mix_plan(sizes, _t(spark, folder, "mix_targets")))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mix reaches."""
    sizes = mix.sized(_t(spark, folder, "documents"))
    plan = mix.mix_plan(sizes, _t(spark, folder, "mix_targets"))
    return mix.shares(mix.mixed(sizes, plan), plan)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects that at least three sentences of a note are about."""
    found = subjects.subjects_of(_t(spark, folder, "documents"), _t(spark, folder, "subject_labels"), _t(spark, folder, "subjects"))
    return found.select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Notes and sentences of each subject, and their part of all notes with a subject and all sentences."""
    model, notes = subjects.fit(_t(spark, folder, "documents"), _t(spark, folder, "subject_labels"), _t(spark, folder, "subjects"))
    return subjects.composition(subjects.counted_sentences(model, notes), notes)


def p8_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The map from topics to subjects that p8_found uses, to be looked through: each topic with its top terms, and how much more of the judged notes with them are of the subject than of all."""
    model, _ = subjects.fit(_t(spark, folder, "documents"), _t(spark, folder, "subject_labels"), _t(spark, folder, "subjects"))
    return spark.createDataFrame(model.table(), "topic int, subject string, share double, terms array<string>")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_knn, p4_found, p4_entities, p5_found, p5_ranked, p6_ids, p7_found, p7_mix, p7_shares, p8_found, p8_composition, p8_topics)}
