"""Notes and their passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.config import IndexConfig
from loamline.functions import markdown as M
from loamline.functions import text as X
from loamline.functions import timefn as T
from loamline.session import cores, spread


def path_order(column: str = "relative_path") -> list[Column]:
    """The order of notes: by path as people sort names, then byte by byte. The last key of every ranking, instead of a position that all notes had to be numbered for."""
    return [F.collate(F.col(column), "UNICODE"), F.col(column)]


def from_dataframe(df: DataFrame, path: Column, text: Column, born: Column, changed: Column, root: str = "") -> DataFrame:
    """Any table as raw notes: path, relative_path, raw, birth_ts, mtime."""
    rows = df.select(path.cast("string").alias("relative_path"), F.coalesce(text.cast("string"), F.lit("")).alias("raw"), born.alias("birth_ts"), changed.alias("mtime"))
    return rows.where(F.col("relative_path").isNotNull()).select(F.concat(F.lit(root), F.col("relative_path")).alias("path"), "relative_path", "raw", "birth_ts", "mtime")


def documents(raw: DataFrame, config: IndexConfig | None = None) -> DataFrame:
    """Notes with their front matter, title, dates, entities and word count; those without words are left out.

    The first ``max_files`` notes by path are read, before empty ones go. A null path is no note; a null text is empty.
    """
    config = config or IndexConfig()
    rows = raw.where(F.col("relative_path").isNotNull())
    if config.max_files is not None:
        rows = rows.orderBy(*path_order()).limit(config.max_files).repartition(cores(raw.sparkSession))
    text = F.coalesce(F.make_valid_utf8(F.col("raw").cast("string")), F.lit(""))
    rows = spread(rows).select("path", "relative_path", "birth_ts", "mtime", M.body(text).alias("content"), F.coalesce(M.parse_yaml(M.frontmatter_block(text)), F.create_map().cast(M.MAP)).alias("frontmatter"))
    rows = rows.select(
        M.stable_id(F.col("relative_path")).alias("doc_id"),
        "path",
        "relative_path",
        M.title(F.col("content"), F.element_at(F.split("relative_path", "/"), -1)).alias("title"),
        "content",
        F.coalesce(T.frontmatter_date(F.col("frontmatter"), T.CREATED_KEYS), "birth_ts", "mtime").alias("created_at"),
        F.coalesce(T.frontmatter_date(F.col("frontmatter"), T.MODIFIED_KEYS), "mtime").alias("modified_at"),
        "frontmatter",
        M.tags_of(F.col("frontmatter"), F.col("content")).alias("tags"),
        M.links_of(F.col("content")).alias("links"),
        F.array_sort(M.folders(F.col("relative_path"))).alias("folders"),
        X.word_count(F.col("content")).alias("word_count"),
    )
    return rows.where(F.col("word_count") > 0).withColumn("entities", M.entity_ids(F.col("tags"), F.col("links"), F.col("folders")))


def chunks(docs: DataFrame, config: IndexConfig | None = None) -> DataFrame:
    """The passages of each note as windows of words, with what they take over from the note, and their tokens.

    ``tokens`` are those of title and content with aliases; ``plain`` those of the content alone without, from which the
    terms of entities are counted. Text is taken apart here and nowhere later.
    """
    config = config or IndexConfig()
    own = ["doc_id", "title", "path", "relative_path", "created_at", "modified_at", "entities"]
    rows = docs.select(*own, F.posexplode(X.chunk_windows(F.col("content"), config.chunk_size_words, config.chunk_overlap_words)).alias("ordinal", "content"))
    rows = rows.withColumn("chunk_id", F.concat_ws(":", "doc_id", F.col("ordinal").cast("string")))
    return rows.withColumn("tokens", X.tokenize(F.concat_ws(" ", "title", "content"))).withColumn("plain", X.tokenize(F.col("content"), aliases=False))
