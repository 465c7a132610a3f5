"""Notes that arrive while an index is in use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamline.operators import corpus
from loamline.operators.embed import embedder
from loamline.plans import store
from loamline.plans.index import vectors_of


def arriving(raw: DataFrame, delay: str = "1 hour", when: str = "mtime") -> DataFrame:
    """A stream of raw notes, each version once: a note (path and time of change) that comes again within the delay is dropped."""
    return raw.withWatermark(when, delay).dropDuplicatesWithinWatermark(["relative_path", when])


def append(raw: DataFrame, folder: str, checkpoint: str, load: Callable | None = None, **trigger) -> StreamingQuery:
    """Adds a stream of raw notes to the index in ``folder``, where ``store.read_index`` finds them: notes, passages and vectors.

    Terms are weighed by the idf of the index, which is made anew by a rebuild. Of a note that has come again only the
    last version is read, and the one of the index no more. Each micro-batch goes to a folder of its own number, so one
    that is run again after a failure writes the same rows in the same place. A rebuild begins without appended notes.
    """
    base = store.read_index(raw.sparkSession, folder)
    config = base.config.merged({"max_files": None})
    maker = embedder(config, load)
    where = store.appended_path(folder)

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def put(name: str, table: DataFrame) -> DataFrame:
            path = f"{where}/{name}/batch={number}"
            table.write.mode("overwrite").parquet(path)
            return spark.read.schema(table.schema).parquet(path)

        docs = put("documents", corpus.documents(batch, config))
        rows = put("chunks", corpus.chunks(docs, config))
        put("vectors", vectors_of(rows, base.idf, base.max_idf, maker))

    return raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def activity(notes: DataFrame, delay: str = "1 day", window: str = "7 days", slide: str = "1 day") -> DataFrame:
    """start, end, entity_id, notes: how many notes of each entity fall into each sliding window of their time of change."""
    rows = notes.select(F.explode("entities").alias("entity_id"), "modified_at").withWatermark("modified_at", delay)
    counts = rows.groupBy(F.window("modified_at", window, slide).alias("w"), "entity_id").agg(F.count("*").alias("notes"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "entity_id", "notes")
