from pyspark.sql import functions as F

from loamline.plans import index as I
from loamline.plans import store
from loamline.sources.vault import SCHEMA
from loamline.streaming import ingest


def raw(spark, rows):
    return spark.createDataFrame(rows, "path string, relative_path string, text string, at string").select("path", "relative_path", F.col("text").cast("binary").alias("raw"), F.to_timestamp("at").alias("birth_ts"), F.to_timestamp("at").alias("mtime"))


def test_append(spark, tmp_path):
    """Notes that arrive are found by questions; one that comes again replaces the version of the index and of the batch before."""
    where = tmp_path / "index"
    old = raw(spark, [("a", "a.md", "# A\n\nalpha beta", "2025-01-01"), ("c", "c.md", "# C\n\nkept gamma", "2025-01-01")])
    store.write_index(where, I.build(old, "2025-06-01"))
    (tmp_path / "in").mkdir()
    stream = ingest.arriving(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    for n, rows in enumerate(([("a", "a.md", "# A\n\ndelta", "2025-02-01"), ("a", "a.md", "# A\n\ndelta", "2025-02-01"), ("b", "b.md", "beta gamma", "2025-02-02")], [("a", "a.md", "# A\n\nomega", "2025-03-01")])):
        raw(spark, rows).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            ingest.append(stream, str(where), str(tmp_path / "checkpoint")).awaitTermination()
        index = store.read_index(spark, where)
        assert sorted((r.relative_path, r.content) for r in index.chunks.collect()) == [("a.md", f"A {('delta', 'omega')[n]}"), ("b.md", "beta gamma"), ("c.md", "C kept gamma")]
        hits, _ = I.ask(index, ("delta", "omega")[n], "2025-06-01")
        assert hits.first().relative_path == "a.md" and index.vectors.count() == 3
    hits, _ = I.ask(index, "beta", "2025-06-01")
    assert hits.first().relative_path == "b.md"


def test_activity(spark, tmp_path):
    rows = spark.createDataFrame([(["tag:a"], "2025-01-03"), (["tag:a", "tag:b"], "2025-01-04")], "entities array<string>, at string").select("entities", F.to_timestamp("at").alias("modified_at"))
    rows.write.parquet(str(tmp_path / "n"))
    stream = ingest.activity(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "n")))
    q = stream.writeStream.format("memory").queryName("activity").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.entity_id, r.notes): r["count"] for r in spark.sql("select entity_id, notes from activity").groupBy("entity_id", "notes").count().collect()}
    assert got == {("tag:a", 1): 2, ("tag:a", 2): 6, ("tag:b", 1): 7}
