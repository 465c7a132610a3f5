from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamline.llm import topn

SCHEMA = "link_no bigint, entity_id string, chunk_no bigint, score double, rev int, scored_at timestamp"
score = st.sampled_from([None, float("nan"), float("inf"), 0.0, -0.0, -1.0, 0.25, 0.5, 0.5, 0.75])
row = st.tuples(st.sampled_from([None, 1, 2, 3, 4, 5, 6]), st.sampled_from([None, "a", "b", ""]), st.sampled_from([None, 1, 2, 3]), score, st.sampled_from([None, 1, 2]), st.none())


def brute(rows, n):
    newest = {}
    for r in rows:
        if r[0] is None:
            continue
        key = (r[4] is not None, r[4] or 0)
        if r[0] not in newest or key > newest[r[0]][0]:
            newest[r[0]] = (key, r)
    groups = {}
    for _, r in newest.values():
        if r[1] is not None and r[2] is not None and r[3] is not None and r[3] > 0:
            groups.setdefault(r[1], []).append(r)
    return {(g, r[0], i + 1) for g, rs in groups.items() for i, r in enumerate(sorted(rs, key=lambda r: (-r[3], r[2], r[0]))[:n])}


@settings(max_examples=25, deadline=None)
@given(st.lists(row, max_size=30), st.integers(1, 3))
def test_links(spark, rows, n):
    # One row for each link and revision, as revisions that differ under one number have no defined winner.
    rows = list({(r[0], r[4]): r for r in rows}.values())
    df = spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(3)
    got = {(r.entity_id, r.link_no, r["rank"]) for r in topn.top_links(df, n).collect()}
    assert got == brute(rows, n)


def test_hot_group_and_many_partitions(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5_000)).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(97)) / 97).alias("s"), F.col("id").alias("t"), F.lit(1).alias("e"), F.lit(2).alias("h"))
    got = topn.top_n(df.repartition(40), "g", "s", ["t"], 8)
    best = sorted(df.where("g = 'hot'").collect(), key=lambda r: (-r.s, r.t))[:8]
    assert [r.t for r in got.where("g = 'hot'").orderBy("rank").collect()] == [r.t for r in best]
    assert got.groupBy("g").count().where("count > 8").isEmpty()


def test_ties_at_the_ends_of_integers(spark):
    df = spark.createDataFrame([("g", 1.0, 2**63 - 1), ("g", 1.0, -(2**63)), ("g", 1.0, 0)], "g string, s double, t bigint")
    assert [r.t for r in topn.top_n(df, "g", "s", ["t"], 3).orderBy("rank").collect()] == [-(2**63), 0, 2**63 - 1]


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA).withColumn("k", F.lit(1)).withColumn("r", F.lit(1)).withColumn("rank", F.lit(0))
    assert topn.top_links(df).count() == 0
    one = spark.createDataFrame([(1, "a", 1, 0.5, 1, None)], SCHEMA).withColumn("k", F.lit(1)).withColumn("rank", F.lit(7)).withColumn("h", F.lit("x"))
    assert [tuple(r) for r in topn.top_links(one).collect()] == [("a", 1, 0.5, 1, 1)]


def test_the_heap_and_its_fallback_agree(spark, monkeypatch):
    import pyspark.sql.internal as internal

    from loamline.llm.heap import largest

    df = spark.createDataFrame([(i % 3, i * 7 % 50) for i in range(200)], "k int, v int")
    heap = sorted(map(tuple, df.groupBy("k").agg(largest(F.col("v"), 4).alias("t")).collect()))
    monkeypatch.delattr(internal, "InternalFunction")
    assert sorted(map(tuple, df.groupBy("k").agg(largest(F.col("v"), 4).alias("t")).collect())) == heap
