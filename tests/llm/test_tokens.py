import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")

from loamline.llm import mix, tokens  # noqa: E402

pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(tokens.TOKENIZER_DIR), reason="no tokenizer files")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300), st.integers(1, 40), st.integers(1, 20))
def test_same_ids_however_cut(text, whole, leaf):
    enc = tokens.encoding()
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.encode(text, enc, whole, leaf).tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "ABC012=/+", "é日本", "a" * 5 + " ", "\t \n", "''sd", "the quick"])
def test_long_runs(letters):
    enc, rng = tokens.encoding(), random.Random(1)
    text = "".join(rng.choice(letters) for _ in range(30_000))
    assert tokens.encode(text, enc).tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize(("text", "tree"), [("x " + "ab" * 600 + " y", True), ("a " * 9_000 + "ab" * 600, True), ("é" * 600, True), ("ab" * 500, False), ("a b" * 900, False), ("a-b/" * 900, False)])
def test_a_long_run_in_a_short_text_takes_the_tree(text, tree, monkeypatch):
    enc, seen, merge = tokens.encoding(), [], tokens.merge_tree
    monkeypatch.setattr(tokens, "merge_tree", lambda piece, *a: seen.append(len(piece)) or merge(piece, *a))
    assert tokens.encode(text, enc).tolist() == enc.encode_ordinary(text)
    assert (max(seen, default=0) > tokens.LEAF) == tree


def test_text_that_the_library_alone_cannot_encode():
    enc = tokens.encoding()
    ids = tokens.encode(" " * 1_000_000 + "x", enc)
    assert enc.decode(ids.tolist()) == " " * 1_000_000 + "x"


def test_round_trip_of_a_long_run_by_threads():
    enc, rng = tokens.encoding(), random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(300_000))
    assert enc.decode(tokens.encode(text, enc).tolist()) == text


def test_pattern_is_that_of_the_files():
    public = pytest.importorskip("public_tokenizers")
    assert public.PATTERN == tokens.PATTERN


def test_rows(spark):
    rows = [(1, "a note"), (2, ""), (3, None), (None, "x"), (1, "a note"), (4, "<|endoftext|>"), (5, "  x "), (6, "y" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(0))
    got = [(r.doc_id, list(r.ids)) for r in tokens.encoded(df, "doc_id", "text").collect()]
    enc = tokens.encoding()
    want = [(i, enc.encode_ordinary(t or "")) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokens.encoded(df.limit(0), "doc_id", "text").count() == 0
    assert {r.doc_id: r.n for r in tokens.counted(df.where("doc_id > 1"), ["doc_id"], "text", "n").collect()} == {i: len(enc.encode_ordinary(t or "")) for i, t in rows if i and i > 1}


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").withColumn("hash", mix.hashed("doc_id"))


def test_mix(spark):
    rows = [(i, "big" if i % 3 else "small", 10 + i % 7) for i in range(6_000)] + [(9_001, None, 500), (9_002, "other", 700)]
    targets = spark.createDataFrame([("big", 0.3, 4), ("small", 0.5, 4), ("tiny", 0.1, 9), ("none", 0.1, 0), (None, 0.5, 1), ("bad", None, 1)], "source string, weight double, max_repeats int")
    table = sizes(spark, rows)
    total = sum(r[2] for r in rows)
    plan = mix.mix_plan(table, targets)
    got = {r.source: r for r in plan.collect()}
    assert set(got) == {"big", "small", "tiny", "none"} and got["big"].all_tokens == total
    assert [got[s].short for s in ("big", "small", "tiny", "none")] == [False, False, True, True]
    made = mix.mixed(table, plan)
    reached = {r.source: r for r in mix.shares(made, plan).collect()}
    for s in ("big", "small"):
        assert got[s].wanted - 17 <= reached[s].mix_tokens <= got[s].wanted
    copies = {r.copies for r in made.where("source = 'small'").collect()}
    assert copies == {1, 2} or copies == {1} or max(copies) <= 4
    assert reached["tiny"].mix_tokens == 0 and abs(sum(r.share for r in reached.values()) - 1) < 1e-9


def test_larger_budgets_take_all_that_smaller_ones_take(spark):
    table = sizes(spark, [(i, "s", 5 + i % 11) for i in range(3_000)])
    before = set()
    for w in (0.05, 0.2, 0.5, 0.9):
        plan = mix.mix_plan(table, spark.createDataFrame([("s", w, 1)], "source string, weight double, max_repeats int"))
        now = {r.doc_id for r in mix.mixed(table, plan).collect()}
        assert before <= now
        before = now


def test_mix_of_nothing(spark):
    table = sizes(spark, [(1, "s", 0)]).limit(0)
    plan = mix.mix_plan(table, spark.createDataFrame([("s", 0.5, 2), ("z", 0.0, 2)], "source string, weight double, max_repeats int"))
    assert {r.source: r.short for r in plan.collect()} == {"s": False, "z": False}
    assert mix.mixed(table, plan).count() == 0 and mix.shares(mix.mixed(table, plan), plan).count() == 2


def test_one_huge_record(spark):
    table = sizes(spark, [(1, "s", 10**12), (2, "s", 1), (3, "t", 10**12)])
    plan = mix.mix_plan(table, spark.createDataFrame([("s", 0.1, 3)], "source string, weight double, max_repeats int"))
    r = mix.shares(mix.mixed(table, plan), plan).first()
    assert r.mix_tokens <= r.wanted_tokens
