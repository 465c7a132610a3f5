from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamline.functions.text import split_words
from loamline.llm import split

TEXT = """# Start

Cats sleep all day. Cats eat fish, e.g. tuna. Cats purr.

- cats and mice
- mice hide

## Ships

Ships sail the sea. Sailors love ships. A harbour keeps ships.
"""
bits = st.sampled_from(["word", "Other", "end.", "Stop!", "\n", "\n\n", "- item", "## Head", "`code`", "[[A|b]]", "```x\ny```", " ", "  ", "日本。", "1. one", "| a | b |", "**bold.**", "é", "\r\n", "![i](u)", "[l](u)"])


@settings(max_examples=300, deadline=None)
@given(st.lists(bits, max_size=80), st.integers(1, 12), st.integers(0, 15))
def test_pieces_hold_the_whole_text(parts, size, overlap):
    text = " ".join(parts)
    words, _, _ = split.words_of(text)
    got = split.split(text, size, overlap)
    shared = min(overlap, size - 1)
    assert got[0]["start"] == 0 and got[-1]["end"] == len(words)
    assert got[0]["start_char"] == 0 and got[-1]["end_char"] == len(text)
    for p in got:
        assert p["end"] - p["start"] <= size and p["text"].split() == words[p["start"] : p["end"]]
    for a, b in zip(got, got[1:], strict=False):
        assert b["start"] == a["end"] - shared and b["end"] > a["end"] and b["start_char"] == a["end_char"]
    assert (len(got) > 1) == (len(words) > size)


@settings(max_examples=200, deadline=None)
@given(st.lists(bits, max_size=80), st.integers(2, 12), st.integers(0, 4))
def test_natural_ends_where_there_is_one(parts, size, overlap):
    text = " ".join(parts)
    words, first, last = split.words_of(text)
    levels = split.ends(text, words, first, last)
    done = min(overlap, size - 1)
    for p in split.split(text, size, overlap)[:-1]:
        places = [e for e in range(done + 1, p["start"] + size + 1) if levels[e - 1] >= split.SENTENCE]
        assert p["ends_with"] >= split.SENTENCE or not places
        done = p["end"]


def test_words_are_those_of_the_column(spark):
    texts = ["a\u00A0b\u2003c", "# h\n## i\n`x y` [[T#p|s]] [l](u) ![a](b)", "```\nz\n```", "", "a_b*c~d|e-f>g", TEXT, "x\r\n# y\r\n", "[[a]] [[b|c]]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", split_words(F.col("t")).alias("w")).collect():
        assert split.words_of(r.t)[0] == r.w


def test_the_valley_is_chosen():
    cats, ships = "Cats like fish and milk. " * 6, "Ships sail past the harbour. " * 6
    got = split.split(cats + ships, 45, 0)
    assert got[0]["end"] == 30


def test_abbreviations_do_not_end():
    words, first, last = split.words_of("Ask Dr. Who, e.g. Today. Then J. Doe went. Next")
    at = split.ends("Ask Dr. Who, e.g. Today. Then J. Doe went. Next", words, first, last)
    assert [w for w, e in zip(words, at, strict=False) if e >= split.SENTENCE] == ["Today.", "went."]


def test_rows(spark):
    docs = spark.createDataFrame([(1, 7, TEXT), (1, 7, TEXT), (2, 0, None), (3, None, "  "), (4, 99, "a b c d e f g"), (None, 7, "x"), (5, 8, "long " * 40_000)], "doc_no bigint, vault_id int, content string").withColumn("text", F.lit("clash")).withColumn("size", F.lit(1))
    configs = spark.createDataFrame([(0, 5, 2), (7, 10, None), (8, None, -3), (None, 1, 1)], "vault_id int, chunk_size_words int, chunk_overlap_words int")
    rows = split.pieces(docs, configs).collect()
    one = [r for r in rows if r.doc_no == 4]
    assert [(r.start_word, r.end_word) for r in one] == [(0, 5), (3, 7)]
    assert [(r.text, r.pieces) for r in rows if r.doc_no in (2, 3)] == [("", 1), ("", 1)]
    assert sum(r.doc_no == 1 for r in rows) % 2 == 0 and max(r.end_word - r.start_word for r in rows if r.doc_no == 1) <= 10
    assert [r.text for r in rows if r.doc_no is None] == ["x"]
    assert sum(r.doc_no == 5 for r in rows) == 8_000
    assert split.pieces(docs.limit(0), configs).count() == 0
    assert split.pieces(docs.where("doc_no = 4"), configs.limit(0)).count() == 1
