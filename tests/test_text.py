import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamline.functions import text as X


@pytest.mark.parametrize(
    ("text", "bare"),
    [
        ("a ```x\ny``` b", "a b"),
        ("`code` here", "code here"),
        ("![alt](x.png) [label](url)", "label"),
        ("[[Target#part|shown]] [[Plain]]", "shown Target Plain"),
        ("# Head\n## Next\ntext", "Head Next text"),
        ("*a* _b_ ~c~ > d | e - f", "a b c d e f"),
        ("a\u00A0b\u2003c\uFEFFd", "a b c d"),
        ("", ""),
        ("  \n ", ""),
        ("x\u2028# y", "x y"),
    ],
)
def test_strip(one, text, bare):
    assert one(X.strip_markdown, text) == bare


@pytest.mark.parametrize(
    ("word", "stem"),
    [("this", "thi"), ("notes", "not"), ("studied", "study"), ("being", "being"), ("running", "runn"), ("boxes", "box"), ("used", "used"), ("gas", "gas"), ("cats", "cat"), ("wanted", "want")],
)
def test_stem(one, word, stem):
    assert one(X.stem, word) == stem
    assert X.stem_word(word) == stem


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("this", ["thi"]),
        ("notes", []),
        ("memory", ["memory", "recall", "context", "knowledge", "not"]),
        ("constructor", ["constructor"]),
        ("café don't", ["caf", "dont"]),
        ("a I x", []),
        ("", []),
        (None, None),
    ],
)
def test_tokenize(one, text, tokens):
    assert one(X.tokenize, text) == tokens


def test_no_aliases(one):
    assert one(lambda c: X.tokenize(c, aliases=False), "memory search") == ["memory", "search"]


@pytest.mark.parametrize(("words", "pieces"), [(0, 1), (1, 1), (260, 1), (261, 2), (472, 2), (473, 3)])
def test_windows(one, words, pieces):
    got = one(lambda c: X.chunk_windows(c, 260, 48), " ".join(f"w{i}" for i in range(words)))
    assert len(got) == pieces


def test_overlap_not_below_size(one):
    got = one(lambda c: X.chunk_windows(c, 2, 5), "a b c d")
    assert got == ["a b", "b c", "c d"]


@settings(max_examples=25, deadline=None)
@given(n=st.integers(0, 60), size=st.integers(1, 20), overlap=st.integers(0, 25))
def test_windows_cover(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    got = spark.createDataFrame([(" ".join(words),)], "x string").select(X.chunk_windows(F.col("x"), size, overlap).alias("y")).first().y
    step = max(1, size - overlap)
    assert [p.split() for p in got] == ([words] if n <= size else [words[i : i + size] for i in range(0, n, step) if i == 0 or i - step + size < n])


@pytest.mark.parametrize(("n", "length"), [(900, 900), (901, 902)])
def test_snippet(one, n, length):
    got = one(X.snippet, "x" * n)
    assert len(got) == length and got.endswith("...") == (n > 900)


def test_phrases(one):
    phrases = lambda c: X.phrases_of(X.tokenize(c, aliases=False))
    assert one(phrases, "alpha beta gamma") == ["alpha beta", "beta gamma", "alpha beta gamma"]
    assert one(phrases, "alpha") == []
