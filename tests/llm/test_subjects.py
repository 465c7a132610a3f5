import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import subjects

OWN = {
    "cooking": "oven dough sauce pepper onion whisk simmer broth".split(),
    "law": "court clause verdict appeal tenant statute plaintiff lawyer".split(),
    "sailing": "anchor harbour sail rudder keel mast jib tide".split(),
}
OTHER = ["Nothing was decided today.", "The train was late again.", "We met on Monday.", "Ask about the list.", "More on this later."]


def sentence(rng, s):
    a, b = rng.sample(OWN[s], 2)
    return rng.choice([f"The {a} depends on the {b}.", f"We looked at the {a} before the {b}.", f"Nobody knew the {b}, only the {a}."])


def corpus(seed, n):
    rng, rows, truth = random.Random(seed), [], set()
    for i in range(n):
        main = rng.choice([*OWN, None])
        passing = rng.choice([*OWN, None, None])
        lines = [rng.choice(OTHER) for _ in range(rng.randint(2, 6))]
        count = {s: 0 for s in OWN}
        for s, k in ((main, rng.randint(3, 6)), (passing, rng.randint(1, 2))):
            if s and not (s == passing and s == main and k < 3):
                lines += [sentence(rng, s) for _ in range(k)]
                count[s] += k
        rng.shuffle(lines)
        rows.append((i, "# " + rng.choice(sum(OWN.values(), [])) + "\n\n" + " ".join(lines), rng.choice(["en", "en", "EN ", None])))
        truth |= {(i, s) for s, k in count.items() if k >= 3}
    return rows, truth


@pytest.fixture(scope="module")
def fitted(spark):
    rows, truth = corpus(11, 600)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    rng, labels = random.Random(12), []
    for i in range(0, 600, 3):
        own = [s for j, s in truth if j == i] or [None]
        labels.append((i, rng.choice(["sailing", "law"]) if rng.random() < 0.08 else rng.choice(own), rng.choice(["a", "b"])))
    labels = [(i, s.upper() if s and i % 2 else s, r) for i, s, r in labels]
    table = spark.createDataFrame(labels + labels[:9], "doc_id bigint, subject string, reader string")
    named = spark.createDataFrame([(s,) for s in OWN], "subject string")
    model, notes = subjects.fit(docs, table, named, topics=16, epochs=3, common=0.5)
    return docs, table, named, truth, model, notes


def test_held_out_accuracy(fitted):
    *_, truth, model, notes = fitted
    got = {(r.doc_id, r.subject) for r in subjects.counted_sentences(model, notes).where("sentences >= 3").collect()}
    new = {(i, s) for i, s in truth if i % 3}
    found = {(i, s) for i, s in got if i % 3}
    assert len(new & found) / len(new) > 0.95 and len(new & found) / len(found) > 0.95


def test_topics_hold_the_words_of_their_subjects(fitted):
    """The topics are learnt without judgements; those mapped to a subject have its words at the top, and every subject has one."""
    model = fitted[4]
    rows = [r for r in model.table(6) if r[1]]
    assert {r[1] for r in rows} == set(OWN)
    for _, s, share, terms in rows:
        assert share > subjects.PURE and len(set(terms) & set(OWN[s])) >= 3


def test_the_map_decides(fitted):
    """Without the map there are no subjects: nothing goes from judgements to notes beside it."""
    *_, model, notes = fitted
    none = subjects._model(model.terms, model.subjects, model.topics, model.share * 0, model.topics @ np.zeros((model.topics.shape[1], len(model.subjects))), model.topics.sum(1))
    assert subjects.counted_sentences(none, notes).where("sentences >= 3").count() == 0


def test_terms_are_not_limited_by_number(spark):
    """Every word that stands in enough notes is a term, in whatever language; the commonest of a language are not."""
    rows = [(i, f"the {w} and {w}x", lang) for i, (w, lang) in enumerate([(w, lang) for lang in ("en", "xx", "yy") for w in (f"{lang}{chr(97 + n // 26 % 26)}{chr(97 + n % 26)}" for n in range(300)) for _ in range(2)])]
    words = subjects.split_notes(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id")
    terms = {r.term for r in subjects.vocabulary(words, 2).collect()}
    assert len(terms) == 1_800 and not terms & {"the", "and"}


def test_composition(fitted):
    *_, model, notes = fitted
    rows = subjects.composition(subjects.counted_sentences(model, notes), notes).collect()
    assert {r.subject for r in rows} == set(OWN) and all(0 < r.note_share < 1 and 0 < r.sentence_share < 1 for r in rows)


def test_odd_notes(spark, fitted):
    docs, labels, named, *_ = fitted
    odd = spark.createDataFrame([(9_001, None, "en"), (9_002, "", None), (9_003, "  \n ", "en"), (None, "The court met the tenant.", "en"), (9_004, "The court heard the tenant. " * 20_000, "en"), (9_005, "日本語だけ。", "und")], docs.schema)
    got = subjects.subjects_of(docs.unionByName(odd).withColumn("key", F.lit("clash")).withColumn("l", F.lit(1)), labels, named, topics=16, epochs=3, common=0.5).where("doc_id > 9000").collect()
    assert {(r.doc_id, r.subject) for r in got} == {(9_004, "law")}


def test_nothing_to_go_by(spark, fitted):
    docs, labels, named, *_ = fitted
    assert subjects.subjects_of(docs.limit(0), labels, named, topics=8, epochs=1, common=0.5).count() == 0
    assert subjects.subjects_of(docs, labels.limit(0), named, topics=8, epochs=1, common=0.5).count() == 0
    assert subjects.subjects_of(docs, labels, named.limit(0), topics=8, epochs=1, common=0.5).count() == 0


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("# Title\n\nOne here. Two there!", ["one here", "two there"]),
        ("---\ntags: x\n---\nA b.", ["a b"]),
        ("- item one\n- item two", ["item one", "item two"]),
        ("| a b | c d |\n| --- | --- |", ["a b", "c d"]),
        ("Ask Dr. Who, e.g. now. Then go", ["ask dr who e g now", "then go"]),
        ("line goes\non here", ["line goes on here"]),
        ("```\ncode\n```\ntext #tag [[Link]]", ["text"]),
        ("00:03 first\n00:06 second", ["first", "second"]),
        ("", []),
        (None, []),
    ],
)
def test_sentences(text, words):
    assert [" ".join(s) for s in subjects.sentences(text)] == words


def test_runs_without_stops_are_cut_at_learnt_beginnings(spark):
    """A pair of words that begins sentences begins one within a run too, however long that is."""
    rows = [(i, "We met them again on a cold day. The court was late.", "en") for i in range(6)] + [(6, " ".join(["we met them again on a cold day", "the court was late"] * 600), "en"), (7, None, None)]
    words = subjects.split_notes(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id")
    starts = [(r.a, r.b) for r in subjects.beginnings(words, 5).collect()]
    assert set(starts) == {("we", "met"), ("the", "court")} or ("we", "met") not in starts
    notes = subjects.encode_notes(words, ["court", "day"], [("we", "met"), ("the", "court")], 4)
    got = {r.key: (r.sentences, len(r.lengths), len(r.ids), r.bag, r.times) for r in notes.collect()}
    assert got[6] == (1_200, 1_200, 1_200, [0, 1], [600, 600]) and got[0] == (2, 2, 2, [0, 1], [1, 1]) and got[7] == (0, 0, 0, [], [])


def test_proportions_are_those_of_the_plain_formula():
    """The blocks give what the loop over single notes gives."""
    rng = np.random.default_rng(3)
    words, alpha = rng.random((20, 4)).astype(np.float32), np.full(4, 0.1, np.float32)
    bags = [np.sort(rng.choice(20, n, replace=False)) for n in (1, 5, 20)]
    times = [rng.integers(1, 9, len(x)) for x in bags]
    gamma, _ = subjects.proportions(np.concatenate(bags), np.concatenate(times), np.array([1, 5, 20]), alpha, words, 5)
    digamma = lambda x: np.array([math.log(v + 50) - 0.5 / (v + 50) - 1 / (12 * (v + 50) ** 2) - sum(1 / (v + i) for i in range(50)) for v in x])
    for bag, n, got in zip(bags, times, gamma, strict=True):
        weight = 1 + np.log(n)
        g = alpha + weight.sum() / 4
        for _ in range(5):
            phi = np.exp(digamma(g)) * words[bag]
            g = alpha + (phi / phi.sum(1, keepdims=True) * weight[:, None]).sum(0)
        assert np.allclose(g, got, rtol=1e-3)


def test_a_model_of_small_blocks_is_the_same(fitted, monkeypatch):
    *_, model, notes = fitted
    want = {tuple(r) for r in subjects.counted_sentences(model, notes).collect()}
    monkeypatch.setattr(subjects, "HELD", 50)
    assert {tuple(r) for r in subjects.counted_sentences(model, notes).collect()} == want
