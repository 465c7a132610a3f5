import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamline.llm import names

ABOUT = names.Words()


@pytest.mark.parametrize(
    ("name", "words", "sure", "short", "given"),
    [
        ("Robert Tamiluk", "robert tamiluk", False, False, None),
        ("TAMILUK, Robert", "robert tamiluk", True, False, "robert"),
        ("Tamiluk, R.", "r tamiluk", True, True, None),
        ("@robert.tamiluk", "robert tamiluk", True, False, "robert"),
        ("people/xavier-tamiluk", "xavier tamiluk", True, False, "xavier"),
        ("Xavier J. Tamiluk", "xavier j tamiluk", False, True, "xavier"),
        ("RJ Tamiluk", "rj tamiluk", False, True, None),
        ("Dr. Zoë Tamiluk", "zoe tamiluk", True, False, "zoe"),
        ("Łucja Tamiluk", "lucja tamiluk", False, False, None),
        ("The Orvadek C. Inst.", "orvadek c inst", False, True, None),
        ("Orvadek Coastal Institute, Inc.", "orvadek coastal institute", True, False, None),
        ("org/orvadek-dept-of-works", "orvadek dept of works", True, False, None),
    ],
)
def test_reading(name, words, sure, short, given):
    n = names.read(name, ABOUT)
    assert (" ".join(n.words), n.sure, n.short, n.given) == (words, sure, short, given)


@pytest.mark.parametrize("name", [None, "", "  ", "--", "@"])
def test_names_without_words(name):
    assert names.read(name, ABOUT) is None


@pytest.mark.parametrize(
    ("a", "b", "least", "most"),
    [
        ("tamiluk", "tamiluk", 1, 1), ("robert", "bob", 0.9, 1), ("robert", "bobb", 0.8, 1), ("tamiluk", "tamilluk", 0.8, 0.95), ("tamiluk", "tmailuk", 0.8, 0.95),
        ("r", "robert", 0.5, 0.9), ("r", "bob", 0.5, 0.9), ("b", "bob", 0, 0), ("rj", "robert", 0.5, 0.9), ("institute", "inst", 0.9, 1), ("hsptl", "hospital", 0.7, 0.9),
        ("tom", "tim", 0, 0), ("tamiluk", "vexoran", 0, 0), ("41", "42", 0, 0), ("2", "23", 0, 0),
    ],
)
def test_words(a, b, least, most):
    assert least <= ABOUT.alike(a, b) <= most and ABOUT.alike(a, b) == ABOUT.alike(b, a)


@pytest.mark.parametrize(
    ("a", "b", "link"),
    [
        ("robert tamiluk", "tamiluk robert", names.STRONG), ("roberttamiluk", "robert tamiluk", names.STRONG), ("roberttamiluk", "bob tamiluk", names.STRONG),
        ("orvadek departmento f works", "orvadek department of works", names.STRONG), ("orvadek coastalinstitute", "orvadek coastal inst", names.STRONG),
        ("robert j tamiluk", "robert tamiluk", names.STRONG), ("r tamiluk", "robert tamiluk", names.PARTIAL), ("orvadek c institute", "orvadek coastal institute", names.PARTIAL),
        ("tamiluk", "robert tamiluk", names.BARE), ("tamilluk", "robert tamiluk", names.BARE_SLIP), ("robert", "robert tamiluk", None), ("institute", "orvadek institute", None),
        ("robert james tamiluk", "robert tamiluk", names.MIDDLE), ("robert tamiluk", "susan tamiluk", None), ("orvadek coastal institute", "orvadek coastal museum", None),
        ("r tamiluk", "s tamiluk", None), ("release plan 2 3", "release plan 2 4", None),
    ],
)
def test_comparing(a, b, link):
    common = {"robert": 4.0, "susan": 4.0, "james": 4.0, "coastal": 4.0, "institute": 3.0, "inst": 4.0, "museum": 3.0, "of": 3.0, "works": 3.0, "release": 3.0, "plan": 3.0}
    x, y = a.split(), b.split()
    weights = {w: common.get(w, 7.0) for w in x + y}
    got = [ABOUT.compare(x, y, weights), ABOUT.compare(y, x, weights)]
    assert [g and g[0] for g in got] == [link, link]


def test_names_of_very_many_words():
    long_ = [f"w{i}" for i in range(3_000)]
    assert ABOUT.compare(long_, long_[::-1], dict.fromkeys(long_, 5.0))[0] == names.STRONG


word = st.text("abcdr", min_size=0, max_size=8)


@settings(max_examples=300)
@given(word, word)
def test_near(a, b):
    slips = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abcdr"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abcdr"} | {a[:i] + a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :] for i in range(len(a) - 1)} | {a}
    assert names.near(a, b) == (b in slips)


def test_the_prefix_filter_loses_nothing(spark):
    """The join gives the very pairs that a comparison of all names gives."""
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdekotr") for _ in range(n))
    given_ = [some(5) for _ in range(6)]
    forms = {f"{rng.choice(given_)} {some(rng.randint(2, 8))}" for _ in range(120)}
    forms |= {f"{rng.choice(given_)} {f.split()[1]}" for f in list(forms)[:40]} | {f.split()[1] for f in list(forms)[:20]} | {"a", "a b"}
    df = spark.createDataFrame(list(enumerate(sorted(forms))), "id bigint, form string")
    rows = names.weighed(df, len(forms)).collect()
    heft = lambda codes: sum(c & (1 << 20) - 1 for c in codes)
    want = set()
    for x, y in combinations(rows, 2):
        x, y = sorted((x, y), key=lambda r: (heft(r.codes), r.id))
        if heft(set(x.codes) & set(y.codes)) >= names.SHARED * heft(x.codes):
            want.add((x.id, y.id))
    got = {tuple(r) for r in names.candidates(names.weighed(df, len(forms))).collect()}
    assert got == want and want


def forms_of(spark, forms):
    return names.weighed(spark.createDataFrame(list(enumerate(sorted(forms))), "id bigint, form string"), len(forms))


def of_syllables(rng, n):
    return "".join(rng.choice("bdgklmtv") + rng.choice("aeiou") for _ in range(n)) + rng.choice(["fem", "gan"])


def test_marks_lose_no_link(spark):
    """Of all names, those that have enough in common and are linked meet by their marks."""
    rng = random.Random(7)
    slip = lambda w: (lambda i: rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :]]))(rng.randrange(len(w)))
    forms = set()
    for _ in range(30):
        g, h, s = rng.choice(["robert", "bob", "rob", "susan", "elizabeth", "beth"]), rng.choice(["james", "anna"]), of_syllables(rng, rng.randint(1, 3))
        forms |= {f"{g} {s}", f"{s} {g}", f"{g}{s}", f"{g}{slip(s)}", f"{g} {h} {s}", f"{g[0]} {s}", f"{g} {s[0]}", f"{g} {h[0]} {s}", f"{g[0]} {h} {s}", f"{g[:1]}{h[:1]} {s}", f"{slip(g)} {s}", f"{g} {slip(s)}", s, slip(s)}
        q, k = rng.choice(["northern", "coastal", "of works"]), rng.choice(["hospital", "hosp", "hsptl", "institute", "instiute", "dept"])
        forms |= {f"{s} {q} {k}", f"{s} {q}{k}", f"{s}{q} {k}", f"{s} {q[0]} {k}", f"{slip(s)} {q} {k}", f"{s} {slip(q).strip()} {k}", f"{s} {k}", f"{k} {s} {q}"}
    forms |= {"r tobert", "robert t", "anna smithjones", "anna maria smith jones", "r tamiluk jones", "robert t jones", "w " * 4 + "tamiluk", "a", "a b", "q1 goals", "q2 goals", "x" * 60 + " y", "x" * 29 + "z" + "x" * 30 + " y"}
    rows = forms_of(spark, {" ".join(f.split()) for f in forms}).cache()
    heft = lambda codes: sum(c & (1 << 20) - 1 for c in codes)
    want = set()
    for x, y in combinations(rows.collect(), 2):
        x, y = sorted((x, y), key=lambda r: (r["all"], r.id))
        if heft(set(x.codes) & set(y.codes)) >= names.SHARED * x["all"] and ABOUT.compare(x.words, y.words, dict(zip(x.words + y.words, x.weights + y.weights, strict=True))):
            want.add((x.id, y.id))
    got = {tuple(r) for r in names.candidates(names.marked(rows, ABOUT)).collect()}
    every = {tuple(r) for r in names.candidates(rows).collect()}
    assert len(want) > 1_000 and got <= every and not want - got


def test_names_of_few_syllables(spark, monkeypatch):
    """Names that share given names and syllables aren't compared for that: their comparisons grow as the names."""
    rng, met = random.Random(5), []
    plain = names.compared
    monkeypatch.setattr(names, "compared", lambda pairs, rows, about: met.append(pairs.count()) or plain(pairs, rows, about))
    rows = [(i, "link", f"{rng.choice(['Robert', 'Susan', 'Elizabeth'])} {of_syllables(rng, 3)}") for i in range(1_500)]
    df = spark.createDataFrame(rows, "entity_no bigint, entity_type string, name string")
    assert names.spellings(df).count() == 1_500
    assert met[0] < 10 * 1_500


@pytest.mark.parametrize("long_", ["tamiluk", "a" * 20 + "tamiluk" * 3, "tamiluk" * 30])
def test_texts_one_slip_apart_have_a_key_in_common(long_):
    for i in range(len(long_)):
        for other in (long_[:i] + long_[i + 1 :], long_[:i] + "x" + long_[i:], long_[:i] + "x" + long_[i + 1 :], long_[:i] + long_[i + 1 : i + 2] + long_[i] + long_[i + 2 :]):
            assert names.slips(long_) & names.slips(other)


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(90)] + [("x", "y"), ("z", "y"), ("q", "q")]
    got = {r.id: r.label for r in names.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(91)} == {"n000"} and {got[k] for k in "xyz"} == {"x"}
    assert names.components(spark.createDataFrame(edges, "a string, b string").limit(0)).count() == 0


def test_components_that_have_not_settled(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(30)], "a string, b string")
    with pytest.raises(RuntimeError):
        names.components(edges, 1)
    assert {r.label for r in names.components(edges).collect()} == {"n000"}


def linked(spark, typed, about=None):
    rows = [(i, k, n) for i, (k, n) in enumerate(typed)]
    df = spark.createDataFrame(rows + rows[:2], "entity_no bigint, entity_type string, name string").withColumn("entity", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("form", F.lit(None).cast("string"))
    return {tuple(r) for r in names.spelling_pairs(df, about).collect()}


def pairs_of(*sets):
    return {(a, b) for s in sets for a in s for b in s if a < b}


TYPED = [
    ("link", "Robert Tamiluk"), ("tag", "people/bob-tamiluk"), ("link", "Tamiluk, R."), ("link", "Robert Tamilluk"), ("tag", "tamiluk"),
    ("link", "Susan Vexoran"), ("link", "Thomas Vexoran"), ("link", "S. Vexoran"), ("tag", "vexoran"), ("link", "T Vexoran"),
    ("link", "Orvadek Coastal Institute"), ("tag", "org/orvadek-coastal-inst"), ("link", "Orvadek Coastal Museum"), ("link", "Orvadek C. Institute"), ("tag", "orvadek"),
    ("link", "Reading Queue"), ("tag", "reading"), ("folder", "Robert Tamiluk"), ("link", None), ("link", ""), (None, "Robert Tamiluk"), ("link", "Release Plan 2.3"), ("link", "Release Plan 2.4"),
]


def test_links(spark):
    assert linked(spark, TYPED) == pairs_of({0, 1, 2, 3, 4}, {5, 7}, {6, 9}, {10, 11, 13})


def test_links_without_the_list_of_short_forms(spark):
    """The list only adds: without it the join finds all but the pairs of Bob, who would need it, and those of the surname that is then of two."""
    assert linked(spark, TYPED, names.Words(nick={})) == pairs_of({0, 2, 3}, {5, 7}, {6, 9}, {10, 11, 13})


def test_links_come_from_the_join(spark, monkeypatch):
    """Without candidates, only names of the same words in the same order are linked."""
    monkeypatch.setattr(names, "candidates", lambda rows: rows.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    assert linked(spark, [*TYPED, ("tag", "robert-tamiluk")]) == {(0, len(TYPED))}


def test_links_of_names_that_no_list_has(spark):
    typed = [
        ("link", "Xavier Tamiluk"), ("link", "Xavier Tamilluk"), ("link", "X. Tamiluk"),
        ("link", "Richard Wood"), ("link", "Rihcard Wood"),
        ("tag", "people/anna-smith-jones"), ("link", "Anna Smith-Jones"), ("link", "Maria del Carmen Ruiz"), ("tag", "maria-del-carmen-ruiz"), ("link", "Ruiz, Maria del Carmen"),
        ("link", "Robert Oldacre"), ("link", "Robert James Oldacre"),
        ("link", "Blue Harbor"), ("link", "Blue Harbo"), ("link", "Ulrik Vexoran"), ("link", "Vexoran, Ulrik"),
        ("link", "Open Loops"), ("tag", "open-loops"), ("tag", "open-loop"), ("link", "Winter Garden"), ("link", "Winter Garden"),
        # Initials fit forms that slips have parted, and names without blanks.
        ("link", "Orvadek Northern Hospital"), ("link", "Orvadek Nothern Hospital"), ("link", "Orvadek N. Hospital"), ("link", "Robert James Kastugan"), ("link", "Robert Jmaes Kastugan"), ("link", "Robert Kastugan"),
        ("tag", "zacharydamuplo"), ("link", "Zach Damuplo"), ("tag", "damuplo"), ("tag", "brizetol-coastalinstitute"), ("link", "Brizetol Coastal Inst."),
    ]
    assert linked(spark, typed) == pairs_of({0, 1, 2}, {3, 4}, {5, 6}, {7, 8, 9}, {10, 11}, {12, 13}, {14, 15}, {21, 22, 23}, {24, 25, 26}, {27, 28, 29}, {30, 31})


def test_given_names_are_learnt(spark):
    """However many there are; a name typed as a person shows which word it is, and then others with it are of persons."""
    letters = lambda n: "".join("bcdfghklmnprstvz"[n // 16**i % 16] + "aeiou"[n // 16**i % 5] for i in range(4)) + "q"
    rows = [(2 * n, "link", f"Vexoran, {letters(n).title()}") for n in range(3_000)] + [(2 * n + 1, "link", f"{letters(n)} {letters(n + 4_000)}") for n in range(3_000)]
    got = names.spellings(spark.createDataFrame(rows, "entity_no bigint, entity_type string, name string"))
    assert got.where("entity_no % 2 = 1").count() == 3_000


def test_no_names(spark):
    df = spark.createDataFrame([], "entity_no bigint, entity_type string, name string")
    assert names.spelling_pairs(df).isEmpty()
    assert names.spelling_pairs(spark.createDataFrame([(1, "link", "Open Loops")], df.schema)).count() == 0


def test_a_name_that_a_third_have(spark):
    """Three hundred records of one name are one form; a surname of a third of all names is compared with no more names for that."""
    odd = F.translate(F.substring(F.sha1(F.col("id").cast("string")), 1, 12), "0123456789", "ghklmnoprs")
    df = spark.range(900).select(F.col("id").alias("entity_no"), F.lit("link").alias("entity_type"), F.when(F.col("id") < 300, F.lit("Robert Tamiluk")).when(F.col("id") < 600, F.concat(odd, F.lit(" Vexoran"))).otherwise(F.concat(F.lit("Susan "), odd)).alias("name"))
    got = names.spellings(df).groupBy("entity").count().orderBy(F.desc("count")).first()
    assert got["count"] == 300
    forms = df.select(F.lower("name").alias("form")).distinct().withColumn("id", F.monotonically_increasing_id())
    assert names.candidates(names.weighed(forms, 601)).count() < 3_000
