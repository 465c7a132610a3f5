import pytest
from pyspark.sql import functions as F

from loamline.functions import markdown as M
from loamline.functions import timefn as T


@pytest.mark.parametrize(
    ("raw", "block", "body"),
    [
        ("---\na: 1\n---\nbody", "a: 1", "body"),
        ("---\n---\nbody", None, "---\n---\nbody"),
        ("---\na: 1\n---", None, "---\na: 1\n---"),
        ("---\r\na: 1\r\n---\r\nb\r\nc", "a: 1", "b\nc"),
        ("plain\r\ntext", None, "plain\r\ntext"),
        ("\uFEFF---\na: 1\n---\nb", None, "\uFEFF---\na: 1\n---\nb"),
        ("", None, ""),
    ],
)
def test_frontmatter(one, raw, block, body):
    assert one(M.frontmatter_block, raw) == block
    assert one(M.body, raw) == body


@pytest.mark.parametrize(
    ("block", "values"),
    [
        ("tags: [a, 'b', \"c\" , ]", {"tags": (True, ["a", "b", "c"])}),
        ("tags:\n  - a\n\n  # note\n  - 'b'\nx: y", {"tags": (True, ["a", "b"]), "x": (False, ["y"])}),
        ("tags:\n  key: v\n  - a", {"tags": (True, [])}),
        ("Title: 'x", {"title": (False, ["x"])}),
        ("a: 1\na: 2", {"a": (False, ["2"])}),
        (" indented: 1", {}),
        ("- lone", {}),
        ("a: [x", {"a": (False, ["[x"])}),
    ],
)
def test_yaml(one, block, values):
    got = one(M.parse_yaml, block)
    assert {k: (v.is_list, list(v["values"])) for k, v in got.items()} == values


@pytest.mark.parametrize(
    ("body", "name", "title"),
    [("x\n# A title \n# B", "f.md", "A title"), ("#\n\nFoo", "f.md", "Foo"), ("## no", "my_note-1.md", "my note 1"), ("", "a.b.md", "a.b")],
)
def test_title(spark, body, name, title):
    assert spark.createDataFrame([(body, name)], "b string, n string").select(M.title(F.col("b"), F.col("n")).alias("t")).first().t == title


@pytest.mark.parametrize(
    ("body", "tags"),
    [("#café", ["caf"]), ("#x", []), ("#foo- bar", ["foo"]), ("#" + "a" * 70, []), ("a#no (#Yes) [#ok] #a/b_c-1", ["yes", "ok", "a/b_c-1"]), ("```\n#code\n```", ["code"]), ("\u00A0#nbsp", ["nbsp"]), ("# heading", [])],
)
def test_inline_tags(one, body, tags):
    assert one(M.inline_tags, body) == tags


@pytest.mark.parametrize(("body", "links"), [("[[ | ]]", []), ("[[A\nB]]", ["A B"]), ("[[A#h|b]] [[ C ]] [[#x]]", ["A", "C"])])
def test_links(one, body, links):
    assert one(M.wiki_links, body) == links


@pytest.mark.parametrize(("path", "folders"), [("n.md", ["."]), ("a/b/n.md", [".", "a", "a/b"]), ("a//n.md", [".", "a"])])
def test_folders(one, path, folders):
    assert one(M.folders, path) == folders


def test_entities(one):
    raw = "---\ntags: [Baking, slow-food]\n---\n# Bread\n\nMy #SourDough needs [[Old Oven|the oven]] and [[Rye  Flour]] #baking.\n"
    assert one(lambda c: M.tags_of(M.parse_yaml(M.frontmatter_block(c)), M.body(c)), raw) == ["baking", "slow-food", "sourdough"]
    assert one(lambda c: M.links_of(M.body(c)), raw) == ["Old Oven", "Rye Flour"]
    # One mark goes from the tag, one more from the id made of it.
    assert one(M.normalize_tag, " ##X ") == "#x"
    assert one(lambda c: M.entity_id("tag", M.normalize_tag(c)), "##X") == "tag:x"


def test_names(one):
    assert one(lambda c: M.display_name(M.entity_type(c), M.entity_name(c)), "folder:.") == "root folder"
    assert one(lambda c: M.display_name(M.entity_type(c), M.entity_name(c)), "link:A: b") == "[[A: b]]"
    with pytest.raises(Exception, match="unknown entity type"):
        one(M.entity_type, "person:x")


@pytest.mark.parametrize(
    ("typed", "iso"),
    [("2025-02-10", "2025-02-10T00:00:00.000Z"), ("2025-02", "2025-02-01T00:00:00.000Z"), ("2025", "2025-01-01T00:00:00.000Z"), ("Feb 10, 2025", "2025-02-10T00:00:00.000Z"), ("2025-02-10T01:02:03Z", "2025-02-10T01:02:03.000Z"), ("soon", None), ("", None)],
)
def test_dates(one, typed, iso):
    assert one(lambda c: T.iso(T.parse_date(c)), typed) == iso


@pytest.mark.parametrize(
    ("ages", "trend"), [([10, 20], "rising"), ([100], "active"), ([200], "stable"), ([400], "dormant"), ([], "stable"), ([10], "active"), ([1, 2, 100, 101, 102], "active")]
)
def test_trend(spark, ages, trend):
    from loamline.operators.entities import activity

    rows = spark.sql("select 'x' as k, timestamp '2025-01-01' - make_dt_interval(int(a)) as d from (select explode(array(" + ",".join(map(str, ages or [0])) + ")) as a)")
    got = activity(rows if ages else rows.limit(0), ["k"], "d", "2025-01-01 00:00:00").collect()
    if ages:
        assert got[0].trend == trend
    else:
        assert not got and spark.range(1).select(T.trend(F.lit(0), F.lit(0), F.lit(None).cast("double")).alias("t")).first().t == trend


def test_recency(spark):
    t = spark.sql("select timestamp '2030-01-01' as future, cast(null as timestamp) as none, timestamp '2024-07-05' as old")
    r = t.select(*[T.recency(F.col(c), 180, "2025-01-01 00:00:00").alias(c) for c in t.columns]).first()
    assert r.future == 1 and r.none == 1 and abs(r.old - 0.5) < 1e-9
    assert t.select(T.quarter_label(F.col("none")).alias("q")).first().q == "unknown"
