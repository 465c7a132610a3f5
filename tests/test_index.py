import math

import pytest
from pyspark.sql import functions as F

from loamline.config import IndexConfig, read_config
from loamline.functions import vectors as V
from loamline.operators import corpus, embed, weights
from loamline.plans import index as I
from loamline.plans import store, vault
from tests.notes import AS_OF, TARGET, VAULT, write


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return write(tmp_path_factory.mktemp("vault"), VAULT)


@pytest.fixture(scope="module")
def index(spark, root):
    return vault.index_vault(spark, root, as_of=AS_OF)


def test_stats(index):
    assert I.stats(index) == {"documents": 3, "chunks": 3, "entities": 11, "probes": 44, "embedding_dimensions": 384}
    assert index.generated_at == "2025-12-31T00:00:00.000Z"


def test_documents(index):
    rows = {r.relative_path: r for r in index.documents.collect()}
    assert rows["garden/beds/layout.md"].entities == ["folder:.", "folder:garden", "folder:garden/beds", "link:Frost Dates", "link:Seed List", "tag:beds", "tag:soil"]
    assert rows["garden/beds/review.md"].tags == ["beds", "yearly"]
    assert rows["kitchen/bread.md"].title == "Overnight Bread"


def test_entity_order(index):
    """Equal scores keep the order in which the entities were met."""
    rows = index.entities.orderBy("entity_pos").collect()
    assert [r.entity_id for r in rows[:6]] == ["folder:.", "folder:garden", "folder:garden/beds", "tag:beds", "tag:yearly", "folder:kitchen"]
    assert round(rows[0].score, 6) == round(2 * 3 + 3 + 1.5 * 3 + 2 * math.exp(-math.log(2) * 291 / 180), 6)
    assert {r.activity_trend for r in rows} == {"stable"} and all(len(r.probe_ids) == 4 for r in rows)


def test_idf(index):
    rows = {r.term: r.idf for r in index.idf.collect()}
    assert round(rows["dough"], 6) == 1.693147 and round(rows["gravel"], 6) == 1.287682


def test_vectors_have_length_one(index):
    for table, key, w in ((weights.as_rows(index.vectors, "chunk_id"), "chunk_id", "weight"), (index.probe_terms, "probe_id", "weight")):
        assert all(abs(r.n - 1) < 1e-9 for r in table.groupBy(key).agg(F.sum(F.col(w) * F.col(w)).alias("n")).collect())


def test_ask(spark, root, index):
    hits, matched = vault.ask_vault(spark, root, "how does the bread dough rise overnight, and what became of the gravel?", limit=2, as_of=AS_OF)
    rows = hits.collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0].title == "Overnight Bread" and rows[0].probe_ids
    assert matched.count() == 5
    longer = vault.ask_vault(spark, root, "how does the bread dough rise overnight, and what became of the gravel?", limit=3, as_of=AS_OF)[0].collect()
    assert [r.chunk_id for r in longer[:2]] == [r.chunk_id for r in rows]


def test_ask_for_nothing(spark, index):
    hits, _ = I.ask(index, "zzzz", AS_OF)
    assert all(r.score > 0 for r in hits.collect())


def test_json_and_summary(spark, root, index):
    hits, matched = vault.ask_vault(spark, root, "compost and gravel", as_of=AS_OF)
    assert '"probes":[{"entity"' in vault.results_json(hits, matched, "compost and gravel", str(root)).first().json
    assert vault.summary(hits).startswith("1. ") and vault.summary(hits.limit(0)) == "No matching notes found."
    assert '"stats":{"documents":3' in vault.inspect_json(index).first().json


def test_inspect(index):
    found, known = I.inspect(index, "")
    assert found.count() == 24 and known.count() == 11
    found, known = I.inspect(index, "compost and gravel")
    assert found.count() == 20 and 1 <= known.count() <= 12
    places = [(r.entity_pos, r.ordinal) for r in found.collect()]
    assert places == sorted(places)


def test_apply(spark, root, index, tmp_path):
    target = write(tmp_path / "other", TARGET)
    entry = vault.apply_corpus(spark, root, target, as_of=AS_OF)
    again = vault.apply_corpus(spark, root, target, as_of=AS_OF)
    assert entry["doc_count"] == 1 and again["id"] == entry["id"]
    loaded = vault.load_index(spark, root)
    assert len(loaded.targets) == 1
    hits, _ = vault.ask_vault(spark, root, "garlic and broad beans", target="other", as_of=AS_OF)
    assert hits.first().title == "Autumn Planting"
    with pytest.raises(LookupError):
        vault.ask_vault(spark, root, "x", target="nowhere")
    # The registry outlives a new index.
    assert len(vault.refresh_vault(spark, root, as_of=AS_OF).targets) == 1


def test_other_embedding_is_refused(spark, root, index, tmp_path):
    with pytest.raises(ValueError, match="embedded otherwise"):
        vault.apply_corpus(spark, root, write(tmp_path / "t", TARGET), {"embedding_dimensions": 64}, as_of=AS_OF)


def test_rows_in_any_order(spark, index, root):
    from loamline.sources import vault as source

    raw = source.read(spark, str(root)).orderBy(F.desc("relative_path")).repartition(3)
    made = I.build(raw, AS_OF, index.config)
    assert sorted(made.probes.select("probe_id").collect()) == sorted(index.probes.select("probe_id").collect())
    assert sorted(made.links.select("probe_id", "chunk_id", "rank").collect()) == sorted(index.links.select("probe_id", "chunk_id", "rank").collect())


def test_empty_corpus(spark, tmp_path):
    (tmp_path / "v").mkdir()
    made = vault.index_vault(spark, tmp_path / "v", as_of=AS_OF)
    assert I.stats(made)["documents"] == 0
    hits, matched = I.ask(made, "anything", AS_OF)
    assert hits.count() == 0 and matched.count() == 0


def test_null_and_blank_notes(spark):
    raw = spark.createDataFrame([("a.md", None), ("b.md", "  "), ("c.md", "words here"), (None, "lost"), ("d.md", "```\nonly code\n```")], "p string, t string")
    now = F.lit("2025-01-01").cast("timestamp")
    docs = corpus.documents(corpus.from_dataframe(raw, F.col("p"), F.col("t"), now, now)).collect()
    assert [d.relative_path for d in docs] == ["c.md"]


def test_max_files_before_empty_ones_go(spark):
    raw = spark.createDataFrame([("a.md", ""), ("b.md", "x y"), ("c.md", "z")], "p string, t string")
    now = F.lit("2025-01-01").cast("timestamp")
    docs = corpus.documents(corpus.from_dataframe(raw, F.col("p"), F.col("t"), now, now), IndexConfig(max_files=2)).collect()
    assert [d.relative_path for d in docs] == ["b.md"]


def test_scores(spark):
    t = spark.sql("select array(1d, 0d) as a, array(0d, 2d) as b, array(0d, 0d) as z, array(1d) as s, array(2d, 0d) as c")
    r = t.select(*[V.dense_cosine(F.col("a"), F.col(x)).alias(x) for x in "bzsc"], V.combined(F.lit(0.0), F.lit(0.3)).alias("sparse"), V.combined(F.lit(-0.5), F.lit(0.3)).alias("neg"), V.link_score(F.lit(-0.1), F.lit(0.9)).alias("link"), V.fused(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("none")).first()
    assert (r.b, r.z, r.s, r.c, r.sparse, r.neg, r.link, r.none) == (0, 0, 0, 1, 0.3, 0.3, -0.1, 0)


def test_hash_vectors_agree_with_columns(spark):
    rows = spark.createDataFrame([(1, ["alpha", "beta", "alpha"]), (2, []), (3, None)], "id int, tokens array<string>")
    got = {r.id: r.embedding for r in embed.HashEmbedder(IndexConfig()).embed_tokens(rows, "tokens").collect()}
    slots = spark.createDataFrame([("alpha", 2), ("beta", 1)], "t string, n int").select("n", V.hash_slot(F.col("t"), 384).alias("s"), V.hash_sign(F.col("t")).alias("g")).collect()
    want = [0.0] * 384
    for r in slots:
        want[r.s] += r.n * r.g / math.sqrt(5)
    assert all(abs(a - b) < 1e-12 for a, b in zip(got[1], want, strict=True)) and not any(got[2]) and not any(got[3])


def test_model_backend(spark):
    config = IndexConfig(embedding_backend="model", embedding_batch_size=2)

    def load(_name):
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")
    got = embed.embedder(config, load).embed(rows, "text", "passage").orderBy("id").collect()
    assert abs(got[0].embedding[0] - 2 / math.sqrt(5)) < 1e-12 and got[1].embedding == [0.0, 1.0]
    with pytest.raises(ValueError, match="loads the model"):
        embed.embedder(config)
    with pytest.raises(ValueError, match="backend"):
        IndexConfig(embedding_backend="other")


def test_ranking_ties_and_limit(spark):
    counts = spark.createDataFrame([("k", "b", 2), ("k", "a", 2), ("k", "c", 5), ("l", "z", 1)], "k string, term string, tf int")
    assert [(r.k, r.term) for r in weights.top_terms(counts, ["k"], 2).orderBy("k", "rank").collect()] == [("k", "c"), ("k", "a"), ("l", "z")]


def test_store_paths_and_targets(tmp_path):
    assert store.store_path(tmp_path).name == ".loamline"
    assert read_config(store.config_path(tmp_path)) == IndexConfig()
    store.save_config(tmp_path, IndexConfig(max_results=3))
    assert store.load_config(tmp_path).max_results == 3
    targets = store.upsert_target([], {"id": "1", "path": "/b/x"})
    targets = store.upsert_target(targets, {"id": "2", "path": "/a/y"})
    assert [t["id"] for t in targets] == ["2", "1"]
    assert [store.find_target(targets, w) is not None for w in ("1", "/b/x", "x", "z")] == [True, True, True, False]


def test_rare_terms_get_their_weights_by_a_join(spark, index):
    """The same vectors whether the weights of all terms go to the tasks or only those of a few."""
    rows = index.chunks.select("chunk_id", "tokens")
    as_set = lambda df: {(r.chunk_id, r.term, round(r.weight, 12)) for r in weights.as_rows(df, "chunk_id").collect()}
    want = as_set(weights.with_vector(rows, index.idf, "chunk_id", index.max_idf))
    assert want and as_set(weights.with_vector(rows, index.idf, "chunk_id", index.max_idf, frequent=5)) == want
    long = weights.tfidf(weights.term_counts(rows, "chunk_id"), index.idf, "chunk_id")
    assert {(r.chunk_id, r.term, round(r.weight, 12)) for r in long.collect()} == want
    odd = spark.createDataFrame([("x", None), ("y", []), ("z", ["unheard", "unheard"])], "chunk_id string, tokens array<string>")
    assert as_set(weights.with_vector(odd, index.idf, "chunk_id", index.max_idf)) == {("z", "unheard", 1.0)}


def test_no_shuffle_carries_texts_or_vectors(spark, index):
    """With and without broadcast joins: the vectors of passages are made in one pass of their rows."""
    plan = I.vectors_of(index.chunks, index.idf, index.max_idf, embed.embedder(index.config))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_links_send_few_rows(spark):
    """A task sends its best rows of a question; rows without a word in common, of which there are many, are none."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(4_000, 8)) * (rng.random((4_000, 1)) > 0.5)
    rows = spark.createDataFrame([(str(i), [float(v) for v in r], {"t": 0.5} if i % 1_000 == 0 else {"u": 1.0}, ["a"] if i % 2 else ["a", "b"]) for i, r in enumerate(x)], "chunk_id string, embedding array<double>, vector map<string,double>, entities array<string>").coalesce(1)
    q = rng.normal(size=(3, 8))
    asked = embed.Asked(["p", "q", "z"], [*q[:2].tolist(), [0.0] * 8], ["a", "b", "a"], [{"t": 1.0}, {}, {"t": 1.0}])
    got = embed.best_rows(rows, asked, ["chunk_id"], 5).collect()
    assert len(got) < 300
    with np.errstate(invalid="ignore"):
        cosine = np.nan_to_num(q @ x.T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1))
    for i, (k, step) in enumerate((("p", 1), ("q", 2))):
        best = sorted(((round(r.score, 9), r.chunk_id) for r in got if r.probe_id == k), reverse=True)[:5]
        assert [s for s, _ in best] == [round(v, 9) for v in sorted(cosine[i][::step], reverse=True)[:5]]
    assert {(r.chunk_id, r.score) for r in got if r.probe_id == "z"} == {(str(i), 0.5) for i in range(0, 4_000, 1_000)}
