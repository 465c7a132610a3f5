"""Queries of the core: name -> (session, folder of the tables) -> rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.config import IndexConfig, read_config, write_config
from loamline.functions import markdown as M
from loamline.functions import text as X
from loamline.functions import timefn as T
from loamline.functions import vectors as V
from loamline.operators import corpus, embed, entities, probes, search, timestamps, weights
from loamline.plans import index as I
from loamline.plans import store, vault
from loamline.session import cores, cut, shared_dir, spread

AS_OF = "2025-12-31 00:00:00"
#: The corpus of the queries isn't a folder of files, so its size isn't limited.
CONFIG = IndexConfig(max_files=None)
#: Vectors that are asked for at once.
QUERY_BLOCK = 4_000
QUESTION = "how did the cache layer change after the release of the message queue?"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, raw of all documents; a null text is empty."""
    rows = spread(table(spark, folder, "documents").select("doc_id", "lang", "source", "text"))
    return rows.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("raw"))


def _path() -> Column:
    return F.concat(F.lower(F.coalesce("source", F.lit("loose"))), F.lit("/"), F.lower(F.coalesce("lang", F.lit("xx"))), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as raw notes: a path of source, language and number, and dates by number."""
    born = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("doc_id") % 720 * 86400)
    changed = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + (F.col("doc_id") % 720 + F.col("doc_id") % 30) * 86400)
    return corpus.from_dataframe(texts(spark, folder), _path(), F.col("raw"), born, changed)


_built: dict = {}


def built(spark: SparkSession, folder: str) -> I.Index:
    """The index of the documents, once for all queries of a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _built:
        _built[key] = I.build(notes(spark, folder), AS_OF, CONFIG)
    return _built[key]


# Text


def strip_markdown(spark, folder):
    return texts(spark, folder).select("doc_id", X.strip_markdown(F.col("raw")).alias("stripped"))


def word_count(spark, folder):
    return texts(spark, folder).select("doc_id", F.size(X.split_words(F.col("raw"))).cast("bigint").alias("words"), X.word_count(F.col("raw")).cast("bigint").alias("word_count"))


def snippets(spark, folder):
    return texts(spark, folder).select("doc_id", X.snippet(F.col("raw")).alias("snippet"))


def chunk_windows(spark, folder):
    rows = texts(spark, folder).select("doc_id", F.posexplode(X.chunk_windows(F.col("raw"), CONFIG.chunk_size_words, CONFIG.chunk_overlap_words)).alias("ordinal", "content"))
    return rows.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "content")


def tokenize_terms(spark, folder):
    tokens = X.tokenize(F.col("raw"))
    return texts(spark, folder).select("doc_id", F.array_join(tokens, " ").alias("tokens"))


def tokenize_no_alias(spark, folder):
    return texts(spark, folder).select("doc_id", F.array_join(X.tokenize(F.col("raw"), aliases=False), " ").alias("tokens"))


def stem_terms(spark, folder):
    words = F.split(F.regexp_replace(F.lower(F.col("raw")), "[^a-z0-9]+", " "), " ")
    rows = texts(spark, folder).select(F.explode(F.array_distinct(words)).alias("word")).where("word <> ''").distinct()
    return rows.select("word", X.stem(F.col("word")).alias("stem"))


def frontmatter(spark, folder):
    rows = texts(spark, folder).select("doc_id", M.frontmatter_block(F.col("raw")).alias("block"), F.length(M.body(F.col("raw"))).cast("bigint").alias("body_chars"))
    return rows.where("block is not null")


def frontmatter_values(spark, folder):
    rows = texts(spark, folder).select("doc_id", F.explode(M.parse_yaml(M.frontmatter_block(F.col("raw")))).alias("key", "entry"))
    return rows.select("doc_id", "key", "entry.is_list", F.array_join("entry.values", "|").alias("joined"))


def titles(spark, folder):
    rows = texts(spark, folder).select("doc_id", M.body(F.col("raw")).alias("body"))
    return rows.select("doc_id", M.title(F.col("body"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("title"))


def inline_tags(spark, folder):
    rows = texts(spark, folder).select("doc_id", F.explode(F.array_distinct(M.inline_tags(M.body(F.col("raw"))))).alias("tag"))
    return rows.where("tag <> ''")


def wiki_links(spark, folder):
    return texts(spark, folder).select("doc_id", F.explode(F.array_distinct(M.wiki_links(M.body(F.col("raw"))))).alias("link"))


def folder_ancestors(spark, folder):
    rows = table(spark, folder, "garden_documents").where("relative_path is not null").select("doc_no", "relative_path").distinct()
    return rows.select("doc_no", F.explode(M.folders(F.col("relative_path"))).alias("folder"))


def stable_ids(spark, folder):
    rows = table(spark, folder, "garden_documents").where("relative_path is not null").select("doc_no", "relative_path").distinct()
    return rows.select("doc_no", M.stable_id(F.col("relative_path")).alias("doc_id"), M.short_sha(F.col("relative_path")).alias("target_id"))


def entity_names(spark, folder):
    """Ids taken apart and names shown, over all entity records."""
    rows = table(spark, folder, "entity_summaries").where("entity_id is not null").select("entity_no", "entity_id").distinct()
    rows = rows.select("entity_no", M.entity_type(F.col("entity_id")).alias("entity_type"), M.entity_name(F.col("entity_id")).alias("name"))
    return rows.select("*", M.display_name(F.col("entity_type"), F.col("name")).alias("shown"))


# Corpus


def corpus_documents(spark, folder):
    d = built(spark, folder).documents
    return d.select("relative_path", "doc_id", "title", F.col("word_count").cast("bigint").alias("word_count"), F.array_join("entities", "|").alias("entities"), T.iso(F.col("created_at")).alias("created"), T.iso(F.col("modified_at")).alias("modified"))


def entity_ids(spark, folder):
    return built(spark, folder).documents.select("doc_id", F.explode("entities").alias("entity_id"))


def corpus_stats(spark, folder):
    ix = built(spark, folder)
    counts = [t.agg(F.count("*").alias(n)).withColumn("k", F.lit(0)) for n, t in (("documents", ix.documents), ("chunks", ix.chunks), ("entities", ix.entities), ("probes", ix.probes))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c, "k")
    return out.drop("k")


# Weights


def doc_frequency_idf(spark, folder):
    return built(spark, folder).idf.select("term", "df", F.round("idf", 9).alias("idf"))


def tfidf_weights(spark, folder):
    return weights.as_rows(built(spark, folder).vectors, "chunk_id").select("chunk_id", "term", F.round("weight", 9).alias("weight"))


def sparse_cosine_topk(spark, folder):
    """The ten passages nearest to the query by their terms alone."""
    ix = built(spark, folder)
    query = search.query_vectors(spark, QUESTION, ix.idf, ix.max_idf, embed.embedder(ix.config)).terms
    rows = ix.vectors.select("chunk_id", F.round(weights.sparse_score(F.col("vector"), query), 9).alias("score")).where("score > 0")
    return rows.orderBy(F.desc("score"), "chunk_id").limit(10)


def _plain_tokens(spark, folder, aliases=True):
    return texts(spark, folder).select(F.coalesce("lang", F.lit("")).alias("lang"), X.tokenize(F.col("raw"), aliases).alias("tokens"))


def top_terms_by_lang(spark, folder):
    counts = weights.term_counts(_plain_tokens(spark, folder), "lang")
    return weights.top_terms(counts, ["lang"], 8).select("lang", "term", "tf", F.col("rank").cast("bigint").alias("rank"))


def top_phrases_by_lang(spark, folder):
    rows = _plain_tokens(spark, folder, aliases=False).select("lang", F.explode(X.phrases_of(F.col("tokens"))).alias("term"))
    counts = rows.groupBy("lang", "term").agg(F.count("*").alias("tf"))
    return weights.top_terms(counts, ["lang"], 8).select("lang", "term", "tf", F.col("rank").cast("bigint").alias("rank"))


def weighted_terms_by_lang(spark, folder):
    rows = _plain_tokens(spark, folder)
    top = weights.weighted_terms(weights.term_counts(rows, "lang"), weights.idf(rows), ["lang"], 12)
    return top.select("lang", "term", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# Dense vectors


def hash_buckets(spark, folder):
    rows = texts(spark, folder).select(F.explode(X.tokenize(F.col("raw"))).alias("term")).distinct()
    return rows.select("term", V.hash_slot(F.col("term"), 384).cast("bigint").alias("slot"), V.hash_sign(F.col("term")).cast("bigint").alias("sign"))


def hash_embedding_nonzero(spark, folder):
    rows = built(spark, folder).vectors.select("chunk_id", F.posexplode("embedding").alias("slot", "value"))
    return rows.where("value <> 0").select("chunk_id", F.col("slot").cast("bigint").alias("slot"), F.round("value", 9).alias("value"))


def dense_cosine_topk(spark, folder):
    """The ten vectors nearest to the one with the smallest number."""
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    first = e.orderBy("vec_id").first()
    if first is None:
        return e.select("vec_id", F.lit(0.0).alias("score")).limit(0)
    score = F.round(V.dense_cosine(F.array(*[F.lit(float(x)) for x in first.embedding]), F.col("embedding").cast("array<double>")), 9)
    return e.where(F.col("vec_id") != first.vec_id).select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


def dense_knn_per_vector(spark, folder):
    """The five nearest of each vector whose number is divisible by 20, exactly: the stated queries go to every task as matrices, block by block.

    What is found for a block is written before the next one, so plans and driver hold one block.
    """
    e = spread(table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")))
    queries = e.where("vec_id % 20 = 0")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    done = []
    for i in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()
        if asked:
            rows = embed.best_rows(e, embed.Asked([r.vec_id for r in asked], [r.embedding for r in asked]), ["vec_id"], 6, "bigint")
            rows = rows.select(F.col("probe_id").alias("query_id"), "vec_id", F.round("score", 9).alias("score")).where("query_id <> vec_id and score > 0")
            best = weights.ranked(rows, ["query_id"], [F.desc("score"), F.col("vec_id")], 5).select("query_id", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))
            done.append(best if blocks == 1 else cut(best, "nearest"))
    if not done:
        return e.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rank")).limit(0)
    return reduce(DataFrame.unionByName, done)


# Time


def recency_score(spark, folder):
    e = table(spark, folder, "events")
    return e.select("event_id", F.round(T.age_days(F.col("ts"), "2024-04-15 00:00:00"), 6).alias("age"), F.round(T.recency(F.col("ts"), 180, "2024-04-15 00:00:00"), 9).alias("recency"))


def quarter_label(spark, folder):
    rows = table(spark, folder, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return rows.select("o_custkey", T.quarter_label(F.col("a")).alias("first_quarter"), T.era_label(F.col("a"), F.col("b")).alias("era"))


def activity_trend(spark, folder):
    """The trend of each user at three points of time."""
    e = table(spark, folder, "events").select("user_id", "ts")
    parts = [entities.activity(e, ["user_id"], "ts", at).select("user_id", F.lit(at).alias("as_of"), "trend", "frequency12m") for at in ("2024-04-15 00:00:00", "2024-08-01 00:00:00", "2025-06-01 00:00:00")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def freq_last_year(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderdate")
    return entities.activity(o, ["o_custkey"], "o_orderdate", "1998-08-01 00:00:00").select("o_custkey", "frequency12m", "trend", F.col("n").alias("orders"))


# Entities, questions, search


def entity_summary(spark, folder):
    ix = built(spark, folder)
    rows = entities.summaries(ix.documents, ix.chunks, AS_OF)
    return rows.select("entity_id", "entity_type", "name", "document_count", "chunk_count", "frequency12m", T.iso(F.col("first_seen")).alias("first_seen"), T.iso(F.col("last_seen")).alias("last_seen"), "activity_trend", F.round("score", 6).alias("score"))


def entity_topk(spark, folder):
    rows = built(spark, folder).entities
    return rows.select(F.col("entity_pos").cast("bigint").alias("entity_pos"), "entity_id", F.round("score", 6).alias("score"), F.array_join("top_terms", " ").alias("top_terms"))


def entity_probes(spark, folder):
    """The questions of each entity, in order."""
    return built(spark, folder).entities.select("entity_id", F.posexplode("probe_ids").alias("pos", "probe_id")).select("entity_id", F.col("pos").cast("bigint").alias("pos"), "probe_id")


def top_vector_terms(spark, folder):
    rows = weights.top_vector_terms(weights.as_rows(built(spark, folder).vectors, "chunk_id"), "chunk_id", 5)
    return rows.select("chunk_id", "term", "weight", F.col("rank").cast("bigint").alias("rank"))


def hydrate_entities(spark, folder):
    """Name and type of the entity of each stored question, from its id where they are missing."""
    rows = table(spark, folder, "catalysts").where("entity_id is not null").select("catalyst_no", "entity_id", "entity_name", "entity_type").distinct()
    # Every other one as if it had been stored without them.
    blank = F.when(F.col("catalyst_no") % 2 == 0, F.lit(""))
    rows = rows.withColumn("entity_name", F.coalesce(blank, "entity_name")).withColumn("entity_type", F.coalesce(blank, "entity_type"))
    return probes.hydrated(rows).select("catalyst_no", "entity_name", "entity_type")


def probe_questions(spark, folder):
    rows = built(spark, folder).probes
    return rows.select("probe_id", "entity_id", "era", "context", "text", F.array_join("terms", " ").alias("terms"))


def probe_links(spark, folder):
    return built(spark, folder).links.select("probe_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def probe_ranking(spark, folder):
    """The questions that match the query."""
    _, matched = I.ask(built(spark, folder), QUESTION, AS_OF)
    return matched.select(F.col("rank").cast("bigint").alias("rank"), "probe_id", F.round("score", 6).alias("score"))


def search_fused(spark, folder):
    hits, _ = I.ask(built(spark, folder), QUESTION, AS_OF)
    return hits.select(F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.array_join("probe_ids", " ").alias("probe_ids"), "content", "relative_path", "score", "title")


def graph_all(spark, folder):
    found, _ = I.inspect(built(spark, folder))
    return found.select("probe_id", "entity_id", "text")


def graph_query(spark, folder):
    found, known = I.inspect(built(spark, folder), QUESTION)
    a = found.select(F.lit("probe").alias("what"), F.col("probe_id").alias("id"))
    return a.unionByName(known.select(F.lit("entity").alias("what"), F.col("entity_id").alias("id")))


_applied: dict = {}


def _target(spark, folder) -> I.Index:
    """The questions of the documents linked to the notes of the vaults."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _applied:
        g = table(spark, folder, "garden_documents").where("doc_no is not null and content is not null").select("doc_no", "content")
        g = g.repartition(max(cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_no").groupBy("doc_no").agg(F.max("content").alias("content"))
        born = F.timestamp_seconds(F.unix_timestamp(F.lit("2025-01-01 00:00:00")) + F.col("doc_no") % 300 * 86400)
        raw = corpus.from_dataframe(g, F.concat(F.lit("garden/note-"), F.col("doc_no").cast("string"), F.lit(".md")), F.col("content"), born, born)
        _applied[key] = I.project(built(spark, folder), raw)
    return _applied[key]


def apply_target(spark, folder):
    return _target(spark, folder).links.select("probe_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def apply_search(spark, folder):
    hits, _ = I.ask(_target(spark, folder), QUESTION, AS_OF)
    return hits.select(F.col("rank").cast("bigint").alias("rank"), "chunk_id", "relative_path", "score", "title")


def target_upsert(spark, folder):
    """The registry after two targets, one of them twice."""
    rows: list[dict] = []
    for path, n in (("/b/notes", 1), ("/a/Notes", 2), ("/b/notes", 3)):
        rows = store.upsert_target(rows, {"id": store.target_id(path), "path": path, "doc_count": n})
    return spark.createDataFrame([(i, r["id"], r["path"], r["doc_count"]) for i, r in enumerate(rows)], "pos bigint, id string, path string, doc_count bigint")


# Outside


def stored(spark, folder) -> I.Index:
    """The index of the documents, written to the shared folder and read again."""
    where = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    store.write_index(where, built(spark, folder))
    return store.read_index(spark, where)


def stored_links(spark, folder):
    return stored(spark, folder).links.select("probe_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def stored_search(spark, folder):
    """The answer of the index that was read again."""
    hits, _ = I.ask(stored(spark, folder), QUESTION, AS_OF)
    return hits.select(F.col("rank").cast("bigint").alias("rank"), "chunk_id", "relative_path", "score", "title")


def answer_json(spark, folder):
    """The passages of the answer as JSON, taken apart again."""
    hits, matched = I.ask(built(spark, folder), QUESTION, AS_OF)
    kinds = "struct<probes:array<struct<id:string,score:double>>,results:array<struct<path:string,score:double,title:string>>>"
    rows = vault.results_json(hits, matched, QUESTION, "v").select(F.from_json("json", kinds).alias("j"))
    return rows.select(F.posexplode("j.results").alias("pos", "r")).select((F.col("pos") + 1).cast("bigint").alias("rank"), "r.path", "r.score", "r.title")


def answer_json_probes(spark, folder):
    """The matched questions of the answer as JSON, taken apart again."""
    hits, matched = I.ask(built(spark, folder), QUESTION, AS_OF)
    rows = vault.results_json(hits, matched, QUESTION, "v").select(F.from_json("json", "struct<probes:array<struct<id:string,score:double>>>").alias("j"))
    return rows.select(F.posexplode("j.probes").alias("pos", "r")).select((F.col("pos") + 1).cast("bigint").alias("rank"), F.col("r.id").alias("probe_id"), "r.score")


def answer_lines(spark, folder):
    """The answer as a numbered list, line by line."""
    hits, _ = I.ask(built(spark, folder), QUESTION, AS_OF)
    return spark.createDataFrame([(int(x.partition(".")[0]), x.rpartition(" score=")[0]) for x in vault.summary(hits).splitlines()], "rank bigint, line string")


def vault_settings(spark, folder):
    """The settings of each vault, written over those of vault 0 and over the defaults, and read again; there are as many as vaults."""
    names = ("chunk_size_words", "chunk_overlap_words", "max_files", "max_results")
    rows = {r.vault_id: {k: r[k] for k in names if r[k] is not None} for r in table(spark, folder, "vault_configs").where("vault_id is not null").orderBy("vault_id").collect()}
    base, out = IndexConfig().merged(rows.get(0)), []
    for key, own in rows.items():
        where = f"{shared_dir(spark)}/settings-{uuid.uuid4().hex}/config.json"
        write_config(where, base.merged(own))
        got = read_config(where)
        out.append((key, *(getattr(got, k) for k in names)))
    return spark.createDataFrame(out, "vault_id int, " + ", ".join(f"{k} bigint" for k in names))


def target_resolution(spark, folder):
    """The target that the path, the id and the folder name of each vault find in the registry of all vaults."""
    paths = [r.vault_path for r in table(spark, folder, "vault_configs").where("vault_path is not null").select("vault_path").distinct().collect()]
    known: list[dict] = []
    for path in paths:
        known = store.upsert_target(known, {"id": store.target_id(path), "path": path})
    asked = [(w, (store.find_target(known, w) or {}).get("path")) for path in paths for w in (path, store.target_id(path), path.rpartition("/")[2])]
    return spark.createDataFrame(asked, "wanted string, path string")


# Timestamps


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each date of a note that isn't in the one form yet, in that form."""
    return timestamps.document_dates(table(spark, folder, "garden_documents"), table(spark, folder, "vault_configs"))


QUERIES = {
    f.__name__: f
    for f in (
        strip_markdown, word_count, snippets, chunk_windows, tokenize_terms, tokenize_no_alias, stem_terms, frontmatter, frontmatter_values, titles, inline_tags, wiki_links, folder_ancestors,
        stable_ids, entity_names, corpus_documents, entity_ids, corpus_stats, doc_frequency_idf, tfidf_weights, sparse_cosine_topk, top_terms_by_lang, top_phrases_by_lang, weighted_terms_by_lang,
        hash_buckets, hash_embedding_nonzero, dense_cosine_topk, dense_knn_per_vector, recency_score, quarter_label, activity_trend, freq_last_year, entity_summary, entity_topk, entity_probes, top_vector_terms, hydrate_entities, probe_questions,
        probe_links, probe_ranking, search_fused, graph_all, graph_query, apply_target, apply_search, target_upsert, stored_links, stored_search, answer_json, answer_json_probes, answer_lines, vault_settings, target_resolution, p3_found,
    )
}
