"""Questions made from what an entity holds, and the passages they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamline.functions import constants as C
from loamline.functions import markdown as M
from loamline.functions import text as X
from loamline.functions import timefn as T
from loamline.operators import weights as G
from loamline.operators.embed import Asked, Embedder, best_rows
from loamline.session import cut

#: The questions, and what stands in for terms that are missing.
QUESTIONS = (
    "What keeps connecting {a} with {b} across {scope}?",
    "Where does {scope} show tension between {a} and {c}?",
    "How did {scope} shift from {early} toward {recent} during {era}?",
    "Which older notes about {c} still matter when {d} appears?",
)
FALLBACKS = ("this thread", "nearby ideas", "older context", "new evidence")


def _filled(question: str, values: dict[str, Column]) -> Column:
    parts, rest = [], question
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


PICKED = 10


def picked_terms(entities: DataFrame, chunks: DataFrame, idf: DataFrame) -> DataFrame:
    """entity_id, terms (10 at most: the weightiest, then frequent phrases and words), top_terms (12).

    Terms are counted passage by passage and summed, so the text of an entity is never put together. Phrases and words
    only come in where an entity has fewer than 10 terms at all, so only those entities are looked through for them.
    """
    chosen = F.broadcast(entities.select("entity_id"))
    of = chunks.select(F.explode("entities").alias("entity_id"), "plain").join(chosen, "entity_id")
    counts = G.term_counts(of.select("entity_id", X.with_aliases(F.col("plain")).alias("tokens")), "entity_id")
    heavy = cut(G.listed(G.weighted_terms(counts, idf, ["entity_id"], 12), ["entity_id"], name="top_terms"), "topterms")
    few = of.join(F.broadcast(heavy.where(F.size("top_terms") < PICKED).select("entity_id")), "entity_id")
    words = G.listed(G.top_terms(G.term_counts(few.select("entity_id", X.with_aliases(F.col("plain")).alias("tokens")), "entity_id"), ["entity_id"], 12), ["entity_id"], name="words")
    runs = few.select("entity_id", F.explode(X.phrases_of(F.col("plain"))).alias("term")).groupBy("entity_id", "term").agg(F.count("*").alias("tf"))
    phrases = G.listed(G.top_terms(runs, ["entity_id"], 6), ["entity_id"], name="phrases")
    none = F.array().cast("array<string>")
    rows = entities.select("entity_id").join(heavy, "entity_id", "left").join(phrases, "entity_id", "left").join(words, "entity_id", "left")
    terms = F.concat(F.coalesce("top_terms", none), F.transform(F.coalesce("phrases", none), lambda p: F.translate(p, " ", "_")), F.coalesce("words", none))
    return cut(rows.select("entity_id", F.slice(F.array_distinct(terms), 1, PICKED).alias("terms"), F.coalesce("top_terms", none).alias("top_terms")), "picked")


def questions(entities: DataFrame, chunks: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """probe_id, entity_id, entity_pos, entity_name, entity_type, era, context, text, terms, ordinal: up to four questions for each entity that has passages. ``terms``: those of ``picked_terms``."""
    place = F.struct("created_at", F.collate("relative_path", "UNICODE"), "ordinal")
    chosen = F.broadcast(entities.select("entity_id"))
    ends = chunks.select(F.explode("entities").alias("entity_id"), "plain", "created_at", "relative_path", "ordinal").join(chosen, "entity_id")
    ends = ends.groupBy("entity_id").agg(F.min_by("plain", place).alias("early"), F.max_by("plain", place).alias("recent"), F.count("*").alias("n_chunks"))
    sides = ends.select("entity_id", F.explode(F.create_map(F.lit("early"), X.with_aliases(F.col("early")), F.lit("recent"), X.with_aliases(F.col("recent")))).alias("side", "tokens"))
    side = G.top_terms(G.term_counts(sides, ["entity_id", "side"]), ["entity_id", "side"], 1).groupBy("entity_id").agg(F.max(F.when(F.col("side") == "early", F.col("term"))).alias("early_term"), F.max(F.when(F.col("side") == "recent", F.col("term"))).alias("recent_term"))
    dates = docs.select(F.explode("entities").alias("entity_id"), "created_at").join(chosen, "entity_id").groupBy("entity_id").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    rows = entities.select("entity_id", "entity_pos", "entity_type", F.col("name").alias("entity_name")).join(ends.select("entity_id", "n_chunks"), "entity_id").join(terms, "entity_id").join(side, "entity_id", "left").join(dates, "entity_id")

    shown = M.display_name(F.col("entity_type"), F.col("entity_name"))
    a, b, c, d = (F.coalesce(F.get("terms", i), F.lit(f)) for i, f in enumerate(FALLBACKS))
    readable = lambda x: F.translate(x, "_", " ")
    several = F.col("n_chunks") > 1
    values = {
        "a": readable(a),
        "b": readable(b),
        "c": readable(c),
        "d": readable(d),
        "scope": F.when(F.col("entity_type") == "folder", shown).otherwise(F.concat(F.lit("the "), shown, F.lit(" material"))),
        "early": readable(F.when(several, F.coalesce("early_term", a)).otherwise(a)),
        "recent": readable(F.when(several, F.coalesce("recent_term", b)).otherwise(b)),
        "era": T.era_label(F.col("first_at"), F.col("last_at")),
    }
    texts = F.array_distinct(F.array(*[_filled(q, values) for q in QUESTIONS]))
    rows = rows.withColumn("era", values["era"]).select("entity_id", "entity_pos", "entity_name", "entity_type", "era", F.array_join(F.slice("terms", 1, 5), " / ").alias("context"), "terms", F.posexplode(texts).alias("ordinal", "text"))
    return rows.withColumn("probe_id", F.concat(F.lit("cat_"), M.short_sha(F.concat_ws("\n", "entity_id", "text"))))


def hydrated(rows: DataFrame) -> DataFrame:
    """Questions whose entity has no name or type, as in old indexes, get them from its id."""
    name, kind = (F.nullif(F.col(c), F.lit("")) for c in ("entity_name", "entity_type"))
    return rows.withColumn("entity_name", F.coalesce(name, M.entity_name(F.col("entity_id")))).withColumn("entity_type", F.coalesce(kind, M.entity_type(F.col("entity_id"))))


def embedded(rows: DataFrame, embedder: Embedder) -> DataFrame:
    """The questions with their vectors; the words of the query prefix are in them."""
    text = F.concat_ws(" ", "entity_name", "text", F.array_join("terms", " "))
    return embedder.embed(rows.withColumn("_text", text), "_text", "query").drop("_text")


def probe_vectors(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """probe_id, term, weight."""
    text = F.concat_ws(" ", M.display_name(F.col("entity_type"), F.col("entity_name")), "text", F.array_join("terms", " "))
    return G.tfidf(G.term_counts(rows.select("probe_id", X.tokenize(text).alias("tokens")), "probe_id"), idf, "probe_id")


def links(probes: DataFrame, probe_terms: DataFrame, vectors: DataFrame, limit: int, restricted: bool = True) -> DataFrame:
    """probe_id, chunk_id, rank, score: the best passages of each question, of its entity only or of all.

    The questions are as many as the settings allow, so they are sent as a matrix; the vectors of the passages are read
    once. A task sends ``limit`` passages a question to the ranking: its best ones, ties settled.
    """
    held = probes.select("probe_id", "entity_id", "embedding").collect()
    if not held:
        return vectors.select(F.lit("").alias("probe_id"), "chunk_id", F.lit(0).alias("rank"), F.lit(0.0).alias("score")).limit(0)
    terms: dict[str, dict[str, float]] = {r.probe_id: {} for r in held}
    for r in probe_terms.collect():
        terms.get(r.probe_id, {})[r.term] = r.weight
    asked = Asked([r.probe_id for r in held], [r.embedding for r in held], [r.entity_id for r in held] if restricted else None, [terms[r.probe_id] for r in held])
    found = best_rows(vectors, asked, ["chunk_id", "relative_path", "ordinal"], limit)
    order = [F.desc("score"), F.collate("relative_path", "UNICODE"), F.col("relative_path"), F.col("ordinal")]
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("probe_id").orderBy(*order))).where(F.col("rank") <= limit)
    return best.select("probe_id", "chunk_id", "rank", "score")
