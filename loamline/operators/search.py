"""Answers to a query: questions that match it, passages they lead to, passages that match it themselves."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions import constants as C
from loamline.functions import text as X
from loamline.functions import timefn as T
from loamline.functions import vectors as V
from loamline.operators import weights as G
from loamline.operators.embed import Embedder, HashEmbedder, dense_scores, hash_matrix


@dataclass(frozen=True)
class Query:
    """One query as vectors, held by the driver."""

    text: str
    terms: dict[str, float]
    embedding: list[float]


def query_vectors(spark, text: str, idf: DataFrame, max_idf: float, embedder: Embedder) -> Query:
    """The vectors of a query; of the weights of all terms only those of its own are read."""
    one = spark.createDataFrame([(0, text)], "id int, text string")
    both = one.select(X.tokenize(F.col("text")).alias("plain"), X.tokenize(F.concat(F.lit(embedder.config.query_prefix), F.col("text"))).alias("asked")).first()
    tf = Counter(both.plain)
    known = {r.term: r.idf for r in idf.where(F.col("term").isin(sorted(tf))).select("term", "idf").collect()} if tf else {}
    raw = {t: (1 + math.log(n)) * known.get(t, max_idf) for t, n in sorted(tf.items())}
    norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
    if isinstance(embedder, HashEmbedder):
        dense = hash_matrix(pa.array([both.asked], pa.list_(pa.string())), embedder.config.embedding_dimensions)[0].tolist()
    else:
        dense = embedder.embed(one, "text", "query").first().embedding
    return Query(text, {t: w / norm for t, w in raw.items()}, dense)


def ranked_probes(probes: DataFrame, probe_terms: DataFrame, query: Query, limit: int = C.PROBES_SCORED) -> list[dict]:
    """The questions with a positive score, best first: rank, score and their columns.

    There are as many questions as the settings allow, so they are scored where the query is.
    """
    sparse: dict[str, float] = {}
    if query.terms:
        for r in probe_terms.where(F.col("term").isin(sorted(query.terms))).orderBy("probe_id", "term").collect():
            sparse[r.probe_id] = sparse.get(r.probe_id, 0.0) + r.weight * query.terms[r.term]
    rows = probes.collect()
    q = np.asarray(query.embedding, dtype=np.float64)
    found = []
    for r in rows:
        e = np.asarray(r.embedding if r.embedding is not None and len(r.embedding) == len(q) else [0.0] * len(q))
        norm = math.sqrt(float(q @ q) * float(e @ e))
        d, s = max(0.0, float(q @ e) / norm if norm else 0.0), max(0.0, sparse.get(r.probe_id, 0.0))
        # What only rounding keeps from 0 is 0.
        score = round(V.DENSE * d + V.SPARSE * s if d > 1e-12 else s, 12)
        if score > 0:
            found.append((score, r))
    found.sort(key=lambda x: (-x[0], x[1].entity_pos, x[1].ordinal))
    return [r.asDict() | {"score": score, "rank": i + 1} for i, (score, r) in enumerate(found[:limit])]


def search(chunks: DataFrame, vectors: DataFrame, matched: list[dict], links: DataFrame, query: Query, as_of, half_life: float, limit: int = C.MAX_RESULTS) -> DataFrame:
    """rank, chunk_id, probe_ids, content (a snippet), path, relative_path, score, title.

    All passages are scored in one scan of their vectors, without a shuffle: each row has its own sparse and dense
    vector. The links of the matched questions (ten at most) are read by their ids and broadcast, as many as the settings allow. The text
    of passages is only read for those that come out.
    """
    spark = vectors.sparkSession
    place = {m["probe_id"]: m for m in matched}
    linked: dict[str, tuple[float, list]] = {}
    for r in links.where(F.col("probe_id").isin(sorted(place))).select("probe_id", "chunk_id", "score").collect() if place else []:
        best, seen = linked.get(r.chunk_id, (0.0, []))
        linked[r.chunk_id] = max(best, r.score * place[r.probe_id]["score"]), [*seen, (place[r.probe_id]["rank"], r.probe_id)]
    by_probe = spark.createDataFrame([(c, s, list(dict.fromkeys(p for _, p in sorted(those)))[: C.PROBES_SHOWN]) for c, (s, those) in linked.items()], "chunk_id string, by_probe double, probe_ids array<string>")
    own = vectors.select("chunk_id", "relative_path", "ordinal", "modified_at", "embedding", G.sparse_score(F.col("vector"), query.terms).alias("sparse"))
    dense = dense_scores(own, query.embedding, ["chunk_id", "relative_path", "ordinal", "modified_at", "sparse"])
    rows = dense.join(F.broadcast(by_probe), "chunk_id", "left")
    direct = V.combined(F.col("dense"), F.col("sparse"))
    score = V.fused(direct, F.coalesce("by_probe", F.lit(0.0)), T.recency(F.col("modified_at"), half_life, as_of))
    scored = rows.withColumn("score", F.round(score, 6)).where(score > 0)
    order = [F.desc("score"), F.collate("relative_path", "UNICODE"), F.col("relative_path"), F.col("ordinal")]
    top = G.ranked(scored.orderBy(*order).limit(limit).withColumn("_all", F.lit(0)), ["_all"], order, limit)
    top = top.select("rank", "chunk_id", F.coalesce("probe_ids", F.array().cast("array<string>")).alias("probe_ids"), "score")
    full = chunks.select("chunk_id", "content", "path", "relative_path", "title").join(F.broadcast(top), "chunk_id")
    return full.select("rank", "chunk_id", "probe_ids", X.snippet(F.col("content")).alias("content"), "path", "relative_path", "score", "title").orderBy("rank")
