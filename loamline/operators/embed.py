"""Dense vectors of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from loamline.config import IndexConfig
from loamline.functions.text import tokenize


class Embedder(Protocol):
    """Adds ``embedding array<double>`` to the rows of a table; ``role``: passage or query."""

    config: IndexConfig

    def embed(self, rows: DataFrame, text: str, role: str) -> DataFrame: ...


def hash_matrix(tokens: pa.Array, dimensions: int) -> np.ndarray:
    """A row a list of tokens. Each distinct token of a batch is hashed once."""
    n = len(tokens)
    out = np.zeros((n, dimensions))
    flat = tokens.flatten()
    if len(flat):
        words = flat.dictionary_encode()
        digests = [hashlib.sha256(w.encode()).digest() for w in words.dictionary.to_pylist()]
        slot = np.array([int.from_bytes(d[:4], "big") % dimensions for d in digests])
        sign = np.array([1.0 if d[4] % 2 == 0 else -1.0 for d in digests])
        code = words.indices.to_numpy(zero_copy_only=False)
        lengths = np.array([0 if x is None else x for x in pa.compute.list_value_length(tokens).to_pylist()])
        np.add.at(out, (np.repeat(np.arange(n), lengths), slot[code]), sign[code])
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        out = np.divide(out, norm, out=out, where=norm > 0)
    return out


def _with_embedding(batch: pa.RecordBatch, keep: list[str], matrix: np.ndarray) -> pa.RecordBatch:
    n, d = matrix.shape
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(matrix.ravel()))
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], vectors], names=[*keep, "embedding"])


def _schema(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("embedding", ArrayType(DoubleType()))])


class HashEmbedder:
    """Tokens hashed to places with a sign; deterministic and without a model."""

    def __init__(self, config: IndexConfig):
        self.config = config

    def embed(self, rows: DataFrame, text: str, role: str) -> DataFrame:
        prefix = self.config.query_prefix if role == "query" else self.config.passage_prefix
        source = F.concat(F.lit(prefix), F.col(text)) if prefix else F.col(text)
        return self.embed_tokens(rows.withColumn("_tokens", tokenize(source)), "_tokens").drop("_tokens")

    def embed_tokens(self, rows: DataFrame, tokens: str) -> DataFrame:
        keep, dimensions = rows.columns, self.config.embedding_dimensions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _with_embedding(b, keep, hash_matrix(b.column(tokens), dimensions))

        return rows.mapInArrow(run, _schema(rows))


class ModelEmbedder:
    """Vectors of a model that ``load`` makes once in each worker: a function from a list of texts to a matrix, mean-pooled.

    Texts go to it in batches of the configured size; the vectors are brought to length 1. A failed load raises, and is
    tried again by the next task.
    """

    def __init__(self, config: IndexConfig, load: Callable[[str], Callable[[list[str]], np.ndarray]]):
        self.config, self.load = config, load

    def embed(self, rows: DataFrame, text: str, role: str) -> DataFrame:
        prefix = self.config.query_prefix if role == "query" else self.config.passage_prefix
        keep, size, name, load = rows.columns, max(1, self.config.embedding_batch_size), self.config.embedding_model, self.load

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load(name)
            for b in batches:
                texts = [f"{prefix}{x or ''}" for x in b.column(text).to_pylist()]
                parts = [np.asarray(model(texts[i : i + size]), dtype=np.float64) for i in range(0, len(texts), size)]
                m = np.concatenate(parts) if parts else np.zeros((0, 1))
                norm = np.sqrt((m * m).sum(1, keepdims=True))
                yield _with_embedding(b, keep, np.divide(m, norm, out=m.copy(), where=norm > 0))

        return rows.mapInArrow(run, _schema(rows))


def embedder(config: IndexConfig, load: Callable | None = None) -> Embedder:
    """The embedder of the configured backend; a model needs ``load``."""
    if config.embedding_backend == "hash":
        return HashEmbedder(config)
    if load is None:
        raise ValueError("the model backend needs a function that loads the model")
    return ModelEmbedder(config, load)


def _cosines(batch: pa.RecordBatch, matrix: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """[question, row]: the cosine of each question with the vectors of the batch; 0 for those of another length."""
    e, size = batch.column("embedding"), matrix.shape[1]
    fits = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(e), size), False).to_numpy(zero_copy_only=False)
    x = np.zeros((batch.num_rows, size))
    if fits.any():
        x[fits] = e.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    scale = norms[:, None] * np.sqrt((x * x).sum(1))[None]
    dot = np.zeros((len(matrix), batch.num_rows))
    np.divide(matrix @ x.T, scale, out=dot, where=scale > 0)
    # What only rounding keeps from 0 is 0, in whatever order it was summed.
    dot[np.abs(dot) < 1e-12] = 0
    return dot


def dense_scores(rows: DataFrame, query: list[float], keep: list[str]) -> DataFrame:
    """``keep``, dense: the cosine of one query with each row."""
    matrix = np.array([query], dtype=np.float64)
    norms = np.sqrt((matrix * matrix).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(_cosines(b, matrix, norms)[0])], names=[*keep, "dense"])

    rows = rows.select(*keep, "embedding")
    return rows.mapInArrow(run, ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep) + ", dense double")


@dataclass
class Asked:
    """Questions that go to every task; their number is bounded by the settings or by a block. ``entities``: only rows with that one count, null: all."""

    ids: list
    embeddings: list[list[float]]
    entities: list[str | None] | None = None
    terms: list[dict[str, float]] | None = None


#: Rows that are scored at once.
SCORED = 1_000


def best_rows(rows: DataFrame, asked: Asked, keep: list[str], limit: int, id_type: str = "string") -> DataFrame:
    """probe_id, ``keep``, score: for each question the rows that may be among its ``limit`` best ones, by cosine.

    Where the cosine is exactly 0, the product of the sparse vectors counts (``vector`` of the rows, ``terms`` of the
    questions). Scores are rounded to 12 digits; only positive ones count. A task knows the ``limit`` best scores of each
    question so far and sends what reaches the last of them, so ties can be settled afterwards by columns.
    """
    matrix = np.array(asked.embeddings, dtype=np.float64).reshape(len(asked.ids), -1)
    norms = np.sqrt((matrix * matrix).sum(1))
    wanted = sorted({e for e in asked.entities or () if e is not None})
    own = np.array([wanted.index(e) if e is not None else -1 for e in asked.entities or [None] * len(asked.ids)], int)
    known = sorted({t for q in asked.terms or () for t in q})
    place = {t: i for i, t in enumerate(known)}
    sparse = np.zeros((len(asked.ids), len(known)))
    for i, q in enumerate(asked.terms or ()):
        for t, w in q.items():
            sparse[i, place[t]] = w
    columns = [*dict.fromkeys([*keep, *(["entities"] if wanted else []), *(["vector"] if known else []), "embedding"])]

    def products(b: pa.RecordBatch) -> np.ndarray:
        v = b.column("vector")
        ends = v.offsets.to_numpy()
        at = pa.compute.fill_null(pa.compute.index_in(v.keys.slice(ends[0], ends[-1] - ends[0]), value_set=pa.array(known, pa.string())), -1).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(at >= 0)
        of = np.repeat(np.arange(b.num_rows), np.diff(ends))[hit]
        w = v.items.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False)[hit]
        out = np.zeros((len(sparse), b.num_rows))
        if len(hit):
            u, first = np.unique(of, return_index=True)
            out[:, u] = np.add.reduceat(sparse[:, at[hit]] * w, first, axis=1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(asked.ids), limit))
        for whole in batches:
            for start in range(0, whole.num_rows, SCORED):
                b = whole.slice(start, SCORED)
                score = _cosines(b, matrix, norms)
                if known and (score == 0).any():
                    score = np.where(score == 0, products(b), score)
                score = np.round(score, 12)
                if wanted:
                    e = b.column("entities")
                    at = pa.compute.fill_null(pa.compute.index_in(e.flatten(), value_set=pa.array(wanted, pa.string())), -1).to_numpy(zero_copy_only=False)
                    has = np.zeros((len(wanted) + 1, b.num_rows), bool)
                    has[at, np.repeat(np.arange(b.num_rows), pa.compute.fill_null(pa.compute.list_value_length(e), 0).to_numpy(zero_copy_only=False))] = True
                    has[-1] = True
                    score[~has[own]] = 0
                least = held.min(1)
                p, c = np.nonzero((score > 0) & (score >= least[:, None]))
                if not len(p):
                    continue
                pad = np.concatenate([held, score], 1)
                held = -np.partition(-pad, limit - 1, axis=1)[:, :limit]
                still = score[p, c] >= held.min(1)[p]
                p, c = p[still], c[still]
                taken = pa.array(c, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(asked.ids).take(pa.array(p)), *[b.column(k).take(taken) for k in keep], pa.array(score[p, c])], names=["probe_id", *keep, "score"])

    rows = rows.select(*columns)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"probe_id {id_type}, {kinds}, score double")
