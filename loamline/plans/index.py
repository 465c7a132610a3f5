"""The index of a corpus: all tables from notes to linked questions, and what is asked of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from loamline.config import IndexConfig
from loamline.functions import constants as C
from loamline.operators import corpus, entities, probes, search, weights
from loamline.operators.embed import Embedder, HashEmbedder, embedder
from loamline.session import cut


@dataclass
class Index:
    config: IndexConfig
    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    idf: DataFrame
    entities: DataFrame | None = None
    probes: DataFrame | None = None
    probe_terms: DataFrame | None = None
    links: DataFrame | None = None
    kind: str = "vault"
    root: str = ""
    generated_at: str = ""
    targets: list[dict] = field(default_factory=list)

    max_idf: float = 1.0

    TABLES = ("documents", "chunks", "vectors", "idf", "entities", "probes", "probe_terms", "links")


#: The columns of a passage that stand beside its vectors: what restricts, ranks and dates it. Its text is in another table.
BESIDE = ("chunk_id", "doc_id", "relative_path", "ordinal", "modified_at", "entities")


def passages(raw: DataFrame, config: IndexConfig) -> tuple[DataFrame, DataFrame]:
    """Notes and passages with their tokens, each written once: what comes after reads only the columns it needs."""
    docs = cut(corpus.documents(raw, config), "documents")
    return docs, cut(corpus.chunks(docs, config), "chunks")


def vectors_of(rows: DataFrame, idf: DataFrame, max_idf: float, maker: Embedder) -> DataFrame:
    """The sparse and the dense vector of each passage, made within its row: no text and no vector is shuffled."""
    sparse = lambda df: weights.with_vector(df, idf, "chunk_id", max_idf)
    if isinstance(maker, HashEmbedder) and not maker.config.passage_prefix:
        return maker.embed_tokens(sparse(rows.select(*BESIDE, "tokens")), "tokens").drop("tokens")
    dense = maker.embed(rows.select(*BESIDE, "tokens", F.concat(F.col("title"), F.lit("\n\n"), F.col("content")).alias("_text")), "_text", "passage")
    return sparse(dense.drop("_text")).drop("tokens")


def build(raw: DataFrame, as_of, config: IndexConfig | None = None, load: Callable | None = None, root: str = "") -> Index:
    """The whole index. ``as_of`` is the one "now" of it; nothing reads the clock."""
    config = config or IndexConfig()
    maker = embedder(config, load)
    docs, rows = passages(raw, config)
    idf = cut(weights.idf(rows), "idf")
    most = weights.max_idf(idf)
    vectors = cut(vectors_of(rows, idf, most, maker), "vectors")
    top = entities.selected(entities.summaries(docs, rows, as_of), config)
    terms = probes.picked_terms(top, rows, idf)
    asked = cut(probes.embedded(probes.questions(top, rows, docs, terms), maker), "probes")
    asked_terms = cut(probes.probe_vectors(asked, idf), "probeterms")
    links = cut(probes.links(asked, asked_terms, vectors, C.LINKS_PER_PROBE), "links")
    ids = asked.groupBy("entity_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "probe_id"))), lambda x: x["probe_id"]).alias("probe_ids"))
    full = top.join(terms.select("entity_id", "top_terms"), "entity_id", "left").join(ids, "entity_id", "left").withColumn("probe_ids", F.coalesce("probe_ids", F.array().cast("array<string>")))
    from loamline.functions.timefn import instant, iso

    made = raw.sparkSession.range(1).select(iso(instant(as_of))).first()[0]
    return Index(config, docs, rows, vectors, idf, cut(full, "entities"), asked, asked_terms, links, root=root, generated_at=made, max_idf=most)


def stats(index: Index) -> dict:
    count = lambda t: 0 if t is None else t.count()
    return {"documents": count(index.documents), "chunks": count(index.chunks), "entities": count(index.entities), "probes": count(index.probes), "embedding_dimensions": index.config.embedding_dimensions}


def ask(index: Index, text: str, as_of, limit: int | None = None, load: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """The passages and the matched questions (five of them are shown) of a query."""
    query = search.query_vectors(index.chunks.sparkSession, text, index.idf, index.max_idf, embedder(index.config, load))
    matched = search.ranked_probes(index.probes, index.probe_terms, query)
    hits = search.search(index.chunks, index.vectors, matched, index.links, query, as_of, index.config.recency_half_life_days, limit or index.config.max_results)
    return hits, _held(index, [m for m in matched if m["rank"] <= C.PROBES_SHOWN])


def _held(index: Index, matched: list[dict]) -> DataFrame:
    """Matched questions as rows."""
    kinds = StructType([*index.probes.schema.fields, StructField("score", DoubleType()), StructField("rank", IntegerType())])
    return index.probes.sparkSession.createDataFrame([tuple(m[f] for f in kinds.names) for m in matched], kinds)


#: How much of the graph is shown, without and with a query.
SHOWN_PROBES, SHOWN_MATCHES, SHOWN_ENTITIES = 24, 20, 12


def inspect(index: Index, text: str | None = None, load: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Questions and entities of the graph, in the order of the index; with a query those that match it. An empty query is none."""
    order = ["entity_pos", "ordinal"]
    if not text:
        return index.probes.orderBy(*order).limit(SHOWN_PROBES), index.entities.orderBy("entity_pos")
    query = search.query_vectors(index.chunks.sparkSession, text, index.idf, index.max_idf, embedder(index.config, load))
    matched = search.ranked_probes(index.probes, index.probe_terms, query, SHOWN_MATCHES)
    found = index.probes.where(F.col("probe_id").isin([m["probe_id"] for m in matched])).orderBy(*order).limit(SHOWN_MATCHES)
    return found, index.entities.where(F.col("entity_id").isin([m["entity_id"] for m in matched])).orderBy("entity_pos").limit(SHOWN_ENTITIES)


def project(index: Index, raw: DataFrame, load: Callable | None = None, root: str = "") -> Index:
    """The questions of an index linked to the passages of another corpus, weighed by the terms of the first.

    Entities and questions of the other corpus aren't made: nothing would use them.
    """
    docs, rows = passages(raw, index.config)
    vectors = cut(vectors_of(rows, index.idf, index.max_idf, embedder(index.config, load)), "vectors")
    links = cut(probes.links(index.probes, index.probe_terms, vectors, C.LINKS_PER_PROBE_APPLIED, restricted=False), "links")
    return replace(index, documents=docs, chunks=rows, vectors=vectors, links=links, entities=index.entities.limit(0), kind="target", root=root, targets=[])
