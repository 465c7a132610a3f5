"""What is done with a vault, a folder of notes: index, refresh, load, ask, inspect, apply."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.plans import index as I
from loamline.plans import store
from loamline.sources import vault as source


def _now(as_of) -> datetime:
    return as_of or datetime.now(UTC)


def index_vault(spark: SparkSession, vault: str | Path, overrides: dict | None = None, as_of=None, load: Callable | None = None) -> I.Index:
    """Builds the index of a folder and writes it with its settings. Targets applied before stay registered."""
    config = store.load_config(vault).merged(overrides)
    root = str(Path(vault).resolve())
    made = I.build(source.read(spark, root, config), _now(as_of), config, load, root)
    try:
        made.targets = store.read_manifest(store.index_path(vault))["targets"]
    except FileNotFoundError:
        pass
    store.write_index(store.index_path(vault), made)
    store.save_config(vault, config)
    return store.read_index(spark, store.index_path(vault))


refresh_vault = index_vault


def load_index(spark: SparkSession, vault: str | Path) -> I.Index:
    return store.read_index(spark, store.index_path(vault))


def ask_vault(spark: SparkSession, vault: str | Path, query: str, limit: int | None = None, target: str | None = None, as_of=None, load: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    found = store.read_target(spark, vault, target) if target else load_index(spark, vault)
    return I.ask(found, query, _now(as_of), limit, load)


def inspect_vault(spark: SparkSession, vault: str | Path, query: str | None = None, load: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    return I.inspect(load_index(spark, vault), query, load)


def apply_corpus(spark: SparkSession, vault: str | Path, target: str | Path, overrides: dict | None = None, as_of=None, load: Callable | None = None) -> dict:
    """Links the questions of a vault to the notes of another folder and registers that. Returns the registry entry."""
    own = load_index(spark, vault)
    config = own.config.merged(overrides) if overrides else store.load_config(vault)
    if config.metadata() != own.config.metadata():
        raise ValueError("the vault was embedded otherwise than the target would be; index the vault again first")
    root = str(Path(target).resolve())
    own.config = config
    made = I.project(own, source.read(spark, root, config), load, root)
    key = store.target_id(root)
    where = store.write_index(store.target_path(vault, key), made)
    entry = {"id": key, "path": root, "index_path": str(where), "doc_count": made.documents.count(), "applied_at": str(_now(as_of))}
    store.set_targets(vault, store.upsert_target(own.targets, entry))
    return entry


def results_json(hits: DataFrame, matched: DataFrame, query: str, vault: str, target: str | None = None) -> DataFrame:
    """One row with the answer as JSON: questions without vectors, passages with their scores."""
    shown = matched.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("entity_name").alias("entity"), F.col("probe_id").alias("id"), F.round("score", 6).alias("score"), "text"))), lambda x: x.dropFields("rank")).alias("probes"))
    found = hits.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "probe_ids", "content", "path", "score", "title"))), lambda x: x.dropFields("rank")).alias("results"))
    both = shown.withColumn("_k", F.lit(0)).join(found.withColumn("_k", F.lit(0)), "_k")
    return both.select(F.to_json(F.struct("probes", F.lit(query).alias("query"), "results", F.lit(target).alias("target"), F.lit(vault).alias("vault"))).alias("json"))


def inspect_json(index: I.Index, query: str | None = None) -> DataFrame:
    """One row with questions, entities, targets and sizes as JSON."""
    found, known = I.inspect(index, query)
    a = found.agg(F.transform(F.sort_array(F.collect_list(F.struct("entity_pos", "ordinal", "probe_id", "entity_id", "text", "era", "context"))), lambda x: x.dropFields("entity_pos", "ordinal")).alias("probes")).withColumn("_k", F.lit(0))
    b = known.agg(F.transform(F.sort_array(F.collect_list(F.struct("entity_pos", "entity_id", "entity_type", "name", "score", "activity_trend"))), lambda x: x.dropFields("entity_pos")).alias("entities")).withColumn("_k", F.lit(0))
    counts = F.struct(*[F.lit(v).alias(k) for k, v in I.stats(index).items()])
    targets = F.array(*[F.struct(F.lit(t["id"]).alias("id"), F.lit(t["path"]).alias("path")) for t in index.targets]) if index.targets else F.array().cast("array<struct<id:string,path:string>>")
    return a.join(b, "_k").select(F.to_json(F.struct("probes", "entities", targets.alias("targets"), counts.alias("stats"), F.lit(query).alias("query"))).alias("json"))


def summary(hits: DataFrame) -> str:
    """The passages as a numbered list."""
    rows = hits.orderBy("rank").collect()
    return "\n".join(f"{r['rank']}. {r.title} ({r.relative_path}) score={r.score}" for r in rows) or "No matching notes found."
