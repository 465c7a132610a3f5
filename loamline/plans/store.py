"""Indexes on disk: a folder of Parquet tables with a manifest, and the registry of applied targets."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loamline.config import IndexConfig, read_config, write_config
from loamline.plans.index import Index

VERSION = "0.2"
APPENDED = ("documents", "chunks", "vectors")
STORE, CONFIG, TARGETS, MANIFEST, INDEX = ".loamline", "config.json", "targets", "manifest.json", "index"


def store_path(vault: str | Path) -> Path:
    return Path(vault).resolve() / STORE


def index_path(vault: str | Path) -> Path:
    return store_path(vault) / INDEX


def config_path(vault: str | Path) -> Path:
    return store_path(vault) / CONFIG


def targets_path(vault: str | Path) -> Path:
    return store_path(vault) / TARGETS


def target_id(path: str | Path) -> str:
    return hashlib.sha1(str(Path(path).resolve()).encode()).hexdigest()[:12]


def target_path(vault: str | Path, target: str) -> Path:
    return targets_path(vault) / target


def load_config(vault: str | Path) -> IndexConfig:
    return read_config(config_path(vault))


def save_config(vault: str | Path, config: IndexConfig) -> None:
    write_config(config_path(vault), config)


def write_index(folder: str | Path, index: Index) -> Path:
    """Tables into a folder of their own, then the manifest that names it, at once.

    A reader sees the old index or the new one. The one before stays for those that still read it; older ones go.
    """
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    try:
        before = read_manifest(folder)["generation"]
    except FileNotFoundError:
        before = None
    generation = uuid.uuid4().hex
    held = [t for t in Index.TABLES if getattr(index, t) is not None]
    for name in held:
        getattr(index, name).write.parquet(f"{folder}/{generation}/{name}")
    manifest = {"version": VERSION, "generation": generation, "kind": index.kind, "root": index.root, "generated_at": index.generated_at, "config": asdict(index.config), "embedding": index.config.metadata(), "tables": held, "targets": index.targets, "max_idf": index.max_idf}
    _put_manifest(folder, manifest)
    for old in folder.iterdir():
        if old.is_dir() and old.name not in (generation, before):
            shutil.rmtree(old, ignore_errors=True)
    return folder


def _put_manifest(folder: Path, manifest: dict) -> None:
    new = folder / (MANIFEST + ".new")
    new.write_text(json.dumps(manifest, indent=2) + "\n")
    os.replace(new, folder / MANIFEST)


def read_manifest(folder: str | Path) -> dict:
    found = json.loads((Path(folder) / MANIFEST).read_text())
    if found["version"] != VERSION:
        raise ValueError(f"the index in {folder} has version {found['version']}, not {VERSION}")
    return found


def appended_path(folder: str | Path) -> str:
    """Where notes that have arrived since the index was built lie."""
    return f"{folder}/{read_manifest(folder)['generation']}/appended"


def read_index(spark: SparkSession, folder: str | Path) -> Index:
    """The index in a folder, with the notes that have been appended to it: of each its last version."""
    m = read_manifest(folder)
    tables = {t: spark.read.parquet(f"{folder}/{m['generation']}/{t}") for t in m["tables"]}
    later = Path(appended_path(folder))
    if all((later / t).exists() for t in APPENDED):
        more = {t: spark.read.schema(StructType([*tables[t].schema.fields, StructField("batch", IntegerType())])).parquet(f"{later}/{t}") for t in APPENDED}
        last = more["documents"].groupBy("doc_id").agg(F.max("batch").alias("batch"))
        for t in APPENDED:
            tables[t] = tables[t].join(last, "doc_id", "left_anti").unionByName(more[t].join(last, ["doc_id", "batch"], "left_semi").select(tables[t].columns))
        if "links" in tables:
            # What a question was linked to may be another text now.
            tables["links"] = tables["links"].withColumn("doc_id", F.substring_index("chunk_id", ":", 1)).join(last, "doc_id", "left_anti").drop("doc_id")
    return Index(IndexConfig().merged(m["config"]), **tables, kind=m["kind"], root=m["root"], generated_at=m["generated_at"], targets=m["targets"], max_idf=m["max_idf"])


def find_target(targets: list[dict], wanted: str) -> dict | None:
    """The first target with that id, path, absolute path or folder name."""
    absolute = str(Path(wanted).resolve())
    return next((t for t in targets if wanted in (t["id"], t["path"]) or t["path"] == absolute or os.path.basename(t["path"]) == wanted), None)


def upsert_target(targets: list[dict], target: dict) -> list[dict]:
    """The targets with one put in or replaced, by path."""
    return sorted([t for t in targets if t["id"] != target["id"]] + [target], key=lambda t: (t["path"].lower(), t["path"]))


def read_target(spark: SparkSession, vault: str | Path, wanted: str) -> Index:
    found = find_target(read_manifest(index_path(vault))["targets"], wanted)
    if found is None:
        raise LookupError(f"no applied target matches {wanted!r}; apply it first")
    return read_index(spark, found["index_path"])


def set_targets(vault: str | Path, targets: list[dict]) -> None:
    """Puts the registry into the manifest; the tables stay as they are."""
    folder = index_path(vault)
    _put_manifest(folder, read_manifest(folder) | {"targets": targets})
