"""A folder of notes as a table, read by a Python data source: file names that Spark would hide are kept."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamline.config import IndexConfig

SCHEMA = "path string, relative_path string, raw binary, birth_ts timestamp, mtime timestamp"
#: Files that one task reads.
FILES = 256


def walk(root: str, excluded: set[str], extensions: set[str]) -> Iterator[str]:
    """Files with one of the extensions, whatever their case, in no order; links and excluded folders aren't followed."""
    for folder, below, files in os.walk(root, followlinks=False):
        below[:] = [d for d in below if d not in excluded and not os.path.islink(os.path.join(folder, d))]
        for name in files:
            at = os.path.join(folder, name)
            if os.path.splitext(name)[1].lower() in extensions and not os.path.islink(at) and os.path.isfile(at):
                yield at


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class VaultReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.excluded = set(filter(None, options.get("excluded", "").split(",")))
        self.extensions = {e.lower() for e in options.get("extensions", ".md,.mdx,.txt").split(",")}

    def partitions(self) -> list[InputPartition]:
        paths = sorted(walk(self.root, self.excluded, self.extensions))
        return [Files(paths[i : i + FILES]) for i in range(0, len(paths), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:
                raw = f.read()
            s = os.stat(path)
            born = getattr(s, "st_birthtime", 0) or s.st_mtime
            at = lambda t: datetime.fromtimestamp(t, UTC)
            yield path, os.path.relpath(path, self.root).replace(os.sep, "/"), raw, at(born), at(s.st_mtime)


class VaultSource(DataSource):
    """format("vault"): option path, excluded (names of folders) and extensions, each separated by commas."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VaultReader(dict(self.options))


def read(spark: SparkSession, root: str, config: IndexConfig | None = None) -> DataFrame:
    """The notes of a folder as raw rows."""
    config = config or IndexConfig()
    spark.dataSource.register(VaultSource)
    return spark.read.format("vault").option("excluded", ",".join(config.excluded_dirs)).option("extensions", ",".join(config.extensions)).load(os.path.abspath(root))
