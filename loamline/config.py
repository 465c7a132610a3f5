"""Settings of an index."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from loamline.functions import constants as C

BACKENDS = ("hash", "model")


@dataclass(frozen=True)
class IndexConfig:
    chunk_size_words: int = C.CHUNK_SIZE_WORDS
    chunk_overlap_words: int = C.CHUNK_OVERLAP_WORDS
    embedding_backend: str = "hash"
    embedding_batch_size: int = C.EMBEDDING_BATCH_SIZE
    embedding_model: str = C.EMBEDDING_MODEL
    embedding_dimensions: int = C.EMBEDDING_DIMENSIONS
    passage_prefix: str = C.PASSAGE_PREFIX
    query_prefix: str = C.QUERY_PREFIX
    excluded_dirs: tuple[str, ...] = C.EXCLUDED_DIRS
    extensions: tuple[str, ...] = C.EXTENSIONS
    max_files: int | None = C.MAX_FILES
    max_results: int = C.MAX_RESULTS
    min_entity_documents: int = C.MIN_ENTITY_DOCUMENTS
    recency_half_life_days: float = C.RECENCY_HALF_LIFE_DAYS
    selected_entity_limit: int = C.SELECTED_ENTITY_LIMIT

    def __post_init__(self):
        if self.embedding_backend not in BACKENDS:
            raise ValueError(f"embedding backend must be one of {', '.join(BACKENDS)}")

    def merged(self, overrides: dict | None) -> IndexConfig:
        """These settings with others put over them; unknown ones are left out, lists replace lists."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in (overrides or {}).items() if k in known})

    def metadata(self) -> dict:
        """What vectors of two indexes must agree in to be compared."""
        model = f"loamline-hash-{self.embedding_dimensions}" if self.embedding_backend == "hash" else self.embedding_model
        return {"backend": self.embedding_backend, "dimensions": self.embedding_dimensions, "model": model, "normalize": True, "passage_prefix": self.passage_prefix, "query_prefix": self.query_prefix}


def read_config(path: str | Path) -> IndexConfig:
    """The settings in a file over the defaults; the defaults where there is no file."""
    try:
        return IndexConfig().merged(json.loads(Path(path).read_text()))
    except FileNotFoundError:
        return IndexConfig()


def write_config(path: str | Path, config: IndexConfig) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(asdict(config), indent=2) + "\n")
