"""Encoding of whole texts with a public byte-level BPE, also where a text has no place to split it."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.session import spread

TOKENIZER_DIR = os.environ.get("LOAMLINE_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k"

#: Fixed value: the public pattern that splits a text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of a text that are given to the library in one call.
WHOLE = 8192
#: Bytes of a pre-token that are merged in one piece; longer ones are encoded as a tree of halves.
LEAF = 1024
#: Bytes of a pre-token from which the leaves are encoded by several threads.
THREADED = 64 * LEAF


@lru_cache(maxsize=4)
def encoding(name: str = TOKENIZER, folder: str = TOKENIZER_DIR):
    """The tokenizer, once a process. It has no special tokens, so their strings are ordinary text."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def pretokens():
    import regex

    return regex.compile(PATTERN)


@lru_cache(maxsize=1)
def breaks():
    """A place where every pre-token ends, whatever follows: a character that isn't white space before one that is.

    No alternative of the pattern goes on from the one to the other, and matching from such a place on
    looks only forward, so the parts on both sides can be encoded alone.
    """
    import regex

    return regex.compile(r"(?<=\S)(?=\s)")


def join(left: list[int], right: list[int], merge: Callable[[bytes], list[int]], token: Callable[[int], bytes]) -> list[int]:
    """The encoding of two neighbouring byte strings from the encodings of each.

    A window of tokens around the join is encoded again and grows until its first token is that of the left side and
    its last one that of the right. A merge by ranks is settled by its neighbouring pairs: every pair in
    the result then stands side by side in one of three encodings, so the result is the encoding of the whole.
    """
    if not left or not right:
        return left + right
    k = 2
    while True:
        a, b = min(k, len(left)), min(k, len(right))
        window = merge(b"".join(map(token, left[len(left) - a :])) + b"".join(map(token, right[:b])))
        held = (a == len(left) or window[0] == left[len(left) - a]) and (b == len(right) or window[-1] == right[b - 1])
        if held and (len(window) > 1 or (a == len(left) and b == len(right))):
            return left[: len(left) - a] + window + right[b:]
        k *= 2


def merge_tree(piece: bytes, merge: Callable[[bytes], list[int]], token: Callable[[int], bytes], leaf: int = LEAF) -> list[int]:
    """The encoding of one pre-token of any length: leaves in parallel, then joined pairwise up the tree."""
    leaves = [piece[i : i + leaf] for i in range(0, len(piece), leaf)]
    if len(piece) >= THREADED:
        with ThreadPoolExecutor(4) as pool:
            parts = list(pool.map(merge, leaves))
    else:
        parts = [merge(x) for x in leaves]
    while len(parts) > 1:
        pairs = [join(parts[i], parts[i + 1], merge, token) for i in range(0, len(parts) - 1, 2)]
        parts = pairs + parts[len(pairs) * 2 :]
    return parts[0] if parts else []


def holds_long(text: str, leaf: int) -> bool:
    """Whether a pre-token of the text has more than ``leaf`` bytes. A character has four at most, so most texts need only a look at the lengths of words."""
    n = max(1, leaf // 4)
    if len(text) < n:
        return False
    words = text.split()
    blank = len(text) - sum(map(len, words))
    # The four separators are white space to split() only.
    if max(map(len, words), default=0) < n and blank - len(words) < n - 2 and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return False
    return any(len(x.encode("utf-8")) > leaf for x in pretokens().findall(text) if len(x) >= n)


def encode_part(part: str, enc, whole: int = WHOLE, leaf: int = LEAF) -> np.ndarray:
    """The ids of a text in one call of the library; where it or a pre-token of it is long, pre-token by pre-token, the long ones as trees."""
    if len(part) <= whole and not holds_long(part, leaf):
        return np.asarray(enc.encode_to_numpy(part, disallowed_special=()), dtype=np.int32)
    ids: list[int] = []
    for m in pretokens().finditer(part):
        ids += merge_tree(m.group().encode("utf-8"), enc._encode_single_piece, enc.decode_single_token_bytes, leaf)
    return np.asarray(ids, dtype=np.int32)


def encode_long(text: str, enc, whole: int = WHOLE, leaf: int = LEAF) -> np.ndarray:
    """The ids of a text longer than ``whole`` characters, the same as those of one encoding of all of it."""
    out: list[np.ndarray] = []
    start, length = 0, len(text)
    while start < length:
        end = length
        if length - start > whole:
            # The last break within reach, else the first one beyond it.
            near = None
            for m in breaks().finditer(text, start + 1, start + whole):
                near = m
            near = near or breaks().search(text, start + whole)
            end = near.start() if near else length
        out.append(encode_part(text[start:end], enc, whole, leaf))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def encode(text: str | None, enc, whole: int = WHOLE, leaf: int = LEAF) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int32)
    if len(text) <= whole:
        return encode_part(text, enc, whole, leaf)
    return encode_long(text, enc, whole, leaf)


def encoded(df: DataFrame, key: str, text: str, ids: str = "ids", name: str = TOKENIZER, folder: str = TOKENIZER_DIR, whole: int = WHOLE, leaf: int = LEAF) -> DataFrame:
    """The token ids of each row: ``key`` and ``ids array<int>``, one row for each row of the input.

    A null and an empty text both give an empty list. No special tokens are added or recognised, and the text isn't
    changed before. A null key is kept, repeated rows are encoded each, other columns are not read. Texts of any length
    are encoded whole. There is no shuffle beyond that which deals out a scan of too few splits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for batch in batches:
            rows = [encode(x, enc, whole, leaf) for x in batch.column(1).to_pylist()]
            ends = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=ends[1:])
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    rows = spread(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    out = rows.mapInArrow(run, f"key {rows.schema[0].dataType.simpleString()}, ids array<int>")
    return out.select(F.col("key").alias(key), F.col("ids").alias(ids))


def counted(df: DataFrame, keep: list[str], text: str, count: str = "tokens", name: str = TOKENIZER, folder: str = TOKENIZER_DIR, whole: int = WHOLE) -> DataFrame:
    """The number of tokens of each row, beside the columns ``keep``; 0 for a null and an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for batch in batches:
            n = pa.array([len(encode(x, enc, whole)) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*[f"c{i}" for i in range(len(keep))], "n"])

    rows = spread(df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text")))
    kinds = ", ".join(f"c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    out = rows.mapInArrow(run, f"{kinds}, n bigint")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("n").alias(count))
