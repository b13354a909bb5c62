"""Word splitting, hashing and plan helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII blanks.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Entries a worker keeps in a word cache before it starts a new one.
CACHE_WORDS = 100_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.transform(F.array(value), body)[0]


class Cache(dict):
    """word -> make(word), remembered; `trim` drops all when it has grown beyond `most` entries."""

    def __init__(self, make, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        value = self[word] = self.make(word)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def word_hash(word: bytes) -> int:
    return signed(xxhash.xxh64_intdigest(word))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of `n` word hashes; len(h) - n + 1 of them."""
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def texts(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches cut to at most `rows` rows with the named column as Python values."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield part, part.column(column).to_pylist()


def array_texts(parts: Iterator[pa.Array], rows: int = 512) -> Iterator[Iterator[list]]:
    """Each array as a series of lists of at most `rows` Python values."""
    for part in parts:
        yield (part.slice(k, rows).to_pylist() for k in range(0, len(part), rows))


def whole_ids(df: DataFrame, column: str) -> Column:
    """The id column as long; other kinds of ids are refused, since a cast would make them null."""
    kind = dict(df.dtypes)[column]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} is {kind}; ids here are whole numbers")
    return F.col(f"`{column}`").cast("long")


def sized_join(left: DataFrame, right: DataFrame, on, how: str, right_rows: int, limit: int = 100_000) -> DataFrame:
    """Join that broadcasts `right` only when its counted rows are within `limit`, else shuffles."""
    return left.join(F.broadcast(right) if right_rows <= limit else right, on, how)
