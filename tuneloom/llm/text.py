"""Helpers inside tasks: Arrow slices of bounded size, words, hashes, shingles; written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.session import new_path

SLICE_BYTES = 4 << 20
#: Ids, at about 16 bytes each, that may be broadcast.
BROADCAST_IDS = 1_000_000

#: Words are runs of digits, ASCII letters and bytes above 0x7F of the text with A-Z lower-cased.
LOWER = bytes(range(256)).lower()
IS_WORD = np.array([chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 for b in LOWER], dtype=bool)
#: The same as a table for bytes.translate: separators become spaces.
WORD_TABLE = bytes(LOWER[b] if IS_WORD[b] else 32 for b in range(256))
SHINGLE = 5

_LOWER_ARRAY = np.frombuffer(LOWER, dtype=np.uint8)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([(0xBF58476D1CE4E5B9 * (2 * k + 1) ** 3) & (2**64 - 1) | 1 for k in range(SHINGLE)], dtype=np.uint64)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: survives lost executors, is computed once."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def sent_if_few(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table of ids, marked to go to every executor where its rows were counted to be at most `most`."""
    return F.broadcast(ids) if ids.count() <= most else ids


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about `limit` bytes of text and up to `rows` rows, one row at least; null texts become empty."""
    for batch in batches:
        place = batch.schema.get_field_index(column)
        batch = batch.set_column(place, column, pc.fill_null(batch.column(place).cast(pa.large_string()), ""))
        ends, row = _offsets(batch.column(place)), 0
        while row < batch.num_rows:
            stop = min(row + rows, max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1))
            yield batch.slice(row, stop - row)
            row = stop


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each text starts and the last one ends."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = _offsets(texts)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def as_bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.large_binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and its inverse, grown on demand and kept within a worker."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1024)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in order, and the row of each word."""
    data, ends = raw(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = IS_WORD[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[ends] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops[:-1] &= ~inside[1:] | first[1:-1]
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_ARRAY[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes = mix((total[stop] - total[begin]) * down[begin])
    return hashes, np.searchsorted(ends, begin, "right") - 1


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word shingles; a text of one to four words is one shingle."""
    hashes, rows = word_hashes(texts)
    counts = np.bincount(rows, minlength=len(texts))
    after = np.cumsum(counts)
    summed = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        summed += hashes[k : k + len(summed)] * _PLACES[k]
    summed = mix(summed)
    out = []
    for n, end in zip(counts.tolist(), after.tolist(), strict=True):
        if n >= SHINGLE:
            out.append(np.unique(summed[end - n : end - SHINGLE + 1]))
        elif n:
            out.append(mix((hashes[end - n : end] * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
