"""Exact dedup: Grace hash partitioning with an open-addressing table that compares complete content.

Three steps, each bounded in memory:

1. Every task joins equal texts of its own split first, so a text held by a third of all rows arrives once per task.
2. The remaining texts are dealt by their hash. A task keeps the distinct contents of its partition in an
   open-addressing table; when they outgrow it, table and remaining input go to spill files by further bits of the
   hash, and each file is treated the same way until its contents fit.
3. The answer for a split's text is joined back to the split's list of members by a number of its own, never by the
   hash, so that no hot key arises.

Cases: null text counts as empty. Null doc_ids take part and never win against a number. Rows that repeat a doc_id
with the same text are separate members; exactly one row of a group is kept. An empty table gives no rows. Columns
besides doc_id and text are not read. Equal means identical after lower-casing A-Z.
"""

from __future__ import annotations

import hashlib
import pickle
import string
import tempfile
from collections.abc import Callable, Iterator
from typing import IO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.text import as_bytes, free_name, sent_if_few, slices, written
from tuneloom.session import shuffle_width

TABLE_BYTES = 64 << 20
TABLE_ROWS = 200_000
FAN_OUT_BITS = 4
HASH_BITS = 64


class ContentTable:
    """Open addressing over complete contents: a slot matches when hash and all bytes are equal."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[list] = []
        self.size = 0

    def find(self, key: int, content: bytes) -> list:
        """The values of this content, an empty list when it is new."""
        mask = len(self.slots) - 1
        place = key & mask
        while (entry := self.slots[place]) >= 0:
            if self.hashes[entry] == key and self.contents[entry] == content:
                return self.values[entry]
            place = (place + 1) & mask
        self.slots[place] = len(self.hashes)
        self.hashes.append(key)
        self.contents.append(content)
        self.values.append([])
        self.size += len(content) + 100
        if len(self.hashes) * 2 > len(self.slots):
            self._grow()
        return self.values[-1]

    def _grow(self) -> None:
        slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for entry, key in enumerate(self.hashes):
            place = key & mask
            while slots[place] >= 0:
                place = (place + 1) & mask
            slots[place] = entry
        self.slots = slots


Record = tuple[int, bytes, tuple]


def grace(records: Iterator[Record], table_bytes: int = TABLE_BYTES, used_bits: int = 0) -> Iterator[list[tuple]]:
    """The values of each distinct content; the records may be any multiple of the memory."""
    table, files = ContentTable(), []
    for key, content, value in records:
        if files:
            _spill(files, key, content, [value], used_bits)
            continue
        table.find(key, content).append(value)
        if table.size > table_bytes and used_bits + FAN_OUT_BITS <= HASH_BITS:
            files = [tempfile.TemporaryFile() for _ in range(1 << FAN_OUT_BITS)]
            for entry in zip(table.hashes, table.contents, table.values, strict=True):
                _spill(files, *entry, used_bits)
            table = ContentTable()
    yield from table.values
    del table
    for file in files:
        file.seek(0)
        yield from grace(_spilled(file), table_bytes, used_bits + FAN_OUT_BITS)
        file.close()


def _spill(files: list[IO[bytes]], key: int, content: bytes, values: list, used_bits: int) -> None:
    pickle.dump((key, content, values), files[key >> (HASH_BITS - FAN_OUT_BITS - used_bits) & (len(files) - 1)], protocol=5)


def _spilled(file: IO[bytes]) -> Iterator[Record]:
    while True:
        try:
            key, content, values = pickle.load(file)
        except EOFError:
            return
        for value in values:
            yield key, content, value


LOCAL = "local_id long, bucket long, keep_id long, text binary, text_sha256 string, members array<long>"
_LOCAL_ARROW = pa.schema([
    ("local_id", pa.int64()), ("bucket", pa.int64()), ("keep_id", pa.int64()), ("text", pa.binary()),
    ("text_sha256", pa.string()), ("members", pa.list_(pa.int64())),
])


def _local(table_bytes: int, table_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = TaskContext.get().partitionId() << 33
        table, rows = ContentTable(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal numbered, table, rows
            for begin in range(0, len(table.contents), 1000):
                part = slice(begin, begin + 1000)
                digests = [hashlib.sha256(x) for x in table.contents[part]]
                members = table.values[part]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(numbered, numbered + len(members)), pa.int64()),
                    pa.array([int.from_bytes(x.digest()[:8], "little", signed=True) for x in digests], pa.int64()),
                    pa.array([max((m for m in x if m is not None), default=None) for x in members], pa.int64()),
                    pa.array(table.contents[part], pa.binary()), pa.array([x.hexdigest() for x in digests], pa.string()), pa.array(members, pa.list_(pa.int64())),
                ], schema=_LOCAL_ARROW)
                numbered += len(members)
            table, rows = ContentTable(), 0

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                content = text.lower()
                table.find(hash(content) & (2**64 - 1), content).append(doc_id)
            rows += batch.num_rows
            if table.size > table_bytes or rows > table_rows:
                yield from flush()
        yield from flush()

    return run


_CLASS = "local_id long, keep_id long, group_size long, holder long"
_CLASS_ARROW = pa.schema([("local_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("holder", pa.int64())])


def _classes(table_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for batch in batches:
                names = ("bucket", "text", "local_id", "keep_id", "n")
                for key, content, *value in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    yield key & (2**64 - 1), content, tuple(value)

        rows: list[tuple] = []
        for values in grace(records(), table_bytes):
            keep = max((k for _, k, _ in values if k is not None), default=None)
            holder = min(i for i, k, _ in values if k == keep)
            size = sum(n for _, _, n in values)
            rows += [(i, keep, size, holder) for i, _, _ in values]
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=_CLASS_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=_CLASS_ARROW)

    return run


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES, table_rows: int = TABLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (see the module for the cases).

    `table_bytes` bounds the distinct contents a task holds at once, `table_rows` the rows between two outputs of the
    first step; neither changes the result.
    """
    spark = docs.sparkSession
    local = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_local(table_bytes, table_rows), LOCAL), "exact-local")
    dealt = local.select("bucket", "local_id", "keep_id", F.size("members").cast("long").alias("n"), "text").repartition(shuffle_width(spark), "bucket")
    classes = dealt.mapInArrow(_classes(table_bytes), _CLASS)
    found = classes.join(local.select("local_id", "members", "text_sha256"), "local_id")
    first = F.when(F.col("keep_id").isNull(), 0).otherwise(F.array_position("members", F.col("keep_id")) - 1)
    return found.select("keep_id", "group_size", "text_sha256", (F.col("local_id") == F.col("holder")).alias("held"), first.alias("first"), F.posexplode("members").alias("place", "doc_id")).select(
        "doc_id", "keep_id", "group_size", (F.col("held") & (F.col("place") == F.col("first"))).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the one with the largest doc_id."""
    groups = written(exact_groups(docs).select("doc_id", "kept", "text_sha256"), "exact-kept")
    by_id = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("stays"))
    other, sha, kept_sha = (free_name(docs, name) for name in ("exact_id", "exact_sha", "exact_kept_sha"))
    same_id = F.col("doc_id").eqNullSafe(F.col(other))
    gone = written(by_id.where("n > 1 or not stays").select(F.col("doc_id").alias(other), (F.col("n") > 1).alias("repeated"), "stays"), "exact-gone")
    once = docs.join(sent_if_few(gone.select(other)), same_id, "left_anti")
    repeated = gone.where("repeated and stays").select(other)
    if repeated.isEmpty():
        return once
    # rows that share a doc_id are told apart by their text
    again = docs.join(sent_if_few(repeated), same_id, "left_semi")
    again = again.withColumn(sha, F.sha2(F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256))
    stay = groups.where("kept").select(F.col("doc_id").alias(other), F.col("text_sha256").alias(kept_sha))
    return once.unionByName(again.join(stay, same_id & (F.col(sha) == F.col(kept_sha)), "left_semi").dropDuplicates([sha]).drop(sha))
