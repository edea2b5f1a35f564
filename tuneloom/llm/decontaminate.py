"""Benchmark decontamination with an FM-index per shard of the training texts.

A window is `SPAN` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A task
gathers the texts of a shard, writes them as symbols, builds the index, searches every window backwards through the
wavelet-tree ranks, locates the occurrences by sampled positions and merges them into spans of words per document.

Only words of the benchmark can stand in an occurrence. All other words, and stretches of benchmark words shorter
than the shortest window, are left out of the index; a boundary symbol stands in their place.

The windows are a stated query set. They are read in blocks of about `BLOCK_WINDOWS`; each block goes once over all
shards and adds its spans to those the row has from the blocks before, without a shuffle.

Cases: null and wordless texts have no words and no hits; null items and items without words have no windows. Rows
are answered one by one, so repeated rows, null doc_ids and ties need no rule. Rows of the benchmark that repeat an
item_id count once; a null item_id is not counted as an item, but its windows hit. An empty benchmark hits nothing. Other
columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.fm_index import FMIndex
from tuneloom.llm.text import WORD_TABLE, as_bytes, slices

SPAN = 10
BLOCK_WINDOWS = 200_000
SHARD_SYMBOLS = 1 << 20
SHARD_BYTES = 32 << 20


class Phrases:
    """The windows of a block of items as symbols, and the items of each window."""

    def __init__(self) -> None:
        self.symbols: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set[str]] = defaultdict(set)

    def add(self, item_id: str | None, words: list[bytes], span: int) -> None:
        # 1 is the boundary
        numbers = [self.symbols.setdefault(w, len(self.symbols) + 2) for w in words]
        for k in range(max(1, len(numbers) - span + 1) if numbers else 0):
            self.windows[tuple(numbers[k : k + span])] |= {item_id} - {None}

    def frozen(self) -> list[tuple[np.ndarray, list[list[str]]]]:
        """By length: the windows as rows, and the items of each."""
        lengths = sorted({len(w) for w in self.windows})
        return [(np.array([w for w in self.windows if len(w) == n]), [sorted(i) for w, i in self.windows.items() if len(w) == n]) for n in lengths]


def phrase_blocks(benchmark: DataFrame, span: int, most: int) -> Iterator[Phrases]:
    """The items in blocks of about `most` windows, read one after another."""
    block, first = Phrases(), True
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).toLocalIterator():
        block.add(row["i"], row["t"].encode().translate(WORD_TABLE).split(), span)
        if len(block.windows) >= most:
            yield block
            block, first = Phrases(), False
    if first or block.windows:
        yield block


class _Shard:
    """Stretches of benchmark words of many texts, one after another."""

    def __init__(self) -> None:
        self.texts: list[np.ndarray] = []
        self.docs: list[int] = []
        self.words: list[int] = []
        self.size = self.bytes = 0

    def add(self, doc: int, numbers: np.ndarray, shortest: int) -> None:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], numbers > 0, [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= shortest:
                self.texts.append(numbers[a:b])
                self.docs.append(doc)
                self.words.append(a)
                self.size += b - a + 1

    def hits(self, phrases: list[tuple[np.ndarray, list[list[str]]]]) -> Iterator[tuple[int, int, int, list[str]]]:
        """(document, first word, word after the last, items) of every occurrence."""
        if not self.texts:
            return
        lengths = np.array([len(t) + 1 for t in self.texts])
        begins = np.cumsum(lengths) - lengths
        text = np.ones(int(lengths.sum()), np.int64)
        for begin, stretch in zip(begins.tolist(), self.texts, strict=True):
            text[begin : begin + len(stretch)] = stretch
        index = FMIndex(text)
        for windows, items in phrases:
            low, high = index.search(windows)
            found = np.flatnonzero(low < high)
            owner, position = index.locate(low[found], high[found])
            stretch = np.searchsorted(begins, position, "right") - 1
            for w, s, p in zip(found[owner].tolist(), stretch.tolist(), position.tolist(), strict=True):
                first = self.words[s] + p - int(begins[s])
                yield self.docs[s], first, first + windows.shape[1], items[w]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "n_words long, spans array<struct<first:long,after:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))


def _find(symbols: dict[bytes, int], phrases: list[tuple[np.ndarray, list[list[str]]]], shard_symbols: int, schema: pa.Schema) -> Callable:
    """Adds n_words, spans and items to the other columns of `schema`; spans and items that a row has already stay."""
    shortest = min((w.shape[1] for w, _ in phrases), default=1 << 60)
    passed = schema.names[:-3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        counts: list[int] = []
        shard = _Shard()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, counts, shard
            spans: dict[int, list] = defaultdict(list)
            items: dict[int, set[str]] = defaultdict(set)
            for doc, first, after, names in shard.hits(phrases):
                spans[doc].append((first, after))
                items[doc].update(names)
            doc = 0
            for batch in held:
                rows = range(doc, doc + batch.num_rows)
                if "spans" in batch.schema.names:
                    for r, old, names in zip(rows, batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                        if names or old:
                            spans[r] += [(s["first"], s["after"]) for s in old]
                            items[r].update(names)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).cast(schema.field(c).type) for c in passed), pa.array([counts[r] for r in rows], pa.int64()),
                    pa.array([[{"first": a, "after": b} for a, b in merge_spans(spans.get(r, []))] for r in rows], _SPANS),
                    pa.array([sorted(items.get(r, ())) for r in rows], pa.list_(pa.string())),
                ], schema=schema)
                doc += batch.num_rows
            held, counts, shard = [], [], _Shard()

        get = symbols.get
        for batch in slices(batches, "text"):
            for text in as_bytes(batch.column("text")):
                words = text.translate(WORD_TABLE).split()
                shard.bytes += len(text)
                if len(words) >= shortest:
                    shard.add(len(counts), np.fromiter((get(w, 0) for w in words), np.int64, len(words)), shortest)
                counts.append(len(words))
            held.append(batch if "text" in passed else batch.drop_columns(["text"]))
            if shard.size >= shard_symbols or shard.bytes >= SHARD_BYTES:
                yield from flush()
        yield from flush()

    return run


def find_spans(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, block_windows: int = BLOCK_WINDOWS, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (first word, word after the last; apart from each other), items.

    `block_windows` bounds the windows held by a task, `shard_symbols` the words of a shard; neither changes the result.
    """
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = phrase_blocks(benchmark, span, block_windows)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        # all blocks but the last hand the text on
        text, column = ("", []) if following is None else ("text string, ", [("text", pa.string())])
        schema = pa.schema([("doc_id", pa.int64()), *column, ("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])
        found = found.mapInArrow(_find(block.symbols, block.frozen(), shard_symbols, schema), f"doc_id long, {text}{_FOUND}")
        block = following
    return found


def _without_hits(symbols: dict[bytes, int], phrases: list[tuple[np.ndarray, list[list[str]]]], shard_symbols: int, text: int) -> Callable:
    schema = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])
    find = _find(symbols, phrases, shard_symbols, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(text)], ["row", "text"])
            hit = [n > 0 for found in find(iter([rows])) for n in pa.compute.list_value_length(found.column("spans")).to_pylist()]
            yield batch.filter(pa.array([not h for h in hit], pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, block_windows: int = BLOCK_WINDOWS, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with all their columns.

    Each block of windows filters what the block before it left; a shard is a batch of rows or a part of it.
    """
    text = docs.columns.index("text")
    for block in phrase_blocks(benchmark, span, block_windows):
        docs = docs.mapInArrow(_without_hits(block.symbols, block.frozen(), shard_symbols, text), docs.schema)
    return docs


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; a line break stands for each span."""
    words, data = [], (text or "").encode()
    inside = np.frombuffer(data.translate(WORD_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]])))
    words = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    out, at = [], 0
    for first, after in spans:
        out.append(data[at : words[first][0]])
        at = words[after - 1][1]
    return b"\n".join([*out, data[at:]]).decode()
