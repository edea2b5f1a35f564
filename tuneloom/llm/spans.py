"""Substring dedup with sliding sentence spans.

A text is a sequence of segments, each up to and with its sentence end or line break; segments with words are its
sentences. A span is a run of consecutive sentences that is just long enough: at least `SENTENCES` sentences and
`LEAST_WORDS` words, or `ENOUGH_WORDS` words. Such a run is taken from every sentence forwards and backwards. Spans are
equal when their words are (A-Z lower-cased, without punctuation); they meet by a 128-bit hash. The first occurrence
by (doc_id, sentence) stays; sentences covered by any other occurrence are removed. Segments without words go with the
sentence before them.

Only hashes that occur twice travel with their places. A span that a third of all documents share is counted before
the shuffle, and its places are dealt out by adaptive skew joins.

Cases: null and wordless texts have no sentences and stay as they are (null as empty). Rows without doc_id neither lose
nor cost others a sentence. Rows that repeat a doc_id are the same document; each gets the document's cuts. An empty
table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.text import IS_WORD, as_bytes, mix, raw, slices, word_hashes, written

SENTENCES = 3
LEAST_WORDS = 10
ENOUGH_WORDS = 30
SEGMENT = rb"[^.!?\n]*[.!?\n]+|[^.!?\n]+"

_SEGMENT = re.compile(SEGMENT)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_A_BACK, _B_BACK = (np.uint64(pow(int(x), -1, 1 << 64)) for x in (_A, _B))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


def sentence_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every sentence of all texts: its row, its first word and the word after its last (numbers over all texts)."""
    data, ends = raw(texts)
    hashes, rows = word_hashes(texts)
    if not len(hashes):
        return (np.empty(0, np.int64),) * 3
    # a sentence ends between two words with an end mark or a text's end between them
    marks = np.concatenate([[0], np.cumsum((data == 10) | (data == 33) | (data == 46) | (data == 63))])
    inside = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | edge[1:-1]]))
    new = np.concatenate([[True], (marks[starts[1:]] != marks[starts[:-1]]) | (rows[1:] != rows[:-1])])
    first = np.flatnonzero(new)
    return rows[first], first, np.append(first[1:], len(hashes))


def runs(rows: np.ndarray, first: np.ndarray, after: np.ndarray, sentences: int, least: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of every span, each once."""
    n = len(rows)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.arange(n)
    begin_of_row = np.searchsorted(rows, rows, "left")
    end_of_row = np.searchsorted(rows, rows, "right")
    forward = np.minimum(np.maximum(place + sentences - 1, np.searchsorted(after, first + least, "left")), np.searchsorted(after, first + enough, "left"))
    backward = np.maximum(np.minimum(place - sentences + 1, np.searchsorted(first, after - least, "right") - 1), np.searchsorted(first, after - enough, "right") - 1)
    pairs = np.concatenate([
        np.column_stack([place, forward])[forward < end_of_row], np.column_stack([backward, place])[(backward >= begin_of_row)]])
    keys = np.unique(pairs[:, 0] * (n + 1) + pairs[:, 1])
    return keys // (n + 1), keys % (n + 1)


_SPANS_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_SPANS = "h1 long, h2 long, doc_id long, first int, last int"


def _spans(sentences: int, least: int, enough: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            hashes, _ = word_hashes(texts)
            rows, begin, after = sentence_words(texts)
            first, last = runs(rows, begin, after, sentences, least, enough)
            if not len(first):
                continue
            prints = []
            for base, back in ((_A, _A_BACK), (_B, _B_BACK)):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ base) * _powers(base, len(hashes) - 1), dtype=np.uint64)])
                prints.append(mix((total[after[last]] - total[begin[first]]) * _powers(back, len(hashes))[begin[first]] + (after[last] - begin[first]).astype(np.uint64)).view(np.int64))
            zero = np.searchsorted(rows, rows[first], "left")
            yield pa.RecordBatch.from_arrays([
                pa.array(prints[0]), pa.array(prints[1]), batch.column("doc_id").take(pa.array(rows[first])),
                pa.array((first - zero).astype(np.int32)), pa.array((last - zero).astype(np.int32))], schema=_SPANS_ARROW)

    return run


def repeated_sentences(docs: DataFrame, sentences: int = SENTENCES, least: int = LEAST_WORDS, enough: int = ENOUGH_WORDS) -> DataFrame:
    """(doc_id, cuts): the runs of sentences (first, last) to remove from each document that has any."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    found = texts.mapInArrow(_spans(sentences, least, enough), _SPANS)
    again = found.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1")
    places = written(found.join(again, "h1", "left_semi"), "span-places")
    firsts = places.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "first", "last")).alias("least"), F.count("*").alias("n")).where("n > 1").select(
        F.col("h1").alias("k1"), F.col("h2").alias("k2"), "least")
    later = places.join(firsts, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where(
        (F.col("doc_id") != F.col("least.doc_id")) | (F.col("first") != F.col("least.first")) | (F.col("last") != F.col("least.last")))
    return later.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("cuts"))


_KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def cut_text(text: bytes, cuts: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """The number of sentences, how many go, and the text that stays."""
    sentence, gone, kept = -1, set(), []
    for first, last in cuts:
        gone.update(range(first, last + 1))
    for segment in _SEGMENT.findall(text):
        if IS_WORD[np.frombuffer(segment, np.uint8)].any():
            sentence += 1
        if sentence not in gone:
            kept.append(segment)
    return sentence + 1, len(gone), b"".join(kept)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = [cut_text(t, [(c["first"], c["last"]) for c in cuts or ()]) for t, cuts in zip(as_bytes(batch.column("text")), batch.column("cuts").to_pylist(), strict=True)]
        n, gone, text = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([t.decode() for t in text], pa.string())], schema=_KEPT_ARROW)


def without_repeats(docs: DataFrame, sentences: int = SENTENCES, least: int = LEAST_WORDS, enough: int = ENOUGH_WORDS) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed, text (what stays of it)."""
    cuts = repeated_sentences(docs, sentences, least, enough)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(cuts, "doc_id", "left").mapInArrow(_cut, "doc_id long, n_sentences long, n_removed long, text string")
