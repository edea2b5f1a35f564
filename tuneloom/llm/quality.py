"""Document quality by a linear-chain conditional random field over lines.

Every line that is not empty is a node with the states good and bad. Its features describe the line itself and, through
the same measures of the line before and after it, its neighbourhood; transitions between neighbouring states are learned too.
Labels are known for documents only, so all lines of a learning document carry its label. Forward-backward gives every
line its marginal of being good, and the document's score is their mean weighted by the lines' lengths.

Learning is the only step on a sample: `LEARN_DOCUMENTS` labelled documents by the order of a hash of their id, of each all
lines in chains of `CHAIN` lines or, where there are more than `LEARN_LINES`, as many whole chains from the whole document by
the order of a hash of its id and their number. Scoring reads every line of every text.

Cases: a null text and a text without lines score the share of good learning documents. Null labels teach nothing; of
labels that repeat a doc_id the smallest counts. Without learning documents every score is 0.5. Rows are answered one
by one, so repeated rows and null doc_ids (never held out, never taught from) need no rule. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.text import IS_WORD, mix, raw, slices, word_hashes

LEARN_DOCUMENTS = 4000
LEARN_LINES = 512
CHAIN = 32
ROUNDS = 150
RIDGE = 1e-3
LIMIT = 0.3

#: Byte classes whose shares of a line are features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"$%&#*@^~+=<>", b"|\\/_[]{}()", b" \t", bytes(range(128, 256)))
_CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _members in enumerate(CLASSES):
    _CLASS_OF[np.frombuffer(_members, np.uint8)] = _k
_ENDS = np.zeros(256, bool)
_ENDS[np.frombuffer(b".!?:\"'", np.uint8)] = True


@dataclass
class Lines:
    """The lines of a slice: their text's row, length in bytes and features."""

    row: np.ndarray
    length: np.ndarray
    features: np.ndarray


def _runs(values: np.ndarray) -> np.ndarray:
    """For each value whether it differs from the one before."""
    return np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)


def lines_of(texts: pa.Array) -> Lines:
    data, ends = raw(texts)
    cuts = np.union1d(ends, np.flatnonzero(data == 10) + 1)
    begin, stop = cuts[:-1], cuts[1:].copy()
    if len(stop):
        stop[data[stop - 1] == 10] -= 1
    full = stop > begin
    begin, stop = begin[full], stop[full]
    length = stop - begin
    row = np.searchsorted(ends, begin, "right") - 1
    if not len(begin):
        return Lines(row, length, np.empty((0, 3 * _base_width() + 1)))
    kinds = _CLASS_OF[data]
    shares = np.empty((len(begin), len(CLASSES)))
    for k in range(len(CLASSES)):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        shares[:, k] = (total[stop] - total[begin]) / length
    # words by line: white space and punctuation stand between them, so a line's words lie between its edges
    hashes, _ = word_hashes(texts)
    line_of_word = _word_lines(data, begin, ends)
    n = np.bincount(line_of_word, minlength=len(begin))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    again = np.bincount(line_of_word, same, minlength=len(begin))
    keys = np.sort(mix(hashes ^ mix(line_of_word.astype(np.uint64) + np.uint64(1))) >> np.uint64(24) | line_of_word.astype(np.uint64) << np.uint64(40))
    distinct = np.bincount((keys[_runs(keys)] >> np.uint64(40)).astype(np.int64), minlength=len(begin))
    some = np.maximum(n, 1)
    # lines that come again within their text
    line_hash = mix(np.bincount(line_of_word, (hashes >> np.uint64(12)).astype(np.float64), minlength=len(begin)).view(np.uint64) ^ length.astype(np.uint64))
    # numbers of rows lie apart from lengths, of which lines without words have nothing else
    line_key = mix(line_hash ^ mix(row.astype(np.uint64) + np.uint64(1 << 63)))
    _, inverse, times = np.unique(line_key, return_inverse=True, return_counts=True)
    base = np.column_stack([
        shares, np.log1p(length), np.log1p(n), np.log((length + 1) / (some + 1)), distinct / some, again / some, _ENDS[data[stop - 1]], times[inverse] > 1,
        (distinct / some < 0.5) & (n >= 8), shares[:, 4] > 0.05, shares[:, 0] > 0.4, n <= 2])
    return Lines(row, length, _with_neighbours(base.astype(np.float64), row))


def _base_width() -> int:
    return len(CLASSES) + 11


def _word_lines(data: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The line of each word; a word ends with its text."""
    inside = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    starts = inside & np.concatenate([[True], ~inside[:-1] | edge[1:-1]])
    return np.searchsorted(begin, np.flatnonzero(starts), "right") - 1


def _with_neighbours(base: np.ndarray, row: np.ndarray) -> np.ndarray:
    before, after = np.zeros_like(base), np.zeros_like(base)
    same = (row[1:] == row[:-1])[:, None]
    before[1:] = np.where(same, base[:-1], base[1:])
    after[:-1] = np.where(same, base[1:], base[:-1])
    before[:1], after[-1:] = base[:1], base[-1:]
    first = _runs(row)[:, None]
    return np.column_stack([base, np.where(first, base, before), after, first])


# The chain


@dataclass
class Chain:
    """Weights of the features for the odds of good against bad, and of a step between states (rows: from)."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    steps: np.ndarray
    prior: float

    def odds(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.spread, -8, 8) @ self.weights + self.bias


def marginals(odds: np.ndarray, row: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of all chains together: P(good) per line, sums of the pair marginals, log of the totals.

    Lines of a chain stand together; chains take their t-th line in step t, the longest chains first.
    """
    starts = np.flatnonzero(_runs(row))
    sizes = np.diff(np.append(starts, len(row)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    node = np.stack([np.exp(np.minimum(-odds, 0)), np.exp(np.minimum(odds, 0))], axis=1)  # bad, good; the larger is 1
    scale = np.maximum(odds, 0)
    step = np.exp(steps - steps.max())
    forward, backward = np.empty_like(node), np.ones_like(node)
    norm = np.empty(len(odds))
    live = [int(n) for n in np.searchsorted(-sizes, -np.arange(1, sizes.max() + 1), "right")] if len(sizes) else []
    for t, k in enumerate(live):
        at = starts[:k] + t
        value = node[at] if t == 0 else node[at] * (forward[at - 1] @ step)
        norm[at] = value.sum(axis=1)
        forward[at] = value / norm[at, None]
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        value = (node[at + 1] * backward[at + 1]) @ step.T
        backward[at] = value / value.sum(axis=1, keepdims=True)
    both = forward * backward
    good = both[:, 1] / both.sum(axis=1)
    inner = np.flatnonzero(~_runs(row))
    pairs = forward[inner - 1][:, :, None] * step * (node[inner] * backward[inner])[:, None, :]
    pairs = (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return good, pairs, np.log(norm) + scale + np.where(_runs(row), 0, steps.max())


def learn(features: np.ndarray, row: np.ndarray, labels: np.ndarray, prior: float, rounds: int = ROUNDS) -> Chain:
    """Largest conditional likelihood of the lines' labels, by gradient steps with momentum (Adam)."""
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = np.clip((features - mean) / spread, -8, 8)
    x = np.column_stack([x, np.ones(len(x))])
    theta = np.zeros(x.shape[1] + 4)
    inner = np.flatnonzero(~_runs(row))
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[inner - 1], labels[inner]), 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        good, pairs, _ = marginals(x @ theta[:-4], row, theta[-4:].reshape(2, 2))
        slope = np.concatenate([x.T @ (labels - good), (seen - pairs).ravel()]) / len(x) - RIDGE * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta + 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return Chain(mean, spread, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2), prior)


# Jobs


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


_FEATURES_ARROW = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("lines", pa.int32()), ("features", pa.binary())])


def _chosen_lines(doc_id: int, n: int, most: int) -> np.ndarray:
    """The lines of a document with `n` lines to learn from, in their order."""
    lines = np.arange(n)
    if n <= most:
        return lines
    chains = np.arange(-(-n // CHAIN), dtype=np.uint64)
    order = np.argsort(mix(mix(chains + np.uint64(1)) ^ np.array([doc_id], np.int64).view(np.uint64)), kind="stable")
    return lines[np.isin(lines // CHAIN, order[: max(1, most // CHAIN)])]


def _feature_rows(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = lines_of(batch.column("text"))
            edges = np.searchsorted(found.row, np.arange(batch.num_rows + 1))
            parts = [found.features[a + _chosen_lines(i, b - a, most)].astype(np.float32) for i, a, b in zip(batch.column("doc_id").to_pylist(), edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("quality"), pa.array([len(p) for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=_FEATURES_ARROW)

    return run


def fit(docs: DataFrame, labels: DataFrame, documents: int = LEARN_DOCUMENTS, lines: int = LEARN_LINES, rounds: int = ROUNDS) -> Chain:
    """The chain learned from a bounded sample of the labelled documents: see the module."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    sample = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(known, "doc_id").select("doc_id", "quality", "text")
    ids = known.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).select("doc_id")
    rows = sample.join(ids, "doc_id", "left_semi").mapInArrow(_feature_rows(lines), "doc_id long, quality int, lines int, features binary").orderBy("doc_id", "lines").collect()
    width = 3 * _base_width() + 1
    if not rows:
        return Chain(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)), 0.5)
    prior = float(np.mean([r["quality"] for r in rows]))
    features = np.concatenate([np.frombuffer(r["features"], np.float32).reshape(-1, width) for r in rows]).astype(np.float64)
    counts = np.array([r["lines"] for r in rows])
    owner = np.repeat(np.arange(len(rows)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    chains = owner * (lines // CHAIN + 1) + inside // CHAIN
    return learn(features, chains, np.array([r["quality"] for r in rows])[owner], prior, rounds) if len(features) else Chain(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)), prior)


def document_scores(texts: pa.Array, chain: Chain) -> np.ndarray:
    found = lines_of(texts)
    scores = np.full(len(texts), chain.prior)
    if len(found.row):
        good, _, _ = marginals(chain.odds(found.features), found.row, chain.steps)
        weight = np.bincount(found.row, found.length, minlength=len(texts))
        some = weight > 0
        scores[some] = np.bincount(found.row, found.length * good, minlength=len(texts))[some] / weight[some]
    return np.clip(scores, 0.0, 1.0)


_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, chain: Chain, limit: float = LIMIT) -> DataFrame:
    """One row per document: doc_id, score, predicted (1 if the score reaches `limit`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = document_scores(batch.column("text"), chain)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= limit).astype(np.int32))], schema=_SCORES_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
