"""Ranked lexical search: MaxScore over segments of documents, with bounds on pairs of terms.

`build` cuts the documents into segments of bounded size and gives each an inverted index: for every term the documents
that hold it and how often. Segments are whole in themselves, so postings cross the network only to bring the lists of a
segment together. `search` takes the queries in blocks of bounded size. For a block it

1. turns the lists of its terms into scores and precomputes, per segment, the intersection lists of term pairs: the
   documents that hold both, with the score of both together. The largest of a list is the bound of its term or pair;
2. finds for every query a score that its k-th best document surely reaches, from the best entries of its lists;
3. runs MaxScore per segment. Of the terms in the order of their bounds, neighbours are matched into disjoint pairs; a pair
   is bound by the largest of its joint maximum and its two single maxima, where MaxScore adds these up. Terms whose
   bounds together cannot reach the threshold are not opened for new documents, and a document is dropped as soon as what
   is left cannot lift it: once the first term of a pair is known, the second adds what the joint maximum leaves.

Nothing is skipped that could still be among the k best: bounds are exact integers and ties stay in until the end, so the
result equals that of scoring every document.

Scores are integers: w of a term is floor(1000 ln((2N+2)/(2df+1))), m of a document 75 + 25 n N div L, the score the sum of
w * (10^9 tf div (1000 tf + 12 m)) over the query's terms with repeats, where N documents have terms, L terms in all, n in
the document, and a term stands in df documents, tf times in this one.

Cases: null and empty texts and those without words are in no list and count in neither N nor L. Texts longer than a
slice are read in parts cut between words. Rows with the same doc_id are documents of their own; equal scores are ordered
by doc_id, null last. A null item_id is an item like others; equal rows of items count once, and different texts under
one item_id are one query with the terms of all. Queries without words, or whose terms no document holds, and empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.llm.ranks import ranked
from tuneloom.llm.text import SLICE_BYTES, WORD_TABLE, raw, slices, written

SEGMENT_BYTES = 16 << 20
#: Terms of queries, counted per query, that a block holds; one query more may pass it.
BLOCK_TERMS = 50_000
#: A term is paired with so many terms that come next by weight.
PARTNERS = 2
#: Terms that are sent to all tasks to choose lists by; an index for more terms keeps all lists.
CHOSEN_TERMS = 500_000
#: Segments whose best entries raise the thresholds before the search; fewer or more change the work, not the result.
PRIME_SEGMENTS = 1000

_CLEAN = np.frombuffer(WORD_TABLE, dtype=np.uint8)
LISTS = "segment long, term string, docs binary, counts binary, ids array<long>, size long, total long"
_LISTS_ARROW = pa.schema([
    ("segment", pa.int64()), ("term", pa.string()), ("docs", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("size", pa.int64()), ("total", pa.int64())])


# Index


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts lower-cased with blanks for separators, and the row of the first; a long text comes in several parts."""
    data, ends = raw(texts)
    clean = _CLEAN[data]
    if len(texts) > 1 or len(clean) <= SLICE_BYTES:
        yield 0, pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(clean))
        return
    blanks, begin = np.flatnonzero(clean == 32), 0
    while begin < len(clean):
        # up to the last blank within a slice, or the first one after it
        k = int(np.searchsorted(blanks, begin + SLICE_BYTES))
        stop = len(clean) if begin + SLICE_BYTES >= len(clean) or not len(blanks) else int(blanks[k - 1]) + 1 if k and blanks[k - 1] >= begin else int(blanks[k]) + 1 if k < len(blanks) else len(clean)
        part = np.ascontiguousarray(clean[begin:stop])
        yield 0, pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(part)], np.int64)), pa.py_buffer(part))
        begin = stop


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, place in the dictionary, count) of every distinct word of every text, and the dictionary."""
    split = pc.ascii_split_whitespace(texts)
    words, rows = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(words), 0)
    words, rows = words.filter(full), rows[full.to_numpy(zero_copy_only=False)]
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    keys, counts = np.unique(rows.astype(np.int64) * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return keys // size, keys % size, counts, coded.dictionary


class _Segment:
    """Words of documents until they are turned into lists."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.words: list[pa.Array] = []
        self.documents = self.dictionary = self.bytes = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        for first, part in _parts(texts):
            rows, codes, counts, words = _counted(part)
            self.found.append((rows + first + self.documents, codes + self.dictionary, counts))
            self.words.append(words)
            self.dictionary += len(words)
        self.ids.append(ids)
        self.documents += len(ids)
        self.bytes += texts.nbytes

    def lists(self, number: int, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        """A row for the documents, those without words left out, and one for each term."""
        docs, codes, counts = (np.concatenate(x) for x in zip(*self.found, strict=True))
        if not len(docs):
            return
        same = pa.concat_arrays(self.words).dictionary_encode()
        terms = same.indices.to_numpy(zero_copy_only=False)[codes]
        # parts of one text may both hold a word
        keys, where = np.unique(terms.astype(np.int64) * self.documents + docs, return_inverse=True)
        counts = np.bincount(where, weights=counts).astype(np.int64)
        terms, docs = keys // self.documents, keys % self.documents
        lengths = np.bincount(docs, weights=counts, minlength=self.documents).astype(np.int64)
        full = np.flatnonzero(lengths)
        docs, lengths = np.searchsorted(full, docs), lengths[full]
        ids = pa.concat_arrays(self.ids).take(pa.array(full))
        yield pa.RecordBatch.from_arrays([
            pa.array([number]), pa.array([None], pa.string()), pa.array([None], pa.binary()), pa.array([lengths.astype("<i8").tobytes()], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([len(ids)]), pa.array([int(lengths.sum())])], schema=_LISTS_ARROW)
        starts = np.concatenate([np.flatnonzero(np.diff(terms, prepend=-1)), [len(terms)]])
        for k in range(0, len(starts) - 1, rows):
            cuts = starts[k : k + rows + 1]
            some = slice(cuts[0], cuts[-1])
            steps = np.diff(docs[some], prepend=0)
            steps[cuts[:-1] - cuts[0]] = docs[cuts[:-1]]
            n = len(cuts) - 1
            ends = pa.py_buffer(((cuts - cuts[0]) * 4).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, number)), same.dictionary.take(pa.array(terms[cuts[:-1]])).cast(pa.string()),
                pa.BinaryArray.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(steps.astype("<i4"))]), pa.BinaryArray.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(counts[some].astype("<i4"))]),
                pa.nulls(n, pa.list_(pa.int64())), pa.array(np.diff(cuts)), pa.array(np.add.reduceat(counts[some], cuts[:-1] - cuts[0]))], schema=_LISTS_ARROW)


def _indexed(segment_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, segment = TaskContext.get().partitionId() << 32, _Segment()
        for batch in slices(batches, "text"):
            segment.add(batch.column("doc_id"), batch.column("text"))
            if segment.bytes >= segment_bytes:
                yield from segment.lists(number)
                number, segment = number + 1, _Segment()
        if segment.documents:
            yield from segment.lists(number)

    return run


class Index(NamedTuple):
    """The lists of all segments (`LISTS`; a null term is the segment's documents), N and L."""

    lists: DataFrame
    documents: int
    words: int


def build(docs: DataFrame, terms: DataFrame | None = None, segment_bytes: int = SEGMENT_BYTES) -> Index:
    """The index of `docs`; with `terms` (a written table with a column `term`) only their lists are kept, for searches that use no others."""
    lists = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_indexed(segment_bytes), LISTS)
    if terms is not None:
        wanted = written(terms.select("term").distinct(), "search-vocabulary")
        if wanted.count() <= CHOSEN_TERMS:
            lists = _with_terms(lists, wanted)
    lists = written(lists, "search-lists")
    size = lists.where("term is null").agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return Index(lists, *size)


def _with_terms(lists: DataFrame, few: DataFrame) -> DataFrame:
    """The documents and the lists of these terms, which go to all tasks: a common term has a list in every segment."""
    few = F.broadcast(few.select(F.col("term").alias("_wanted")))
    return lists.join(few, F.col("term") == F.col("_wanted"), "left").where("term is null or _wanted is not null").drop("_wanted")


def words_of(text: Column) -> Column:
    """The words of a text, empty ones included."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def queries_of(items: DataFrame) -> DataFrame:
    """item_id, term, times of every distinct term of each item."""
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    return rows.select("item_id", F.explode(words_of(F.col("text"))).alias("term")).where("term != ''").groupBy("item_id", "term").agg(F.count("*").alias("times"))


# Blocks of queries


class Block:
    """Queries of bounded size: per item its terms and how often each stands there, and the pairs to be intersected."""

    def __init__(self, rows: list, partners: int) -> None:
        weights = {r["term"]: r["weight"] for r in rows}
        self.terms = sorted(weights)
        place = {t: k for k, t in enumerate(self.terms)}
        self.weights = [weights[t] for t in self.terms]
        self.items: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            self.items.setdefault(r["item"], []).append((place[r["term"]], r["times"]))
        self.pairs_of: dict[int, list[tuple[int, int]]] = {}
        for item, terms in self.items.items():
            terms.sort(key=lambda x: (-self.weights[x[0]] * x[1], x[0]))
            self.pairs_of[item] = [(min(a, b), max(a, b)) for n, (a, _) in enumerate(terms) for b, _ in terms[n + 1 : n + 1 + partners]]
        self.pairs = set().union(*self.pairs_of.values())


class Entry(NamedTuple):
    """A list: documents ascending, their scores, the largest one."""

    docs: np.ndarray
    scores: np.ndarray
    most: int


def intersection(a: Entry, b: Entry) -> Entry | None:
    """The documents of both lists and their joint scores."""
    if len(a.docs) > len(b.docs):
        a, b = b, a
    at = np.searchsorted(b.docs, a.docs)
    at[at == len(b.docs)] = 0
    both = b.docs[at] == a.docs
    if not both.any():
        return None
    scores = a.scores[both] + b.scores[at[both]]
    return Entry(a.docs[both], scores, int(scores.max()))


SCORED = "segment long, kind string, a long, b long, most long, docs binary, scores binary, ids array<long>"
_SCORED_ARROW = pa.schema([
    ("segment", pa.int64()), ("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("most", pa.int64()), ("docs", pa.binary()), ("scores", pa.binary()),
    ("ids", pa.list_(pa.int64()))])


def _score(block: Block, documents: int, words: int, k: int) -> Callable[[pa.Table], pa.Table]:
    """Lists of one segment to scores, pairs, and the best entries of each item's best list."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["term"] is None)
        segment, lengths = own["segment"], np.frombuffer(own["counts"], "<i8")
        m = 75 + 25 * lengths * documents // words
        entries: dict[tuple[int, int], Entry] = {}
        for r in rows:
            if r["term"] is not None:
                a = bisect.bisect_left(block.terms, r["term"])
                docs, times = np.cumsum(np.frombuffer(r["docs"], "<i4"), dtype=np.int64), np.frombuffer(r["counts"], "<i4").astype(np.int64)
                scores = block.weights[a] * (1_000_000_000 * times // (1000 * times + 12 * m[docs]))
                entries[a, -1] = Entry(docs.astype(np.int32), scores, int(scores.max()))
        for a, b in sorted(block.pairs):
            if (a, -1) in entries and (b, -1) in entries and (both := intersection(entries[a, -1], entries[b, -1])):
                entries[a, b] = both
        tops = {key: np.sort(e.scores)[: -k - 1 : -1] for key, e in entries.items()}
        sums = {key: int(t.sum()) for key, t in tops.items()}
        out = [(segment, "documents", -1, -1, 0, b"", b"", own["ids"])]
        out += [(segment, "term" if b < 0 else "pair", a, b, e.most, e.docs.astype("<i4").tobytes(), e.scores.astype("<i8").tobytes(), None) for (a, b), e in entries.items()]
        for item, terms in block.items.items():
            keys = [*((a, -1) for a, _ in terms), *block.pairs_of[item]]
            best = max((key for key in keys if key in sums), key=sums.__getitem__, default=None)
            if best is not None:
                out.append((segment, "prime", item, -1, 0, b"", tops[best].astype("<i8").tobytes(), None))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _SCORED_ARROW, strict=True)], schema=_SCORED_ARROW)

    return run


# MaxScore


class Bounds(NamedTuple):
    """A query's terms that the segment has, by ascending bound.

    `upto[p]` is the most that a document can get from the first p terms: neighbours in this order are matched into disjoint
    pairs, bound by the joint maximum, where that is least. `joint[p]` is that of the terms p and p - 1, None if unknown.
    """

    terms: list[tuple[int, int]]
    alone: list[int]
    joint: list[int | None]
    upto: list[int]


def bounds_of(terms: list[tuple[int, int]], entries: dict[tuple[int, int], Entry], pairs: set[tuple[int, int]]) -> Bounds:
    here = sorted((entries[a, -1].most * n, a, n) for a, n in terms if (a, -1) in entries)
    alone, joint, upto = [m for m, _, _ in here], [], [0]
    for p, (most, a, n) in enumerate(here):
        both = None
        if p:
            other, b, n2 = here[p - 1]
            key = (min(a, b), max(a, b))
            if key in entries:
                # the joint maximum holds for one of each; further repeats add their single maxima
                both = max(most, other, entries[key].most + entries[a, -1].most * (n - 1) + entries[b, -1].most * (n2 - 1))
            elif key in pairs:
                both = max(most, other)
        joint.append(both)
        upto.append(upto[p] + most if both is None else min(upto[p] + most, upto[p - 1] + both))
    return Bounds([(a, n) for _, a, n in here], alone, joint, upto)


class Work:
    """Postings read, for tests."""

    def __init__(self) -> None:
        self.postings = 0


def best_of(
    terms: list[tuple[int, int]], entries: dict[tuple[int, int], Entry], pairs: set[tuple[int, int]], documents: int, k: int, threshold: int, work: Work | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a segment that may be among the k best of a query, and their scores: all that reach the k-th and the threshold."""
    work, bounds = work or Work(), bounds_of(terms, entries, pairs)
    threshold, left, upto = max(threshold, 1), len(bounds.terms), bounds.upto
    none = np.empty(0, np.int64)
    if upto[left] < threshold:
        return none, none
    scores, seen = np.zeros(documents, np.int64), np.zeros(documents, bool)
    # lists are read whole until the others cannot reach the threshold without them
    while left and upto[left] >= threshold:
        left -= 1
        a, n = bounds.terms[left]
        e = entries[a, -1]
        scores[e.docs] += n * e.scores
        seen[e.docs] = True
        work.postings += len(e.docs)
        threshold = max(threshold, _kth(scores[seen], k))
    found = np.flatnonzero(seen)
    for p in range(left - 1, -1, -1):
        found = found[scores[found] + upto[p + 1] >= threshold]
        if not len(found):
            return none, none
        a, n = bounds.terms[p]
        hit, at = _held(entries[a, -1], found)
        got = np.where(hit, n * entries[a, -1].scores[at], 0)
        work.postings += min(len(found), len(entries[a, -1].docs))
        scores[found] += got
        threshold = max(threshold, _kth(scores[found], k))
        if bounds.joint[p] is not None:
            # the other term of the pair adds what the joint maximum leaves, and no more than its own
            rest = np.minimum(bounds.alone[p - 1], np.where(hit, bounds.joint[p] - got, bounds.alone[p - 1]))
            found = found[scores[found] + upto[p - 1] + rest >= threshold]
    found = found[scores[found] >= threshold]
    return found, scores[found]


def _held(e: Entry, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(e.docs, docs)
    at[at == len(e.docs)] = 0
    return e.docs[at] == docs, at


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


FOUND = "item long, doc_id long, score long"
_FOUND_ARROW = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searched(block: Block, thresholds: dict[int, int], k: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        entries, ids = {}, pa.array([], pa.int64())
        for r in table.to_pylist():
            if r["kind"] == "documents":
                ids = pa.array(r["ids"], pa.int64())
            else:
                entries[r["a"], r["b"]] = Entry(np.frombuffer(r["docs"] or b"", "<i4"), np.frombuffer(r["scores"] or b"", "<i8"), r["most"])
        items, docs, found = [], [], []
        last = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        for item, terms in block.items.items():
            rows, scores = best_of(terms, entries, block.pairs, len(ids), k, thresholds.get(item, 0))
            first = np.lexsort((last[rows], -scores))[:k]
            items.append(np.full(len(first), item, np.int64))
            docs.append(rows[first])
            found.append(scores[first])
        columns = [pa.array(np.concatenate(items)), ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(found))]
        return pa.Table.from_arrays(columns, schema=_FOUND_ARROW)

    return run


def search(index: Index, queries: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS, partners: int = PARTNERS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each query (item_id, term, times)."""
    spark = queries.sparkSession
    named = queries.groupBy("item_id").agg(F.count("*").alias("_n")).select("item_id", F.monotonically_increasing_id().alias("item"))
    names = written(named, "search-items").withColumnRenamed("item_id", "_item_id")
    rows = written(queries.join(names, F.col("item_id").eqNullSafe(F.col("_item_id"))).select("item", "term", "times"), "search-queries")
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = index.lists.where("term is not null").groupBy("term").agg(F.sum("size").alias("df")).select("term", weight.alias("weight")).where("weight > 0")
    placed = ranked(written(rows.join(weights, "term"), "search-terms"), [], ["item", "term"], "search-order")
    first = F.min("rank").over(Window.partitionBy("item"))
    blocks = written(placed.select("item", "term", "times", "weight", F.floor(first / block_terms).alias("block")), "search-blocks")
    found = spark.createDataFrame([], FOUND)
    for number in sorted(r["block"] for r in blocks.select("block").distinct().collect()):
        block = Block(blocks.where(F.col("block") == number).collect(), partners)
        found = found.unionByName(written(_block_search(index, block, k), "search-found"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(names, "item").select(F.col("_item_id").alias("item_id"), "rank", "doc_id", "score")


def _block_search(index: Index, block: Block, k: int) -> DataFrame:
    lists = _with_terms(index.lists, index.lists.sparkSession.createDataFrame([(t,) for t in block.terms], "term string"))
    scored = written(lists.select("segment", "term", "docs", "counts", "ids").groupBy("segment").applyInArrow(_score(block, index.documents, index.words, k), SCORED), "search-scored")
    segments = max(1, scored.where("kind = 'documents'").count())
    primes = scored.where("kind = 'prime'").where(F.pmod(F.xxhash64("segment"), F.lit(1_000_000)) < 1_000_000 * min(1.0, PRIME_SEGMENTS / segments))
    reached = primes.select(F.col("a").alias("item"), "scores").groupBy("item").applyInArrow(_reached(k), "item long, threshold long")
    thresholds = {r["item"]: r["threshold"] for r in reached.collect()}
    # of pairs the bound is enough
    terms = F.col("kind") == "term"
    lists = scored.where("kind != 'prime'").select("segment", "kind", "a", "b", "most", F.when(terms, F.col("docs")).alias("docs"), F.when(terms, F.col("scores")).alias("scores"), "ids")
    return lists.groupBy("segment").applyInArrow(_searched(block, thresholds, k), FOUND)


def _reached(k: int) -> Callable[[pa.Table], pa.Table]:
    """The k-th largest of an item's entries, which are of different documents."""

    def run(table: pa.Table) -> pa.Table:
        scores = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("scores").to_pylist()])
        return pa.table({"item": table.column("item")[:1].cast(pa.int64()), "threshold": pa.array([_kth(scores, k)], pa.int64())})

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, segment_bytes: int = SEGMENT_BYTES, block_terms: int = BLOCK_TERMS, partners: int = PARTNERS) -> DataFrame:
    """The k best documents of every item: item_id, rank (from 1), doc_id, score (see the module)."""
    queries = written(queries_of(items), "search-words")
    return search(build(docs, queries, segment_bytes), queries, k, block_terms, partners)
