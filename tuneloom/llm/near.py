"""N-gram Jaccard join by chosen paths.

Sets are the five-word shingles of a text. Equal sets form a class; a pair of classes is a link when the Jaccard
similarity of its sets is at least the threshold.

1. Every set is embedded in `WIDTH` tokens (place, smallest hash at that place). Two sets share a token with the
   probability of their similarity.
2. A run walks down a random tree: a node samples tokens, each with probability 1 / (threshold * WIDTH), and a set goes
   to the child of every sampled token that it has. The choice depends on node and token alone, so two sets that share
   a sampled token meet. Nodes of at most `BUCKET` sets are leaves, and so are nodes whose sets share most tokens; any
   other node splits again.
3. Inside a leaf all pairs are compared: first on the embedded tokens, then exactly on the whole shingle sets. A leaf
   larger than `BLOCK` is dealt out as pairs of blocks, so a group of any size is spread over many tasks. A pair is
   counted only in the first leaf that both sets have.
4. Runs are repeated until a pair at the threshold is missed with a probability of at most 1 - recall.

A leaf returns for each set its number of links and the smallest member it hangs together with, never the pairs.

Cases: null or wordless texts have no shingles, no links and a class of their own; a text of one to four words is one
shingle. Rows without doc_id are returned with null classes and no links. Rows that repeat a doc_id are judged each by
its own text: sets have numbers of their own until the end. An empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.text import free_name, mix, sent_if_few, shingles, slices, written
from tuneloom.session import shuffle_width

THRESHOLD = 0.8
RECALL = 0.9999
WIDTH = 64
BUCKET = 2048
BLOCK = 1024
MAX_DEPTH = 6
#: Share of common tokens from which a node is compared at once instead of split.
DENSE = 0.4
DENSE_PLACES = 4
#: Standard deviations by which the embedded similarity of a pair may fall short before the pair is dropped.
SLACK = 5.5

_SEED = np.uint64(0x5851F42D4C957F2D)
_COEFFICIENTS = mix(np.arange(1, 2 * WIDTH + 1, dtype=np.uint64) * _SEED).astype(np.uint32).reshape(2, WIDTH) | np.uint32(1)


def runs_needed(depth: int, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has met with probability `recall` in a leaf of that depth.

    The children of a node that both sets of such a pair have are close to Poisson with mean 1.
    """
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


# Step 1: sets and their embedding


def _tokens(hashes: np.ndarray) -> np.ndarray:
    least = np.full(WIDTH, 2**32 - 1, np.uint32)
    for begin in range(0, len(hashes), 4096):
        low = (hashes[begin : begin + 4096] >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, (((low[:, None] ^ _COEFFICIENTS[0]) * _COEFFICIENTS[1])).min(axis=0), out=least)
    return least


_SETS = "doc_id long, text_hash long, size int, print1 long, print2 long, tokens binary"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("size", pa.int32()), ("print1", pa.int64()), ("print2", pa.int64()), ("tokens", pa.binary())])


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = shingles(batch.column("text"))
        prints = np.array([(mix(s ^ _SEED).sum(dtype=np.uint64), s.sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints[:, 0]), pa.array(prints[:, 1]),
            pa.array([_tokens(s).tobytes() if len(s) else None for s in sets], pa.binary()),
        ], schema=_SETS_ARROW)


# Step 2: paths


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, WIDTH)


_PATHS = "path long, set_id long"
_PATHS_ARROW = pa.schema([("path", pa.int64()), ("set_id", pa.int64())])
_PLACE = mix(np.arange(1, WIDTH + 1, dtype=np.uint64))


def _children(tokens: np.ndarray, nodes: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes of the tokens that each row's node samples."""
    drawn = mix(mix(tokens.astype(np.uint64) ^ _PLACE) + nodes[:, None])
    rows, places = np.nonzero(drawn < np.uint64(min(2.0**64 - 2048, rate / WIDTH * 2.0**64)))
    return rows, mix(drawn[rows, places] ^ _SEED)


def _roots(runs: range, rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ids = _matrix(batch.column("tokens")), np.asarray(batch.column("set_id"))
            for r in runs:
                rows, paths = _children(tokens, np.full(len(ids), mix(np.uint64([r + 1]) * _SEED)[0]), rate)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(ids[rows])], schema=_PATHS_ARROW)

    return run


def _inner(rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.asarray(batch.column("path")).view(np.uint64)
            rows, paths = _children(_matrix(batch.column("tokens")), nodes, rate)
            yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(np.asarray(batch.column("set_id"))[rows])], schema=_PATHS_ARROW)

    return run


def _dense_nodes(members: DataFrame) -> DataFrame:
    """Nodes whose sets agree in most tokens: mean over some places of the chance that two sets share the token."""
    words = [F.substring("tokens", 4 * p + 1, 4) for p in range(0, WIDTH, WIDTH // DENSE_PLACES)]
    long = members.select("path", "n", F.posexplode(F.array(*words)).alias("place", "token"))
    counts = long.groupBy("path", "place", "token").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    share = F.sum((F.col("c") / F.col("n")) ** 2) / DENSE_PLACES
    return counts.groupBy("path").agg(share.alias("share")).where(F.col("share") >= DENSE).select("path")


def _walk(sets: DataFrame, runs: range, rate: float, bucket: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(path, set_id, n) of the leaves of these runs with two sets or more, the sets of split nodes, the depth reached."""
    paths = sets.select("set_id", "tokens").mapInArrow(_roots(runs, rate), _PATHS)
    done = split = None
    for depth in range(1, MAX_DEPTH + 1):
        sizes = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        level = written(paths.join(sizes, "path"), "near-level")
        big = level.where(F.col("n") > bucket)
        if depth == MAX_DEPTH or big.isEmpty():
            return level if done is None else done.unionByName(level), split, depth
        members = written(big.join(sets.select("set_id", "tokens"), "set_id"), "near-big")
        dense = written(_dense_nodes(members), "near-dense")
        ready = level.where(F.col("n") <= bucket).unionByName(big.join(dense, "path", "left_semi"))
        done = ready if done is None else done.unionByName(ready)
        sparse = written(members.join(dense, "path", "left_anti").select("path", "set_id", "tokens"), "near-split")
        if sparse.isEmpty():
            return done, split, depth
        split = sparse.select("set_id").distinct() if split is None else split
        paths = sparse.mapInArrow(_inner(rate), _PATHS)
    raise AssertionError("the last level returns")


def leaves(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """(path, set_id, n) of the leaves of as many runs as the target recall takes.

    Sets that met in leaves of the first level need the fewest runs. Sets of split nodes walk again until the runs
    suffice for the depth that their leaves reached.
    """
    have = runs_needed(1, recall)
    found, split, depth = _walk(sets, range(have), 1 / threshold, bucket)
    while split is not None and have < (need := runs_needed(depth, recall)):
        again = written(sets.join(split, "set_id", "left_semi"), "near-again")
        more, _, reached = _walk(again, range(have, need), 1 / threshold, bucket)
        found, have, depth = found.unionByName(more), need, max(depth, reached)
    return found


# Step 3: pairs inside leaves


def _rows_in_blocks(found: DataFrame, block: int) -> DataFrame:
    """A leaf of up to `block` sets is one group; a larger one is dealt out as all pairs of its blocks."""
    several = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("set_id"), several).cast("int")
    return found.select("path", "set_id", mine.alias("own"), F.explode(F.sequence(F.lit(0), several - 1)).alias("other")).select(
        "path", "set_id", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own")


class _Groups:
    """Rows of a partition sorted by (path, low, high), given out group by group."""

    KEYS = ("path", "low", "high")

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.batches = batches

    def __iter__(self) -> Iterator[pa.Table]:
        rest = None
        for batch in self.batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            edges = self._edges(rest)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield rest.slice(a, b - a)
            rest = rest.slice(edges[-1])
        if rest is not None and rest.num_rows:
            yield rest

    def _edges(self, table: pa.Table) -> list[int]:
        if not table.num_rows:
            return [0]
        changes = np.zeros(table.num_rows, bool)
        for k in self.KEYS:
            values = table.column(k).to_numpy()
            changes[1:] |= values[1:] != values[:-1]
        return [0, *np.flatnonzero(changes).tolist()]


def _candidates(group: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that share enough tokens and have no earlier leaf in common."""
    own, path = group.column("own").to_numpy(), group.column("path")[0].as_py()
    tokens = _matrix(group.column("tokens").combine_chunks())
    if group.column("low")[0].as_py() == group.column("high")[0].as_py():
        a = b = np.arange(len(own))
    else:
        a, b = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
    if not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shared = np.zeros((len(a), len(b)), np.uint8)
    for place in range(WIDTH):
        shared += tokens[a, place][:, None] == tokens[b, place]
    i, j = np.nonzero(shared >= least)
    i, j = a[i], b[j]
    if a is b:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j
    # earlier leaves of the rows as a matrix of flags; two rows met before when they share one
    flat = group.column("earlier").combine_chunks()
    owner = np.repeat(np.arange(len(own)), np.diff(flat.offsets.to_numpy()))
    names = flat.flatten().to_numpy()
    before = names < path
    owner, names = owner[before], names[before]
    if len(names):
        distinct, names = np.unique(names, return_inverse=True)
        flags = np.zeros((len(own), len(distinct)), np.uint8)
        flags[owner, names] = 1
        packed = np.packbits(flags, axis=1)
        fresh = np.ones(len(i), bool)
        for begin in range(0, len(i), 65536):
            part = slice(begin, begin + 65536)
            fresh[part] = ~(packed[i[part]] & packed[j[part]]).any(axis=1)
        i, j = i[fresh], j[fresh]
    return i, j


_NEED = "path long, low int, high int, own int, set_id long, earlier array<long>, tokens binary"


def _needed(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of groups that are in a pair worth an exact look."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _Groups(batches):
            i, j = _candidates(group, least) if group.num_rows > 1 else ((), ())
            if len(i):
                rows = np.unique(np.concatenate([i, j]))
                yield from group.select(["path", "low", "high", "own", "set_id", "earlier", "tokens"]).take(pa.array(rows)).combine_chunks().to_batches()

    return run


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted distinct arrays."""
    rows = np.unique(np.concatenate([i, j]))
    if len(i) < 4 * len(rows):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    # many pairs of few sets: products of blocks of the table of sets and shared shingles
    place = np.full(int(rows.max()) + 1, -1)
    place[rows] = np.arange(len(rows))
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    distinct, column, times = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    number = np.cumsum(times > 1) - 1
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    counts = np.zeros((len(rows), len(rows)), np.float32)
    step = 4096
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [begin, begin + step])
        flags = np.zeros((len(rows), step), np.float32)
        flags[owner[a:b], column[a:b] - begin] = 1
        counts += flags @ flags.T
    return counts[place[i], place[j]].astype(np.int64)


def _roots_of(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the smallest id of the rows it hangs together with."""
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            return label
        label = new


_LINKS = "set_id long, links long, root long"
_LINKS_ARROW = pa.schema([("set_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _verify(least: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _Groups(batches):
            i, j = _candidates(group, least)
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            ids, sizes = group.column("set_id").to_numpy(), np.array([len(s) for s in sets])
            fits = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
            i, j = i[fits], j[fits]
            if not len(i):
                continue
            common = _common(sets, i, j)
            linked = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
            i, j = i[linked], j[linked]
            count = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            rows = np.flatnonzero(count)
            root = _roots_of(len(ids), i, j, ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(count[rows].astype(np.int64)), pa.array(root[rows])], schema=_LINKS_ARROW)

    return run


_SHINGLES_ARROW = pa.schema([("set_id", pa.int64()), ("shingles", pa.binary())])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array([s.tobytes() for s in shingles(batch.column("text"))], pa.binary())], schema=_SHINGLES_ARROW)


# Step 4: classes, links and groups of the documents


def components(edges: DataFrame) -> DataFrame:
    """(set_id, group_id) for edges (set_id, root), root <= set_id: the smallest set of everything that hangs together.

    Every round takes the smallest label among the neighbours and then that label's own label, so that distances
    halve. Minima are combined before the shuffle; a root with many neighbours meets one row per neighbour.
    """
    both = written(edges.where("set_id != root").select("set_id", "root").distinct(), "near-edges")
    pairs = both.unionByName(both.select(F.col("root").alias("set_id"), F.col("set_id").alias("root")))
    labels = written(pairs.groupBy("set_id").agg(F.least(F.min("root"), F.col("set_id")).alias("label")), "near-labels")
    while True:
        near = pairs.join(labels.select(F.col("set_id").alias("root"), "label"), "root").groupBy("set_id").agg(F.min("label").alias("near"))
        step = labels.join(near, "set_id").select("set_id", F.col("label").alias("old"), F.least("label", "near").alias("next"))
        jump = labels.select(F.col("set_id").alias("next"), F.col("label").alias("over"))
        new = written(step.join(jump, "next").select("set_id", "old", F.least("next", "over").alias("label")), "near-labels")
        if new.where("old != label").isEmpty():
            return new.select("set_id", F.col("label").alias("group_id"))
        labels = new.select("set_id", "label")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of it, which tells the texts of a repeated doc_id apart."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.withColumn("text_hash", F.xxhash64("text"))


def near_links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, set_id, n_links.

    set_id is the smallest doc_id with the same shingle set, n_links the number of other sets with a similarity of at
    least `threshold`, class_id the smallest doc_id of everything that hangs together by links or equal sets. `bucket`
    and `block` size leaves and tasks and don't change which pairs are compared inside a leaf.
    """
    return _linked(docs, threshold, recall, bucket, block).select("doc_id", "class_id", "set_id", "n_links")


def _linked(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """The columns of `near_links`, and text_hash."""
    spark = docs.sparkSession
    texts = _texts(docs)
    prints = written(texts.mapInArrow(_embed, _SETS), "near-prints")
    known = prints.where("doc_id is not null and size > 0")
    # within these steps set_id is a number of the set's own
    sets = written(known.groupBy("print1", "print2").agg(F.min(F.struct("doc_id", "text_hash", "tokens")).alias("least")).select(
        "print1", "print2", F.monotonically_increasing_id().alias("set_id"), F.struct("least.doc_id", "least.text_hash").alias("first"), F.col("least.tokens").alias("tokens")), "near-sets")
    found = written(leaves(sets, threshold, recall, bucket), "near-leaves")
    least = max(1, math.floor(WIDTH * threshold - SLACK * math.sqrt(WIDTH * threshold * (1 - threshold))))
    lists = found.groupBy("set_id").agg(F.array_sort(F.collect_set("path")).alias("earlier"))
    # a set is in few leaves, however many sets share a leaf
    about = sets.select("set_id", "tokens").join(lists, "set_id")
    rows = _rows_in_blocks(found, block).join(about, "set_id")
    keys = ["path", "low", "high"]
    width = shuffle_width(spark)
    spread = lambda df: df.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    need = written(spread(rows).mapInArrow(_needed(least), _NEED), "near-needed")
    # up to a bound the ids go to the texts, beyond it the texts are dealt by id
    ids = sent_if_few(written(need.select("set_id").distinct().join(sets, "set_id").select("set_id", "first.doc_id", "first.text_hash"), "near-ids"))
    whole = texts.join(ids, ["doc_id", "text_hash"]).select("set_id", "text").dropDuplicates(["set_id"])
    exact = written(whole.mapInArrow(_shingle_rows, "set_id long, shingles binary"), "near-shingles")
    links = written(spread(need.join(exact, "set_id")).mapInArrow(_verify(least, threshold), _LINKS), "near-links")
    groups = written(components(links.select("set_id", "root")).join(sets.select("set_id", "first"), "set_id"), "near-groups")
    groups = groups.join(groups.groupBy("group_id").agg(F.min("first.doc_id").alias("least_id")), "group_id").select("set_id", "least_id")
    counts = links.groupBy("set_id").agg(F.sum("links").alias("n_links"))
    per_set = sets.select("print1", "print2", "set_id", "first").join(counts, "set_id", "left").join(groups, "set_id", "left")
    named = prints.select("doc_id", "text_hash", "size", "print1", "print2").join(
        per_set.withColumnsRenamed({"print1": "p1", "print2": "p2"}),
        (F.col("print1") == F.col("p1")) & (F.col("print2") == F.col("p2")) & (F.col("size") > 0) & F.col("doc_id").isNotNull(), "left")
    return named.select(
        "doc_id", F.coalesce("least_id", "first.doc_id", "doc_id").alias("class_id"), F.coalesce("first.doc_id", "doc_id").alias("set_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_hash")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, with all their columns: of each group the one with the smallest doc_id.

    Where a doc_id has several texts, each goes or stays by its own group.
    """
    other, its_hash = free_name(docs, "near_id"), free_name(docs, "near_hash")
    found = _linked(docs, threshold).where("doc_id != class_id").select(F.col("doc_id").alias(other), F.col("text_hash").alias(its_hash)).distinct()
    return docs.join(sent_if_few(written(found, "near-dropped")), (F.col("doc_id") == F.col(other)) & (F.xxhash64(F.col("text").cast("string")) == F.col(its_hash)), "left_anti")
