"""Best-fit packing by a configuration linear program over the histogram of lengths.

Documents become token ids with an end id, longer ones are cut into pieces of the capacity (the first may be shorter).
What is packed is the histogram of piece lengths, whose size follows the capacity and not the data:

- The program: as few sequences as cover every length as often as it occurs; a column is a configuration, a multiset of
  lengths that fits one sequence. The shortest pieces, `RESERVE` of all tokens, stay out of it to fill what rounding leaves.
- Multiplicative weights: every length has a weight that falls with the share of its pieces already covered, and steps are
  small, until every length is covered. The pricing step is a knapsack dynamic program over the capacity; from its values
  many configurations are drawn whose weight is within `LOSS` of the largest. Any weights bound the program from below,
  so `fractional` returns its value, the best of these bounds, and thereby the gap between them.
- Rounding: configurations are used a whole number of times, the most used first, while their pieces last. What is left,
  less than a tenth of the tokens on the given tables, and the shortest pieces go by best fit, longest first, into the
  room of these sequences and into new ones, on counts of equal sequences.

Pieces then take the places of their length in the order of their rank. Ranks come from counts per (length, salt) and
numbers inside a salt, so a length held by a third of all pieces is spread over many tasks.

Cases: null text is empty and holds the end id only. Rows that repeat a doc_id and null doc_ids are packed like any
other row. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.llm.text import slices, written

CAPACITY = 2048
END_ID = 0
#: How fast the weight of a length falls with the share of its pieces that is covered.
SPEED = 0.5
#: How much less than the largest weight a configuration may have, configurations drawn from one pricing step, draws in
#: vain that end it, and the share of what is left of a configuration that a step uses.
LOSS, DRAWS, VAIN, STEP = 0.05, 256, 32, 0.5
#: Share of all tokens, in the shortest pieces, that fills gaps; how full a configuration has to be.
RESERVE, FULL = 0.05, 0.85
#: Pieces of one (length, salt) group on average, if one length held all of them.
PER_SALT = 20_000

Pattern = tuple[tuple[int, int], ...]


# Token ids


class Ids:
    """Ids of a byte-level vocabulary of the tokenizers library.

    Where a rank file of the same vocabulary lies beside it, ids come from the quicker library that reads it; texts with
    special strings go through the vocabulary file itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = None
        ranks = re.sub(r"\.json$", ".tiktoken", path)
        if ranks != path and os.path.exists(ranks):
            self.quick = self._quick(ranks)

    @staticmethod
    def _quick(path: str):  # noqa: ANN205
        import tiktoken

        #: Fixed value: the word pattern of byte-level vocabularies.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(path, "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.quick is None or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


@functools.cache
def ids_of(path: str) -> Ids:
    return Ids(path)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(path)
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text), END_ID], dtype="<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)

    return run


# The linear program


def price(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack's dynamic program: the largest weight of a multiset of lengths with each exact sum, -inf where there is none."""
    value = np.full(capacity + 1, -np.inf)
    value[0] = 0.0
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        k = upto[room]
        if k:
            value[room] = (value[room - lengths[:k]] + weights[:k]).max()
    return value


def best_configuration(lengths: np.ndarray, weights: np.ndarray, value: np.ndarray, room: int) -> dict[int, int]:
    """The configuration of the largest weight with this sum, as counts by place among the lengths."""
    found: dict[int, int] = {}
    while room:
        k = int(np.searchsorted(lengths, room, "right"))
        item = int((value[room - lengths[:k]] + weights[:k]).argmax())
        found[item] = found.get(item, 0) + 1
        room -= int(lengths[item])
    return found


def near_configuration(lengths: np.ndarray, weights: np.ndarray, value: np.ndarray, room: int, left: np.ndarray, draws: np.random.Generator) -> dict[int, int] | None:
    """A drawn configuration of pieces that are left, within `LOSS` of the largest weight; None if the draw gets stuck."""
    found: dict[int, int] = {}
    spare, left = LOSS * value[room], left.copy()
    while room:
        k = int(np.searchsorted(lengths, room, "right"))
        loss = value[room] - (value[room - lengths[:k]] + weights[:k])
        shares = np.cumsum(np.where(loss <= spare + 1e-12, np.maximum(left[:k], 0.0), 0.0) * lengths[:k])
        if not k or shares[-1] <= 1e-6:
            return None
        item = min(int(np.searchsorted(shares, draws.random() * shares[-1], "right")), k - 1)
        spare -= max(loss[item], 0.0)
        found[item] = found.get(item, 0) + 1
        left[item] -= 1
        room -= int(lengths[item])
    return found


def fractional(demand: dict[int, int], capacity: int) -> tuple[Counter[Pattern], float]:
    """Configurations with the number of sequences that each fills, covering all lengths, and a lower bound of the least number."""
    draws = np.random.default_rng(7)
    lengths = np.array(sorted(demand))
    need = np.array([demand[n] for n in lengths.tolist()], dtype=float)
    left, used, bound = need.copy(), Counter(), 0.0
    while (left > 0).any():
        live = left > 0
        own, rest, most = lengths[live], left[live], need[live]
        # the weights start at the share of a sequence that a piece fills
        weights = own / capacity * np.exp(-SPEED * (1 - rest / most))
        value = price(own, weights, capacity)
        room = int(np.flatnonzero(value >= value.max() * (1 - 1e-12))[-1])
        bound = max(bound, float((weights * most).sum() / value[room]))
        done = vain = 0
        while done < DRAWS and vain < VAIN:
            found = near_configuration(own, weights, value, room, rest, draws)
            if found is None:
                vain += 1
                if done or vain < VAIN:
                    continue
                found = best_configuration(own, weights, value, room)
            items, counts = np.array(list(found)), np.array(list(found.values()), dtype=float)
            counts = np.minimum(counts, most[items])
            whole = float((rest[items] / counts).min())
            if whole <= 0:
                vain += 1
                continue
            step = whole if whole <= 1 else max(1.0, STEP * whole)
            rest[items] -= step * counts
            rest[rest < 1e-9] = 0.0
            used[tuple((int(own[i]), int(c)) for i, c in zip(items, counts, strict=True))] += step
            done, vain = done + 1, 0
        left[live] = rest
    return used, bound


def best_fit(left: Counter, capacity: int, bins: dict[int, Counter] | None = None) -> Counter[Pattern]:
    """Longest pieces first, each into the fullest sequence that takes it; equal sequences are counted together.

    `bins` has sequences to begin with, by the room they have.
    """
    bins = bins or {}
    for length in sorted(left, reverse=True):
        todo = left[length]
        for room in sorted(r for r in bins if r >= length):
            each = room // length
            for pattern in sorted(bins[room]):
                if not todo:
                    break
                for count in (each, todo % each if todo < each * bins[room][pattern] else 0):
                    filled = min(todo // count, bins[room][pattern]) if count else 0
                    if filled:
                        bins[room][pattern] -= filled
                        bins.setdefault(room - count * length, Counter())[(*pattern, (length, count))] += filled
                        todo -= filled * count
            bins[room] += Counter()
        each = capacity // length
        for count in (each, todo % each):
            if count and todo >= count:
                bins.setdefault(capacity - count * length, Counter())[((length, count),)] += todo // count
                todo -= todo // count * count
    return sum(bins.values(), Counter())


def rounded(used: Counter[Pattern], left: Counter, capacity: int) -> dict[int, Counter]:
    """Whole uses of the configurations by the room they have; their pieces go from `left`."""
    bins: dict[int, Counter] = {}
    for pattern, times in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        size = sum(n * c for n, c in pattern)
        whole = min([max(1, round(times)), *(left[n] // c for n, c in pattern)])
        if whole and size >= FULL * capacity:
            bins.setdefault(capacity - size, Counter())[pattern] += whole
            left.subtract({n: c * whole for n, c in pattern})
    return bins


def plan(demand: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Configurations and how many sequences use each; every piece has exactly one place."""
    left = Counter({n: c for n, c in demand.items() if n < capacity and c})
    out: list[tuple[Pattern, int]] = [(((capacity, 1),), demand[capacity])] if demand.get(capacity) else []
    spare, kept = RESERVE * sum(n * c for n, c in left.items()), Counter()
    for n in sorted(left):
        kept[n] = min(left[n], int(spare // n))
        spare -= n * kept[n]
        if kept[n] < left[n]:
            break
    left -= kept
    bins = rounded(fractional(dict(left), capacity)[0], left, capacity) if left else {}
    return out + list(best_fit(+(left + kept), capacity, bins).items())


class Places:
    """The place of the r-th piece of a length, for all lengths, as sorted arrays."""

    def __init__(self, configurations: list[tuple[Pattern, int]]) -> None:
        rows, sequence = [], 0
        for pattern, times in configurations:
            offset = 0
            for length, count in pattern:
                rows.append((length, count, times, sequence, offset))
                offset += length * count
            sequence += times
        rows.sort(key=lambda r: r[0])
        self.length, self.count, self.times, self.sequence, self.offset = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        slots = self.count * self.times
        total = np.cumsum(slots) - slots
        self.first = total - total[np.searchsorted(self.length, self.length)]
        # one sorted key for (length, first place)
        self.scale = int(slots.sum()) + 1
        self.key = self.length * self.scale + self.first

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, length * self.scale + rank, "right") - 1
        number = rank - self.first[row]
        return self.sequence[row] + number // self.count[row], self.offset[row] + number % self.count[row] * length


# Ranks and places of the pieces


_PACKED_ARROW = pa.schema([*_PIECES_ARROW, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _place(places: Places) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["rank"]).columns, pa.array(sequence), pa.array(offset)], schema=_PACKED_ARROW)

    return run


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """The pieces with a rank from 0 among those of their length."""
    salts = max(32, total // PER_SALT)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("number", F.row_number().over(inside) - 1)
    return numbered.join(bases, ["length", "salt"]).select(*pieces.columns, (F.col("base") + F.col("number")).alias("rank"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = written(texts.mapInArrow(_cut(path, capacity), _PIECES), "pack-pieces")
    demand = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = Places(plan(demand, capacity))
    return ranked(pieces, sum(demand.values())).mapInArrow(_place(places), f"{_PIECES}, sequence_id long, offset long")
