"""The hash tree: places, growth, confined movement, slots."""

import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, ODD
from tuneloom.llm import sharding
from tuneloom.llm.sharding import Shard


def brute(key, tree):
    """The shard of a key, level by level."""
    path, names = "", [(s.region, s.rack, str(s.shard), s.weight) for s in tree if s.weight]
    for level in range(3):
        weights = collections.Counter()
        for s in names:
            weights[s[level]] += s[3]
        def time(child):
            drawn = int(hashlib.md5(f"{path}/{child}:{key}".encode()).hexdigest()[:13], 16)
            return -math.log((drawn + 0.5) / 16**13) / weights[child]
        chosen = min(weights, key=lambda c: (time(c), c))
        names = [s for s in names if s[level] == chosen]
        path += f"/{chosen}"
    return int(chosen)


def placed(spark, tree, n=4000):
    rows = spark.range(n).select("id", sharding.place(F.col("id").cast("string"), tree).alias("shard")).collect()
    return {r["id"]: r["shard"] for r in rows}


def test_places_equal_brute_force(spark):
    tree = [Shard("a", "x", 0, 0.5), Shard("a", "x", 1), Shard("a", "y", 2, 3.0), Shard("b", "x", 3, 2.0), Shard("b", "z", 4, 0.0)]
    got = placed(spark, tree, 500)
    assert got == {k: brute(k, tree) for k in range(500)} and set(got.values()) == {0, 1, 2, 3}


def test_weights_decide_the_shares(spark):
    tree = [Shard("a", "x", 0), Shard("a", "y", 1, 2.0), Shard("b", "x", 2, 5.0)]
    shares = collections.Counter(placed(spark, tree, 16_000).values())
    assert all(abs(shares[s.shard] - 2000 * s.weight) < 5 * math.sqrt(2000 * s.weight) for s in tree)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = sharding.even_tree()
    for _ in range(3):
        more = sharding.grown(tree)
        before, after, new = placed(spark, tree), placed(spark, more), len(tree)
        moved = {k for k in before if before[k] != after[k]}
        assert all(after[k] == new for k in moved) and 0.5 / len(more) < len(moved) / len(before) < 1.6 / len(more)
        tree = more


def test_movement_is_confined_to_subtrees_whose_weights_change(spark):
    tree = sharding.even_tree()
    changed = [s._replace(weight=3.0) if s.shard == 5 else s for s in tree]
    before, after, of = placed(spark, tree), placed(spark, changed), {s.shard: s for s in tree}
    own = of[5]
    for k, old in before.items():
        a, b = of[old], of[after[k]]
        if a != b:  # nothing moves between subtrees that weigh what they did
            assert b.region == own.region
            assert a.region != own.region or (b.rack == own.rack and (a.rack != own.rack or b.shard == 5))
    assert sum(before[k] != after[k] for k in before) > 100


def test_sharded_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows, texts = sharding.sharded(docs).collect(), {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == len(texts)
    slots = collections.defaultdict(list)
    for r in rows:
        text = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 1, zlib.crc32(text), "key")
        assert r["shard"] == brute(r["doc_id"], sharding.even_tree()) and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
    for taken in slots.values():
        taken.sort()
        assert [s for s, _ in taken] == list(range(len(taken))) and [d for _, d in taken] == sorted(d for _, d in taken)


def test_sharding_cases(spark):
    odd = spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("clash") for c in ("size", "shard", "slot", "law", "row", "rank", "members")})
    rows = sharding.sharded(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(1, 0)}
    assert len({r["shard"] for r in rows if r["doc_id"] == 6}) == 1 and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert sharding.sharded(odd.limit(0)).count() == 0
    hot = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    assert sorted(r["slot"] for r in sharding.sharded(hot).collect()) == list(range(3000))


@pytest.mark.parametrize("tree", [[], [Shard("a", "x", 0, 0.0)], [Shard("a", "x", 0), Shard("b", "x", 0)], [Shard("a", "x", 0, -1.0)], [Shard("a/b", "x", 0)]])
def test_trees_that_make_no_sense(tree):
    with pytest.raises(ValueError):
        sharding.place(F.lit("k"), tree)
