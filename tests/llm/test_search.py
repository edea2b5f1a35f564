"""Ranked search against scoring every document, and what the bounds on pairs save."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, ODD, words
from tuneloom.llm import search

ITEMS = "item_id long, text string"


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score), sorted."""
    counts = [(i, collections.Counter(words(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, length = len(counts), sum(x for _, _, x in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    queries = collections.defaultdict(collections.Counter)
    for item, text in set(items):
        queries[item].update(words(text))
    found = []
    for item, terms in queries.items():
        scored = []
        for i, c, size in counts:
            m = 75 + 25 * size * n // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in terms.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        found += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=str)


def found(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in frame.collect()), key=str)


def random_texts(seed, n, vocabulary=60, length=40):
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(vocabulary)]
    shares = [1 / (k + 1) for k in range(vocabulary)]
    return [" ".join(rng.choices(names, shares, k=rng.randint(0, length))) for _ in range(n)]


@pytest.mark.parametrize(("segment_bytes", "block_terms", "partners"), [(1 << 24, 50_000, 4), (2000, 30, 2), (300, 1, 0)])
def test_search_equals_brute_force(spark, segment_bytes, block_terms, partners):
    docs = [(k // 2, t) for k, t in enumerate(random_texts(1, 300) + ["w1 w1 w2", "w2 w1 w1"] * 30)]
    items = [(k % 9, t) for k, t in enumerate(random_texts(2, 12, length=12))] + [(50, "w1 W1 w3 w3 w3"), (50, "w1 W1 w3 w3 w3"), (51, "nowhere"), (52, "w5 nowhere")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = found(search.ranked_search(frame, spark.createDataFrame(items, ITEMS), 20, segment_bytes, block_terms, partners))
    assert got == brute(docs, items)


def test_search_cases(spark):
    odd = spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("clash") for c in ("term", "score", "segment", "item", "rank")})
    items = [(1, "tie id"), (1, "word7"), (None, "Tie HERE"), (2, None), (3, ""), (4, "!!"), (5, "Übung é 12345 ß"), (6, "and3 word1 word2")]
    frame = spark.createDataFrame(items, ITEMS).withColumn("times", F.lit("clash"))
    assert found(search.ranked_search(odd, frame)) == brute([(r[0], r[1]) for r in ODD], items)
    assert search.ranked_search(odd.limit(0), frame).count() == 0
    assert search.ranked_search(odd, frame.limit(0)).count() == 0


def test_long_texts_come_in_parts(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(3000)) + "," + "x" * 700 + ";" + "y" * 10
    monkeypatch.setattr(search, "SLICE_BYTES", 256)
    parts = [p.to_pylist()[0] for _, p in search._parts(pa.array([text], pa.large_string()))]
    assert len(parts) > 30 and [w for p in parts for w in p.split()] == words(text)
    segment = search._Segment()
    segment.add(pa.array([5], pa.int64()), pa.array([text], pa.large_string()))
    lists = {r["term"]: np.frombuffer(r["counts"], "<i4").tolist() for b in segment.lists(0) for r in b.to_pylist() if r["term"] is not None}
    assert lists == {t: [n] for t, n in collections.Counter(words(text)).items()}


def test_pairs_tighten_the_skipping_and_change_nothing():
    """Thirty long documents hold most of a query's terms, short ones hold one and score higher for it."""
    rng, numbers, saved = random.Random(5), np.random.default_rng(3), []
    for _ in range(40):
        terms = list(range(16))
        texts = [f"w{rng.randrange(16)}" if rng.random() < 0.5 else "" for _ in range(4000)] + [" ".join(f"w{a}" for a in rng.sample(terms, 15)) for _ in range(30)]
        query = [(a, rng.choice([1, 1, 1, 1, 1, 2])) for a in reversed(terms)]
        pairs = [(min(a, b), max(a, b)) for n, (a, _) in enumerate(query) for b, _ in query[n + 1:n + 5]]
        made = {}
        for a in terms:
            docs = np.array([k for k, t in enumerate(texts) if f"w{a}" in t.split()], np.int32)
            scores = numbers.integers(1, 1000, len(docs)) * np.where(docs < 4000, 10, 6)
            made[a, -1] = search.Entry(docs, scores, int(scores.max()))
        made |= {(a, b): both for a, b in pairs if (both := search.intersection(made[a, -1], made[b, -1]))}
        total = np.zeros(len(texts), np.int64)
        for a, n in query:
            total[made[a, -1].docs] += n * made[a, -1].scores
        kth = int(np.sort(total)[-20])
        want = {k: total[k] for k in np.flatnonzero(total >= kth)}
        for threshold in (0, kth):
            work = search.Work(), search.Work()
            for some, spent in zip((set(), set(pairs)), work, strict=True):
                known = made if some else {key: e for key, e in made.items() if key[1] < 0}
                rows, scores = search.best_of(query, known, some, len(texts), 20, threshold, spent)
                assert dict(zip(rows.tolist(), scores.tolist(), strict=True)) == want
            saved.append(work[1].postings / work[0].postings)
        assert search.best_of(query, made, set(pairs), len(texts), 20, int(total.max()) + 1)[0].size == 0
    assert np.mean(saved) < 0.96 and max(saved) < 1.05


def test_a_pair_is_bound_by_its_joint_maximum():
    a = search.Entry(np.array([1, 2], np.int32), np.array([9, 2]), 9)
    b = search.Entry(np.array([2, 3], np.int32), np.array([3, 8]), 8)
    both = search.intersection(a, b)
    assert both.docs.tolist() == [2] and both.scores.tolist() == [5]
    made, pair = {(0, -1): a, (1, -1): b, (0, 1): both}, {(0, 1)}
    assert search.bounds_of([(0, 1), (1, 1)], made, pair).upto == [0, 8, 9]
    assert search.bounds_of([(0, 1), (1, 1)], {(0, -1): a, (1, -1): b}, set()).upto == [0, 8, 17]
    assert search.bounds_of([(0, 2), (1, 1)], made, pair).upto == [0, 8, 18]
    assert search.bounds_of([(0, 1), (1, 1)], {(0, -1): a, (1, -1): b}, pair).upto == [0, 8, 9]
