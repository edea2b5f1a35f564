"""The Merkle manifest against a tree built in Python."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, LOWER, ODD
from tuneloom.llm import merkle, ranks


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    said = [None if row[c] is None else str(row[c]) for c in merkle.COLUMNS]
    return h(*("-" if x is None else f"{len(x.encode())}:{x}" for x in said))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][k:k + 8]) for k in range(0, len(found[-1]), 8)])
    return found


def siblings(tree, place):
    for level in tree[:-1]:
        first = place // 8 * 8
        yield level[first:place], level[place + 1:first + 8]
        place //= 8


def brute(rows, tampered):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, as a sorted list."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"], leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees.append(levels([x[2] for x in by[lang]]))
    top, found = levels([t[-1][0] for t in trees]), []
    for n, lang in enumerate(langs):
        for place, (_, doc_id, own, r) in enumerate(by[lang]):
            path = [*siblings(trees[n], place), *siblings(top, n)]
            folded = leaf(r | {"text": r["text"].translate(LOWER)}) if tampered(r) and r["text"] is not None else own
            for before, after in path:
                folded = h(*before, folded, *after)
            found.append((doc_id, own, trees[n][-1][0], top[-1][0], h(*(x for pair in path for side in pair for x in side)), folded, folded == top[-1][0]))
    return sorted(found, key=str)


def third(r):
    return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0


def check(frame, tampered=third, column=None):
    column = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0 if column is None else column
    got = sorted((tuple(r) for r in merkle.manifest(frame, column).collect()), key=str)
    assert got == brute([r.asDict() for r in frame.collect()], tampered)
    return got


def made(spark, langs):
    """Rows of the languages, as many as named."""
    rows = [(k, f"Text {k} OF {lang}", lang, f"src{k % 3}", k) for lang, n in langs.items() for k in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_manifest_cases(spark):
    odd = spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("clash") for c in ("leaf", "row", "tree", "place", "next", "rank", "width", "root")})
    check(odd)
    got = check(odd, lambda r: True, F.lit(True))
    assert len(got) == len(ODD) and 0 < sum(not r[-1] for r in got) < len(ODD)
    assert merkle.manifest(odd.limit(0)).count() == 0
    assert all(r["verified"] for r in merkle.manifest(odd).collect())


@pytest.mark.parametrize("langs", [{"en": 1}, {"en": 2}, {"en": 9}, {"en": 64, "de": 1, "é": 8, "zz": 65}, {f"l{k:02}": 1 + k % 2 for k in range(11)}])
def test_manifest_of_any_height(spark, langs):
    check(made(spark, langs))


def test_manifest_above_a_hop_with_copies_of_nodes(spark, monkeypatch):
    """Five levels below the subroot and one above it; a node for four leaves stands in the table several times."""
    monkeypatch.setattr(merkle, "SPREAD", 4)
    monkeypatch.setattr(ranks, "FEW_ROWS", 0)
    frame = made(spark, {"en": 4100, "fr": 70, None: 1})
    made_levels = merkle.build(merkle.leaves_of(frame))
    climbed = merkle.hops(made_levels.nodes, made_levels.count)
    assert climbed.groupBy("node").count().agg(F.max("count")).first()[0] >= 4100 // 4
    assert climbed.agg(F.max(F.size("steps"))).first()[0] == merkle.HOP
    assert made_levels.nodes.where("parent is null").count() == 1
    check(frame)


def test_recursion_limit_is_put_back(spark):
    before = spark.conf.get(merkle._ROWS)
    merkle.manifest(made(spark, {"en": 3}))
    assert spark.conf.get(merkle._ROWS) == before
