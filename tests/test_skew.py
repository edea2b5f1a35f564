import random

import pytest
from pyspark.sql import functions as F

from tuneloom.operators import skew


def rows(n=3000, hot=0.5):
    rng = random.Random(1)
    return [(0 if rng.random() < hot else rng.randrange(1, 40), i, rng.randrange(0, 50), None if rng.random() < 0.3 else rng.random())
            for i in range(n)]


@pytest.mark.parametrize("ranges", [1, 7])
def test_row_numbers_of_a_hot_group(spark, ranges):
    data = rows()
    df = spark.createDataFrame(data, "k int, id int, v int, x double").repartition(5)
    got = {(r["k"], r["id"]): r["rn"] for r in skew.row_numbers(df, ["k"], ["v", "id"], ranges=ranges).collect()}
    want = {}
    for k in {d[0] for d in data}:
        for i, d in enumerate(sorted((d for d in data if d[0] == k), key=lambda d: (d[2], d[1]))):
            want[(k, d[1])] = i
    assert got == want


def test_ranges_follow_the_counted_bytes(spark):
    df = spark.createDataFrame(rows(), "k int, id int, v int, x double")
    once = skew.range_count(df, 4096)
    assert 0.8 < skew.range_count(df.unionByName(df).unionByName(df).unionByName(df), 4096) / (4 * once) <= 1.05
    assert skew.range_count(df) == 1 == skew.range_count(df.limit(0))
    text = df.select(F.repeat(F.lit("ab"), 500).alias("s"), F.array(F.lit("x" * 90), F.lit(None)).alias("a"), F.struct("k", "id").alias("t"))
    assert 1100 * 3000 < skew.range_count(text, 1) < 1300 * 3000


def test_a_hot_group_spans_several_ranges(spark):
    df = spark.createDataFrame(rows(), "k int, id int, v int, x double")
    cut = skew.dealt(df, ["k", "v", "id"], 7).where("k = 0").groupBy("_range").count().collect()
    assert len(cut) >= 3
    assert max(r["count"] for r in cut) < 0.5 * 1500


@pytest.mark.parametrize("ranges", [1, 2, 11])
def test_running_max_and_last(spark, ranges):
    """Of numbers, and the last of arrays; a group whose begin has no value at all spans ranges too."""
    data = [(k, i, v, None if k == 0 and i < 1000 else x) for k, i, v, x in rows()]
    df = spark.createDataFrame(data, "k int, id int, v int, x double")
    out = skew.running(df, ["k"], ["id"], {
        "m": ("max", F.col("x")), "l": ("last", F.col("x")), "s": ("sum_before", F.col("v")), "p": ("last", F.when(F.col("x").isNotNull(), F.array("id")))}, ranges).collect()
    state = {}
    want = {}
    for k, i, v, x in data:
        m, last, total, path = state.get(k, (None, None, 0, None))
        if x is not None:
            m, last, path = (x if m is None else max(m, x)), x, [i]
        state[k] = (m, last, total + v, path)
        want[(k, i)] = (m, last, total, path)
    assert {(r["k"], r["id"]): (r["m"], r["l"], r["s"], r["p"]) for r in out} == want


@pytest.mark.parametrize("sent", [20_000, 0])
def test_rows_cross_the_network_once(spark, monkeypatch, sent):
    """Null keys too: the rows are dealt out once, what reads them again finds them in buckets."""
    monkeypatch.setattr(skew, "SENT_RANGES", sent)
    data = [(None if i % 3 == 0 else i % 5, i, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(data, "k int, id int, x double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (skew.running(df, ["k"], ["id"], {"s": ("sum_before", F.col("x"))}, ranges=9), skew.average_ranks(df, ["k"], "x", "s", ranges=9)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            rows_side = plan[plan.index("Join"):plan.index("_to#", plan.index("FileScan"))]
            assert "Bucketed: true" in rows_side and "Exchange hashpartitioning" not in rows_side and "Window" in rows_side
        out = skew.running(df, ["k"], ["id"], {"s": ("sum_before", F.col("x"))}, ranges=9)
        got = {(r["k"], r["id"]): r["s"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    for k, i, _ in data:
        assert got[(k, i)] == sum(x for a, b, x in data if a == k and b < i)


def test_more_ranges_than_buckets(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_BUCKETS", 3)
    df = spark.createDataFrame(rows(500), "k int, id int, v int, x double")
    got = skew.row_numbers(df, [], ["id"], ranges=9).collect()
    assert all(r["rn"] == r["id"] for r in got) and len(got) == 500


def test_no_tables_are_left_in_the_catalogue(spark):
    df = spark.createDataFrame(rows(100), "k int, id int, v int, x double")
    before = {t.name for t in spark.catalog.listTables()}
    skew.row_numbers(df, ["k"], ["id"], ranges=3).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("ranges", [1, 2, 9, 40])
def test_average_ranks_of_ties_over_many_ranges(spark, ranges):
    """One value holds most of a group that holds most rows; copies of a row, null keys and null values are there too."""
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([3.0, 3.0, 3.0, 1.5, None, rng.randrange(9) / 2]), k // 2) for k in range(900)]
    got = sorted(((r["k"], r["v"], r["id"], r["avg_rank"]) for r in skew.average_ranks(
        spark.createDataFrame(data, "k string, v double, id int").repartition(4), ["k"], "v", ranges=ranges).collect()), key=str)
    want = []
    for key in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == key), key=lambda d: (d[1] is not None, d[1] or 0))
        for d in own:
            places = [n for n, e in enumerate(own, 1) if e[1] == d[1]]
            want.append((*d, sum(places) / len(places)))
    assert got == sorted(want, key=str)


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("a", 0.5)], "k string, v double")
    got = sorted((r["v"], r["avg_rank"]) for r in skew.average_ranks(df, ["k"], "v").collect())
    assert got == [(0.5, 1.5), (0.5, 1.5), (0.7, 3.0)]


def test_salted_join_keeps_every_row_once(spark):
    df = spark.createDataFrame(rows(), "k int, id int, v int, x double")
    small = df.select("k").distinct().withColumn("w", F.col("k") * 2)
    out = skew.salted_join(df, small, ["k"])
    assert out.count() == df.count() == out.select("id").distinct().count()
    half = small.where("k % 2 = 0")
    assert skew.salted_join(df, half, ["k"], how="left").count() == df.count()
