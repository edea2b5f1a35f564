"""Steps whose tasks stay small, and rows that cross the network once, whatever the size of the table."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tuneloom.operators import ensemble, similarity, skew, tuning
from tuneloom.plans import REGISTRY
from tuneloom.sources import views


@pytest.fixture
def lines(spark, tmp_path):
    """A folder with 900 lines, some of them twice, some without a key or flag."""
    rows = [(None if k % 50 == 0 else k // 4, k % 4 + 1 if k % 70 else None, float(k % 7), 10.0 * k, (k % 11) / 100, (k % 9) / 100, None if k % 31 == 0 else "ANR"[k // 12 % 3], "OF"[k % 2])
            for k in range(800)]
    rows += rows[:100]
    kinds = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path), rows


def exchanges(df):
    """(number of partitions, why) of every exchange by hash in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), (\w+)", plan), plan


def test_constant_categories_are_broken_in_bounded_tasks(spark, lines, monkeypatch):
    folder, rows = lines
    monkeypatch.setattr(skew, "GROUPED_ROWS", 50)
    out = REGISTRY["break_constant_categories"].run(spark, folder)
    found, _ = exchanges(out)
    assert found and set(found) == {("18", "REPARTITION_BY_NUM")}  # 900 rows; no exchange sized by compressed bytes
    code = {"A": 0.0, "N": 1.0}
    want, flags = Counter(), {}
    for r in rows:
        f = code.get(r[6], 2.0)
        want[r[0], round(r[2] / 50, 6), f] += 1
        flags.setdefault(r[0], set()).add(f)
    for s, seen in flags.items():
        if len(seen) == 1:
            want[s, 0.5, 1.0 if seen == {0.0} else 0.0] += 1
    assert {(r["space_id"], r["quantity"], r["flag"]): r["weight"] for r in out.collect()} == want


def test_missing_steps_are_filled_in_bounded_tasks(spark, lines, monkeypatch):
    folder, rows = lines
    monkeypatch.setattr(skew, "GROUPED_ROWS", 50)
    out = REGISTRY["fill_missing_steps"].run(spark, folder)
    found, plan = exchanges(out)
    assert set(found) == {("18", "REPARTITION_BY_NUM")} and "SortAggregate" not in plan and "Join" not in plan
    name = {"A": "Default", "N": "Hyperopt"}
    logged = {}
    for r in rows:
        q, t, o = logged.get(r[:2], (math.inf, math.inf, "~"))
        logged[r[:2]] = min(q, r[2]), min(t, r[5]), min(o, name.get(r[6], "Random Search"))
    got = [((r["run_id"], r["step_no"]), (r["quantity"], r["tax"], r["origin"])) for r in out.collect()]
    # a step without a full key equals no logged one: all steps of the run without a key are drawn as well
    drawn = [(run, step) for run in {k[0] for k in logged} for step in range(1, 8) if run is None or (run, step) not in logged]
    assert Counter(k for k, _ in got) == Counter([*logged, *drawn])
    for k, v in logged.items():
        assert (k, (round(v[0], 6), round(v[1], 6), v[2])) in got


def test_predictions_of_all_models_meet_without_another_exchange(spark, lines, monkeypatch):
    """lines are dealt by the row's number once; the ten predictions of a row are put together where they are."""
    monkeypatch.setattr(skew, "GROUPED_ROWS", 50)
    found, plan = exchanges(REGISTRY["greedy_round"].run(spark, lines[0]))
    assert len(re.findall(r"Exchange hashpartitioning\(row_id", plan)) == 1 and ("18", "REPARTITION_BY_NUM") in found
    assert "hashpartitioning(l_orderkey" not in plan


@pytest.mark.parametrize("copies", [1, 4])
def test_like_rows_are_put_together_before_they_are_written(spark, copies, monkeypatch):
    """what is written first are distinct rows of the true class's shares, not rows of all probabilities."""
    written = []
    monkeypatch.setattr(ensemble, "cut_lineage", lambda df: written.append(df.columns) or df)
    rows = [(m, 40 * c + r, r % 2, [2.0 * (r + 1), float(m + 1)]) for c in range(copies) for r in range(40) for m in range(3)]
    preds = spark.createDataFrame(rows, "model_id int, row_id int, y int, probs array<double>").repartition(3)
    got = {tuple(round(x, 9) for x in r["truth"]): r["n"] for r in ensemble.truth_rows(preds, 3, (0, 1)).collect()}
    share = [[(2.0 * (r + 1) if r % 2 == 0 else m + 1.0) / (2.0 * (r + 1) + m + 1) for m in range(3)] for r in range(40)]
    assert got == {tuple(round(x, 9) for x in s): copies for s in share}
    assert written == [["truth", "n"]]


def test_selection_over_lines_equals_votes(spark, lines):
    """the query still selects over all rows of the library."""
    folder, rows = lines
    folder_rows = {(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None}
    preds = views.preds(spark, folder).where("row_id IS NOT NULL").select("model_id", "row_id", "y", F.array(1 - F.col("p"), F.col("p")).alias("probs"))
    assert ensemble.truth_rows(preds, 10, (0, 1)).agg(F.sum("n")).first()[0] == len(folder_rows)


def test_small_spaces_meet_python_in_one_table(spark, monkeypatch):
    """sixty spaces of twenty rows, one without an id, one hot: few tables, the same sums as kernel by kernel."""
    monkeypatch.setattr(tuning, "TASK_ROWS", 60)
    dims = [tuning.Dim("x"), tuning.Dim("c", 3)]
    rng = np.random.default_rng(3)
    rows = [(None if s == 7 else f"s{s}", kind, round(float(rng.random()), 1), float(rng.integers(3)), int(rng.integers(1, 4)))
            for s in range(60) for kind in ("good", "bad") for _ in range(100 if s == 9 else 10)]
    frame = spark.createDataFrame(rows, "space_id string, set string, x double, c double, weight long")
    bw = tuning.kde_bandwidth(frame, dims, ["space_id", "set"])
    points = spark.createDataFrame([(f"s{s}", p, 0.1 * p, float(p % 3)) for s in range(60) if s != 7 for p in range(5)], "space_id string, point long, x double, c double")
    left, _ = tuning.spread(frame, points, ["space_id"], together=True)
    assert left.count().count() == 1
    monkeypatch.setattr(tuning, "TABLE_ROWS", 200)
    got = {(r["space_id"], r["point"]): (r["good"], r["bad"]) for r in tuning.kde_density(frame, bw, points, dims).collect()}
    widths = {(r["space_id"], r["set"]): (r["n"], r["bw_x"], r["bw_c"]) for r in bw.collect()}
    assert len(got) == 59 * 5
    for (s, p), pair in got.items():
        for kind, value in zip(("good", "bad"), pair):
            n, bx, bc = widths[s, kind]
            want = sum(w / n * math.exp(-0.5 * ((x - 0.1 * p) / bx) ** 2) / (math.sqrt(2 * math.pi) * bx) * (1 - bc if c == p % 3 else bc / 2)
                       for i, k, x, c, w in rows if i == s and k == kind)
            assert abs(value - want) < 1e-9


def test_configurations_are_read_once(spark, monkeypatch):
    """places and sizes of a split come from rows that are written once; sizes are sent, the rows are not dealt out for them."""
    cut = []
    monkeypatch.setattr(tuning, "cut_lineage", lambda df: cut.append(df.columns) or df)
    configs = spark.createDataFrame([(s, i / 40, float(i), 2) for s in range(3) for i in range(40)], "space_id int, x double, loss double, copies long")
    out = tuning.good_bad_split(configs, [tuning.Dim("x")])
    assert cut[0] == configs.columns
    assert "_salt" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r[0], r[1]): r[2] for r in out.groupBy("space_id", "set").agg(F.sum("weight")).collect()} == {(s, k): n for s in range(3) for k, n in (("good", 12), ("bad", 68))}


def test_equal_keys_are_found_by_a_join():
    q, s = (pa.table({"key": k}) for k in (["b", "a", None, "c", "a"], ["a", "x", "b", "a"]))
    i, j = similarity.same_keys(q, s)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 2), (1, 0), (1, 3), (4, 0), (4, 3)] and list(i) == sorted(i)


@pytest.fixture
def numbered(spark, tmp_path):
    """A folder with 900 lines, some of them twice, all with a key."""
    rows = [(k // 4, k % 4 + 1, (k % 11) / 100, "OF"[k % 3 % 2]) for k in range(800)]
    rows += [(o, n, d / 2, "O") for o, n, d, _ in rows[:100]]
    frame = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_discount double, l_linestatus string")
    frame.selectExpr("*", "1e0 AS l_quantity", "0e0 AS l_tax", "'A' AS l_returnflag").write.parquet(f"{tmp_path}/numbered/lineitem.parquet")
    return f"{tmp_path}/numbered"


@pytest.mark.parametrize("name", ["greedy_selection", "bagged_ensemble"])
def test_selection_deals_the_lines_once(spark, numbered, name, monkeypatch):
    """neither the models nor the bags cost a shuffle of all lines of their own."""
    monkeypatch.setattr(skew, "GROUPED_ROWS", 24)  # 38 tasks
    sc = spark.sparkContext
    sc.setJobGroup(f"F3 {name}", name)
    try:
        assert REGISTRY[name].run(spark, numbered).count() > 0
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(f"F3 {name}") for s in tracker.getJobInfo(j).stageIds}
    tasks = [i.numTasks for i in map(tracker.getStageInfo, stages) if i and i.numCompletedTasks]
    assert len(tasks) > 25 and tasks.count(38) == 1


def test_wide_library_is_the_long_one_without_a_sort(spark, numbered, lines):
    """one exchange of numbers, nothing that sorts or spills ten predictions per row; the same doubles."""
    wide = views.preds_wide(spark, numbered)
    _, plan = exchanges(wide)
    assert plan.count("Exchange hashpartitioning") == 1 and not re.search("ObjectHashAggregate|SortAggregate|Sort ", plan)
    long = views.preds(spark, numbered).groupBy("row_id").agg(F.first("y"), F.transform(F.array_sort(F.collect_list(F.struct("model_id", "p"))), lambda s: s["p"]))
    got = sorted(map(tuple, wide.collect()))
    assert len(got) == 800 and got == sorted(map(tuple, long.collect()))
    _, plan = exchanges(views._lines(spark, lines[0]).select("row_id", "status"))
    assert "ascii(l_linestatus" in plan[plan.index("Exchange"):]  # codes cross the network as numbers


def test_lines_keep_orders_whose_number_is_missing_apart(spark, lines):
    """an order's number is sent only where the row's is missing; lines without a part of their key stay those of their order."""
    folder, rows = lines
    want = {}
    for r in rows:
        key = r[:2]
        s, f, d = want.get(key, ("", None, math.inf))
        want[key] = max(s, r[7]), max(filter(None, (f, r[6])), default=None), min(d, r[4])
    number = {k: None if None in k else 10 * k[0] + k[1] for k in want}
    got = Counter((r["row_id"], r["status"], r["flag"], r["discount"]) for r in views._lines(spark, folder).collect())
    assert got == Counter((number[k], *v) for k, v in want.items())


def test_a_number_of_several_lines_is_an_error(spark, lines, tmp_path):
    """as before, the selection refuses rows that can't be told apart: here lines without a key, then line 12 of order 1 and line 2 of order 2."""
    with pytest.raises(Exception, match="number of row null"):
        REGISTRY["greedy_selection"].run(spark, lines[0])
    kinds = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(1, 12, 1.0, 0.1, 0.1, "A", "O"), (2, 2, 1.0, 0.1, 0.1, "A", "F")], kinds).write.parquet(f"{tmp_path}/same/lineitem.parquet")
    with pytest.raises(Exception, match="number of row 22"):
        REGISTRY["greedy_selection"].run(spark, f"{tmp_path}/same")
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/none/lineitem.parquet")
    assert REGISTRY["greedy_selection"].run(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("metric", ["logloss", "accuracy"])
def test_a_wide_library_is_selected_as_a_long_one(spark, metric):
    """with the models named, rows may come as arrays; a row without all models' predictions stays an error."""
    rng = np.random.default_rng(6)
    raw = rng.random((50, 5, 2)) + 0.1
    long = spark.createDataFrame([(m, r, r % 2, [float(x) for x in raw[r, m]]) for r in range(50) for m in range(5)], "model_id int, row_id int, y int, probs array<double>")
    models = long.select("model_id").distinct()
    bags = models.withColumn("bag", F.lit(0))
    wide = ensemble.wide_predictions(long)
    was, now = ([tuple(x) for x in ensemble.greedy_selection(p, bags, (0, 1), metric, 5, models=m).orderBy("model_id").collect()] for p, m in ((long, None), (wide, models)))
    assert [x[:3] for x in was] == [x[:3] for x in now] and abs(was[0][3] - now[0][3]) < 1e-12
    short = wide.withColumn("library", F.when(F.col("row_id") == 7, F.slice("library", 1, 4)).otherwise(F.col("library")))
    with pytest.raises(Exception, match="no prediction for row 7"):
        ensemble.greedy_selection(short, bags, (0, 1), metric, 5, models=models)
