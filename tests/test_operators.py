import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneloom.operators import compare, ensemble, metrics, quantiles, racing, runs, similarity, skew, splits, structures, trajectory, tree, tuning
from tuneloom.sources import logs, tables


def test_halving_and_resampling(spark):
    cand = spark.createDataFrame([(0, 0, i, x) for i, x in enumerate((0.3, 0.1, 0.2, 0.1))], "iteration int, rung int, structure int, loss double")
    sched = spark.createDataFrame([(0, 0, 4), (0, 1, 2)], "iteration int, rung int, n_candidates int")
    adv = racing.successive_halving(cand, sched, 4).where("advance").collect()
    assert sorted(r["structure"] for r in adv) == [1, 3]
    adv = racing.successive_resampling(cand, sched, 4).where("advance").collect()
    assert [r["structure"] for r in adv] == [1]


def test_hyperband_brackets(spark):
    assert racing.n_rungs(3, 1, 9) == 3
    its = spark.createDataFrame([(i,) for i in range(3)], "iteration int")
    got = {}
    for r in racing.hyperband_schedule(its, 3, 1, 9).orderBy("iteration", "rung").collect():
        got.setdefault(r["iteration"], []).append((r["n_candidates"], round(r["budget"], 6)))
    assert got == {0: [(9, 1.0), (3, 3.0), (1, 9.0)], 1: [(3, 3.0), (1, 9.0)], 2: [(3, 9.0)]}


def test_mixed_budgets_are_an_error(spark):
    cand = spark.createDataFrame([(0, 0, 0, 1.0, "REVIEW"), (0, 0, 1, 2.0, "REVIEW")], "iteration int, rung int, structure int, budget double, status string")
    sched = spark.createDataFrame([(0, 0, 2)], "iteration int, rung int, n_candidates int")
    with pytest.raises(Exception, match="same budget"):
        racing.iteration_progress(cand, sched).collect()


def test_uct(spark):
    nodes = spark.createDataFrame(
        [("", 0, 10, -5.0, False), ("a", 1, 5, -4.0, False), ("b", 1, 2, -1.0, True)], "path string, depth int, visits int, reward double, failed boolean")
    got = {r["path"]: r["score"] for r in tree.uct_score(nodes).collect()}
    assert abs(got["a"] - (-0.8 - math.sqrt(math.log(10) / 5)) * 0.875) < 1e-12
    assert got["b"] == 0.0
    factors = spark.range(6).select(tree.depth_factor(F.col("id"))).collect()
    assert [r[0] for r in factors] == [0.9375, 0.875, 0.75, 0.5, 0.0, -1.0]


def test_widening(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 5), ("c", 30)], "path string, visits int")
    got = {r["path"]: r["limit"] for r in tree.widening_limit(nodes, 20).collect()}
    assert got == {"a": 1, "b": 3, "c": 7}


def test_path_rollup(spark):
    chain = spark.createDataFrame([(["a", "b", "c"], -1.0)], "steps array<string>, reward double")
    assert {r["path"]: r["visits"] for r in tree.node_statistics(chain).collect()} == {"": 1, "a": 1, "a/b": 1, "a/b/c": 1}
    assert {r["path"]: r["visits"] for r in tree.node_statistics(chain, "reference").collect()} == {"": 1, "a/b": 1, "a/b/c": 1}
    short = spark.createDataFrame([(["a"], -1.0)], "steps array<string>, reward double")
    assert {r["path"]: r["visits"] for r in tree.node_statistics(short, "reference").collect()} == {"": 2, "a": 1}


def test_strict_asof(spark):
    pts = spark.createDataFrame([("s", 0, 0.1), ("s", 5, 0.4)], "system string, sec long, score double")
    got = {r["sec"]: r["score"] for r in trajectory.asof_raster(pts, 1, F.lit(6).cast("long")).collect()}
    assert got[0] == 0.0 and got[1] == 0.1 and got[5] == 0.1 and got[6] == 0.4


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, p double")
    assert metrics.roc_auc(df).first()["roc_auc"] == 0.75
    multi = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, pred int")
    assert metrics.accuracy(multi).first()[0] == 0.5
    assert abs(metrics.weighted_precision(multi).first()[0] - (0.5 * 1 + 0.25 / 3 + 0)) < 1e-12
    assert metrics.weighted_recall(multi).first()[0] == 0.5
    assert abs(metrics.weighted_f1(multi).first()[0] - (0.5 * 2 / 3 + 0.25 * 0.5)) < 1e-12


def test_density(spark):
    dims = [tuning.Dim("x")]
    rows = spark.createDataFrame([(1, s, x, 1) for s in ("good", "bad") for x in (0.0, 1.0)], "space_id int, set string, x double, weight long")
    bw = spark.createDataFrame([(1, s, 2, 1.0) for s in ("good", "bad")], "space_id int, set string, n long, bw_x double")
    pts = spark.createDataFrame([(1, 0, 0.0)], "space_id int, point long, x double")
    assert abs(tuning.kde_density(rows, bw, pts, dims).first()["good"] - 0.320457) < 1e-6
    match = tuning.kernel(tuning.Dim("c", 3), np.array([1.0]), np.array([1.0, 2.0]), 0.2)
    assert match.round(12).tolist() == [[0.8, 0.1]]
    assert np.isnan(tuning.kernel(tuning.Dim("c", 1), np.array([1.0]), np.array([0.0]), 0.2)).all()


def test_kernel_sums_of_a_hot_space(spark, monkeypatch):
    """A space of many rows is spread over salts, the others are not; the sums are those of one task."""
    rng = np.random.default_rng(2)
    dims = [tuning.Dim("x"), tuning.Dim("c", 3)]
    data = [(int(k % 7 == 0), str(rng.choice(["good", "bad"])), float(rng.random()), float(rng.integers(3)), int(rng.integers(1, 4))) for k in range(900)]
    rows = spark.createDataFrame(data, "space_id int, set string, x double, c double, weight long").repartition(3)
    pts = spark.createDataFrame([(s, k, k / 5, float(k % 3)) for s in (0, 1, 2) for k in range(5)], "space_id int, point long, x double, c double")
    bw = tuning.kde_bandwidth(rows, dims, ["space_id", "set"])
    want = {(r["space_id"], r["point"]): r for r in tuning.kde_density(rows, bw, pts, dims).collect()}
    means = {(r["space_id"], r["name"], r["value"]): r for r in tuning.marginal_means(rows, bw, dims).collect()}
    monkeypatch.setattr(tuning, "TASK_ROWS", 200)
    monkeypatch.setattr(tuning, "CHUNK_ROWS", 7)
    left, _ = tuning.spread(rows, pts, ["space_id"])
    assert {r["space_id"]: r["n"] for r in left.count().groupBy("space_id").agg(F.count("*").alias("n")).collect()} == {0: 4, 1: 1}
    got = tuning.kde_density(rows, bw, pts, dims).collect()
    assert len(got) == len(want) == 10
    for r in got:
        w = want[r["space_id"], r["point"]]
        assert abs(r["good"] - w["good"]) < 1e-9 and abs(r["bad"] - w["bad"]) < 1e-9
    for r in tuning.marginal_means(rows, bw, dims).collect():
        assert abs(r["good"] - means[r["space_id"], r["name"], r["value"]]["good"]) < 1e-9


def test_good_and_bad_sets_overlap_and_take_part_of_copies(spark):
    dims = [tuning.Dim("x")]
    configs = spark.createDataFrame([(1, 0.1, 0.5, 3), (1, 0.2, float("nan"), 1)], "space_id int, x double, loss double, copies long")
    got = {(r["set"], r["x"]): r["weight"] for r in tuning.good_bad_split(configs, dims).collect()}
    # least points = 2, n = 4: n_good = 2, n_bad = 3; the row without a loss is the worst
    assert got == {("good", 0.1): 2, ("bad", 0.1): 2, ("bad", 0.2): 1}


def test_marginal_means_equal_the_grid(spark):
    rng = np.random.default_rng(0)
    dims = [tuning.Dim("a"), tuning.Dim("b"), tuning.Dim("c", 3)]
    data = [(1, s, float(rng.random()), float(rng.random()), float(rng.integers(3)), int(rng.integers(1, 3))) for s in ("good", "bad") for _ in range(20)]
    rows = spark.createDataFrame(data, "space_id int, set string, a double, b double, c double, weight long")
    bw = tuning.kde_bandwidth(rows, dims, ["space_id", "set"])
    got = {(r["name"], round(r["value"], 6)): r["good"] for r in tuning.marginal_means(rows, bw, dims).collect()}
    h = {r["set"]: r for r in bw.collect()}["good"]
    good = [d for d in data if d[1] == "good"]
    total = sum(d[5] for d in good)

    def gauss(x, v, b):
        return math.exp(-0.5 * ((x - v) / b) ** 2) / (math.sqrt(2 * math.pi) * b)

    def f(a, b, c):
        return sum(d[5] * gauss(d[2], a, h["bw_a"]) * gauss(d[3], b, h["bw_b"]) * ((1 - h["bw_c"]) if d[4] == c else h["bw_c"] / 2) for d in good) / total

    grid = [i / 7 for i in range(8)]
    for a in (0.0, 3 / 7):
        want = np.mean([f(a, b, c) for b in grid for c in (0.0, 1.0, 2.0)])
        assert abs(got[("a", round(a, 6))] - want) < 1e-9
    assert abs(got[("c", 2.0)] - np.mean([f(a, b, 2.0) for a in grid for b in grid])) < 1e-9


def test_conditional_imputation(spark):
    dims = [tuning.Dim("a"), tuning.Dim("b")]
    data = [(1, i, None if i % 3 == 0 else i / 100, None if i % 4 == 0 else i / 50) for i in range(60)] + [(2, 100, None, 0.5)]
    rows = spark.createDataFrame(data, "space_id int, id int, a double, b double")
    out = {r["id"]: r for r in tuning.impute_conditional(rows, dims, ["space_id"], ["id"]).collect()}
    assert len(out) == 61 and all(r["a"] is not None and r["b"] is not None for r in out.values())
    known_a = {d[2] for d in data if d[2] is not None}
    for i, d in enumerate(data[:-1]):
        assert out[d[1]]["a"] in known_a
        if d[2] is not None:
            assert out[d[1]]["a"] == d[2]
    assert 0 < out[100]["a"] < 1


def test_proposals(spark):
    rng = random.Random(3)
    dims = [tuning.Dim("x"), tuning.Dim("c", 2)]
    data = [(s, x, float(c), abs(x - 0.2) + 0.5 * c, 1) for s in range(10) for x, c in ((rng.random(), rng.randrange(2)) for _ in range(60))]
    configs = spark.createDataFrame(data + [(99, 0.5, 0.0, 0.1, 1)], "space_id int, x double, c double, loss double, copies long")
    out = {r["space_id"]: r for r in tuning.propose_configs(configs, dims, seed=5).collect()}
    assert len(out) == 11 and out[99]["origin"] == "Random Search"
    modelled = [r for r in out.values() if r["origin"] == "Hyperopt"]
    assert len(modelled) >= 5
    assert all(0 <= r["x"] <= 1 and r["c"] in (0.0, 1.0) for r in out.values())
    assert np.mean([abs(r["x"] - 0.2) for r in modelled]) < 0.2


def test_wilcoxon(spark):
    ref = [0.9, 0.8, 0.7, 0.95, 0.85, 0.6]
    other = [0.5, 0.7, 0.75, 0.6, 0.65, 0.58]
    pairs = spark.createDataFrame([("t", "s", i, a, b) for i, (a, b) in enumerate(zip(ref, other))], "task string, system string, fold int, ref double, result double")
    r = compare.wilcoxon(pairs, "exact").first()
    d = [round(a - b, 9) for a, b in zip(ref, other)]
    order = sorted(range(6), key=lambda i: abs(d[i]))
    rank = {i: n + 1 for n, i in enumerate(order)}
    minus = sum(rank[i] for i in range(6) if d[i] < 0)
    assert r["statistic"] == minus
    ways = sum(1 for k in range(64) if sum(i + 1 for i in range(6) if k >> i & 1) <= minus)
    assert abs(r["p_value"] - min(1, 2 * ways / 64)) < 1e-12 and not r["significant"]


def test_wilcoxon_method_does_not_follow_the_size(spark):
    """26 pairs: the exact chance from the number of subsets, the normal one beside it; a tie leaves only the normal one."""
    signs = [1 if i % 4 else -1 for i in range(1, 27)]
    rows = [(t, "s", i, 0.01 * i * g, 0.01 if t == "tied" and i == 2 else 0.0) for t in ("whole", "tied") for i, g in enumerate(signs, 1)]
    pairs = spark.createDataFrame(rows, "task string, system string, fold int, ref double, result double")
    exact, normal_ = ({r["task"]: r for r in compare.wilcoxon(pairs, m).collect()} for m in ("exact", "normal"))
    ways = [1] + [0] * 351
    for i in range(1, 27):
        ways = [w + (ways[k - i] if k >= i else 0) for k, w in enumerate(ways)]
    w = int(exact["whole"]["statistic"])
    assert w == sum(i for i in range(1, 27) if i % 4 == 0)
    assert abs(exact["whole"]["p_value"] - 2 * sum(ways[:w + 1]) / 2**26) < 1e-12
    assert normal_["whole"]["p_value"] != exact["whole"]["p_value"] and abs(normal_["whole"]["p_value"] - exact["whole"]["p_value"]) < 0.01
    assert exact["tied"]["p_value"] == normal_["tied"]["p_value"]
    with pytest.raises(ValueError, match="unknown method"):
        compare.wilcoxon(pairs, "auto")


def test_systems_come_from_the_data(spark, tmp_path):
    rows = [("t", f"{k}/system {k}", f, "auc", 0.1 * k + 0.01 * f) for k in range(6) for f in range(3)]
    results = spark.createDataFrame(rows, "task string, system string, fold int, metric string, result double")
    tables.write_benchmark(results, str(tmp_path / "sheets"))
    back = tables.read_benchmark(spark, str(tmp_path / "sheets")).select(*results.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    cells = compare.comparison_cells(results, "exact")
    wide = compare.comparison_table(cells).first()
    assert cells.count() == 6 and len(wide) == 2 + 6 * 3 and wide["5/system 5_flag"] == "best"


def library(n_rows=300, n_models=5):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, n_rows)
    p = {m: np.clip(0.5 + (y - 0.5) * (0.2 + 0.1 * m) + rng.normal(0, 0.25, n_rows), 0.02, 0.98) for m in range(n_models)}
    return y, p


@pytest.mark.parametrize("metric", ["logloss", "accuracy"])
def test_greedy_selection_follows_brute_force(spark, metric):
    y, p = library()
    rows = [(m, i, int(y[i]), [float(1 - p[m][i]), float(p[m][i])]) for m in p for i in range(len(y))]
    preds = spark.createDataFrame(rows, "model_id int, row_id int, y int, probs array<double>")
    bag = preds.select("model_id").distinct().withColumn("bag", F.lit(0))
    got = {r["model_id"]: r for r in ensemble.greedy_selection(preds, bag, (0, 1), metric, max_models=6).collect()}

    def loss(q):
        if metric == "logloss":
            return float(np.mean(-np.log(np.where(y == 1, q, 1 - q))))
        return -float(np.mean((q > 0.5) == (y == 1)))

    blend, best = np.zeros(len(y)), None
    for n in range(6):
        values = {m: loss((blend * n + p[m]) / (n + 1)) for m in p}
        m = min(values, key=values.get)
        if metric == "accuracy" and list(values.values()).count(values[m]) > 1:
            return  # ties are broken by a draw
        blend = (blend * n + p[m]) / (n + 1)
        if best is None or values[m] < best - 1e-12:
            best = values[m]
    assert abs(next(iter(got.values()))["loss"] - best) < 1e-9


def test_votes(spark):
    preds = spark.createDataFrame([(0, 1, 1, [0.6, 0.4]), (1, 1, 1, [0.1, 0.9])], "model_id int, row_id int, y int, probs array<double>")
    r = ensemble.soft_vote(preds, {0: 2, 1: 1}, (0, 1)).first()
    assert [round(x, 4) for x in r["probs"]] == [0.4333, 0.5667] and r["pred"] == 1
    assert ensemble.hard_vote(preds, {0: 2, 1: 1}, (0, 1)).first()["pred"] == 0
    assert ensemble.ensemble_score(preds, {0: 0}, (0, 1), "logloss").first()["loss"] == 100.0


def test_failed_models_are_marked(spark):
    preds = spark.createDataFrame([(0, 1, 1, [0.6, 0.4]), (1, 1, 1, None)], "model_id int, row_id int, y int, probs array<double>")
    got = {r["model_id"]: (r["loss"], r["failed"]) for r in ensemble.score_library(preds, (0, 1)).collect()}
    assert got[1] == (None, True) and not got[0][1]


def test_a_missing_prediction_is_an_error(spark):
    preds = spark.createDataFrame([(0, 1, 1, [0.6, 0.4]), (1, 1, 1, [0.5, 0.5]), (0, 2, 1, [0.6, 0.4])], "model_id int, row_id int, y int, probs array<double>")
    bag = preds.select("model_id").distinct().withColumn("bag", F.lit(0))
    with pytest.raises(Exception, match="no prediction for row 2"):
        ensemble.greedy_selection(preds, bag, (0, 1))


def greedy(truth, members, rounds, seed=0):
    """Forward selection row by row: {model: weight} of the best round and its loss."""
    chosen, best = np.zeros(truth.shape[1]), (math.inf, {})
    for step in range(rounds):
        keys = []
        for m in members:
            p = (truth @ chosen + truth[:, m]) / (chosen.sum() + 1)
            keys.append((round(-np.log(np.clip(p, metrics.EPS, 1 - metrics.EPS)).mean(), 12), hashlib.md5(f"{seed}|{step}|0|{m}".encode()).hexdigest(), m))
        loss, _, m = min(keys)
        chosen[m] += 1
        if loss < best[0]:
            best = (loss, {k: int(w) for k, w in enumerate(chosen) if w})
    return best


@pytest.mark.parametrize("copies", [1, 3])
def test_greedy_selection_equals_row_by_row(spark, copies, monkeypatch):
    """Three classes, probabilities that don't sum to 1; with copies of all rows like rows are put together."""
    monkeypatch.setattr(ensemble, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(4)
    raw, y = rng.random((60, 12, 3)) + 0.05, rng.integers(0, 3, 60)
    raw[np.arange(60), :, y] += rng.random((60, 12)) * 1.5
    rows = [(m, r + 100 * c, int(y[r]), [float(x) for x in raw[r, m]]) for c in range(copies) for r in range(60) for m in range(12)]
    preds = spark.createDataFrame(rows, "model_id int, row_id int, y int, probs array<double>").repartition(4)
    members = [m for m in range(12) if m != 7]
    truth = ensemble.truth_rows(preds, 12, (0, 1, 2))
    assert truth.agg(F.count("*"), F.sum("n")).first() == (60, 60 * copies)
    bag = spark.createDataFrame([(0, m) for m in members], "bag int, model_id int")
    got = ensemble.greedy_selection(preds, bag, (0, 1, 2), max_models=8).collect()
    loss, want = greedy((raw / raw.sum(2, keepdims=True))[np.arange(60), :, y], members, 8)
    assert {r["model_id"]: r["weight"] for r in got} == want and len(want) > 2 and abs(got[0]["loss"] - loss) < 1e-9


def test_a_round_of_many_models_is_one_plan_of_constant_size(spark):
    sizes = []
    for n in (5, 1000):
        truth = spark.range(50).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: 1.0 / (i + 1)).alias("truth"), F.lit(2).cast("long").alias("n"))
        rounds = ensemble.round_log_losses(truth, {0: np.ones(n)}, {0: np.arange(n)})
        sizes.append(len(rounds._jdf.queryExecution().optimizedPlan().toString()))
        assert rounds.count() == n
    assert sizes[1] < sizes[0] + 200


def vectors(n=160, dims=4, seed=0):
    rng = np.random.default_rng(seed)
    v = np.round(rng.random((n, dims)), 2)
    v[n // 2: n // 2 + n // 3] = v[0]  # a third of the rows are copies
    return v


@pytest.mark.parametrize("weights,shift", [(None, 0.0), ([1.0, 2.0, 0.5, 0.5], 0.0), (None, 5000.0)])
def test_nearest_neighbour_with_a_hot_copy(spark, weights, shift, monkeypatch):
    monkeypatch.setattr(similarity, "STORE_BLOCK", 16)
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 16)
    v = vectors() + shift
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    got = {r["id"]: r for r in similarity.nearest_neighbour(df, df, "id", "v", weights, exclude_self=True).collect()}
    w = np.ones(4) if weights is None else np.array(weights)
    d = np.sqrt(((v[:, None] - v[None]) ** 2 * w).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert len(got) == len(v)
    for i in range(len(v)):
        assert abs(got[i]["distance"] - d[i].min()) < 1e-9
        assert abs(d[i, got[i]["neighbour"]] - d[i].min()) < 1e-9
        if not shift:
            assert got[i]["neighbour"] == int(np.flatnonzero(d[i] <= d[i].min() + 1e-12)[0])


def test_config_groups_equal_first_come_first_served(spark):
    v = vectors(90, 2, 5)
    df = spark.createDataFrame([(i, i % 2, [float(x) for x in r]) for i, r in enumerate(v)], "id long, space int, v array<double>")
    got = {r["id"]: r["leader"] for r in similarity.config_groups(df, "id", "v", "space", threshold=0.2).collect()}
    leaders, want = {0: [], 1: []}, {}
    for i, row in enumerate(v):
        known = leaders[i % 2]
        dist = [(round(float(np.sqrt(((row - v[k]) ** 2).sum())), 11), k) for k in known]
        near = min(dist, default=(math.inf, -1))
        if near[0] <= 0.2 + 1e-9:
            want[i] = near[1]
        else:
            want[i] = i
            known.append(i)
    assert got == want

def clustered(n, dims, seed=1):
    """Points around a few centres, a third of them around one."""
    rng = np.random.default_rng(seed)
    at = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n))
    return rng.random((40, dims))[at] + 0.02 * rng.standard_normal((n, dims))


@pytest.mark.parametrize("within", [None, 0.03, 0.2])
def test_growing_reach_finds_the_nearest(spark, within, monkeypatch):
    """Several rounds, some rows far from all others, two spaces, another store than the asking rows."""
    monkeypatch.setattr(similarity, "STORE_BLOCK", 64)
    monkeypatch.setattr(similarity, "VISIT", 1)
    s = clustered(500, 5)
    q = np.concatenate([clustered(300, 5, 2), np.random.default_rng(9).random((20, 5)) * 3])
    store = spark.createDataFrame([(i, i % 2, [float(x) for x in r]) for i, r in enumerate(s)], "id long, sp int, v array<double>")
    asking = spark.createDataFrame([(i, i % 2, [float(x) for x in r]) for i, r in enumerate(q)], "id long, sp int, v array<double>")
    grid = similarity.grid_of(store.select(F.col("v").alias("vec")))
    assert similarity.projections_for(grid, 0.03, 500) >= 2 and similarity.projections_for(grid, 50.0, 500) == 0
    got = {r["id"]: (r["neighbour"], r["distance"]) for r in similarity.nearest_neighbour(asking, store, "id", "v", within=within, space="sp").collect()}
    d = np.sqrt(((q[:, None] - s[None]) ** 2).sum(-1))
    d[(np.arange(len(q))[:, None] % 2) != (np.arange(len(s))[None] % 2)] = np.inf
    for i in range(len(q)):
        best = int(d[i].argmin())
        if within is not None and d[i, best] > within:
            assert got[i] == (None, None)
        else:
            assert got[i][0] == best and abs(got[i][1] - d[i, best]) < 1e-9


def test_visits_of_cells_grow_as_the_rows(spark):
    """At one reach a row visits few cells, however many rows there are, and meets a small part of them."""
    counts = []
    for n in (1000, 10_000):
        v = clustered(n, 8)
        df = spark.createDataFrame([(0, str(i), i, [float(x) for x in r]) for i, r in enumerate(v)], "space int, key string, ord long, vec array<double>")
        grid = similarity.grid_of(df)
        p = similarity.projections_for(grid, 0.05, n)
        asked = similarity.visits(df, grid, p, 0.05)
        assert asked.groupBy("key").count().agg(F.max("count")).first()[0] <= 2 ** p
        counts.append(asked.count())
        met = asked.groupBy("cell").count().join(similarity.store_cells(df, grid, p, 0.05).groupBy("cell").agg(F.count("*").alias("n")), "cell").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
        assert met < 0.35 * n * n
    assert counts[1] < 25 * counts[0]


def test_transform_effect(spark):
    store = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0])], "id long, vec array<double>")
    steps = spark.createDataFrame([
        (10, "SUCCESS", [1.0, 1.0], [1.0, 1.0]), (11, "SUCCESS", [1.0, 1.0], [5.0, 5.01]), (12, "SUCCESS", [1.0, 1.0], None),
        (13, "SUCCESS", [1.0, 1.0], [9.0, 9.0]), (14, "TIMEOUT", [1.0, 1.0], None)],
        "id long, status string, before array<double>, after array<double>")
    got = {r["id"]: (r["effect"], r["duplicate_of"]) for r in similarity.transform_effect(steps, store, "id").collect()}
    assert got == {10: ("INEFFECTIVE", None), 11: ("DUPLICATE", 2), 12: ("CRASHED", None), 13: ("SUCCESS", None), 14: ("TIMEOUT", None)}


def test_splits_are_partitions(spark):
    rows = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    marked = splits.stratified_split(rows, "label", "row_id")
    assert {(r["label"], r["n"]) for r in marked.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {(0, 180), (1, 20)}
    folds = splits.stratified_folds(rows, "label", "row_id")
    assert {r["n"] for r in folds.where("label = 1").groupBy("fold").agg(F.count("*").alias("n")).collect()} == {25}
    train, test = tables.fold_split(rows, folds, 2)
    assert train.count() + test.count() == 1000 and train.join(test, "row_id").count() == 0


def test_logs(spark, tmp_path):
    s = spark.createDataFrame([(0, 1, 2)], "iteration int, structure long, budget int")
    r = spark.createDataFrame([(0, 1, 0, "SUCCESS", -0.5), (0, 9, 0, "CRASHED", 0.0)], "iteration int, structure long, config long, status string, loss double")
    assert runs.orphan_results(s, r).count() == 1
    with pytest.raises(Exception, match="unknown structure 9"):
        runs.split_results(s, r, strict=True).collect()
    logs.append_results(runs.split_results(s, r), str(tmp_path / "log"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1 == spark.read.parquet(str(tmp_path / "bad")).count()
    bad = spark.createDataFrame([('[[0,1,2],{"status":"SUCCESS","loss":-0.5}]',), ("not a line",)], "value string")
    got = logs.parse_result_lines(bad).collect()
    assert [g["loss"] for g in got] == [-0.5, None]


def test_history_documents_are_bounded(spark, tmp_path):
    s = spark.createDataFrame([(0, 1, 2)], "iteration int, structure long, budget int")
    r = spark.range(25).select(
        F.lit(0).alias("iteration"), F.lit(1).cast("long").alias("structure"), F.col("id").alias("config"), F.lit("SUCCESS").alias("status"),
        (-F.col("id") / 100).alias("loss"), F.lit(0.0).alias("structure_loss"), F.lit("x").alias("origin"), F.lit(1.0).alias("training_time"),
        F.timestamp_seconds(F.col("id")).alias("ts"))
    docs = logs.export_history(s, r, 10)
    assert sorted(x["n_configs"] for x in docs.collect()) == [5, 10, 10]
    logs.write_history(docs, str(tmp_path / "history"))
    with pytest.raises(Exception, match="already exists"):
        logs.write_history(docs, str(tmp_path / "history"))


def test_edges_of_single_step_chains_count(spark):
    steps = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x")], "chain string, pos int, step string")
    assert [tuple(r) for r in structures.edge_frequency(steps).collect()] == [("x", "y", 1, 0.5)]
    assert [tuple(r) for r in structures.edge_frequency(steps, per="chains").collect()] == [("x", "y", 1, 0.5)]


def test_explanations_need_every_step(spark):
    steps = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "run_id int, step_no int")
    ex = spark.createDataFrame([(1, 1, 300.0), (1, 2, 100.0), (2, 1, 1.0)], "run_id int, step_no int, loss double")
    assert [tuple(r) for r in runs.explanation_join(steps, ex).collect()] == [(1, 2, 100.0)]


def test_origin_by_majority_then_first(spark):
    steps = spark.createDataFrame([(1, 1, "B", 1.0), (1, 2, "A", 2.0), (2, 1, "A", 1.0), (2, 2, "B", 1.0), (2, 3, "B", 3.0)], "run_id int, step_no int, origin string, q double")
    got = {r["run_id"]: (r["origin"], r["config"]) for r in runs.merge_configs(steps, ["q"]).collect()}
    assert got == {1: ("B", {"1:q": 1.0, "2:q": 2.0}), 2: ("B", {"1:q": 1.0, "2:q": 1.0, "3:q": 3.0})}


def test_chains_are_whole(spark, tmp_path):
    """A day of eleven steps is one chain."""
    from tuneloom.sources import views

    spark.range(11).select(
        F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
        F.lit("click").alias("event_type"), F.col("id").cast("double").alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    rows = views.chain_steps(spark, str(tmp_path)).collect()
    assert len({r["chain"] for r in rows}) == 1 and sorted(r["pos"] for r in rows) == list(range(11))


def test_vectors_are_whole(spark, data):
    from tuneloom.sources import views

    assert views.vectors(spark, data).select(F.size("mf").alias("n")).distinct().collect()[0]["n"] == 64


def test_quantiles_reach_one_and_constant_columns_get_a_bin(spark):
    from tuneloom.evaluation import components

    df = spark.createDataFrame([(float(k % 5), 3.0) for k in range(200)] + [(float("nan"), 3.0), (None, None)], "a double, c double")
    got = [r["a_q"] for r in quantiles.rank_scale(df, ["a"]).collect()]
    assert max(g for g in got if g is not None) == 1.0 and min(g for g in got if g is not None) == 0.0 and got[-2:] == [None, None]
    assert {r["c_q"] for r in quantiles.rank_scale(df, ["c"]).collect()} == {0.0, None}
    assert {r["c_bin"] for r in components.equal_width_bins(df, "c", 4).collect()} == {0.0, None}


def test_order_statistics_are_exact(spark, monkeypatch):
    """Over several ranges, with ties, nulls and a column without values."""
    monkeypatch.setattr(skew, "RANGE_BYTES", 400)
    rng = np.random.default_rng(6)
    a, b = np.round(rng.normal(size=501), 1), rng.lognormal(size=501)
    df = spark.createDataFrame([(float(x), None if k % 50 == 0 else float(y), None) for k, (x, y) in enumerate(zip(a, b))], "a double, b double, c double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)
    got = quantiles.quantiles(df, ["a", "b", "c"], shares)
    kept = b[np.arange(501) % 50 != 0]
    assert np.allclose(got["a"], np.quantile(a, shares)) and np.allclose(got["b"], np.quantile(kept, shares)) and got["c"] == []
    scaled = quantiles.robust_scale(df, ["a", "c"]).collect()
    low, mid, high = np.quantile(a, (0.25, 0.5, 0.75))
    assert np.allclose([r["a_r"] for r in scaled], (a - mid) / (high - low)) and {r["c_r"] for r in scaled} == {None}
    ranks = [r["a_q"] for r in quantiles.rank_scale(df, ["a"], 10).collect()]
    cuts = sorted({np.sort(a)[-(-i * 501 // 10) - 1] for i in range(1, 10)})
    passed = np.searchsorted(cuts, a, "right")
    assert np.allclose(ranks, (passed - passed.min()) / (passed.max() - passed.min()))
    assert quantiles.rank_scale(df, ["c"]).where("c_q is not null").count() == 0 == quantiles.robust_scale(df.limit(0), ["a"]).count()


def test_donors_that_differ_in_the_parameter_only(spark):
    """Their order, and so the result, does not depend on the order of the rows."""
    from tuneloom.operators import tuning

    dims = [tuning.Dim("x")]
    rows = [(1, "i", float(k)) for k in range(6)] + [(1, f"a{k}", None) for k in range(20)]
    schema = "g int, ident string, x double"
    first, second = (sorted(map(tuple, tuning.impute_conditional(spark.createDataFrame(r, schema).repartition(3), dims, ["g"], ["g", "ident"]).select(
        "g", "ident", "x").collect())) for r in (rows, rows[::-1]))
    assert first == second
