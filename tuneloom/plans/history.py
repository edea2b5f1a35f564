"""Run history: sources, ids, scores, filters, joins and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneloom.functions import ids, names, scores
from tuneloom.operators import runs as R
from tuneloom.operators import skew, splits
from tuneloom.plans.registry import query
from tuneloom.session import new_path
from tuneloom.sources import logs, tables
from tuneloom.sources import views as V

CANDIDATES_SQL = """
cand AS (
    SELECT s.iteration, s.structure, s.budget, s.rung, l.loss,
           CASE l.last WHEN 'SUCCESS' THEN 'REVIEW' WHEN 'TIMEOUT' THEN 'RUNNING' ELSE 'QUEUED' END AS status
    FROM structures s JOIN (SELECT iteration, structure, min(loss) AS loss, arg_max(status, (ts, config)) AS last
                            FROM runs GROUP BY ALL) l USING (iteration, structure))
"""


def r6(c, name=None, digits=6):
    col = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return col.alias(name or c)


# ---- sources and sinks

@query("read_labelled", "SELECT p_size, round(p_retailprice, 6) AS p_retailprice, p_brand AS label FROM part")
def read_labelled(spark, d):
    path = new_path(spark, "labelled")
    V.table(spark, d, "part").select("p_size", "p_retailprice", "p_brand").write.csv(path, header=True)
    return tables.read_labelled(spark, path, "p_size INT, p_retailprice DOUBLE, p_brand STRING").select(
        "p_size", r6("p_retailprice"), "label")


@query("fold_split", """
    SELECT row_id, y, CASE WHEN rn % 4 = 0 THEN 'test' ELSE 'train' END AS part
    FROM (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('7|' || CAST(row_id AS VARCHAR)), row_id) - 1 AS rn
          FROM preds_bin)""")
def fold_split(spark, d):
    rows = V.preds_bin(spark, d).select("row_id", "y")
    folds = splits.stratified_folds(rows, "y", "row_id", 4, seed=7).select("row_id", "fold")
    train, test = tables.fold_split(rows, folds, 0)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("read_run_log", """
    SELECT r.iteration, r.structure, r.config, status, round(loss, 6) AS loss, round(training_time, 6) AS training_time,
           round(epoch_us(ts) / 1e6, 3) AS timestamp, origin, printf('models_%d-%d-%d.pkl', r.iteration, r.structure, r.config) AS model_file,
           CAST(budget AS DOUBLE) AS budget
    FROM runs r JOIN structures s USING (iteration, structure)""")
def read_run_log(spark, d):
    """The log files, written and read back."""
    structures, results = new_path(spark, "structure-log"), new_path(spark, "result-log")
    logs.write_log_lines(logs.structure_lines(V.structures(spark, d)), structures)
    logs.write_log_lines(logs.result_lines(V.runs(spark, d)), results)
    log = logs.read_run_log_files(spark, structures, results)
    return log.select("iteration", "structure", "config", "status", r6("loss"), r6("training_time"), r6("timestamp", digits=3), "origin", "model_file", "budget")


@query("append_structures", """
    SELECT iteration, structure, budget FROM structures""")
def append_structures(spark, d):
    """Structures of budget 3 and more are stored first, all that are logged arrive after them: each is stored once."""
    path = new_path(spark, "structures")
    known = V.structures(spark, d)
    logs.append_structures(known.where("budget >= 3").select("iteration", "structure", "budget"), path)
    stored = spark.read.schema("structure BIGINT, budget INT, iteration INT").parquet(path)
    incoming = V.runs(spark, d).select("iteration", "structure", (F.col("structure") % 5 + 1).cast("int").alias("budget"))
    logs.append_structures(R.new_structures(stored, incoming), path)
    return spark.read.schema("structure BIGINT, budget INT, iteration INT").parquet(path).select("iteration", "structure", "budget")


@query("append_results", """
    SELECT iteration, structure, config, round(loss, 6) AS loss, rung > 0 AS accepted
    FROM runs JOIN structures USING (iteration, structure)""")
def append_results(spark, d):
    """Accepted results in the log and the others in the reject table, read back."""
    log, rejects = new_path(spark, "results"), new_path(spark, "rejects")
    known = V.structures(spark, d).where("rung > 0")
    marked = R.split_results(known, V.runs(spark, d)).select("iteration", "structure", "config", r6("loss"), "accepted")
    logs.append_results(marked, log, rejects)
    schema = "iteration INT, structure BIGINT, config BIGINT, loss DOUBLE"
    return spark.read.schema(schema).parquet(log).withColumn("accepted", F.lit(True)).unionByName(
        spark.read.schema(schema).parquet(rejects).withColumn("accepted", F.lit(False)))


CONFIGS_PER_DOCUMENT = 1000


@query("export_history", """
    SELECT iteration, structure, (rn // 1000) AS part, printf('%02d:%02d', iteration, structure) AS cid, count(*) AS n_configs,
           min(config) AS first_config, max(config) AS last_config, round(max(-loss), 6) AS best_score, CAST(any_value(budget) AS INTEGER) AS budget
    FROM (SELECT *, row_number() OVER (PARTITION BY iteration, structure ORDER BY ts, config) - 1 AS rn FROM runs)
    JOIN structures USING (iteration, structure) GROUP BY iteration, structure, part""")
def export_history(spark, d):
    """The documents, read back."""
    path = new_path(spark, "history")
    logs.write_history(logs.export_history(V.structures(spark, d), V.runs(spark, d), CONFIGS_PER_DOCUMENT), path)
    config = "STRUCT<pos: BIGINT, config: BIGINT, status: STRING, loss: DOUBLE>"
    doc = F.from_json("value", f"cid STRING, budget INT, configs ARRAY<{config}>")
    read = spark.read.text(path).select(doc.alias("d")).select("d.*")
    ids_ = F.transform("configs", lambda c: c["config"])
    cid = F.split("cid", ":")
    return read.select(
        cid.getItem(0).cast("int").alias("iteration"), cid.getItem(1).cast("bigint").alias("structure"),
        F.floor(F.array_min(F.transform("configs", lambda c: c["pos"])) / CONFIGS_PER_DOCUMENT).cast("bigint").alias("part"),
        "cid", F.size("configs").cast("bigint").alias("n_configs"), F.array_min(ids_).alias("first_config"),
        F.array_max(ids_).alias("last_config"), r6(F.array_max(F.transform("configs", lambda c: c["loss"])), "best_score"), "budget")


@query("read_benchmark", "SELECT task, system, fold, metric, round(result, 12) AS result FROM bench")
def read_benchmark(spark, d):
    path = new_path(spark, "sheets")
    tables.write_benchmark(V.bench(spark, d), path)
    return tables.read_benchmark(spark, path).select("task", "system", "fold", "metric", r6("result", digits=12))


@query("read_trajectory", """
    WITH pts AS (SELECT event_type AS system, user_id AS task,
                        (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 1000000 AS sec,
                        min(least(value/500, 1e0)) AS score FROM events GROUP BY ALL),
    expected AS (SELECT s.system, u.task FROM (SELECT DISTINCT user_id AS task FROM events) u,
                 (SELECT DISTINCT event_type AS system FROM events UNION SELECT 'idle') s)
    SELECT system, task, sec, round(score, 6) AS score FROM pts
    UNION ALL
    SELECT system, task, CAST(sec AS BIGINT) AS sec, 0e0 AS score
    FROM expected e, (SELECT unnest([0, 3660]) AS sec) t
    WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE p.system = e.system AND p.task = e.task)""")
def read_trajectory(spark, d):
    ev = V.runs(spark, d).select("origin", "structure", "training_time", F.unix_micros("ts").alias("us"))
    start = ev.agg(F.min("us")).scalar()
    sec = F.floor((F.col("us") - start) / 1000000).cast("long")
    pts = ev.groupBy(F.col("origin").alias("system"), F.col("structure").alias("task"), sec.alias("sec")).agg(
        F.min(F.least(F.col("training_time") / 500, F.lit(1.0))).alias("score"))
    # all systems of the log and one that never ran; a name per system comes to the driver
    systems = sorted({"idle", *(r["origin"] for r in ev.select("origin").distinct().collect())})
    expected = ev.select(F.col("structure").alias("task")).distinct().withColumn("system", F.explode(F.lit(systems)))
    out = tables.complete_trajectories(pts, expected, ["system", "task"], F.lit(0.0))
    return out.select("system", "task", "sec", r6("score"))


@query("store_dataset", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, o_orderpriority AS label FROM orders")
def store_dataset(spark, d):
    path = new_path(spark, "dataset")
    rows = V.table(spark, d, "orders").select("o_orderkey", r6("o_totalprice"), F.col("o_orderpriority").alias("label"))
    tables.store_dataset(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query("read_step_log", """
    SELECT run_id, 'step_' || CAST(step_no AS VARCHAR) AS name, round(quantity, 6) AS quantity, round(tax, 6) AS tax, origin
    FROM step_configs""")
def read_step_log(spark, d):
    steps = logs.read_step_log(logs.step_lines(V.step_configs(spark, d)))
    return steps.select("run_id", "name", r6(F.get("config", F.lit(0)), "quantity"), r6(F.get("config", F.lit(1)), "tax"), "origin")


# ---- projections

CID = """printf('%02d:%02d', iteration, structure) || CASE WHEN status = 'SUCCESS' THEN printf(':%02d', config) ELSE '' END"""


def _cid(df):
    config = F.when(F.col("status") == "SUCCESS", F.col("config"))
    return ids.format_candidate_id(F.col("iteration"), F.col("structure"), config)


@query("parse_candidate_id", """
    SELECT config AS run, iteration, CAST(structure AS INTEGER) AS structure,
           CASE WHEN status = 'SUCCESS' THEN CAST(config AS INTEGER) END AS config FROM runs""")
def parse_candidate_id(spark, d):
    df = V.runs(spark, d)
    return df.select(F.col("config").alias("run"), ids.parse_candidate_id(_cid(df)).alias("p")).select("run", "p.*")


@query("format_candidate_id", f"SELECT config AS run, {CID} AS cid FROM runs")
def format_candidate_id(spark, d):
    df = V.runs(spark, d)
    return df.select(F.col("config").alias("run"), _cid(df).alias("cid"))


@query("id_from_model_file", """
    SELECT config AS run, iteration, CAST(structure AS INTEGER) AS structure, CAST(config AS INTEGER) AS config FROM runs""")
def id_from_model_file(spark, d):
    df = V.runs(spark, d)
    name = F.concat(F.lit("models/"), ids.model_file_name(
        F.col("iteration"), F.col("structure"), F.col("config"), F.lit(None).cast("string")))
    return df.select(F.col("config").alias("run"), ids.id_from_model_file(name).alias("p")).select("run", "p.*")


@query("model_file_name", """
    SELECT config AS run,
           CASE WHEN status = 'SUCCESS' THEN printf('models_%d-%d-%d.pkl', iteration, structure, config)
                ELSE 'step_' || trim(regexp_replace(lower('1_' || origin || ' Step (' || CAST(structure AS VARCHAR) || ')'),
                                                    '[^a-z0-9]+', '-', 'g'), '-') || '.pkl' END AS file
    FROM runs""")
def model_file_name(spark, d):
    step = F.when(F.col("status") != "SUCCESS", F.concat(
        F.lit("1_"), F.col("origin"), F.lit(" Step ("), F.col("structure").cast("string"), F.lit(")")))
    return V.runs(spark, d).select(
        F.col("config").alias("run"),
        ids.model_file_name(F.col("iteration"), F.col("structure"), F.col("config"), step).alias("file"))


@query("signed_loss", """
    SELECT task, system, fold, round(CASE WHEN metric = 'logloss' THEN result ELSE -result END, 12) AS loss
    FROM bench WHERE result IS NOT NULL""")
def signed_loss(spark, d):
    return V.bench(spark, d).where("result IS NOT NULL").select(
        "task", "system", "fold", r6(scores.signed_loss(F.col("result"), F.col("metric")), "loss", digits=12))


@query("worst_score", """
    SELECT task, system, fold,
           round(CASE WHEN result IS NOT NULL THEN result WHEN metric = 'logloss' THEN 100e0 ELSE 0e0 END, 12) AS loss,
           round(CASE WHEN result IS NOT NULL THEN result ELSE 0e0 END, 12) AS structure_loss
    FROM bench""")
def worst_score(spark, d):
    bench = V.bench(spark, d)
    result = F.col("result")
    return bench.select(
        "task", "system", "fold", r6(scores.loss_or_worst(result, F.col("metric")), "loss", digits=12),
        r6(F.when(scores.finite(result), result).otherwise(F.lit(scores.WORST_STRUCTURE)), "structure_loss", digits=12))


@query("impute_missing", """
    SELECT task, system, fold, metric,
           round(CASE WHEN result IS NOT NULL THEN result WHEN metric = 'auc' THEN 0e0 ELSE 4e0 END, 12) AS result FROM bench""")
def impute_missing(spark, d):
    return V.bench(spark, d).select(
        "task", "system", "fold", "metric", r6(scores.impute_missing(F.col("result"), F.col("metric")), "result", digits=12))


@query("clip_scores", """
    SELECT task, system, fold, metric,
           round(CASE WHEN metric = 'logloss' THEN -greatest(0e0, least(5e0, result*3)) ELSE greatest(0e0, least(1e0, result*3)) END, 12) + 0e0 AS score
    FROM bench WHERE result IS NOT NULL""")
def clip_scores(spark, d):
    log = F.col("metric") == "logloss"
    clipped = scores.clip_scores(
        F.col("result") * 3, F.when(log, 5.0).otherwise(0.0), F.when(log, 0.0).otherwise(1.0),
        F.when(log, -1.0).otherwise(1.0))
    return V.bench(spark, d).where("result IS NOT NULL").select(
        "task", "system", "fold", "metric", r6(clipped, "score", digits=12))


@query("elapsed_time", """
    SELECT config, round((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM runs)) / 1e6, 6) AS elapsed FROM runs""")
def elapsed_time(spark, d):
    df = V.runs(spark, d).select("config", F.unix_micros("ts").alias("us"))
    start = df.agg(F.min("us")).scalar()
    return df.select("config", r6(scores.elapsed_seconds(F.col("us"), start), "elapsed"))


_TASK_ROWS = ", ".join(f"({t}, {x})" for t, x in names.TASK_DATASET.items())


@query("task_lookup", f"""
    WITH m(task, ds) AS (VALUES {_TASK_ROWS})
    SELECT o_orderkey, coalesce(a.ds, -1) AS dataset, coalesce(b.task, -1) AS task
    FROM orders LEFT JOIN m a ON o_orderkey = a.task LEFT JOIN m b ON o_orderkey = b.ds""")
def task_lookup(spark, d):
    key = F.col("o_orderkey")
    return V.table(spark, d, "orders").select(
        "o_orderkey", names.dataset_of_task(key).alias("dataset"), names.task_of_dataset(key).alias("task"))


@query("merge_configs", """
    WITH votes AS (SELECT run_id, origin, count(*) AS n, min(step_no) AS first FROM step_configs GROUP BY ALL),
    best AS (SELECT run_id, arg_min(origin, (-n, first)) AS origin FROM votes GROUP BY run_id),
    kv AS (SELECT run_id, CAST(step_no AS VARCHAR) || ':quantity' AS k, quantity AS v FROM step_configs
           UNION ALL SELECT run_id, CAST(step_no AS VARCHAR) || ':tax' AS k, tax AS v FROM step_configs)
    SELECT run_id, origin, string_agg(k || '=' || CAST(CAST(round(v*100) AS BIGINT) AS VARCHAR), ';' ORDER BY k) AS config
    FROM kv JOIN best USING (run_id) GROUP BY run_id, origin""")
def merge_configs(spark, d):
    merged = R.merge_configs(V.step_configs(spark, d), ["quantity", "tax"])
    text = F.array_join(F.transform(
        F.array_sort(F.map_entries("config")),
        lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 100).cast("long").cast("string"))), ";")
    return merged.select("run_id", "origin", text.alias("config"))


@query("fill_missing_steps", """
    WITH s AS (SELECT run_id, unnest(generate_series(1, 7)) AS step_no FROM (SELECT DISTINCT run_id FROM step_configs))
    SELECT run_id, CAST(step_no AS INTEGER) AS step_no, round(coalesce(c.quantity, 1e0 + 49e0 * u1), 6) AS quantity,
           round(coalesce(c.tax, 0.08e0 * u2), 6) AS tax, coalesce(c.origin, 'Random Search') AS origin
    FROM (SELECT *,
           (CAST('0x' || substr(md5('3quantity|' || run_id || '|' || step_no), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u1,
           (CAST('0x' || substr(md5('3tax|' || run_id || '|' || step_no), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u2 FROM s) s
    LEFT JOIN step_configs c USING (run_id, step_no)""")
def fill_missing_steps(spark, d):
    logged = V.step_configs(spark, d)
    wanted = logged.select("run_id").distinct().withColumn("step_no", F.explode(F.sequence(F.lit(1), F.lit(7))))
    out = R.fill_missing_steps(wanted, logged, {"quantity": (1.0, 50.0), "tax": (0.0, 0.08)}, seed=3)
    return out.select("run_id", "step_no", r6("quantity"), r6("tax"), "origin")


# ---- filters

@query("successful_runs", """
    SELECT iteration, structure, config, round(loss, 6) AS loss, budget
    FROM runs JOIN structures USING (iteration, structure) WHERE status = 'SUCCESS'""")
def successful_runs(spark, d):
    return R.successful_runs(V.structures(spark, d), V.runs(spark, d)).select(
        "iteration", "structure", "config", r6("loss"), "budget")


@query("open_candidates", f"WITH {CANDIDATES_SQL} SELECT iteration, structure, budget, status FROM cand WHERE status IN ('QUEUED', 'REVIEW')")
def open_candidates(spark, d):
    cand = R.candidate_states(V.structures(spark, d), V.runs(spark, d))
    return R.open_candidates(cand).select("iteration", "structure", "budget", "status")


@query("usable_results", """
    SELECT structure, config, round(loss, 6) AS loss FROM runs WHERE status = 'SUCCESS' AND origin <> 'view'""")
def usable_results(spark, d):
    df = V.runs(spark, d)
    loss = F.when(F.col("status") == "SUCCESS", F.col("loss"))
    vector = F.when(F.col("origin") == "view", F.array(F.col("loss"))).otherwise(F.array("loss", "training_time"))
    marked = df.withColumn("loss", loss).withColumn("vector", vector)
    return R.usable_results(marked, F.col("structure"), F.col("vector"), 2).select("structure", "config", r6("loss"))


# ---- joins

@query("structure_results", """
    SELECT iteration, structure, config, status, budget, rung, round(loss, 6) AS loss
    FROM runs JOIN structures USING (iteration, structure)""")
def structure_results(spark, d):
    return R.structure_results(V.structures(spark, d), V.runs(spark, d)).select(
        "iteration", "structure", "config", "status", "budget", "rung", r6("loss"))


@query("orphan_results", """
    SELECT iteration, structure, config, round(loss, 6) AS loss FROM runs WHERE structure % 10 = 0""")
def orphan_results(spark, d):
    known = V.structures(spark, d).where("structure % 10 <> 0")
    return R.orphan_results(known, V.runs(spark, d)).select("iteration", "structure", "config", r6("loss"))


@query("explanation_join", """
    SELECT run_id, count(*) AS n_steps,
           round(greatest(-100e0, least(100e0, avg(CASE WHEN origin <> 'Random Search' THEN tax*100 - quantity END))), 6) AS loss
    FROM step_configs GROUP BY run_id HAVING count(*) = count(*) FILTER (WHERE origin <> 'Random Search')""")
def explanation_join(spark, d):
    steps = V.step_configs(spark, d)
    explained = steps.where("origin <> 'Random Search'").withColumn("loss", F.col("tax") * 100 - F.col("quantity"))
    return R.explanation_join(steps, explained).select("run_id", "n_steps", r6("loss"))


# ---- aggregates, windows, top-k, sets

@query("incumbent_per_structure", """
    SELECT iteration, structure, arg_min(config, (loss, config)) AS config, round(min(loss), 6) AS loss
    FROM runs GROUP BY iteration, structure""")
def incumbent_per_structure(spark, d):
    return R.incumbent_per_structure(V.runs(spark, d)).select("iteration", "structure", "config", r6("loss"))


@query("incumbent", """
    SELECT iteration, structure, config, round(loss, 6) AS loss FROM runs
    ORDER BY runs.loss, iteration, structure, config LIMIT 1""")
def incumbent(spark, d):
    return R.incumbent(V.runs(spark, d)).select("iteration", "structure", "config", r6("loss"))


@query("run_summary", """
    SELECT count(DISTINCT (iteration, structure)) AS n_structures, count(*) AS n_configs,
           round(min(loss), 6) AS incumbent, max(epoch_us(ts)) AS end_us FROM runs""")
def run_summary(spark, d):
    return R.run_summary(V.runs(spark, d)).select("n_structures", "n_configs", r6("incumbent"), "end_us")


@query("reindex_runs", """
    SELECT structure, config, row_number() OVER (PARTITION BY structure ORDER BY ts, config) - 1 AS position FROM runs""")
def reindex_runs(spark, d):
    return R.reindex_runs(V.runs(spark, d).select("structure", "config", "ts")).select("structure", "config", "position")


@query("candidate_numbering", """
    SELECT iteration, structure, row_number() OVER (PARTITION BY iteration ORDER BY first_ts, structure) - 1 AS number
    FROM (SELECT iteration, structure, min(ts) AS first_ts FROM runs GROUP BY ALL)""")
def candidate_numbering(spark, d):
    return R.candidate_numbering(V.runs(spark, d)).select("iteration", "structure", "number")


@query("leaderboard", """
    SELECT iteration, structure, config, round(loss, 6) AS loss
    FROM (SELECT iteration, structure, arg_min(config, (loss, config)) AS config, min(loss) AS loss FROM runs GROUP BY ALL)
    ORDER BY loss, structure LIMIT 25""")
def leaderboard(spark, d):
    best = R.incumbent_per_structure(V.runs(spark, d))
    rounded = best.select("iteration", "structure", "config", r6("loss"))
    return R.leaderboard(rounded, 25)


@query("random_tie_break", """
    SELECT structure, origin, 0e0 + min(q) AS score, arg_min(config, (q, u, config)) AS config
    FROM (SELECT structure, origin, config, round(training_time / 20) AS q,
                 (CAST('0x' || substr(md5('5|' || structure || '|' || origin || '|' || config), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u
          FROM runs) GROUP BY structure, origin""")
def random_tie_break(spark, d):
    rows = V.runs(spark, d).withColumn("score", F.round(F.col("training_time") / 20))
    return R.random_tie_break(rows, ["structure", "origin"], "score", "config", seed=5)


@query("structure_cap", """
    SELECT structure, min(epoch_us(ts)) AS first_us FROM runs GROUP BY structure ORDER BY first_us, structure LIMIT 200""")
def structure_cap(spark, d):
    first = V.runs(spark, d).groupBy("structure").agg(F.min("ts").alias("first_ts"))
    return R.structure_cap(first).select("structure", F.unix_micros("first_ts").alias("first_us"))


@query("distinct_structures", """
    SELECT sha256(array_to_string(list_sort(steps), ',')) AS space_hash, min(chain) AS chain, count(*) AS n_chains
    FROM chains GROUP BY 1""")
def distinct_structures(spark, d):
    return R.distinct_structures(V.pipelines(spark, d))


@query("union_systems", """
    SELECT 'orders' AS system, o_orderpriority AS task, o_totalprice AS result FROM orders
    UNION ALL SELECT 'events' AS system, event_type AS task, value AS result FROM events""")
def union_systems(spark, d):
    return tables.union_systems({
        "orders": V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_totalprice").alias("result")),
        "events": V.table(spark, d, "events").select(F.col("event_type").alias("task"), F.col("value").alias("result")),
    })
