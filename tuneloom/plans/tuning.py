"""Similarity, profiles, density models and proposals."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tuneloom.functions import normal
from tuneloom.operators import similarity as SIM
from tuneloom.operators import skew
from tuneloom.operators import tuning as T
from tuneloom.plans.history import r6
from tuneloom.plans.registry import query
from tuneloom.session import cut_lineage
from tuneloom.sources import views as V

DIMS = [T.Dim("quantity"), T.Dim("discount"), T.Dim("tax"), T.Dim("flag", 3)]
# Random unit vectors lie far apart; this is about their typical nearest distance.
NEAR = 0.85

DIST = "list_distance(a.mf, b.mf)"
NN = f"""nn AS (SELECT a.vec_id AS id, arg_min(b.vec_id, (round({DIST}, 12), b.vec_id)) AS neighbour, min({DIST}) AS distance
               FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)"""


@query("nearest_neighbour", f"WITH {NN} SELECT id, neighbour, round(distance, 6) AS distance FROM nn")
def nearest_neighbour(spark, d):
    v = V.vectors(spark, d)
    return SIM.nearest_neighbour(v, v, "vec_id", "mf", exclude_self=True).select("id", "neighbour", r6("distance"))


@query("similar_within", f"""
    WITH {NN} SELECT id, CASE WHEN distance <= {NEAR}e0 THEN neighbour END AS neighbour,
    CASE WHEN distance <= {NEAR}e0 THEN round(distance, 6) END AS distance, distance <= {NEAR}e0 AS same FROM nn""")
def similar_within(spark, d):
    return SIM.similar_within(V.vectors(spark, d), "vec_id", "mf", NEAR).select("id", "neighbour", r6("distance"), "same")


@query("config_groups", f"""
    WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM vectors),
    reach AS (SELECT b.vec_id, a.vec_id AS other, {DIST} AS distance FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {DIST} <= 1e0 + 1e-9),
    earlier AS (SELECT vec_id, list(other) AS others FROM reach GROUP BY vec_id),
    led AS (SELECT DISTINCT label, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS leaders FROM v
            UNION ALL SELECT l.label, l.k + 1, CASE WHEN list_has_any(l.leaders, coalesce(e.others, [])) THEN l.leaders ELSE list_append(l.leaders, v.vec_id) END
            FROM led l JOIN v ON v.label = l.label AND v.k = l.k + 1 LEFT JOIN earlier e ON e.vec_id = v.vec_id),
    leaders AS (SELECT unnest(arg_max(leaders, k)) AS leader FROM led GROUP BY label),
    joined AS (SELECT r.vec_id, arg_min(r.other, (round(distance, 12), r.other)) AS leader, min(distance) AS distance
               FROM reach r SEMI JOIN leaders ON other = leader GROUP BY r.vec_id)
    SELECT v.label, v.vec_id, CASE WHEN l.leader IS NOT NULL THEN l.leader ELSE j.leader END AS leader, CASE WHEN l.leader IS NOT NULL THEN 0e0 ELSE round(j.distance, 6) END AS distance
    FROM v LEFT JOIN leaders l ON l.leader = v.vec_id LEFT JOIN joined j ON j.vec_id = v.vec_id""")
def config_groups(spark, d):
    groups = SIM.config_groups(V.vectors(spark, d), "vec_id", "mf", "label", threshold=1.0)
    return groups.select("label", "vec_id", "leader", r6("distance"))


@query("transform_effect", """
    WITH st AS (SELECT vec_id, label, mf AS before, CASE label % 5 WHEN 0 THEN mf WHEN 1 THEN [round(x, 3) FOR x IN mf]
                       WHEN 2 THEN NULL WHEN 3 THEN [-x FOR x IN mf] ELSE mf END AS after FROM vectors),
    nn AS (SELECT a.vec_id AS id, arg_min(b.vec_id, (round(list_distance(a.after, b.mf), 12), b.vec_id)) AS neighbour, min(list_distance(a.after, b.mf)) AS d
           FROM st a, vectors b WHERE a.after IS NOT NULL AND a.label % 5 <> 4 GROUP BY a.vec_id)
    SELECT vec_id, CASE WHEN label % 5 = 4 THEN 'TIMEOUT' WHEN after IS NULL THEN 'CRASHED' WHEN label % 5 = 0 THEN 'INEFFECTIVE'
                        WHEN d <= 0.05 THEN 'DUPLICATE' ELSE 'SUCCESS' END AS effect,
           CASE WHEN label % 5 NOT IN (0, 2, 4) AND d <= 0.05 THEN neighbour END AS duplicate_of
    FROM st LEFT JOIN nn ON vec_id = id""")
def transform_effect(spark, d):
    """Five kinds of steps by label: identity, rounding, no result, negation, time limit."""
    kind, mf = F.col("label") % 5, F.col("mf")
    after = (
        F.when(kind == 1, F.transform(mf, lambda x: F.round(x, 3))).when(kind == 2, F.lit(None))
        .when(kind == 3, F.transform(mf, lambda x: -x)).otherwise(mf))
    v = V.vectors(spark, d)
    steps = v.select("vec_id", F.when(kind == 4, "TIMEOUT").otherwise("SUCCESS").alias("status"), mf.alias("before"), after.alias("after"))
    return SIM.transform_effect(steps, v.select("vec_id", F.col("mf").alias("vec")), "vec_id")


_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_MOM = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, unnest(['mean','std','skewness','kurtosis','missing','min','max']) AS measure,
        unnest([avg({c}), stddev_samp({c}), avg(pow({c} - m, 3)) / pow(var_pop({c}), 1.5e0), avg(pow({c} - m, 4)) / pow(var_pop({c}), 2) - 3,
                count(*) FILTER ({c} IS NULL) / count(*), min({c}), max({c})]) AS value
        FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)""" for c in _COLS)
_COR = " UNION ALL ".join(
    f"SELECT '{a}' AS name, 'corr_{b}' AS measure, corr({a}, {b}) AS value FROM lineitem"
    for i, a in enumerate(_COLS) for b in _COLS[i + 1:])


@query("column_profile", f"""
    WITH c AS (SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM lineitem GROUP BY l_returnflag),
    allm AS ({_MOM} UNION ALL {_COR} UNION ALL SELECT 'dataset' AS name, 'rows' AS measure, CAST(count(*) AS DOUBLE) AS value FROM lineitem
    UNION ALL SELECT 'dataset' AS name, 'classes' AS measure, CAST(count(*) AS DOUBLE) AS value FROM c
    UNION ALL SELECT 'dataset' AS name, 'class_entropy' AS measure, sum(-p * ln(p)) AS value FROM c
    UNION ALL SELECT 'dataset' AS name, 'largest_class' AS measure, max(p) AS value FROM c)
    SELECT name, measure, round(value, 6) + 0e0 AS value FROM allm""")
def column_profile(spark, d):
    profile = SIM.column_profile(V.table(spark, d, "lineitem"), "l_returnflag", _COLS)
    return profile.select("name", "measure", r6(F.round("value", 6) + 0.0, "value"))


# ---- density models

SPLIT = """
cr AS (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY loss, quantity, discount, tax, flag) AS rn,
              count(*) OVER (PARTITION BY space_id) AS n FROM config_rows),
sets AS (SELECT *, 'good' AS "set" FROM cr WHERE rn <= greatest(7, 15 * n // 100)
         UNION ALL SELECT *, 'bad' AS "set" FROM cr WHERE rn > n - greatest(7, 85 * n // 100)),
bw AS (SELECT space_id, "set", count(*) AS n,
       greatest(1e-3, 1.06e0 * stddev_pop(quantity) * pow(count(*), -1e0/8)) AS bq, greatest(1e-3, 1.06e0 * stddev_pop(discount) * pow(count(*), -1e0/8)) AS bd,
       greatest(1e-3, 1.06e0 * stddev_pop(tax) * pow(count(*), -1e0/8)) AS bt, greatest(1e-3, 1.06e0 * stddev_pop(flag) * pow(count(*), -1e0/8)) AS bf
       FROM sets GROUP BY space_id, "set")"""


def _g(x, at, bw):
    return f"(exp(-0.5e0 * pow(({x} - {at}) / {bw}, 2)) / (sqrt(2 * pi()) * {bw}))"


KERNEL = " * ".join([
    _g("s.quantity", "p.quantity", "bq"), _g("s.discount", "p.discount", "bd"), _g("s.tax", "p.tax", "bt"),
    "(CASE WHEN s.flag = p.flag THEN 1 - bf ELSE bf / 2 END)"])
SEED = 3


def _u(seed, *parts):
    text = " || '|' || ".join([f"'{seed}'", *parts])
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)"


def _poly(coefs, x):
    made = f"{coefs[0]!r}e0"
    for c in coefs[1:]:
        made = f"({made} * {x} + {c!r}e0)"
    return made


def _cdf(z):
    """The normal distribution function of a column, by the approximation that the operators use."""
    x = f"(abs({z}) / {math.sqrt(2.0)!r}e0)"
    t = f"(1e0 / (1e0 + {normal.ERF_P!r}e0 * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN 1 - 0.5e0 * {_poly(normal.ERF_A[::-1], t)} * {t} * exp(-{x} * {x}) ELSE 0.5e0 * {_poly(normal.ERF_A[::-1], t)} * {t} * exp(-{x} * {x}) END)"


def _quantile(p):
    m, r = f"({p} - 0.5e0)", f"sqrt(-2e0 * ln(least({p}, 1 - {p})))"
    s = f"({m} * {m})"
    edge = f"({_poly(normal.Q_C, r)} / ({_poly(normal.Q_D, r)} * {r} + 1e0))"
    return f"(CASE WHEN {p} < {normal.Q_LOW}e0 THEN {edge} WHEN {p} > {1 - normal.Q_LOW!r}e0 THEN -{edge} ELSE {_poly(normal.Q_A, s)} * {m} / ({_poly(normal.Q_B, s)} * {s} + 1e0) END)"


_NUMERIC = (("quantity", "bq"), ("discount", "bd"), ("tax", "bt"))
#: Drawn points: a random good row, its numbers moved by a normal three bandwidths wide within [0, 1], its category kept or drawn anew.
DRAWN = f"""
drawn AS (SELECT g.space_id, g.point, {", ".join(f"m.{c} AS m_{c}, 3e0 * {b} AS s_{c}, {_u(f'{SEED}{c}', 'g.space_id', 'g.point')} AS u_{c}" for c, b in _NUMERIC)}, m.flag AS m_flag, bf,
                 {_u(f'{SEED}flag', 'g.space_id', 'g.point')} AS u_flag, {_u(f'{SEED}flagc', 'g.space_id', 'g.point')} AS u_flagc
          FROM (SELECT *, unnest(range(64)) AS point FROM bw WHERE "set" = 'good') g
          JOIN cr m ON m.space_id = g.space_id AND m.rn = CAST(floor({_u(f'{SEED}row', 'g.space_id', 'g.point')} * g.n) AS BIGINT) + 1),
limits AS (SELECT *, {", ".join(f"(0e0 - m_{c}) / s_{c} AS a_{c}, (1e0 - m_{c}) / s_{c} AS b_{c}" for c, _ in _NUMERIC)} FROM drawn),
shares AS (SELECT *, {", ".join(f"{_cdf(f'a_{c}')} AS lo_{c}, {_cdf(f'b_{c}')} AS hi_{c}" for c, _ in _NUMERIC)} FROM limits),
ps AS (SELECT *, {", ".join(f"lo_{c} + u_{c} * (hi_{c} - lo_{c}) AS p_{c}" for c, _ in _NUMERIC)} FROM shares),
pts AS (SELECT space_id, point, {", ".join(f"greatest(0e0, least(1e0, m_{c} + s_{c} * {_quantile(f'p_{c}')})) AS {c}" for c, _ in _NUMERIC)},
               CASE WHEN u_flag < 1 - bf THEN m_flag ELSE floor(u_flagc * 3) END AS flag FROM ps)"""
DENSITY = SPLIT + f""",{DRAWN},
dens AS (SELECT s.space_id, p.point, sum(CASE WHEN s."set" = 'good' THEN {KERNEL} / b.n ELSE 0 END) AS good,
                sum(CASE WHEN s."set" = 'bad' THEN {KERNEL} / b.n ELSE 0 END) AS bad
         FROM sets s JOIN bw b ON s.space_id = b.space_id AND s."set" = b."set" JOIN pts p ON p.space_id = s.space_id GROUP BY s.space_id, p.point),
ei AS (SELECT *, greatest(1e-32, good) / greatest(1e-32, bad) AS ei FROM dens)"""


def _split(spark, d):
    return T.good_bad_split(V.configs(spark, d), DIMS)


def _densities(spark, d):
    split, bw = T.fitted(V.configs(spark, d), DIMS)
    return T.kde_density(split, bw, cut_lineage(T.draw_candidates(split, bw, DIMS, seed=SEED)), DIMS)


@query("good_bad_split", f"""
    WITH {SPLIT} SELECT space_id, "set", round(quantity, 6) AS quantity, round(discount, 6) AS discount, round(tax, 6) AS tax, flag,
    round(loss, 9) AS loss, count(*) AS weight FROM sets GROUP BY ALL""")
def good_bad_split(spark, d):
    split = _split(spark, d).select("space_id", "set", r6("quantity"), r6("discount"), r6("tax"), "flag", r6("loss", digits=9), "weight")
    return split


@query("fit_gate", """
    SELECT space_id, n, greatest(7, 15 * n // 100) AS n_good, greatest(7, 85 * n // 100) AS n_bad,
           n >= 7 AS fits
    FROM (SELECT l_orderkey AS space_id, count(*) AS n FROM lineitem GROUP BY l_orderkey)""")
def fit_gate(spark, d):
    """Orders as spaces: most of them are too small for a model."""
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("space_id"), F.lit(1).alias("copies"))
    return T.fit_gate(rows, DIMS).select("space_id", "n", "n_good", "n_bad", "fits")


@query("break_constant_categories", """
    WITH g AS (SELECT l_orderkey AS space_id, min(l_quantity/50) AS q, max(CASE l_returnflag WHEN 'A' THEN 0e0 WHEN 'N' THEN 1e0 ELSE 2e0 END) AS hi,
                      min(CASE l_returnflag WHEN 'A' THEN 0e0 WHEN 'N' THEN 1e0 ELSE 2e0 END) AS lo FROM lineitem GROUP BY l_orderkey),
    allr AS (SELECT l_orderkey AS space_id, l_quantity/50 AS quantity, CASE l_returnflag WHEN 'A' THEN 0e0 WHEN 'N' THEN 1e0 ELSE 2e0 END AS flag FROM lineitem
             UNION ALL SELECT space_id, 0.5e0 AS quantity, CASE WHEN lo = 0 THEN 1e0 ELSE 0e0 END AS flag FROM g WHERE lo = hi)
    SELECT space_id, round(quantity, 6) AS quantity, flag, count(*) AS weight FROM allr GROUP BY ALL""")
def break_constant_categories(spark, d):
    flag = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("space_id"), (F.col("l_quantity") / 50).alias("quantity"), flag.alias("flag"))
    rows = skew.bounded(li, "space_id").groupBy("space_id", "quantity", "flag").agg(F.count("*").alias("weight"))
    dims = [T.Dim("quantity"), T.Dim("flag", 3)]
    out = T.break_constant_categories(rows, dims, {"quantity": 0.5, "flag": 0.0}, ["space_id"])
    return out.groupBy("space_id", r6("quantity"), "flag").agg(F.sum("weight").alias("weight"))


@query("kde_bandwidth", f"""
    WITH {SPLIT} SELECT space_id, "set", n, round(bq, 6) AS bw_quantity, round(bd, 6) AS bw_discount, round(bt, 6) AS bw_tax, round(bf, 6) AS bw_flag FROM bw""")
def kde_bandwidth(spark, d):
    bw = T.kde_bandwidth(_split(spark, d), DIMS, ["space_id", "set"])
    return bw.select("space_id", "set", "n", *[r6(f"bw_{x.name}") for x in DIMS])


@query("kde_density", f"WITH {DENSITY} SELECT space_id, point, round(good, 6) AS good, round(bad, 6) AS bad FROM dens")
def kde_density(spark, d):
    return _densities(spark, d).select("space_id", "point", r6("good"), r6("bad"))


@query("expected_improvement", f"WITH {DENSITY} SELECT space_id, point, round(ei, 6) AS ei FROM ei")
def expected_improvement(spark, d):
    return T.expected_improvement(_densities(spark, d)).select("space_id", "point", r6("ei"))


@query("best_candidate", f"""
    WITH {DENSITY} SELECT space_id, arg_min(point, (-round(ei, 9), point)) AS point, round(max(ei), 6) AS ei FROM ei GROUP BY space_id""")
def best_candidate(spark, d):
    return T.best_candidate(T.expected_improvement(_densities(spark, d))).select("space_id", "point", r6("ei"))


GRID = ", ".join(f"({v!r}e0)" if "e" not in repr(v) else f"({v!r})" for v in T.Dim("x").support())


@query("marginal_means", f"""
    WITH {SPLIT},
    k AS (SELECT s.space_id, s."set", b.n, s.quantity, s.discount, s.tax, s.flag, bq, bd, bt, bf FROM sets s JOIN bw b ON s.space_id = b.space_id AND s."set" = b."set"),
    g(v) AS (VALUES {GRID}), c(v) AS (VALUES (0e0), (1e0), (2e0)),
    grid AS (SELECT a.v AS quantity, b.v AS discount, e.v AS tax, c.v AS flag FROM g a, g b, g e, c),
    kq AS (SELECT space_id, "set", quantity, discount, tax, flag, n, bq, bd, bt, bf, count(*) AS w FROM k GROUP BY ALL),
    den AS (SELECT s.space_id, s."set", p.quantity, p.discount, p.tax, p.flag, sum(w * {KERNEL} / n) AS f
            FROM kq s, grid p GROUP BY ALL),
    m AS (SELECT space_id, "set", 'quantity' AS name, quantity AS value, avg(f) AS f FROM den GROUP BY ALL
          UNION ALL SELECT space_id, "set", 'discount' AS name, discount AS value, avg(f) AS f FROM den GROUP BY ALL
          UNION ALL SELECT space_id, "set", 'tax' AS name, tax AS value, avg(f) AS f FROM den GROUP BY ALL
          UNION ALL SELECT space_id, "set", 'flag' AS name, flag AS value, avg(f) AS f FROM den GROUP BY ALL)
    SELECT space_id, name, round(value, 6) AS value, round(max(f) FILTER ("set" = 'good'), 6) AS good, round(max(f) FILTER ("set" = 'bad'), 6) AS bad,
           round(max(f) FILTER ("set" = 'good') / max(f) FILTER ("set" = 'bad'), 6) AS ei
    FROM m GROUP BY space_id, name, value""")
def marginal_means(spark, d):
    means = T.marginal_means(*T.fitted(V.configs(spark, d), DIMS), DIMS)
    return means.select("space_id", "name", r6("value"), r6("good"), r6("bad"), r6("ei"))


# Every document source is a space; its bounds come from its data.
SPACES_SQL = """
spaces AS (SELECT l_suppkey AS space_id, 'quantity' AS name, 'numeric' AS kind, min(l_quantity) AS lower, max(l_quantity) AS upper, false AS log, 0 AS choices, median(1e0) AS def FROM lineitem GROUP BY l_suppkey
           UNION ALL SELECT l_suppkey, 'price', 'numeric', min(l_extendedprice), max(l_extendedprice), true, 0, 1000e0 FROM lineitem GROUP BY l_suppkey
           UNION ALL SELECT l_suppkey, 'flag', 'categorical', 0e0, 0e0, false, count(DISTINCT l_returnflag), 0e0 FROM lineitem GROUP BY l_suppkey)"""


def _spaces(spark, d):
    per = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("space_id")).agg(
        F.min("l_quantity").alias("ql"), F.max("l_quantity").alias("qh"), F.min("l_extendedprice").alias("pl"),
        F.max("l_extendedprice").alias("ph"), F.count_distinct("l_returnflag").cast("int").alias("k"))

    def hp(name, kind, lower, upper, log, choices, default):
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), lower.alias("lower"), upper.alias("upper"),
                        F.lit(log).alias("log"), choices.cast("int").alias("choices"), F.lit(default).alias("default"))

    zero = F.lit(0.0)
    return per.select("space_id", F.explode(F.array(
        hp("quantity", "numeric", F.col("ql"), F.col("qh"), False, F.lit(0), 1.0),
        hp("price", "numeric", F.col("pl"), F.col("ph"), True, F.lit(0), 1000.0),
        hp("flag", "categorical", zero, zero, False, F.col("k"), 0.0))).alias("h")).select("space_id", "h.*")


@query("parameter_grid", f"""
    WITH {SPACES_SQL}
    SELECT space_id, name, i, round(CASE WHEN kind = 'categorical' THEN i WHEN log THEN lower * pow(upper / lower, i / 9e0) ELSE lower + (upper - lower) * (i / 9e0) END, 6) AS value
    FROM (SELECT *, CAST(unnest(range(CASE WHEN kind = 'categorical' THEN choices ELSE 10 END)) AS INTEGER) AS i FROM spaces)""")
def parameter_grid(spark, d):
    return T.parameter_grid(_spaces(spark, d)).select("space_id", "name", "i", r6("value"))


@query("random_configs", f"""
    WITH {SPACES_SQL},
    r AS (SELECT *, (CAST('0x' || substr(md5('4|' || space_id || '|' || i || '|' || name), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u
          FROM (SELECT *, CAST(unnest(range(20)) AS INTEGER) AS i FROM spaces))
    SELECT space_id, i AS config_no, name, CASE WHEN i = 0 THEN 'Default' ELSE 'Random Search' END AS origin,
           round(CASE WHEN i = 0 THEN def WHEN kind = 'categorical' THEN floor(choices * u) WHEN log THEN exp(ln(lower) + (ln(upper) - ln(lower)) * u) ELSE lower + (upper - lower) * u END, 6) AS value
    FROM r""")
def random_configs(spark, d):
    return T.random_configs(_spaces(spark, d), 20, seed=4).select("space_id", "config_no", "name", "origin", r6("value"))


COMPONENTS = ("Imputer", "OneHotEncoder", "StandardScaler", "PCA", "Selector", "DecisionTree", "RandomForest", "NaiveBayes")
CLASSIFIERS = ("DecisionTree", "RandomForest", "NaiveBayes")


@query("random_structures", f"""
    WITH q AS (SELECT config, greatest(1, least(10, CAST(ceil((0.5e0 + sqrt(-2 * ln({_u('6deptha', 'config')})) * cos(2 * pi() * {_u('6depthb', 'config')}) / 6) * 10) AS INTEGER))) AS depth FROM runs),
    s AS (SELECT config, depth, unnest(range(1, depth + 1)) AS i FROM q)
    SELECT config, depth, string_agg(CASE WHEN i = depth THEN {list(CLASSIFIERS)}[CAST(floor({_u('6last', 'config', '0')} * 3) AS INTEGER) + 1]
           ELSE {list(COMPONENTS)}[CAST(floor({_u('6step', 'config', 'i')} * 8) AS INTEGER) + 1] END, '>' ORDER BY i) AS steps
    FROM s GROUP BY config, depth""")
def random_structures(spark, d):
    out = T.random_structures(V.runs(spark, d).select("config"), ["config"], COMPONENTS, CLASSIFIERS, seed=6)
    return out.select("config", "depth", F.array_join("steps", ">").alias("steps"))


_KEY = ", ".join(f"CAST({c} AS VARCHAR)" for c in ("space_id", "quantity", "discount", "flag", "loss"))


@query("impute_conditional", f"""
    WITH q AS (SELECT space_id, quantity, discount, flag, loss, CASE WHEN flag <> 1 THEN tax END AS tax, count(*) AS copies
               FROM config_rows GROUP BY ALL),
    don AS (SELECT space_id, tax, row_number() OVER (PARTITION BY space_id ORDER BY quantity, discount, flag, loss, tax) - 1 AS no,
                   count(*) OVER (PARTITION BY space_id) AS m FROM q WHERE tax IS NOT NULL),
    sz AS (SELECT space_id, any_value(m) AS m FROM don GROUP BY space_id),
    ask AS (SELECT q.*, CAST(floor((CAST('0x' || substr(md5(concat_ws('|', '2tax', {_KEY})), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 * m) AS BIGINT) AS no
            FROM q LEFT JOIN sz USING (space_id) WHERE tax IS NULL)
    SELECT space_id, round(quantity, 6) AS quantity, round(discount, 6) AS discount, flag, round(loss, 9) AS loss, round(tax, 6) AS tax, copies FROM q WHERE tax IS NOT NULL
    UNION ALL
    SELECT a.space_id, round(a.quantity, 6) AS quantity, round(a.discount, 6) AS discount, a.flag, round(a.loss, 9) AS loss, round(d.tax, 6) AS tax, a.copies
    FROM ask a JOIN don d ON a.space_id = d.space_id AND a.no = d.no""")
def impute_conditional(spark, d):
    """The tax parameter is active only for two of the three categories."""
    rows = V.configs(spark, d).withColumn("tax", F.when(F.col("flag") != 1.0, F.col("tax")))
    distinct = rows.groupBy("space_id", *V.DIMS, "loss").agg(F.sum("copies").alias("copies"))
    out = T.impute_conditional(distinct, DIMS, ["space_id"], ["space_id", "quantity", "discount", "flag", "loss"], seed=2)
    return out.select("space_id", r6("quantity"), r6("discount"), "flag", r6("loss", digits=9), r6("tax"), "copies")


@query("propose_configs")
def propose_configs(spark, d):
    return T.propose_configs(V.configs(spark, d), DIMS, seed=1)
