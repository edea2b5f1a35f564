"""Density models over evaluated configurations, and proposals from them.

Configurations are counted rows: (space_id, dims.., loss, copies). Every step is
linear in the rows: points to be rated are a bounded number per space and sums
combine before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tuneloom.functions import draws, normal
from tuneloom.operators import skew
from tuneloom.session import cut_lineage

# Fixed values of the density model.
TOP_PERCENT = 15
NUM_SAMPLES = 64
RANDOM_FRACTION = 0.2
BANDWIDTH_FACTOR = 3.0
MIN_BANDWIDTH = 1e-3
SUPPORT_POINTS = 8
TINY = 1e-32

#: Rows of a group that one task adds up, and rows whose kernels stand in memory at once.
TASK_ROWS = 200_000
CHUNK_ROWS = 4096
#: Rows of small groups that meet Python in one table.
TABLE_ROWS = 50_000
#: Hot groups, counted, that are sent to all tasks.
SENT_GROUPS = 100_000
#: Spaces, counted, whose sizes (one short row each) are sent to all tasks.
SENT_SPACES = 500_000
#: Points that a task draws.
DRAWN_POINTS = 50_000


@dataclass(frozen=True)
class Dim:
    """A unit-scaled numeric parameter, or a categorical one with `choices` values 0..choices-1."""

    name: str
    choices: int = 0

    def support(self, points: int = SUPPORT_POINTS) -> list[float]:
        if self.choices:
            return [float(i) for i in range(self.choices)]
        return [i / (points - 1) for i in range(points)]


def names_of(dims: Sequence[Dim]) -> list[str]:
    return [d.name for d in dims]


def least_points(dims: Sequence[Dim], min_points: int = 0) -> int:
    return max(int(1.5 * len(dims)) + 1, min_points)


def space_sizes(configs: DataFrame, dims: Sequence[Dim], min_points: int = 0, top: int = TOP_PERCENT) -> DataFrame:
    need = F.lit(least_points(dims, min_points)).cast("long")
    n = F.col("n")
    sizes = configs.groupBy("space_id").agg(F.sum("copies").alias("n"))
    return sizes.select(
        "space_id", "n", F.greatest(need, F.floor(n * top / 100)).alias("n_good"),
        F.greatest(need, F.floor(n * (100 - top) / 100)).alias("n_bad"), (n >= need).alias("enough"))


def good_bad_split(configs: DataFrame, dims: Sequence[Dim], min_points: int = 0, top: int = TOP_PERCENT, settled: bool = False) -> DataFrame:
    """The best n_good and the worst n_bad rows per space as weights; the two sets may overlap.

    A loss that is not finite sorts last. Copies stand together in the order, so a
    set boundary may take a part of them. `place` is the number of better rows.
    The configurations are written once, for the places and the sizes, unless they are `settled`.
    """
    configs = configs if settled else cut_lineage(configs)
    finite = F.col("loss").isNotNull() & ~F.isnan("loss")
    clean = configs.withColumn("loss", F.when(finite, F.col("loss")).otherwise(float("inf")))
    placed = skew.running(clean, ["space_id"], ["loss", *names_of(dims)], {"place": ("sum_before", F.col("copies"))})
    sizes = cut_lineage(space_sizes(configs, dims, min_points, top).where("enough"))
    joined = placed.join(F.broadcast(sizes), "space_id") if sizes.count() <= SENT_SPACES else skew.salted_join(placed, sizes, ["space_id"])
    zero = F.lit(0).cast("long")

    def within(limit: Column, before: Column) -> Column:
        return F.greatest(zero, F.least(F.col("copies"), limit - before))

    good = within(F.col("n_good"), F.col("place"))
    bad = within(F.col("n_bad"), F.col("n") - F.col("place") - F.col("copies"))
    sets = F.explode(F.array(
        F.struct(F.lit("good").alias("set"), good.alias("weight")), F.struct(F.lit("bad").alias("set"), bad.alias("weight"))))
    return joined.select("space_id", *names_of(dims), "loss", "place", sets.alias("_s")).select(
        "space_id", "_s.set", *names_of(dims), "loss", "place", "_s.weight").where("weight > 0")


def fit_gate(configs: DataFrame, dims: Sequence[Dim], min_points: int = 0, top: int = TOP_PERCENT) -> DataFrame:
    """Spaces with enough rows for a model: enough in total, and more rows than columns in both sets."""
    d = len(dims)
    sizes = space_sizes(configs, dims, min_points, top)
    n_good, n_bad = F.least("n", "n_good"), F.least("n", "n_bad")
    return sizes.select("space_id", "n", "n_good", "n_bad", (F.col("enough") & (n_good > d) & (n_bad > d)).alias("fits"))


def break_constant_categories(rows: DataFrame, dims: Sequence[Dim], defaults: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """Adds the default configuration, with another category, to groups where a category never changes."""
    cats = [d for d in dims if d.choices]
    if not cats:
        return rows
    spread = rows.groupBy(*keys).agg(
        *[F.min(c.name).alias(f"_lo_{c.name}") for c in cats], *[F.max(c.name).alias(f"_hi_{c.name}") for c in cats])
    same = {c.name: F.col(f"_lo_{c.name}") == F.col(f"_hi_{c.name}") for c in cats}
    any_same = None
    for cond in same.values():
        any_same = cond if any_same is None else any_same | cond
    values = []
    for d in dims:
        base = F.lit(float(defaults[d.name]))
        if d.choices:
            kept = F.col(f"_lo_{d.name}")
            other = F.when(kept == 0, 1.0).otherwise(0.0)
            base = F.when(same[d.name] & (kept == base), other).otherwise(base)
        values.append(base.alias(d.name))
    extra = spread.where(any_same).select(*keys, *values, F.lit(1).cast("long").alias("weight"))
    return rows.select(*keys, *names_of(dims), "weight").unionByName(extra)


def kde_bandwidth(rows: DataFrame, dims: Sequence[Dim], keys: Sequence[str]) -> DataFrame:
    """Normal-reference bandwidth per dimension, at least 1e-3; `n` is the number of rows."""
    w, d = F.col("weight"), len(dims)
    n = F.sum(w).cast("double")
    out = []
    for dim in dims:
        x = F.col(dim.name)
        mean = F.sum(w * x) / n
        var = F.greatest(F.sum(w * x * x) / n - mean * mean, F.lit(0.0))
        rule = 1.06 * F.sqrt(var) * F.pow(n, F.lit(-1.0 / (4 + d)))
        out.append(F.greatest(rule, F.lit(MIN_BANDWIDTH)).alias(f"bw_{dim.name}"))
    return rows.groupBy(*keys).agg(F.sum(w).alias("n"), *out)


def kernel(dim: Dim, x: np.ndarray, at: np.ndarray, bw: float) -> np.ndarray:
    """Kernels of all rows at all points: Gaussian for a number, match kernel for a category."""
    if dim.choices:
        return np.where(x[:, None] == at[None], 1 - bw, bw / (dim.choices - 1) if dim.choices > 1 else np.nan)
    own, place = np.unique(x, return_inverse=True)
    if 2 * len(own) <= len(x):  # equal values have equal kernels
        return kernel(dim, own, at, bw)[place]
    return np.exp(-0.5 * ((x[:, None] - at[None]) / bw) ** 2) / (math.sqrt(2 * math.pi) * bw)


def _chunks(n: int) -> Iterator[slice]:
    for begin in range(0, n, CHUNK_ROWS):
        yield slice(begin, begin + CHUNK_ROWS)


def _floats(table: pa.Table, names: Sequence[str]) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy().astype(float) for c in names}


def spread(rows: DataFrame, models: DataFrame, keys: Sequence[str], together: bool = False) -> tuple[GroupedData, GroupedData]:
    """Rows and the models of their group by (keys, salt). Only groups counted to hold more than a task's rows have several salts.

    With `together`, small groups share tables of about `TABLE_ROWS` rows, by a hash of the same; `in_groups` takes them apart again.
    """
    keys = list(keys)
    # columns of their own: both sides may come from one frame
    rows, models = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (rows, models))
    sizes = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    total, n = sizes.agg(F.sum("_n"), F.count_if(F.col("_n") > TASK_ROWS)).first()
    table = F.pmod(F.xxhash64(*keys, "_salt"), F.lit(max(1, -(-(total or 0) // TABLE_ROWS)))).alias("_table")
    by = [table] if together else [*keys, "_salt"]
    if not n:
        return tuple(x.withColumn("_salt", F.lit(0).cast("long")).groupBy(*by) for x in (rows, models))
    hot = sizes.where(F.col("_n") > TASK_ROWS).select(*keys, F.ceil(F.col("_n") / TASK_ROWS).alias("_salts"))
    hot = F.broadcast(hot) if n <= SENT_GROUPS else hot
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    salted = rows.withColumn("_part", F.spark_partition_id()).join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns, "_part"), salts))
    each = models.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return tuple(x.drop("_salts", "_part").groupBy(*by) for x in (salted, each))


def in_groups(add_up: Callable[[pa.Table, pa.Table], pa.Table], keys: Sequence[str], schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """`add_up` for the rows and the model of every group of (keys, `_salt`) that has a model in the two tables."""
    def each(data: pa.Table, model: pa.Table) -> pa.Table:
        code = np.zeros(data.num_rows + model.num_rows, dtype=np.int64)
        for c in (*keys, "_salt"):
            values = pa.chunked_array([*data.column(c).chunks, *model.column(c).chunks], data.schema.field(c).type).combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * len(values.dictionary) + values.indices.to_numpy(), return_inverse=True)[1]
        sides = []
        for side, own in ((data, code[:data.num_rows]), (model, code[data.num_rows:])):
            order = np.argsort(own, kind="stable")
            sides.append((side.take(pa.array(order)).combine_chunks(), own[order]))
        (data, d), (model, m) = sides
        parts = [schema.empty_table()]
        for g in np.unique(m):
            (a, b), (e, f) = (np.searchsorted(x, (g, g + 1)) for x in (d, m))
            parts.append(add_up(data.slice(a, b - a), model.slice(e, f - e)).cast(schema))
        return pa.concat_tables(parts).combine_chunks()

    return each


def kde_density(rows: DataFrame, bandwidths: DataFrame, points: DataFrame, dims: Sequence[Dim]) -> DataFrame:
    """Density of both sets at every point: (space_id, point, good, bad).

    `points` has a bounded number of rows (space_id, point, dims..) per space. A task adds up the kernels of its rows at
    all points of the space as one array; these sums, one row per task and point, are all that is added up after it.
    """
    cols = names_of(dims)
    wide = bandwidths.groupBy("space_id").agg(*(
        F.max(F.when(F.col("set") == s, F.col(c))).alias(f"{s}_{c}") for s in ("good", "bad") for c in ("n", *(f"bw_{c}" for c in cols))))
    models = points.select("space_id", "point", *cols).join(wide, "space_id")

    def add_up(data: pa.Table, model: pa.Table) -> pa.Table:
        x, at = _floats(data, [*cols, "weight"]), _floats(model, cols)
        sets, sums = data.column("set").to_numpy(zero_copy_only=False), {}
        for s in ("good", "bad"):
            own, sums[s] = sets == s, np.zeros(model.num_rows)
            if model.num_rows and own.any():
                n, bw = model.column(f"{s}_n")[0].as_py(), {c: model.column(f"{s}_bw_{c}")[0].as_py() for c in cols}
                some = {c: v[own] for c, v in x.items()}
                for part in _chunks(len(some["weight"])):
                    k = some["weight"][part, None] / n
                    for d in dims:
                        k = k * kernel(d, some[d.name][part], at[d.name], bw[d.name])
                    sums[s] += k.sum(0)
        return pa.table({"space_id": model.column("space_id"), "point": model.column("point"), "good": sums["good"], "bad": sums["bad"]})

    types = dict(points.dtypes)
    kinds = StructType.fromDDL(f"space_id {types['space_id']}, point {types['point']}, good double, bad double")
    left, right = spread(rows.select("space_id", "set", *cols, "weight"), models, ["space_id"], together=True)
    each = left.cogroup(right).applyInArrow(in_groups(add_up, ["space_id"], to_arrow_schema(kinds)), kinds)
    return each.groupBy("space_id", "point").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def expected_improvement(densities: DataFrame) -> DataFrame:
    ratio = F.greatest(F.lit(TINY), F.col("good")) / F.greatest(F.lit(TINY), F.col("bad"))
    return densities.withColumn("ei", ratio)


def best_candidate(rated: DataFrame, digits: int = 9) -> DataFrame:
    """Point with the largest expected improvement per space; the smallest point on ties."""
    return rated.groupBy("space_id").agg(
        F.min_by("point", F.struct(-F.round("ei", digits), F.col("point"))).alias("point"), F.max("ei").alias("ei"))


def parameter_grid(spaces: DataFrame, points: int = 10) -> DataFrame:
    """Support of every parameter: its categories, or linear or geometric points between its bounds.

    `spaces` has (space_id, name, kind, lower, upper, log, choices).
    """
    step = (F.col("i") / (points - 1)).cast("double")
    linear = F.col("lower") + (F.col("upper") - F.col("lower")) * step
    geometric = F.col("lower") * F.pow(F.col("upper") / F.col("lower"), step)
    count = F.when(F.col("kind") == "categorical", F.col("choices")).otherwise(F.lit(points))
    each = spaces.select("*", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("i"))
    value = F.when(F.col("kind") == "categorical", F.col("i").cast("double")).when(F.col("log"), geometric).otherwise(linear)
    return each.select("space_id", "name", "i", value.alias("value"))


def random_configs(spaces: DataFrame, n: int, seed: int = 0, default_first: bool = True) -> DataFrame:
    """`n` configurations per space in long form (space_id, config_no, name, value, origin).

    Uniform on the (log) range or over the categories; the first one may be the default.
    """
    rows = spaces.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("config_no"))
    u = draws.uniform(seed, "space_id", "config_no", "name")
    linear = F.col("lower") + (F.col("upper") - F.col("lower")) * u
    logged = F.exp(F.log("lower") + (F.log("upper") - F.log("lower")) * u)
    drawn = F.when(F.col("kind") == "categorical", F.floor(F.col("choices") * u).cast("double")).when(
        F.col("log"), logged).otherwise(linear)
    is_default = F.lit(default_first) & (F.col("config_no") == 0)
    return rows.select(
        "space_id", "config_no", "name", F.when(is_default, F.col("default")).otherwise(drawn).alias("value"),
        F.when(is_default, "Default").otherwise("Random Search").alias("origin"))


def marginal_means(rows: DataFrame, bandwidths: DataFrame, dims: Sequence[Dim]) -> DataFrame:
    """Mean density over the full parameter grid for every value of every dimension.

    The kernel is a product, so the mean over the other dimensions' grid points is
    the product of their mean kernels: the exact grid mean without the grid. A task takes the kernels of its rows at the
    support of each dimension once and returns one row per value.
    """
    cols = names_of(dims)

    def add_up(data: pa.Table, model: pa.Table) -> pa.Table:
        names, values = [d.name for d in dims for _ in d.support()], [v for d in dims for v in d.support()]
        if not data.num_rows or not model.num_rows:
            return out.empty_table()
        x, n = _floats(data, [*cols, "weight"]), model.column("n")[0].as_py()
        sums, seen = np.zeros(len(values)), np.zeros(len(values), dtype=np.int64)
        for part in _chunks(data.num_rows):
            at = [kernel(d, x[d.name][part], np.array(d.support()), model.column(f"bw_{d.name}")[0].as_py()) for d in dims]
            means = [k.mean(1) for k in at]
            terms = np.concatenate([
                k * math.prod((m for j, m in enumerate(means) if j != i), start=x["weight"][part] / n)[:, None] for i, k in enumerate(at)], axis=1)
            known = ~np.isnan(terms)
            sums += np.where(known, terms, 0.0).sum(0)
            seen += known.sum(0)
        same = [data.column(c).take(pa.array([0] * len(values))) for c in ("space_id", "set")]
        return pa.Table.from_arrays([*same, pa.array(names), pa.array(values, pa.float64()), pa.array(sums), pa.array(seen)], schema=out)

    frame = rows.select("space_id", "set", *cols, "weight")
    kinds = frame.select("space_id", "set", F.lit("").alias("name"), F.lit(0.0).alias("value"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("seen")).schema
    out = to_arrow_schema(kinds)
    left, right = spread(frame, bandwidths, ["space_id", "set"], together=True)
    each = left.cogroup(right).applyInArrow(in_groups(add_up, ["space_id", "set"], out), kinds)
    density = F.when(F.sum("seen") > 0, F.sum("total"))
    per_set = each.groupBy("space_id", "set", "name", "value").agg(density.alias("density"))
    both = per_set.groupBy("space_id", "name", "value").agg(
        F.max(F.when(F.col("set") == "good", F.col("density"))).alias("good"),
        F.max(F.when(F.col("set") == "bad", F.col("density"))).alias("bad"))
    return both.withColumn("ei", F.col("good") / F.col("bad"))


def impute_conditional(rows: DataFrame, dims: Sequence[Dim], keys: Sequence[str], ident: Sequence[str], seed: int = 0) -> DataFrame:
    """Fills inactive (NULL or NaN) parameters from a random other row of the group that has them.

    The donor of the first missing dimension gives all of the row's missing values it
    has itself; a dimension nobody has gets a uniform draw. Donors are numbered, and a
    row asks for one number, so the join is one to one however large the group is.
    """
    keys, ident = list(keys), list(ident)
    cols = names_of(dims)
    source = rows
    for c in cols:
        source = source.withColumn(c, F.when(F.isnan(c), None).otherwise(F.col(c)))
    out = source
    gaps = source.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    for d in dims:
        if not gaps[d.name]:
            continue
        donors = source.where(F.col(d.name).isNotNull())
        place = list(dict.fromkeys([*ident, *cols]))  # donors that differ in a parameter only have an order too
        numbered = skew.row_numbers(donors.select(*dict.fromkeys([*keys, *place])), keys, place, "_no").select(
            *keys, "_no", *[F.col(c).alias(f"_don_{c}") for c in cols])
        sizes = donors.groupBy(*keys).agg(F.count("*").alias("_size"))
        full = out.where(F.col(d.name).isNotNull())
        asking = skew.salted_join(out.where(F.col(d.name).isNull()), sizes, keys, how="left")
        asking = asking.withColumn("_no", draws.pick(F.col("_size"), f"{seed}{d.name}", *ident))
        given = asking.join(numbered, [*keys, "_no"], "left")
        u = draws.uniform(f"{seed}{d.name}r", *ident)
        fresh = F.floor(u * d.choices).cast("double") if d.choices else u
        filled = []
        for c in cols:
            value = F.coalesce(F.col(c), F.col(f"_don_{c}"))
            filled.append((F.coalesce(value, fresh) if c == d.name else value).alias(c))
        rest = [c for c in rows.columns if c not in cols]
        out = full.select(*rest, *cols).unionByName(given.select(*rest, *filled))
    return out


def draw_candidates(split: DataFrame, bandwidths: DataFrame, dims: Sequence[Dim], n: int = NUM_SAMPLES, seed: int = 0) -> DataFrame:
    """`n` points per space around random good rows.

    A number comes from a normal around the row's value, three bandwidths wide and
    limited to [0, 1], drawn by its quantile; a category stays with probability
    1 - bandwidth, else it is drawn anew.
    """
    cols = names_of(dims)
    good_bw = bandwidths.where("set = 'good'").drop("set")
    asked = good_bw.select("space_id", "n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point"))
    none = F.lit(None).cast("double")
    requests = asked.select(
        "space_id", draws.pick(F.col("n"), f"{seed}row", "space_id", "point").alias("pos"), F.lit(1).alias("kind"),
        F.col("point").cast("long").alias("point"), *[none.alias(c) for c in cols])
    data = split.where("set = 'good'").select(
        "space_id", F.col("place").alias("pos"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("point"), *cols)
    seen = skew.running(
        data.unionByName(requests), ["space_id"], ["pos", "kind", "point"],
        {"row": ("last", F.when(F.col("kind") == 0, F.struct(*cols)))})
    # few rows, but many sums for each: in tasks of their own, not in the few ranges that the rows fill
    tasks = max(split.sparkSession.sparkContext.defaultParallelism, -(-good_bw.count() * n // DRAWN_POINTS))
    centres = seen.where("kind = 1").select("space_id", "point", "row").repartition(tasks, "space_id", "point").join(good_bw, "space_id")
    out = centres
    for d in dims:
        u = draws.uniform(f"{seed}{d.name}", "space_id", "point")
        m, bw = F.col(f"row.{d.name}"), F.col(f"bw_{d.name}")
        if d.choices:
            again = F.floor(draws.uniform(f"{seed}{d.name}c", "space_id", "point") * d.choices).cast("double")
            out = out.withColumn(d.name, F.when(u < 1 - bw, m).otherwise(again))
        else:
            out = normal.add_truncated(out, d.name, u, m, bw * BANDWIDTH_FACTOR, 0.0, 1.0)
    return out.select("space_id", "point", *cols)


def fitted(configs: DataFrame, dims: Sequence[Dim], settled: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sets and their bandwidths, written once because every later step reads them again."""
    split = cut_lineage(good_bad_split(configs, dims, settled=settled))
    return split, cut_lineage(kde_bandwidth(split, dims, ["space_id", "set"]))


def propose_configs(configs: DataFrame, dims: Sequence[Dim], n: int = NUM_SAMPLES, seed: int = 0) -> DataFrame:
    """One proposal per space: the drawn candidate with the largest expected improvement.

    One space in five, and every space without a model, gets a uniform configuration.
    """
    cols = names_of(dims)
    configs = cut_lineage(configs)
    split, bandwidths = fitted(configs, dims, settled=True)
    points = cut_lineage(draw_candidates(split, bandwidths, dims, n, seed))
    rated = expected_improvement(kde_density(split, bandwidths, points, dims))
    chosen = best_candidate(rated).join(points, ["space_id", "point"])
    fits = fit_gate(configs, dims).select("space_id", "fits")
    by_chance = draws.uniform(f"{seed}chance", "space_id") < RANDOM_FRACTION
    joined = fits.join(chosen, "space_id", "left").withColumn(
        "_random", ~F.col("fits") | by_chance | F.col("point").isNull())
    values = []
    for d in dims:
        u = draws.uniform(f"{seed}{d.name}u", "space_id")
        fresh = F.floor(u * d.choices).cast("double") if d.choices else u
        values.append(F.when(F.col("_random"), fresh).otherwise(F.col(d.name)).alias(d.name))
    return joined.select(
        "space_id", *values, F.when(F.col("_random"), 1.0).otherwise(F.col("ei")).alias("ei"),
        F.when(F.col("_random"), "Random Search").otherwise("Hyperopt").alias("origin"))


def random_structures(requests: DataFrame, key: Sequence[str], components: Sequence[str], classifiers: Sequence[str],
                      max_depth: int = 10, seed: int = 0) -> DataFrame:
    """One random chain per request.

    The depth is ceil(N(0.5, 1/6) * max) within [1, max]. A chain is valid when its last
    step is a classifier; drawing that step among the classifiers gives the same
    distribution as drawing whole chains until one is valid.
    """
    depth = F.ceil((0.5 + draws.normal(f"{seed}depth", *key) / 6.0) * max_depth)
    bounded = F.greatest(F.lit(1), F.least(F.lit(max_depth), depth)).cast("int")
    steps = requests.select(*key, bounded.alias("depth"))

    def choose(names: Sequence[str], tag: str, i: Column) -> Column:
        u = draws.uniform(f"{seed}{tag}", *key, i)
        return F.get(F.lit(list(names)), F.floor(u * len(names)).cast("int"))

    last = choose(classifiers, "last", F.lit(0))
    body = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.when(
        i == F.col("depth"), last).otherwise(choose(components, "step", i)))
    return steps.select(*key, "depth", body.alias("steps"))
