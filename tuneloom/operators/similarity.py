"""Exact nearest neighbours between two tables of vectors.

A projection on a unit vector never lengthens a distance, so two vectors within a reach lie within it on every
projection. A grid over a few projections, its cells twice the reach wide, therefore holds all stored rows within reach
of an asking row in the at most two cells per projection that the row's box touches: an equi join on cells finds them,
and none is missed. Without a reach, or below it, the reach grows: what is found within the reach of a round is the
nearest there is, and only the rows that found nothing ask again. When cells no longer part the rows, the rest meets
everything once.

Directions, number of projections and first reach come from a sample of bounded size; they change the work, not the
result. Inside a cell stored and asking rows meet in blocks of bounded size. A task gets one block of each side and
returns one row per asking row, so neither a full cell nor the pairs of a cell ever exist as rows, and no candidate is
left out. Copies of a vector are searched once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tuneloom.operators import skew
from tuneloom.session import cut_lineage

STORE_BLOCK = 16384
QUERY_BLOCK = 16384
SLACK = 1e-9
#: Stored vectors from which the grid is made.
SAMPLE = 1000
MOST_PROJECTIONS = 6
#: What a visit of a cell costs, in comparisons of two vectors.
VISIT = 64
#: Cells part the rows if a row meets at most this share of the stored rows in the cells it visits.
PARTED = 0.5


class Grid(NamedTuple):
    """Unit vectors (already weighted), and the sample on them: the places of its rows and how far each has its nearest."""

    directions: np.ndarray
    places: np.ndarray
    nearest: np.ndarray


def grid_of(store: DataFrame, weights: Sequence[float] | None = None) -> Grid:
    """Directions of greatest spread; at most `SAMPLE` rows reach the driver."""
    rows = store.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()
    if not rows:
        return Grid(np.empty((0, 0)), np.empty((0, 0)), np.empty(0))
    root = np.ones(len(rows[0]["vec"])) if weights is None else np.sqrt(np.array(weights, dtype=float))
    x = np.array([r["vec"] for r in rows], dtype=float) * root
    units = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:MOST_PROJECTIONS]
    units = units / np.linalg.norm(units, axis=1, keepdims=True)
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    return Grid(units * root, x @ units.T, d.min(1))


def projections_for(grid: Grid, reach: float, rows: int) -> int:
    """How many projections make the least work for `rows` stored rows at this reach, 0 if cells don't part the rows."""
    apart = np.ones((len(grid.places), len(grid.places)), dtype=bool)
    best, cost = 0, PARTED * rows
    for p in range(1, grid.places.shape[1] + 1):
        cell = np.floor(grid.places[:, p - 1] / (2 * reach))
        first, last = (np.floor((grid.places[:, p - 1] + s * reach) / (2 * reach)) for s in (-1, 1))
        apart &= (cell[None] >= first[:, None]) & (cell[None] <= last[:, None])
        met = 2.0**p * VISIT + apart.mean() * rows
        if apart.mean() <= PARTED and met < cost:
            best, cost = p, met
    return best


def _places(grid: Grid, p: int) -> Column:
    """Where a row lies on the first `p` projections."""
    return F.array(*(F.aggregate(F.zip_with("vec", F.lit([float(x) for x in u]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for u in grid.directions[:p]))


def _cell(numbers: Column) -> Column:
    return F.concat_ws(",", numbers.cast("array<string>"))


def store_cells(store: DataFrame, grid: Grid, p: int, reach: float) -> DataFrame:
    """Every stored row in its cell."""
    return store.withColumn("cell", _cell(F.transform(_places(grid, p), lambda x: F.floor(x / (2 * reach)))))


def visits(queries: DataFrame, grid: Grid, p: int, reach: float) -> DataFrame:
    """One row per asking row and cell that its box touches; sums and the slack of distances are allowed for."""
    def touched(x: Column) -> Column:
        wide = F.lit(reach + 4 * SLACK) + F.abs(x) * SLACK
        return F.sequence(F.floor((x - wide) / (2 * reach)), F.floor((x + wide) / (2 * reach)))

    spans = F.transform(_places(grid, p), touched)
    cells = F.aggregate(spans, F.array(F.array().cast("array<bigint>")), lambda made, span: F.flatten(F.transform(made, lambda m: F.transform(span, lambda c: F.concat(m, F.array(c))))))
    return queries.withColumn("_cells", cells).select(*queries.columns, F.explode("_cells").alias("_c")).withColumn("cell", _cell(F.col("_c"))).drop("_c")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of two blocks (already weighted), exact up to `doubt`."""
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0.0))


def doubt(a: np.ndarray, b: np.ndarray) -> float:
    """How far a distance from the matrix form may be off; it grows with the length of the vectors."""
    return 1e-7 * (1.0 + np.sqrt((a * a).sum(1).max()) + np.sqrt((b * b).sum(1).max()))


def _scaled(rows: pa.Table, root: np.ndarray | None) -> np.ndarray:
    vecs = rows.column("vec").combine_chunks()
    if vecs.null_count or len(pc.list_value_length(vecs).unique()) != 1:
        raise ValueError("vectors are missing or differ in length")
    x = vecs.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)
    return x if root is None else x * root


def same_keys(q: pa.Table, s: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows with equal keys, by the place in `q`; all other pairs need no look at their keys."""
    left, right = (pd.DataFrame({"key": x.column("key").to_pandas(), "at": np.arange(x.num_rows)}) for x in (q, s))
    both = left.merge(right, on="key")
    i, j = both["at_x"].to_numpy(), both["at_y"].to_numpy()
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def _meet(routed: DataFrame, celled: DataFrame, root: np.ndarray | None, within: float | None, exclude_same: bool, earlier: bool, first: bool) -> DataFrame:
    """The best stored row of every asking row in the cells it visits."""
    # columns of their own: both sides may come from one frame
    routed, celled = (x.select(*(F.col(c).alias(c) for c in ("space", "key", "ord", "vec", "cell"))) for x in (routed, celled))
    cells = celled.groupBy("space", "cell").agg(F.count("*").alias("n"))
    asked = routed.groupBy("space", "cell").agg(F.count("*").alias("m"))
    plan = cells.join(asked, ["space", "cell"]).select(
        "space", "cell", F.ceil(F.col("n") / STORE_BLOCK).alias("store_blocks"),
        F.ceil(F.col("m") / QUERY_BLOCK).alias("query_blocks"))
    plan = cut_lineage(plan)
    long = F.lit(1).cast("long")
    left = skew.salted_join(routed, plan, ["space", "cell"]).select(
        "space", "cell", "key", "ord", "vec",
        F.pmod(F.xxhash64("key", "ord"), "query_blocks").alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("store_blocks") - long)).alias("sb"))
    right = skew.salted_join(celled, plan, ["space", "cell"]).select(
        "space", "cell", "key", "ord", "vec",
        F.pmod(F.xxhash64("key"), "store_blocks").alias("sb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - long)).alias("qb"))
    asks, types = dict(routed.dtypes), dict(celled.dtypes)
    kinds = StructType.fromDDL(f"space {types['space']}, key {asks['key']}, ord {asks['ord']}, found_key {types['key']}, found_ord {types['ord']}, distance double")
    out = to_arrow_schema(kinds)

    def meet(q: pa.Table, s: pa.Table) -> pa.Table:
        if not q.num_rows or not s.num_rows:
            return out.empty_table()
        s = s.sort_by([("ord", "ascending"), ("key", "ascending")])
        a, b = _scaled(q, root), _scaled(s, root)
        slack, n, parts = doubt(a, b), s.num_rows, []
        i, j = same_keys(q, s) if exclude_same else (np.empty(0, int), np.empty(0, int))
        asked, stored = q.column("ord").to_numpy(), s.column("ord").to_numpy()
        # one product gives the squared distances without the asking row's own square
        left, right, own = np.c_[-2.0 * a, np.ones(len(a))], np.c_[b, (b * b).sum(1)].T, (a * a).sum(1)
        for lo in range(0, len(a), 512):
            hi = min(lo + 512, len(a))
            d2 = left[lo:hi] @ right
            here = slice(*np.searchsorted(i, (lo, hi)))
            d2[i[here] - lo, j[here]] = np.inf
            if earlier:
                d2[stored[None, :] >= asked[lo:hi, None]] = np.inf
            reach2 = np.inf if within is None else (within + slack) ** 2
            # the matrix form is inexact: whatever is in doubt is decided by plain differences
            if first:
                sure = d2 <= ((within - slack) ** 2 - own[lo:hi] if within >= slack else np.full(hi - lo, -np.inf))[:, None]
                at = np.where(sure.any(1), sure.argmax(1), n)
                maybe = (d2 <= (reach2 - own[lo:hi])[:, None]) & ~sure & (np.arange(n)[None, :] < at[:, None])
                r, c = np.nonzero(maybe)
                found = at < n
                r, c = np.concatenate([r, np.flatnonzero(found)]), np.concatenate([c, at[found]])
            else:
                least = d2.min(1)
                most = np.minimum((np.sqrt(np.maximum(least + own[lo:hi], 0.0)) + 2 * slack) ** 2, reach2) - own[lo:hi]
                r, c = np.nonzero(d2 <= np.where(np.isfinite(least), most, -np.inf)[:, None])
            exact = np.sqrt(((a[lo + r] - b[c]) ** 2).sum(1))
            if within is not None:
                kept = exact <= within + SLACK
                r, c, exact = r[kept], c[kept], exact[kept]
            order = np.lexsort((c, r)) if first else np.lexsort((c, np.round(exact, 12), r))
            r, c, exact = r[order], c[order], exact[order]
            best = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.array([], dtype=int)
            parts.append((lo + r[best], c[best], exact[best]))
        qi, si, dist = (np.concatenate(x) for x in zip(*parts))
        qq, ss = q.take(pa.array(qi, pa.int64())), s.take(pa.array(si, pa.int64()))
        return pa.Table.from_arrays([*(qq.column(c) for c in ("space", "key", "ord")), ss.column("key"), ss.column("ord"), pa.array(dist, pa.float64())], schema=out)

    by = ["space", "cell", "qb", "sb"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, kinds)
    rank = F.struct("found_ord", "found_key", "distance") if first else F.struct(
        F.round("distance", 12).alias("r"), F.col("found_ord"), F.col("found_key"), F.col("distance"))
    best = met.groupBy("space", "key", "ord").agg(F.min(rank).alias("b"))
    return best.select("space", "key", "ord", "b.found_key", "b.found_ord", "b.distance")


def search(queries: DataFrame, store: DataFrame, weights: Sequence[float] | None = None, within: float | None = None,
           exclude_same: bool = False, earlier: bool = False, first: bool = False, grid: Grid | None = None) -> DataFrame:
    """Best stored row per asking row.

    `queries` and `store` have (space, key, ord, vec); the result has
    (space, key, ord, found_key, found_ord, distance) for the asking rows that found one.
    `exclude_same` skips equal keys, `earlier` stored rows with ord >= the asking ord,
    `first` takes the smallest ord within reach instead of the nearest.
    """
    root = None if weights is None else np.sqrt(np.array(weights, dtype=float))
    grid = grid or grid_of(store, weights)
    n = store.count()
    if not n:
        return queries.where("false").select(
            "space", "key", "ord", F.col("key").alias("found_key"), F.col("ord").alias("found_ord"), F.lit(0.0).alias("distance"))
    limit = math.inf if within is None else within
    finite = grid.nearest[np.isfinite(grid.nearest) & (grid.nearest > 0)]
    reach = limit if first or not len(finite) else min(limit, float(np.median(finite)))
    asking, parts = queries, []
    while True:
        p = projections_for(grid, reach, n) if 0 < reach < math.inf else 0
        if not p:
            # one cell for all: the rest is decided here
            routed, celled = (x.withColumn("cell", F.lit("")) for x in (asking, store))
            parts.append(_meet(routed, celled, root, within, exclude_same, earlier, first))
            break
        found = _meet(visits(asking, grid, p, reach), store_cells(store, grid, p, reach), root, reach, exclude_same, earlier, first)
        if reach == limit:
            parts.append(found)
            break
        found = cut_lineage(found.where(F.col("distance") <= reach))
        parts.append(found)
        asking = cut_lineage(asking.join(found.select("space", "key", "ord"), ["space", "key", "ord"], "left_anti"))
        if asking.isEmpty():
            break
        reach = min(limit, 2 * reach)
    out = parts[0]
    for part in itertools.islice(parts, 1, None):
        out = out.unionByName(part)
    return out


def _prepare(df: DataFrame, ident: str, vec: str, space: str | None) -> DataFrame:
    return df.select(
        (F.col(space) if space else F.lit(0)).alias("space"), F.col(ident).alias("id"), F.col(vec).alias("vec"),
        F.md5(F.col(vec).cast("string")).alias("key"))


def nearest_neighbour(queries: DataFrame, store: DataFrame, ident: str, vec: str, weights: Sequence[float] | None = None,
                      within: float | None = None, exclude_self: bool = False, space: str | None = None) -> DataFrame:
    """Nearest stored row by sqrt(sum w (x - y)^2): (id, neighbour, distance), the smallest id on ties.

    Rows without a neighbour (empty store, or none within reach) have NULLs.
    """
    q, s = _prepare(queries, ident, vec, space), _prepare(store, ident, vec, space)
    # two smallest ids per distinct vector; the limit is applied before the shuffle
    order = Window.partitionBy("space", "key").orderBy("id")
    top = s.withColumn("_rn", F.row_number().over(order)).where("_rn <= 2")
    copies = top.groupBy("space", "key").agg(
        F.min("id").alias("first_id"), F.max(F.when(F.col("_rn") == 2, F.col("id"))).alias("second_id"),
        F.first("vec").alias("vec"))
    distinct_q = q.groupBy("space", "key").agg(F.first("vec").alias("vec")).withColumn("ord", F.lit(0).cast("long"))
    stored = copies.select("space", "key", F.col("first_id").cast("long").alias("ord"), "vec")
    hits = search(distinct_q, stored, weights, within, exclude_same=exclude_self)
    found = hits.select("space", "key", F.col("found_ord").alias("other_id"), "distance")
    if not exclude_self:
        joined = skew.salted_join(q, found, ["space", "key"], how="left")
        return joined.select("id", F.col("other_id").alias("neighbour"), "distance")
    own = copies.select("space", "key", "first_id", "second_id").join(found, ["space", "key"], "left")
    joined = skew.salted_join(q, own, ["space", "key"], how="left")
    twin = F.when(F.col("first_id") != F.col("id"), F.col("first_id")).otherwise(F.col("second_id"))
    return joined.select(
        "id", F.coalesce(twin, F.col("other_id")).cast("long").alias("neighbour"),
        F.when(twin.isNotNull(), 0.0).otherwise(F.col("distance")).alias("distance"))


def similar_within(rows: DataFrame, ident: str, vec: str, threshold: float = 0.05, weights: Sequence[float] | None = None,
                   space: str | None = None) -> DataFrame:
    """Every row with its nearest other row if that is within the threshold, and whether it counts as the same."""
    near = nearest_neighbour(rows, rows, ident, vec, weights, threshold, exclude_self=True, space=space)
    return near.withColumn("same", F.col("neighbour").isNotNull())


def config_groups(rows: DataFrame, ident: str, vec: str, space: str, threshold: float = 0.05,
                  weights: Sequence[float] | None = None) -> DataFrame:
    """Groups of similar datasets per space, first come first served: (space, id, leader, distance).

    In the order of ids a row joins its nearest earlier leader within the threshold or
    becomes a leader. Leaders are found in rounds over all rows at once: a row with
    no earlier row within reach leads; a row whose earliest such row leads does not; the
    others wait for the next round. Every round decides the earliest open row at least. The result is the same as going
    row by row.
    """
    q = _prepare(rows, ident, vec, space).withColumn("ord", F.col("id").cast("long"))
    # a later copy is never a leader, so only the earliest copy of a vector can be
    reps = q.groupBy("space", "key").agg(F.min("ord").alias("ord"), F.first("vec").alias("vec"))
    undecided = cut_lineage(reps.withColumn("lead", F.lit(False)))
    leaders, grid = undecided.where("false"), grid_of(reps, weights)
    while True:
        pool = leaders.unionByName(undecided)
        hit = search(undecided.drop("lead"), pool.drop("lead"), weights, threshold, exclude_same=True, earlier=True, first=True, grid=grid)
        marks = leaders.select("space", F.col("key").alias("found_key"), F.lit(True).alias("_known"))
        state = (
            undecided.join(hit.select("space", "key", "found_key"), ["space", "key"], "left")
            .join(marks, ["space", "found_key"], "left"))
        state = cut_lineage(state)
        fresh = state.where("found_key IS NULL").select("space", "key", "ord", "vec", F.lit(True).alias("lead"))
        leaders = cut_lineage(leaders.unionByName(fresh))
        undecided = state.where("found_key IS NOT NULL AND _known IS NULL").select("space", "key", "ord", "vec", "lead")
        if undecided.isEmpty():
            break
    lead = leaders.drop("lead")
    near = search(q.select("space", "key", "ord", "vec"), lead, weights, threshold, earlier=True, grid=grid)
    own = lead.select("space", "ord", F.col("ord").alias("own"))
    joined = (
        q.select("space", "ord").join(near.select("space", "ord", "found_ord", "distance"), ["space", "ord"], "left")
        .join(own, ["space", "ord"], "left"))
    return joined.select(
        F.col("space").alias(space), F.col("ord").alias(ident), F.coalesce("own", "found_ord").alias("leader"),
        F.when(F.col("own").isNotNull(), 0.0).otherwise(F.col("distance")).alias("distance"))


def all_close(before, after, rtol: float = 1e-5, atol: float = 1e-8):
    """Element-wise closeness of two vectors; NaN equals NaN."""
    both = F.zip_with(before, after, lambda a, b: (F.isnan(a) & F.isnan(b)) | (F.abs(a - b) <= atol + rtol * F.abs(b)))
    return F.forall(both, lambda x: F.coalesce(x, F.lit(False)))


def transform_effect(steps: DataFrame, store: DataFrame, ident: str, max_distance: float = 0.05) -> DataFrame:
    """What a transformation did: CRASHED, INEFFECTIVE, DUPLICATE of a stored dataset, or SUCCESS.

    `steps` has (id, status, before, after), `store` (id, vec). The checks apply in this order.
    """
    has = F.col("after").isNotNull() & (F.size("after") > 0) & ~F.exists("after", lambda x: x.isNull() | F.isnan(x))
    asking = steps.where((F.col("status") == "SUCCESS") & has).select(ident, F.col("after").alias("vec"))
    near = nearest_neighbour(asking, store, ident, "vec", within=max_distance).select(
        F.col("id").alias(ident), "neighbour", "distance")
    joined = steps.join(near, ident, "left")
    effect = (
        F.when(F.col("status") != "SUCCESS", F.col("status"))
        .when(~F.coalesce(has, F.lit(False)), "CRASHED")
        .when(all_close(F.col("before"), F.col("after")), "INEFFECTIVE")
        .when(F.col("neighbour").isNotNull(), "DUPLICATE").otherwise("SUCCESS"))
    return joined.select(
        ident, effect.alias("effect"), F.when(effect == "DUPLICATE", F.col("neighbour")).alias("duplicate_of"))


def column_profile(df: DataFrame, label: str, numeric: Sequence[str]) -> DataFrame:
    """Meta-features of a labelled table as (name, measure, value): one pass each for moments, correlations and classes."""
    x = F.col("x")
    moments = {
        "mean": F.avg(x), "std": F.stddev_samp(x), "skewness": F.skewness(x), "kurtosis": F.kurtosis(x),
        "missing": F.count_if(x.isNull() | F.isnan(x)) / F.count("*"), "min": F.min(x), "max": F.max(x)}
    # a few sums per column name stay inside generated code, many sums side by side do not
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in numeric]))
    per_column = df.select(each.alias("e")).select("e.*").groupBy("name").agg(*[m.alias(k) for k, m in moments.items()])
    long = per_column.select("name", F.explode(F.array(*[
        F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in moments])).alias("e")).select("name", "e.*")

    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1:]]
    one = df.agg(F.count("*").cast("double").alias("rows"), *[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])
    cells = [("dataset", "rows", "rows"), *[(a, f"corr_{b}", f"{a}_{b}") for a, b in pairs]]
    wide = one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(m).alias("measure"), F.col(c).alias("value")) for n, m, c in cells])).alias("e")).select("e.*")

    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    share = F.col("n") / total
    classes = counts.agg(
        F.count("*").cast("double").alias("classes"), F.sum(-share * F.log(share)).alias("class_entropy"),
        F.max(share).alias("largest_class"))
    class_rows = classes.select(F.explode(F.array(*[
        F.struct(F.lit("dataset").alias("name"), F.lit(m).alias("measure"), F.col(m).alias("value"))
        for m in ("classes", "class_entropy", "largest_class")])).alias("e")).select("e.*")
    return long.unionByName(wide).unionByName(class_rows)
