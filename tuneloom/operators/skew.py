"""Ordered computations over groups of any size.

A plain window puts a whole group into one task. The functions here deal the rows out by ranges of (keys, order),
`RANGE_BYTES` of counted bytes each, so a group holding a third of the table spans a third of the ranges, while a small
group stays whole. A range holds the end of one group, whole groups, and the begin of another: only its first group can
have rows before the range. So one row per range carries everything over: what came before its first group's rows.

The rows cross the network once. A range lands in one bucket of a table in the shared folder; the window inside the
range and the totals read that table by its buckets and need no further exchange of rows. Tables of a single range are
not dealt at all: a plain window does.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneloom.session import cut_lineage, new_path

RANGE_BYTES = 64 << 20
#: Buckets a table may have in Spark; more ranges than that share them, a window each.
MAX_BUCKETS = 100_000
#: Ranges, one short row each, whose carried values are sent to all tasks.
SENT_RANGES = 20_000


#: Rows that a task of a grouping by fine keys gets.
GROUPED_ROWS = 250_000


def bounded(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by hash of the keys, in as many tasks as `GROUPED_ROWS` counted rows fill.

    For groupings that hardly make rows fewer: they add up where the rows land, without a partial aggregate of a whole file,
    and without tasks that are made by compressed bytes and hold many millions of short rows. Meant for tables that are read
    from files, whose rows are counted without reading them.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // GROUPED_ROWS))
    return df.repartition(tasks, *keys)


def bytes_of(field: T.StructField) -> Column:
    """About the bytes a value takes in a shuffle."""
    x, kind = F.col(field.name), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(x), F.lit(0)) + 8
    if isinstance(kind, (T.ArrayType, T.MapType)):
        inner = kind.elementType if isinstance(kind, T.ArrayType) else None
        if isinstance(inner, (T.StringType, T.BinaryType)):
            return F.coalesce(F.aggregate(x, F.lit(0), lambda n, s: n + F.coalesce(F.octet_length(s), F.lit(0)) + 8), F.lit(0)) + 16
        return F.greatest(F.size(x), F.lit(0)) * 16 + 16
    return F.lit(8 * len(kind.fields) + 8 if isinstance(kind, T.StructType) else 8)


def range_count(df: DataFrame, range_bytes: int | None = None) -> int:
    """How many ranges of `RANGE_BYTES` the rows of `df` fill, counted."""
    size = sum((bytes_of(f) for f in df.schema.fields), F.lit(8))
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return max(1, -(-total // (range_bytes or RANGE_BYTES)))


def dealt(df: DataFrame, cols: Sequence[str], ranges: int) -> DataFrame:
    """The rows in a bucketed table, with the number `_range` of the range they fall into, ordered by `cols`.

    Also `_place`, which grows along `cols` within a range.
    """
    spark = df.sparkSession
    sorted_rows = df.repartitionByRange(ranges, *cols).sortWithinPartitions(*cols).withColumn("_place", F.monotonically_increasing_id())
    named = f"ranges_{uuid.uuid4().hex}"
    sorted_rows.withColumn("_range", F.shiftright("_place", 33)).write.bucketBy(min(ranges, MAX_BUCKETS), "_range").option("path", new_path(spark, "ranges")).saveAsTable(named)
    rows = spark.table(named)
    spark.sql(f"DROP TABLE {named}")  # the name goes, the files stay
    return rows


def _over_ranges(edges: DataFrame, held: Column, amounts: dict[str, Column], asked: Column, later: bool = False) -> DataFrame:
    """(_to, and for each name of `amounts` its value over the earlier, or later, ranges that hold what the range `_to` asks for).

    `edges` has one row per range; `amounts` are aggregates of columns of it.
    """
    rows = edges.select(F.col("_range").alias("_to"), F.explode(F.array(
        F.struct(held.alias("of"), F.lit(True).alias("gives")), F.struct(asked.alias("of"), F.lit(False).alias("gives")))).alias("_e"), *[c for c in edges.columns if c != "_range"])
    there = Window.partitionBy("_e.of").orderBy("_to")
    there = there.rangeBetween(1, Window.unboundedFollowing) if later else there.rangeBetween(Window.unboundedPreceding, -1)
    return rows.select("_to", "_e.gives", *(x.over(there).alias(n) for n, x in amounts.items())).where("not gives").drop("gives")


def _carried_over(rows: DataFrame, carry: DataFrame, ranges: int) -> DataFrame:
    """The rows next to what their range carries: joined on the range alone, by which they lie in buckets."""
    return rows.join(F.broadcast(carry) if ranges <= SENT_RANGES else carry, F.col("_range") == F.col("_to"), "left")


def _giving(x: Column) -> Column:
    return F.when(F.col("_e.gives"), x)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, Column]],
    ranges: int | None = None,
    settle: bool = False,
) -> DataFrame:
    """Running values per group in the ascending order of `order`, which has to identify a row inside its group.

    `values` maps an output name to one of
    ("sum_before", x): sum of x over the rows strictly before this one,
    ("max", x): largest x up to and including this row,
    ("last", x): latest non-NULL x up to and including this row.
    The input is read to count its bytes and again to deal it out; `settle` writes it once first, which pays when it is
    itself the result of joins or aggregations. `ranges` overrides the count.
    """
    keys, order = list(keys), list(order)
    unknown = {kind for kind, _ in values.values()} - {"sum_before", "max", "last"}
    if unknown:
        raise ValueError(f"unknown running value {unknown}")
    kept = df.columns
    df = df.withColumns({f"_in_{name}": x for name, (_, x) in values.items()})
    if settle:
        df = cut_lineage(df)
    ranges = ranges or range_count(df)
    alone = ranges == 1
    rows = df if alone else dealt(df, keys + order, ranges)
    # a struct is never null, and null fields of two structs are equal
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    inside = (Window.partitionBy(*(keys or [F.lit(0)])) if alone else Window.partitionBy("_range", *keys)).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    local, totals, carried, out = {}, [], {}, []
    for name, (kind, _) in values.items():
        x, loc, car, tot = F.col(f"_in_{name}"), F.col(f"_loc_{name}"), F.when(group == F.col("_head"), F.col(f"_carry_{name}")), F.col(f"_t._tot_{name}")
        if kind == "sum_before":
            local[f"_loc_{name}"] = F.sum(x).over(before)
            totals.append(F.sum(x).alias(f"_tot_{name}"))
            carried[f"_carry_{name}"] = F.sum(_giving(tot))
            out.append((F.coalesce(loc, F.lit(0)) + (F.lit(0) if alone else F.coalesce(car, F.lit(0)))).alias(name))
        elif kind == "max":
            local[f"_loc_{name}"] = F.max(x).over(upto)
            totals.append(F.max(x).alias(f"_tot_{name}"))
            carried[f"_carry_{name}"] = F.max(_giving(tot))
            out.append((loc if alone else F.greatest(loc, car)).alias(name))
        else:
            local[f"_loc_{name}"] = F.last(x, ignorenulls=True).over(upto)
            totals.append(F.max_by(x, F.when(x.isNotNull(), F.col("_place"))).alias(f"_tot_{name}"))
            carried[f"_carry_{name}"] = F.last(_giving(tot), ignorenulls=True)
            out.append((loc if alone else F.coalesce(loc, car)).alias(name))
    rows_with = rows.withColumns(local)
    if alone:
        return rows_with.select(*kept, *out)
    each = rows.groupBy("_range", group.alias("_group")).agg(F.min("_place").alias("_at"), *totals)
    picked = [c for c in each.columns if c not in ("_range", "_at")]
    edges = cut_lineage(each.groupBy("_range").agg(F.min_by("_group", "_at").alias("_head"), F.max_by(F.struct(*picked), "_at").alias("_t")))
    carry = _over_ranges(edges, F.col("_t._group"), carried, F.col("_head")).join(edges.select(F.col("_range").alias("_to"), "_head"), "_to")
    return _carried_over(rows_with, carry, ranges).select(*kept, *out)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", ranges: int | None = None) -> DataFrame:
    """0-based position inside the group; the same number everywhere as row_number() - 1."""
    return running(df, keys, order, {name: ("sum_before", F.lit(1).cast("long"))}, ranges)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "avg_rank", ranges: int | None = None) -> DataFrame:
    """Rank with ties averaged, over groups and ties of any size.

    Ties may span ranges; a range asks the others for the rows that tie with its first and its last one.
    """
    keys, kept = list(keys), df.columns
    ranges = ranges or range_count(df)
    alone = ranges == 1
    if not alone:
        plain = [F.col(f.name) for f in df.schema.fields if f.dataType.typeName() != "map"]
        df = dealt(df.withColumn("_spread", F.xxhash64(*plain) + F.spark_partition_id()), [*keys, value, "_spread"], ranges)
    by = keys or [F.lit(0)]
    within = Window.partitionBy(*by) if alone else Window.partitionBy("_range", *keys)
    ties = Window.partitionBy(*by, value) if alone else Window.partitionBy("_range", *keys, value)
    place, tied = F.rank().over(within.orderBy(value)), F.count("*").over(ties)
    if alone:
        return df.select(*kept, (place + (tied - 1) / 2).alias(name))
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    each = df.groupBy("_range", group.alias("_group"), F.col(value).alias("_value")).agg(F.count("*").alias("_n"), F.min("_place").alias("_at"))
    one = F.struct(F.struct("_group", "_value").alias("tie"), "_n")
    each = each.groupBy("_range", "_group").agg(
        F.sum("_n").alias("_rows"), F.min_by(one, "_at").alias("_low"), F.max_by(one, "_at").alias("_high"), F.min("_at").alias("_at"))
    edges = cut_lineage(each.groupBy("_range").agg(F.min_by("_low", "_at").alias("_head"), F.max_by(F.struct("_rows", "_high"), "_at").alias("_t")))
    head, tail = F.col("_head.tie"), F.col("_t._high.tie")
    carry = edges.select(F.col("_range").alias("_to"), head.alias("_first"), tail.alias("_last"))
    carry = carry.join(_over_ranges(edges, tail["_group"], {"_before": F.sum(_giving(F.col("_t._rows")))}, head["_group"]), "_to")
    carry = carry.join(_over_ranges(edges, tail, {"_ties_before": F.sum(_giving(F.col("_t._high._n")))}, head), "_to")
    carry = carry.join(_over_ranges(edges, head, {"_ties_after": F.sum(_giving(F.col("_head._n")))}, tail, later=True), "_to")
    here = F.struct(group.alias("_group"), F.col(value).alias("_value"))

    def where(found: Column, x: str) -> Column:
        return F.when(found, F.coalesce(x, F.lit(0))).otherwise(0)

    earlier = where(here == F.col("_first"), "_ties_before")
    start = F.col("_rank") + where(group == F.col("_first._group"), "_before") - earlier
    ties = F.col("_tied") + earlier + where(here == F.col("_last"), "_ties_after")
    rows = df.select("*", place.alias("_rank"), tied.alias("_tied"))
    return _carried_over(rows, carry, ranges).select(*kept, (start + (ties - 1) / 2).alias(name))


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi join where one key may hold a large share of `big`.

    `small` holds at most a bounded number of rows per key; it is repeated once
    per salt while `big` is spread over the salts by a hash of the whole row and the
    task it sits in, so copies of one row part as well. A repeated task gives its
    rows the same salts again.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep their meaning when the right side is repeated")
    plain = [F.col(f.name) for f in big.schema.fields if f.dataType.typeName() != "map"]
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*plain) + F.spark_partition_id(), F.lit(salts)))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
