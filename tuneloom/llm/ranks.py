"""Places of rows in the order of their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.llm.text import written
from tuneloom.session import shuffle_width

RANGE_ROWS = 1_000_000
#: Tables of so many rows are numbered by a plain window.
FEW_ROWS = 10_000
#: Rows of a task where a table of known size is written.
TASK_ROWS = 50_000


def numbered(df: DataFrame) -> Column:
    """A number of its own for each row; use it in a table that is written, and as the last column of an order."""
    return F.monotonically_increasing_id()


def ranked(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Every row of a written table with `rank` (from 0) in its group and `members`, the size of the group.

    The rows are dealt out once by ranges of (group, order); a range counts its rows of each group, and running sums over
    these counts place the ranges. A group may hold all rows: no task ever sees more than a range of it. The order must
    not tie in more rows than a task holds; `numbered` as its last column sees to that. Nulls come first. A table of
    `FEW_ROWS` takes a plain window.
    """
    keys, n = [*group, *order], rows.count()
    within = Window.partitionBy(*(group or [F.lit(0)]))
    if n <= FEW_ROWS:
        return rows.select("*", (F.row_number().over(within.orderBy(*keys)) - 1).cast("long").alias("rank"), F.count("*").over(within).alias("members"))
    width = max(shuffle_width(rows.sparkSession), -(-n // RANGE_ROWS))
    dealt = rows.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    placed = written(dealt.withColumn("_place", F.monotonically_increasing_id()), label)
    part = F.shiftright("_place", 33).alias("_part")
    counts = placed.groupBy(*group, part).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_part").alias("_range"), "_first", before.alias("_before"), F.sum("_n").over(within).alias("members"))
    same = F.shiftright("_place", 33) == F.col("_range")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    return placed.join(starts, same).select(*rows.columns, (F.col("_before") + F.col("_place") - F.col("_first")).alias("rank"), "members")


def written_rows(df: DataFrame, label: str, rows: int) -> DataFrame:
    """As `written`, by as many tasks as about `rows` rows need."""
    tasks = -(-max(rows, 1) // TASK_ROWS)
    return written(df.coalesce(tasks) if tasks < shuffle_width(df.sparkSession) else df, label)
