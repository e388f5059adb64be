"""Exact row numbers that never put a whole group into one task."""

from pyspark.sql import Window, functions as F

from corpusctx.functions import paths
from corpusctx.operators.joins import join_on
from corpusctx.sources.scratch import materialize

_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def place_rows(df, group, order):
    """Rows in the order of (group, order) over partitions, written once: with ``_part`` and ``_pos`` therein."""
    # Order expressions become columns first: a sort evaluates its expressions at every comparison.
    computed = {f"_o{i}": o for i, o in enumerate(order) if not isinstance(o, str)}
    keys = [*group, *[o if isinstance(o, str) else f"_o{i}" for i, o in enumerate(order)]]
    ordered = df.withColumns(computed).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*computed)
    placed = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    at = F.col("_at")
    return placed.withColumns(
        {"_part": F.shiftright(at, _POSITION_BITS), "_pos": at.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))}
    ).drop("_at")


def number_rows(df, group, order, out="seq", totals=None):
    """1-based position of each row in its group by ``order`` (names or columns, ties must not matter).

    The rows are range-partitioned by group and order and written once, each with its
    partition and its place there. A group that spans many partitions gets its numbers
    from the sizes of its earlier partitions, so only one row per group and partition
    passes through a window. The join key holds the partition too and stays even when
    one group owns most rows.

    ``totals`` adds columns of what holds for the whole group: name to (aggregate of rows, function
    that merges its parts). They ride on the same sums, so a group's total is never joined on the
    group alone, where a hot group could not be split.

    Finding the ranges samples the input, which runs it twice: pass key columns only and
    join large payloads to the numbers afterwards.
    """
    placed = place_rows(df, group, order)
    totals = totals or {}
    parts = [rows.alias(name) for name, (rows, _) in totals.items()]
    runs = placed.groupBy(*group, "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"), *parts)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1
    # Written, so the planner knows its true size and broadcasts it only when small.
    whole = Window.partitionBy(*group)
    merged = [merge(name).over(whole).alias(name) for name, (_, merge) in totals.items()]
    runs = materialize(runs.select(*group, "_part", shift.alias("_shift"), *merged), "runs")
    joined = join_on(placed, runs, [*group, "_part"])
    return joined.select(*df.columns, *totals, (F.col("_pos") + F.col("_shift")).cast("bigint").alias(out))


def path_order(files, group=("project",), out="seq"):
    """Position of each file in its group, paths compared component by component."""
    return number_rows(files, list(group), [paths.order_key(F.col("path"))], out)
