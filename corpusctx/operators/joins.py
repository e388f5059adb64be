"""Joins that keep hot keys spread over tasks."""

from functools import reduce

from pyspark.sql import functions as F

# A key set up to this many rows may be broadcast; it is counted before the hint is given.
BROADCAST_ROWS = 100_000
SALTS = 256
TASKS_PER_COPY = 64


def join_on(left, right, keys, how="inner"):
    """Equi join on key columns where null equals null; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def without_keys(df, dropped, n_dropped, keys, spread):
    """Rows of ``df`` whose key is not in ``dropped`` (distinct keys, ``n_dropped`` of them, counted).

    Few keys are broadcast, so the rows to drop never move. Many keys are repeated once per
    salt and joined on key and salt, so no dropped group meets in one task.
    """
    if n_dropped <= BROADCAST_ROWS:
        return join_on(df, F.broadcast(dropped.select(*keys)), keys, "left_anti")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    copies = dropped.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_salt"))
    return join_on(salted, copies, [*keys, "_salt"], "left_anti").drop("_salt")


def join_sparse(left, right, key, spread):
    """Left join on a key that many left rows lack.

    Rows without the key match nothing; each gets a join key of its own from ``spread``, so
    they do not all meet in one task.
    """
    own = F.concat(F.lit("k"), F.col(key).cast("string"))
    placed = left.withColumn("_key", F.coalesce(own, F.concat(F.lit("-"), F.col(spread).cast("string"))))
    return placed.join(right.withColumn("_key", own).drop(key), "_key", "left").drop("_key")


def join_wide(tasks, wide, keys):
    """Left join of tasks to one wide row per key, with a copy of that row per ``TASKS_PER_COPY`` tasks.

    Without the copies all tasks of a popular key would write their wide rows from one task.
    """
    load = tasks.groupBy(*keys).agg(F.ceil(F.count("*") / TASKS_PER_COPY).alias("_copies"))
    placed = join_on(tasks, load, keys).withColumn("_copy", F.pmod(F.xxhash64("task_id"), F.col("_copies"))).drop("_copies")
    copies = join_on(wide, load, keys).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    return join_on(placed, copies, [*keys, "_copy"], "left").drop("_copy")
