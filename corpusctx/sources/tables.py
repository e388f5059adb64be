"""Keyed tables kept as one folder per run: history is every run, the table is the latest per key.

A run's folder is written as a whole and rewritten as a whole when a job is repeated, so
a lost executor or a repeated batch leaves no mixture behind.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpusctx.operators.store import PromptStore
from corpusctx.sources.scratch import materialize

# Parts of one task that lie together in a file.
SLICE = 100_000
# Folders that the keys of a run are dealt to, and chunks of a prompt that lie together in a file.
BUCKETS = 64
CHUNKS_A_FILE = 1024


def write_run(df, path, run_id):
    """Write one run."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={int(run_id)}")


def _bucket(keys):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def write_keyed(df, path, run_id, keys, spread=()):
    """Write one run with a folder per bucket of keys, so ``read_key`` reads one bucket of every run.

    Rows of one bucket and one value of ``spread`` meet in one file.
    """
    placed = df.withColumn("_bucket", _bucket([F.col(k) for k in keys]))
    placed = placed.repartition("_bucket", *spread).sortWithinPartitions("_bucket", *keys)
    placed.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/run_id={int(run_id)}")


def read_runs(spark, path):
    runs = spark.read.option("basePath", path).parquet(path).withColumn("run_id", F.col("run_id").cast("bigint"))
    return runs.drop("_bucket")


def _newest(runs, keys):
    newest = runs.groupBy(*keys).agg(F.max("run_id").alias("run_id"))
    return runs.join(newest, [*keys, "run_id"], "left_semi")


def read_latest(spark, path, keys):
    """Rows of the newest run of each key."""
    return _newest(read_runs(spark, path), keys)


def read_key(spark, path, key):
    """Rows of the newest run of one key (a dict of columns and values), from its bucket alone.

    ``path`` was written by ``write_keyed`` over these columns in this order.
    """
    runs = spark.read.option("basePath", path).parquet(path).withColumn("run_id", F.col("run_id").cast("bigint"))
    # Hashes depend on the type, so values get that of the column.
    values = {k: F.lit(v).cast(runs.schema[k].dataType) for k, v in key.items()}
    rows = runs.where(F.col("_bucket") == _bucket(list(values.values())))
    for k, v in values.items():
        rows = rows.where(F.col(k).eqNullSafe(v))
    return _newest(rows.drop("_bucket"), list(key))


def write_prompts(prompts, path, run_id):
    """Prompts of a run; ``read_latest(spark, path, ["task_id"])`` gives the current ones, ``read_key`` one of them."""
    spread = [F.floor(F.col("chunk_no") / CHUNKS_A_FILE)] if "chunk_no" in prompts.columns else []
    write_keyed(prompts, path, run_id, ["task_id"], spread)


def write_store(store, path, run_id):
    """A ``PromptStore`` of a run. Texts that an earlier run holds are not written again.

    Repeating a run looks at earlier runs only and so writes the same. Texts move to no other task
    than the one that writes them, unless the earlier addresses are too many to be sent around.
    """
    spark, contents = store.contents.sparkSession, store.contents
    earlier = _earlier(spark, f"{path}/contents", run_id)
    if earlier is not None:
        known = materialize(earlier.select("address").distinct(), "known")
        contents = contents.join(known, "address", "left_anti")
    write_run(contents, f"{path}/contents", run_id)
    for name in ("places", "heads", "tails"):
        write_run(getattr(store, name), f"{path}/{name}", run_id)


def _earlier(spark, path, run_id):
    """Rows of the runs before ``run_id``; None where there are none."""
    try:
        runs = read_runs(spark, path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return runs.where(F.col("run_id") < int(run_id))


def read_store(spark, path, run_id, keys=("project",)):
    """The ``PromptStore`` of a run; its texts may lie in earlier runs."""
    tables = {name: read_runs(spark, f"{path}/{name}") for name in ("contents", "places", "heads", "tails")}
    held = tables.pop("contents").where(F.col("run_id") <= int(run_id)).drop("run_id")
    own = {name: t.where(F.col("run_id") == int(run_id)).drop("run_id") for name, t in tables.items()}
    return PromptStore(contents=held, **own, keys=tuple(keys))


def write_prompt_parts(parts, path, run_id):
    """Parts of a run, each slice of a task in order in one file; no task is ever held whole.

    Slices are placed by hash: ordering ranges would have to run the input twice.
    """
    placed = parts.repartition("task_id", F.floor((F.col("seq") - 1) / SLICE))
    write_run(placed.sortWithinPartitions("task_id", "seq"), path, run_id)


def write_results(results, path, run_id):
    """Answers keyed by task and raw model name: a later run replaces an earlier answer."""
    write_keyed(results, path, run_id, ["task_id", "model"])


def compact(spark, path, keys, out, spread=()):
    """Fold all runs into one at a new place, by buckets of the keys."""
    latest = read_latest(spark, path, keys)
    last = latest.agg(F.max("run_id")).first()[0]
    write_keyed(latest.drop("run_id"), out, last if last is not None else 0, keys, spread)
