"""Latest status per model and progress per run; the same code serves batch and stream."""

import time

from pyspark.sql import functions as F

from corpusctx.operators.dispatch import ROUTE_MARK
from corpusctx.sources.tables import read_runs, write_run

FINAL = ("Done", "Error", "Manual Input")


def _newest(events, keys):
    newest = F.max_by(F.struct("status", "ts", "event_id"), F.struct("ts", "event_id")).alias("s")
    return events.groupBy(*keys).agg(newest).select(*keys, "s.status", F.col("s.ts").alias("last_ts"), "s.event_id")


def latest_status(events, keys=("run", "model")):
    """Newest status of each model of each run; late events cannot replace newer ones.

    On a stream, state is one row per run and model; add a watermark before this call to
    let runs expire.
    """
    return _newest(events, keys).drop("event_id")


def run_progress(status):
    """Finished and all models per run; models asked by hand count as finished at once."""
    by_hand = ~F.contains(F.col("model"), F.lit(ROUTE_MARK))
    return status.groupBy("run").agg(
        F.count_if(F.col("status").isin(*FINAL) | by_hand).alias("completed"), F.count("*").alias("total")
    )


def order_models(status):
    """A status table in the order it is shown: by run, then model name."""
    return status.orderBy("run", "model")


def current_status(spark, path, keys=("run", "model")):
    """Newest status of each key by event time and id, whichever run or checkpoint wrote it."""
    written = read_runs(spark, path).withColumnRenamed("last_ts", "ts")
    return latest_status(written, keys)


def start_status(events, path, checkpoint, available_now=True, keys=("run", "model")):
    """Keep the status table at ``path`` up to date; read it with ``current_status(spark, path, keys)``.

    Every start writes runs of its own: a new checkpoint replaces none of an earlier one.
    """
    first = time.time_ns()

    def save(batch, epoch):
        write_run(batch, path, first + epoch)

    writer = (
        _newest(events, keys)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
