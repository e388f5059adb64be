"""A written ledger of answers: a request that it holds is not asked again."""

import time
import uuid

from pyspark.sql import functions as F

from corpusctx.operators.dispatch import CONCURRENCY, dispatch_batch
from corpusctx.sources.scratch import materialize, scratch_dir

# Requests that one task asks before its answers are written.
SLICE_ROWS = 20


def request_ids(requests):
    """``requests`` with ``request_id``, a digest of task, model and body: a question keeps its id in every run."""
    return requests.withColumn("request_id", F.sha2(F.to_json(F.struct("task_id", "model", "body")), 256))


def _schema(requests):
    task = requests.schema["task_id"].dataType.simpleString()
    return f"task_id {task}, model string, raw string, error string, seconds double, request_id string, asked_at long"


def ledger_answers(ledger):
    """One row per request of a ledger: its newest answer, or its newest error if it has none."""
    last = F.max(F.struct(F.col("error").isNull().alias("good"), "asked_at")).alias("last")
    newest = ledger.groupBy("request_id").agg(last).select("request_id", "last.asked_at")
    return ledger.join(newest, ["request_id", "asked_at"], "left_semi")


def dispatch_to_ledger(requests, provider, path, concurrency=CONCURRENCY, slice_rows=SLICE_ROWS, retry_errors=False):
    """Ask what the ledger at ``path`` doesn't hold, add the answers, and return those of ``requests``.

    Requests (task_id, model, body) go in rounds of ``concurrency`` tasks of about ``slice_rows``
    each, and a round is written before the next one starts. A lost task repeats its slice, a job
    that is started again at most the round that was not written. Equal requests are asked once.
    Errors count as answers unless ``retry_errors``. One job at a time may write to a ledger.
    """
    spark, schema = requests.sparkSession, _schema(requests)
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    held = spark.read.schema(schema).parquet(path)
    settled = held.where("error IS NULL") if retry_errors else held
    asked = request_ids(requests.select("task_id", "model", "body")).dropDuplicates(["request_id"])
    asked = materialize(asked, "asked")
    unanswered = asked.join(settled.select("request_id"), "request_id", "left_anti")
    rounds = -(-unanswered.count() // (concurrency * slice_rows))
    if rounds:
        # A folder per round, so that a round reads its own requests only.
        waiting = f"{scratch_dir(spark)}/waiting-{uuid.uuid4().hex}"
        numbered = unanswered.withColumn("round", F.pmod(F.xxhash64("request_id"), F.lit(rounds)).cast("int"))
        numbered.repartition("round").write.partitionBy("round").parquet(waiting)
        waiting = spark.read.schema(numbered.schema).parquet(waiting)
        for k in range(rounds):
            answers = dispatch_batch(waiting.where(F.col("round") == k), provider, concurrency)
            answers = answers.withColumn("asked_at", F.lit(time.time_ns()))
            answers.write.mode("append").parquet(path)
    answered = spark.read.schema(schema).parquet(path).join(asked.select("request_id"), "request_id", "left_semi")
    return ledger_answers(answered)
