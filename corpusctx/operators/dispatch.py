"""Which model gets which prompt, and how it is asked."""

import time
from functools import partial

import pandas as pd
from pyspark.sql import functions as F

from corpusctx.functions.text import json_literal
from corpusctx.operators.settings import dispatchable_tasks

# Fixed values of the request body, as JSON.
DEFAULT_TEMPERATURE = "1.0"
DEFAULT_TIMEOUT = "60"

# Fixed values of routes and first states.
ROUTE_MARK = "/"
QUEUED, MANUAL = "Queued...", "Manual Input"

# Fixed value: requests in flight at once.
CONCURRENCY = 5


def route_models(df, model="model"):
    """Models with a slash in the name are asked through a provider, others by hand."""
    remote = F.contains(F.col(model), F.lit(ROUTE_MARK))
    return df.withColumn("route", F.when(remote, "api").otherwise("manual")).withColumn(
        "initial_status", F.when(remote, QUEUED).otherwise(MANUAL)
    )


def dispatch_plan(tasks, overrides=None):
    """One row per dispatchable task and distinct model, with its overrides (empty by default)."""
    pairs = dispatchable_tasks(tasks).select("task_id", F.explode(F.array_distinct("models")).alias("model"))
    pairs = route_models(pairs)
    none = F.create_map().cast("map<string,string>")
    if overrides is None:
        return pairs.withColumn("overrides", none)
    return pairs.join(overrides, ["task_id", "model"], "left").withColumn("overrides", F.coalesce("overrides", none))


def request_fields(plan):
    """Temperature, timeout (JSON literals) and the number of overrides of each request."""
    given = F.col("overrides")
    return (
        plan.withColumn("temperature", F.coalesce(F.try_element_at(given, F.lit("temperature")), F.lit(DEFAULT_TEMPERATURE)))
        .withColumn("timeout", F.coalesce(F.try_element_at(given, F.lit("timeout")), F.lit(DEFAULT_TIMEOUT)))
        .withColumn("n_overrides", F.size(given).cast("bigint"))
    )


def build_requests(plan, prompts):
    """Request bodies (JSON) of the API-routed rows: model, one user message, parameters.

    A request without a prompt has no body; it is answered with an error and never sent.
    """
    fields = request_fields(plan.filter(F.col("route") == "api")).join(prompts.select("task_id", "prompt"), "task_id")
    passed = F.transform(
        F.filter(F.map_entries("overrides"), lambda e: ~e["key"].isin("temperature", "timeout")),
        lambda e: F.concat(F.lit(","), json_literal(e["key"]), F.lit(":"), e["value"]),
    )
    body = F.concat(
        F.lit('{"model":'), json_literal(F.col("model")),
        F.lit(',"messages":[{"role":"user","content":'), json_literal(F.col("prompt")),
        F.lit('}],"temperature":'), F.col("temperature"),
        F.lit(',"timeout":'), F.col("timeout"),
        F.array_join(passed, ""), F.lit("}"),
    )
    return fields.select("task_id", "model", "temperature", "timeout", "n_overrides", F.when(F.col("prompt").isNotNull(), body).alias("body"))


NO_PROMPT = "not sent: the request has no prompt"


def _ask(batches, provider):
    for batch in batches:
        rows = []
        for model, body in zip(batch["model"], batch["body"]):
            started = time.monotonic()
            raw = error = None
            if body is None:
                error = NO_PROMPT
            else:
                try:
                    raw = provider(model, body)
                except Exception as problem:  # one failure never stops the other requests
                    error = f"Error: {problem}"
            rows.append((raw, error, time.monotonic() - started))
        answers = pd.DataFrame(rows, columns=["raw", "error", "seconds"], index=batch.index)
        yield batch.drop(columns="body").join(answers)


def dispatch_batch(requests, provider, concurrency=CONCURRENCY):
    """Ask ``provider(model, body) -> raw response`` for every request: one row each, answer or error.

    At most ``concurrency`` tasks run it at once. A lost executor repeats its requests, so
    a provider should recognise a (task, model) it has answered; ``ledger.dispatch_to_ledger``
    writes answers as they come. A ``request_id`` of the requests stays with the answers.
    """
    carried = [c for c in ("request_id",) if c in requests.columns]
    schema = f"task_id {requests.schema['task_id'].dataType.simpleString()}, model string, raw string, error string, seconds double"
    schema += "".join(f", {c} {requests.schema[c].dataType.simpleString()}" for c in carried)
    spread = requests.select("task_id", "model", "body", *carried).repartition(concurrency, "task_id", "model", *carried)
    return spread.mapInPandas(partial(_ask, provider=provider), schema)
