import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusctx.operators import ledger
from corpusctx.run import reconcile

SCHEMA = "task_id bigint, model string, body string"


def asking(folder):
    """A provider that notes its calls, kills its worker once at body 17 and always fails at body 5."""
    calls, killed = folder / "calls", folder / "killed"
    calls.touch()

    def provider(model, body):
        with calls.open("a") as file:
            file.write(body + "\n")
        if body == "17" and not killed.exists():
            killed.touch()
            os._exit(1)
        if body == "5":
            raise RuntimeError("down")
        return json.dumps({"id": "g" + body, "choices": [{"message": {"content": "says " + body}}]})

    return provider, lambda: Counter(calls.read_text().split())


def test_a_killed_worker_repeats_no_written_answer(spark, rows, tmp_path):
    requests = rows([(i % 7, "m/a", str(i)) for i in range(30)] + [(3, "m/a", "3"), (1, "m/b", None)], SCHEMA)
    path, (provider, calls) = str(tmp_path / "ledger"), asking(tmp_path)
    ask = lambda **more: ledger.dispatch_to_ledger(requests, provider, path, concurrency=2, slice_rows=3, **more)
    with pytest.raises(Exception):
        ask()
    written = {r.raw for r in spark.read.parquet(path).collect() if r.raw}
    got = ask().collect()
    assert len(got) == 31 and len({r.request_id for r in got}) == 31
    assert {r.body for r in requests.where("body IS NOT NULL").collect()} == set(calls())
    assert {n for body, n in calls().items() if any(f'"says {body}"' in raw for raw in written)} <= {1}
    assert {(r.model, r.error) for r in got if r.raw is None} == {("m/a", "Error: down"), ("m/b", ledger_error())}

    before = calls()
    assert {tuple(r) for r in ask().collect()} == {tuple(r) for r in got} and calls() == before
    ask(retry_errors=True)
    assert calls() - before == Counter({"5": 1})
    assert ledger.dispatch_to_ledger(requests.limit(0), provider, path).count() == 0


def ledger_error():
    from corpusctx.operators.dispatch import NO_PROMPT

    return NO_PROMPT


def test_ledger_to_final_results(spark, rows, tmp_path):
    requests = rows([(1, "m/a", "1"), (1, "m/a", "2"), (2, "m/a", "5"), (2, "m/a", "6")], SCHEMA)
    log = ledger.dispatch_to_ledger(requests, asking(tmp_path)[0], str(tmp_path / "ledger"))
    generation = rows([("g1", 0.25), ("g6", 0.5)], "generation_id string, total_cost double")
    attempts = rows([("g1", 1, 200, True), ("g2", 1, 404, False), ("g6", 1, 200, True)], "generation_id string, attempt int, code int, has_data boolean")
    final, costs = reconcile(log, generation, "T", attempts)
    states = {(r.task_id, r.content, r.status) for r in final.collect()}
    assert states == {(1, "says 1", "Done"), (1, "says 2", "Pending"), (2, None, "Error"), (2, "says 6", "Done")}
    assert {(r.task_id, r.n_done, r.n_error, str(r.total_cost)) for r in costs.collect()} == {(1, 1, 0, "0.250000"), (2, 1, 1, "0.500000")}
    assert final.where(F.col("request_id").isNull()).count() == 0
