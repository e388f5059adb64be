import json

import pytest
from pyspark.sql import functions as F

from corpusctx.operators import results
from corpusctx.sources import responses

NUMERIC = {"id": 4410937, "choices": [{"message": {"content": "hello"}}], "usage": 0.001}
OBJECT = {"choices": [{"message": {"content": "x\n\"é\""}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 9, "generation_id": "g-2"}}
BODIES = {
    1: json.dumps(NUMERIC),
    2: json.dumps(OBJECT),
    3: '{"id": "a", "choices": [',
    4: '{"id": "a", "choices": []}',
    5: '{"id": "", "choices": [{"message": {"content": ""}}], "usage": 0}',
    6: '{"usage": {"generation_id": "g-6"}}',
    7: "[]",
    8: '{"id": "z"} trailing',
}


@pytest.fixture(scope="module")
def parsed(rows):
    return responses.read_response_log(rows([(k, "m/x", v) for k, v in BODIES.items()], "request_id int, model string, raw string"))


def test_response_fields(parsed):
    got = {r.request_id: r for r in parsed.collect()}
    assert (got[1].content, got[1].generation_id, got[1].tokens_prompt, got[1].error) == ("hello", "4410937", 0, None)
    assert (got[2].content, got[2].generation_id, got[2].tokens_prompt, got[2].tokens_completion) == ("x\n\"é\"", "g-2", 3, 4)
    assert (got[3].error, got[8].error) == (responses.BAD_BODY, responses.BAD_BODY)
    assert got[4].error == responses.NO_CHOICES
    assert (got[5].content, got[5].generation_id, got[5].error) == (None, None, responses.EMPTY_CONTENT)
    assert (got[6].generation_id, got[6].error) == ("g-6", responses.EMPTY_CONTENT)
    assert {r[0] for r in results.distinct_lookups(parsed).collect()} == {"4410937", "g-2", "a", "g-6"}


DETAILS = "generation_id string, usage double, total_cost double, tokens_prompt bigint, tokens_completion bigint, model string, latency bigint, finish_reason string"


def test_usage_and_final_text(rows, parsed):
    details = rows([("4410937", 0.0, 0.2, 50, 60, "named", 12, "stop"), ("g-6", 0.1, 0.5, 1, 0, None, None, None)], DETAILS)
    usage = results.attach_generation(parsed, details)
    got = {r.request_id: r for r in usage.collect()}
    assert [str(got[i].cost) for i in (1, 6, 2)] == ["0.200000", "0.100000", "0.000000"]
    assert (got[1].total_tokens, got[2].total_tokens, got[5].total_tokens) == (110, 9, 0)
    assert (got[1].cost_known, got[2].cost_known) == (True, False)

    final = results.finalize_results(usage.withColumn("outcome", F.when(F.col("request_id") == 2, "EXHAUSTED")), "T")
    got = {r.request_id: r for r in final.collect()}
    assert got[1].status == "Done" and got[1].error is None
    assert got[1].result == (
        "hello\n\n---\n**Model:** named\n**Prompt tokens:** 50\n**Completion tokens:** 60\n**Total tokens:** 110\n"
        "**Cost:** $0.200000\n**Latency:** 12 ms\n**Finish Reason:** stop"
    )
    assert got[2].status == "Error" and "g-2, 3 lookups" in got[2].error and got[2].content == "x\n\"é\""
    assert got[2].result.startswith("# No answer from m/x\n\nAt T:\ndetails")
    assert {got[i].status for i in (3, 4, 5, 6)} == {"Error"}


@pytest.mark.parametrize(
    "answer, outcome, expected",
    [
        ("bad", "EMPTY", "details are empty: g"),
        ("bad", "FAILED", "bad\\ndetails lookup failed: g, HTTP 500"),
        ("bad", "EXHAUSTED", "bad"),
        (None, "FAILED", "details lookup failed: g, HTTP 500"),
        (None, None, None),
        ("bad", None, "bad"),
    ],
)
def test_error_precedence(rows, answer, outcome, expected):
    usage = rows(
        [(1, "m/x", "text", "g", answer, outcome, 500)],
        "request_id int, model string, content string, generation_id string, error string, outcome string, last_code int",
    ).withColumns({"tokens_prompt": F.lit(0), "tokens_completion": F.lit(0)})
    usage = results.attach_generation(usage, rows([], DETAILS))
    assert results.finalize_results(usage, "T").first().error == expected


def test_answer_without_id(rows, parsed):
    body = '{"choices": [{"message": {"content": "hi"}}], "usage": 0}'
    one = responses.read_response_log(rows([(1, "m/x", body)], "request_id int, model string, raw string"))
    r = results.finalize_results(results.attach_generation(one, rows([], DETAILS)), "T").first()
    assert r.result == "hi\n\n---\n**Model:** m/x\n" + results.UNKNOWN_NO_ID


@pytest.mark.parametrize("ending", ["\n", "\r\n", " \t"])
def test_blanks_after_the_body(rows, ending):
    one = responses.read_response_log(rows([(1, "m/x", json.dumps(NUMERIC) + ending)], "request_id int, model string, raw string"))
    assert (one.first().content, one.first().error) == ("hello", None)


def test_repeated_details_count_once(rows, parsed):
    details = rows([("4410937", 0.0, 0.2, 50, 60, "named", 12, "stop")] * 2 + [("4410937", 0.0, 0.1, 50, 60, "named", 12, "stop")], DETAILS)
    usage = results.attach_generation(parsed, details).where("request_id = 1").collect()
    assert [str(r.cost) for r in usage] == ["0.200000"]


def test_unfinished_lookups_stay_pending(rows):
    schema = "request_id int, task_id int, model string, content string, generation_id string, error string, outcome string"
    usage = rows([(1, 1, "m/x", "text", "g", None, "PENDING"), (2, 1, "m/x", "text", "g", "bad", "PENDING")], schema)
    usage = results.attach_generation(usage.withColumns({"tokens_prompt": F.lit(0), "tokens_completion": F.lit(0)}), rows([], DETAILS))
    got = {r.request_id: r for r in results.finalize_results(usage, "T").collect()}
    assert (got[1].status, got[1].error, got[1].content) == ("Pending", None, "text")
    assert (got[2].status, got[2].error) == ("Error", "bad")
