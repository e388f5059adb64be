import json

from pyspark.sql import functions as F

from corpusctx.operators import dispatch
from corpusctx.run import prepare, reconcile
from corpusctx.sources.corpus import read_corpus
from corpusctx.sources.rules import read_rules


def test_a_whole_run(spark, rows, tmp_path):
    tree = {"file1.py": "print(1)\n", "file2.md": "# Two", "src/main.py": "main", "build/x.py": "no", "src/a.log": "no", "notes.tmp": "no",
            ".gitignore": "*.tmp\n.gitignore\n"}
    for name, content in tree.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    files = read_corpus(spark, str(tmp_path), "p")
    ignore = [r.pattern for r in read_rules(spark, str(tmp_path)).orderBy("ordinal").collect()]
    tasks = rows([(1, "first", "Explain this.", "p", ["m/a", "m/b", "by hand"])],
                 "task_id bigint, name string, definition string, project string, models array<string>")
    params = rows([(1, "m/a", "temperature", 1, "0")], "task_id bigint, model string, k string, ordinal int, v string")
    run = prepare(files, tasks, ignore=ignore, param_layers=[params])

    prompt = run.prompts.first()
    shown = [line[len("## Source: "):] for line in prompt.prompt.split("\n") if line.startswith("## Source: ")]
    assert shown == ["file1.py", "file2.md", "src/main.py"]
    assert "print(1)\n" in prompt.prompt and "Explain this." in prompt.prompt and prompt.n_files == 3
    counts = run.counts.first()
    assert (counts.scanned, counts.ignored, counts.excluded, counts.included) == (7, 2, 2, 3)
    assert run.totals.first().total_chars == len(prompt.prompt)
    assert "".join(r.chunk for r in run.chunks.orderBy("chunk_no").collect()) == prompt.prompt
    assert run.manifest.first().sources_text == "*   `file1.py`\n*   `file2.md`\n*   `src/main.py`"
    assert {r.model: r.route for r in run.plan.collect()} == {"m/a": "api", "m/b": "api", "by hand": "manual"}
    assert json.loads(run.requests.filter("model = 'm/a'").first().body)["temperature"] == 0

    calls = tmp_path / "calls"
    calls.touch()

    def provider(model, body):
        with calls.open("a") as file:
            file.write(model + "\n")
        if model == "m/b":
            raise RuntimeError("down")
        return json.dumps({"id": "g1", "choices": [{"message": {"content": "because"}}]})

    answers = dispatch.dispatch_batch(run.requests, provider)
    log = answers.select(F.col("model").alias("request_id"), "task_id", "model", "raw", "error")
    generation = rows([("g1", 0.25, 10, 5)], "generation_id string, total_cost double, tokens_prompt bigint, tokens_completion bigint")
    attempts = rows([("g1", 1, 404, False), ("g1", 2, 200, True)], "generation_id string, attempt int, code int, has_data boolean")
    final, costs = reconcile(log, generation, "2024-01-01T00:00:00", attempts)
    got = {r.model: r for r in final.collect()}
    assert got["m/a"].status == "Done" and got["m/a"].result.startswith("because\n\n---\n") and "$0.250000" in got["m/a"].result
    assert (got["m/b"].status, got["m/b"].error) == ("Error", "Error: down")
    cost = costs.first()
    assert (cost.n_done, cost.n_error, str(cost.total_cost)) == (1, 1, "0.250000")
    assert sorted(calls.read_text().split()) == ["m/a", "m/b"]  # each request is asked once


def test_request_without_prompt_is_never_sent(rows):
    requests = rows([(1, "m/a", None), (2, "m/a", "{}")], "task_id bigint, model string, body string")
    got = {r.task_id: r for r in dispatch.dispatch_batch(requests, lambda model, body: body.upper()).collect()}
    assert (got[1].raw, got[1].error) == (None, dispatch.NO_PROMPT) and got[2].raw == "{}"


def test_includes_narrow_the_run(rows):
    files = rows([("p", "a/x.py", "1"), ("p", "b/y.py", "2"), ("p", "a/b/z.md", "3")], "project string, path string, content string")
    tasks = rows([(1, "n", "d", "p", [])], "task_id bigint, name string, definition string, project string, models array<string>")
    assert prepare(files, tasks, includes=["a", "https://h/r"]).prompts.first().n_files == 2
    assert prepare(files, tasks, includes=["https://h/r"]).prompts.first().n_files == 3
