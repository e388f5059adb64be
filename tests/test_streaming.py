from pyspark.sql import functions as F

from corpusctx.operators import assemble, measure, selection
from corpusctx.sources.tables import read_latest
from corpusctx.streaming import status
from corpusctx.streaming.refresh import ContextRefresh

EVENTS = [(i, 1000 + (i * 7) % 50, i % 4, ("m/" if i % 3 else "by-hand-") + str(i % 5), ["Queued", "Done", "Error", "Sending"][i % 4])
          for i in range(200)]
SCHEMA = "event_id bigint, ts bigint, run bigint, model string, status string"


def test_status_stream_equals_batch(spark, rows, tmp_path):
    events = rows(EVENTS, SCHEMA)
    source = str(tmp_path / "events")
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = status.start_status(stream, str(tmp_path / "status"), str(tmp_path / "check"))
    query.awaitTermination(120)
    streamed = read_latest(spark, str(tmp_path / "status"), ["run", "model"]).drop("run_id")
    batch = status.latest_status(events)
    assert {tuple(r) for r in streamed.select(*batch.columns).collect()} == {tuple(r) for r in batch.collect()}
    got = {r.run: (r.completed, r.total) for r in status.run_progress(streamed).collect()}
    assert got == {r.run: (r.completed, r.total) for r in status.run_progress(batch).collect()}
    newest = {}
    for event_id, ts, run, model, state in EVENTS:
        newest[run, model] = max(newest.get((run, model), (0, 0, "")), (ts, event_id, state))
    assert {(r.run, r.model): r.status for r in batch.collect()} == {k: v[2] for k, v in newest.items()}


def test_a_new_checkpoint_lets_no_stale_event_win(spark, rows, tmp_path):
    fresh = rows([(5, 2000, 1, "m/a", "Done"), (6, 2000, 1, "m/b", "Queued")], SCHEMA)
    stale = rows([(1, 1000, 1, "m/a", "Queued"), (7, 2000, 1, "m/b", "Error"), (2, 10, 2, "m/a", "Sending")], SCHEMA)
    for n, events in enumerate((fresh, stale, stale)):
        source = str(tmp_path / f"events{n}")
        events.coalesce(1).write.parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        status.start_status(stream, str(tmp_path / "status"), str(tmp_path / f"check{n}")).awaitTermination(120)
    got = {tuple(r) for r in status.current_status(spark, str(tmp_path / "status")).collect()}
    assert got == {tuple(r) for r in status.latest_status(fresh.union(stale)).collect()}
    assert (1, "m/a", "Done", 2000) in got and (1, "m/b", "Error", 2000) in got and len(got) == 3


def test_refresh_equals_batch(spark, rows, tmp_path):
    schema = "project string, path string, content string"
    tasks = rows([(1, "do", "p1"), (2, "it", "p2"), (3, "", "p9"), (4, "more", "p1")], "task_id bigint, definition string, project string")
    drops = [
        [("p1", "a/x.md", "one"), ("p1", "a/y.log", "no"), ("p2", "b/z.md", "two" * 9)],
        [("p1", "c/n.md", "three" * 5), ("p1", "a/x.md", "one, changed and longer")],
        [("p2", "b/z2.md", ""), ("p3", "k.md", "unused")],
    ]
    refresh = ContextRefresh(str(tmp_path / "out"), tasks, excludes=["*.log"])
    source = str(tmp_path / "drops")
    rows([("none", "none.log", "")], schema).limit(0).coalesce(1).write.parquet(source)
    for drop in drops:
        rows(drop, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        refresh.start(stream, str(tmp_path / "check")).awaitTermination(120)
    refresh.process(rows(drops[2], schema), 2)  # a repeated batch changes nothing

    final = {(p, path): c for drop in drops for p, path, c in drop}
    whole = rows([(p, path, c) for (p, path), c in final.items()], schema)
    files = selection.included(selection.classify_files(whole, (), ["*.log"]))
    folders = measure.folder_tokens(files).select("project", "folder", "tokens")
    assert {tuple(r) for r in refresh.folders(spark).select(*folders.columns).collect()} == {tuple(r) for r in folders.collect()}
    totals = assemble.prompt_totals(files, tasks)
    assert {tuple(r) for r in refresh.totals(spark).select(*totals.columns).collect()} == {tuple(r) for r in totals.collect()}
    assert {tuple(r) for r in refresh.files(spark).select(*files.columns).collect()} == {tuple(r) for r in files.collect()}


def test_refresh_forgets_removed_files_and_skips_unreadable_ones(spark, rows, tmp_path):
    schema = "project string, path string, content string, read_error string, removed boolean"
    tasks = rows([(1, "do", "p1"), (2, "it", "p2"), (3, "", "p3")], "task_id bigint, definition string, project string")
    drops = [
        [("p1", "a/x.md", "one", None, None), ("p1", "b/y.md", "two" * 9, None, False), ("p2", "c/z.md", "three", None, False), ("p1", "d/w.md", "w", None, False)],
        [("p1", "b/y.md", None, None, True), ("p2", "c/z.md", None, None, True), ("p1", "e/bad.md", None, "denied", False), ("p1", "d/w.md", None, "denied", False)],
        [("p1", "a/never.md", None, None, True), ("p3", "k.md", "back", None, False), ("p2", "c/z.md", "three again", None, False), ("p1", "a/x.md", None, None, True)],
    ]
    path = str(tmp_path / "out")
    final = {}
    for epoch, drop in enumerate(drops):
        for _ in range(1 + epoch % 2):  # a repeated batch changes nothing
            ContextRefresh(path, tasks).process(rows(drop, schema), epoch)
        for project, name, content, problem, removed in drop:
            final.pop((project, name), None)
            if not removed:
                final[project, name] = (project, name, content, problem)
        refresh = ContextRefresh(path, tasks)
        whole = rows(list(final.values()), "project string, path string, content string, read_error string")
        files = selection.included(selection.classify_files(whole))
        folders = measure.folder_tokens(files).select("project", "folder", "tokens")
        assert {tuple(r) for r in refresh.folders(spark).select(*folders.columns).collect()} == {tuple(r) for r in folders.collect()}
        totals = assemble.prompt_totals(files, tasks)
        assert {tuple(r) for r in refresh.totals(spark).select(*totals.columns).collect()} == {tuple(r) for r in totals.collect()}
        assert {tuple(r) for r in refresh.files(spark).select(*files.columns).collect()} == {tuple(r) for r in files.collect()}
