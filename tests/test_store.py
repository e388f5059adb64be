from pyspark.sql import functions as F

from corpusctx.operators import assemble, store
from corpusctx.sources import tables

TASK = "task_id int, project string, definition string"


def _bodies(rows, texts):
    blocks = rows([(p, f"{i:03}", t) for i, (p, t) in enumerate(texts)], "project string, path string, block string")
    return assemble.body_chunks(blocks, chunk_chars=10)


def _built(rows, texts, tasks):
    given = rows(tasks, TASK)
    return store.prompt_store(_bodies(rows, texts), given, chunk_chars=10), given


def _whole(chunks):
    texts = {}
    for r in chunks.orderBy("task_id", "chunk_no").collect():
        texts.setdefault(r.task_id, []).append(r.chunk)
    return {k: "".join(v) for k, v in texts.items()}


TEXTS = [("p", "0123456789" * 3), ("p", "abc"), ("q", "0123456789" * 2), (None, "nobody's text"), ("lonely", "unused " * 5)]
TASKS = [(1, "p", "same"), (2, "p", "same"), (3, "q", None), (4, None, "x"), (5, "absent", "same"), (6, "q", "0123456789")]


def test_store_equals_prompt_chunks(rows):
    built, tasks = _built(rows, TEXTS, TASKS)
    plain = assemble.prompt_chunks(_bodies(rows, TEXTS), tasks, chunk_chars=10)
    columns = ["task_id", "chunk_no", "n_chars", "chunk"]
    got, expected = store.spelled_out(built).select(columns).collect(), plain.select(columns).collect()
    # The plain form joins tasks to groups by equal keys alike, null among them.
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and got
    contents = built.contents.collect()
    assert len({r.chunk for r in contents}) == len(contents) == len({r.address for r in contents})
    assert {r.chunk for r in contents} == {r.chunk for r in expected}  # nothing of groups without a task
    heads = {r.task_id: r for r in built.heads.collect()}
    whole = _whole(plain)
    assert {k: h.n_chars for k, h in heads.items()} == {k: len(v) for k, v in whole.items()}
    refs = store.references(built).groupBy("task_id").agg(F.count("*").alias("n"), F.max("chunk_no").alias("last")).collect()
    assert all((r.n, r.last + 1) == (heads[r.task_id].n_chunks,) * 2 for r in refs)


def test_what_is_stored_does_not_grow_with_the_tasks_of_a_source(rows):
    few, _ = _built(rows, TEXTS, [(i, "p", "same") for i in range(2)])
    many, _ = _built(rows, TEXTS, [(i, "p", "same") for i in range(500)])
    stored = [sorted(map(tuple, s.contents.collect())) for s in (few, many)]
    assert stored[0] == stored[1] and few.places.count() == many.places.count()
    assert many.heads.count() == 500 and store.references(many).count() == 250 * store.references(few).count()


def test_empty_tables_and_empty_texts(rows):
    nothing, _ = _built(rows, TEXTS, [])
    assert nothing.contents.count() == store.references(nothing).count() == store.spelled_out(nothing).count() == 0
    bare = assemble.Templates(task_open="", task_close="")
    given = rows([(1, "p", ""), (2, "p", None)], TASK)
    built = store.prompt_store(_bodies(rows, []), given, templates=bare)
    assert built.contents.count() == 0 and sorted(map(tuple, built.heads.select("n_chunks", "n_chars").collect())) == [(0, 0)] * 2


def test_later_runs_write_new_texts_only(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    first, _ = _built(rows, TEXTS, TASKS)
    tables.write_store(first, path, 1)
    changed = [("p", "0123456789" * 3), ("p", "xyz"), ("q", "0123456789" * 2)]
    second, tasks = _built(rows, changed, TASKS[:3])
    for _ in range(2):  # a repeated job changes nothing
        tables.write_store(second, path, 2)
        new = spark.read.parquet(f"{path}/contents/run_id=2").collect()
        assert [r.chunk for r in new] == ["xyz"]
    again = tables.read_store(spark, path, 2)
    assert _whole(store.spelled_out(again)) == _whole(assemble.prompt_chunks(_bodies(rows, changed), tasks, chunk_chars=10))
    one = store.narrowed(tables.read_store(spark, path, 1), rows([(4,)], "task_id int"))
    assert _whole(store.spelled_out(one)) == {4: _whole(store.spelled_out(first))[4]}


def test_one_key_is_read_from_its_bucket(spark, rows, tmp_path):
    path, schema = str(tmp_path / "results"), "task_id bigint, model string, result string"
    tables.write_results(rows([(i, m, f"{i}{m}") for i in range(50) for m in ("a/b", "a:b", None)], schema), path, 1)
    newer = rows([(7, "a:b", "new")], schema)
    for _ in range(2):
        tables.write_results(newer, path, 2)
    found = tables.read_key(spark, path, {"task_id": 7, "model": "a:b"})
    assert [r.result for r in found.collect()] == ["new"]
    assert [r.result for r in tables.read_key(spark, path, {"task_id": 8, "model": "a/b"}).collect()] == ["8a/b"]
    assert tables.read_key(spark, path, {"task_id": 99, "model": "a/b"}).count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan  # other buckets are not listed, let alone read
    bucket = tables._bucket([F.lit(7).cast("bigint"), F.lit("a:b")])
    read = spark.read.parquet(path).where(F.col("_bucket") == bucket).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.rsplit("/", 2)[1] for r in read}) == 1
    tables.compact(spark, path, ["task_id", "model"], str(tmp_path / "small"))
    assert [r.result for r in tables.read_key(spark, str(tmp_path / "small"), {"task_id": 7, "model": "a:b"}).collect()] == ["new"]
