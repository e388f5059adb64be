import os

from pyspark.sql import functions as F

from corpusctx.operators import measure
from corpusctx.sources import tables
from corpusctx.sources.corpus import list_tree, read_corpus, read_listed
from corpusctx.sources.rules import parse_rules, read_rules
from corpusctx.sources.scratch import scratch_dir


def make_tree(root):
    files = {
        "README.md": b"top", "src/main.py": b"print()\r\n", "src/.hidden": b"h", ".env": b"KEY", ".git/HEAD": b"ref", "_under/x": b"u",
        "src/empty.txt": b"", "docs/bad.bin": b"\xe2\x82abc\xff", "docs/deep/er/still.md": "é".encode(),
        ".gitignore": b"# note\n\n  *.log  \r\n!keep\n", "sub/.gitignore": b"x/\n",
    }
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    os.symlink(root / "src", root / "loop")
    os.symlink(root / "nowhere", root / "dangling")
    return files


def test_every_file_is_read(spark, tmp_path):
    files = make_tree(tmp_path)
    got = {r.path: r for r in read_corpus(spark, str(tmp_path), "p").collect()}
    assert got.keys() == files.keys()
    assert got["src/main.py"].content == "print()\n"
    assert got["src/empty.txt"].content == "" and got["docs/deep/er/still.md"].content == "é"
    assert got["docs/bad.bin"].content == "�abc�"
    assert all(r.read_error is None and r.size == len(files[p]) for p, r in got.items())
    folders = measure.folder_tokens(read_corpus(spark, str(tmp_path), "p"))
    assert {r.folder for r in folders.collect()} >= {".", "src", ".git", "docs/deep/er"}


def test_unreadable_file_is_a_row(spark, tmp_path):
    make_tree(tmp_path)
    gone = spark.createDataFrame([("x", str(tmp_path / "x"), 3)], "path string, full_path string, size bigint")
    listing = list_tree(spark, str(tmp_path)).filter("path = 'README.md'").unionByName(gone)
    got = {r.path: r for r in read_listed(listing, str(tmp_path)).collect()}
    assert got["README.md"].content == "top"
    assert got["x"].content is None and got["x"].read_error


def test_rules(spark, tmp_path):
    make_tree(tmp_path)
    got = {tuple(r) for r in read_rules(spark, str(tmp_path)).collect()}
    assert got == {(".", 1, "*.log"), (".", 2, "!keep"), ("sub", 1, "x/")}
    texts = spark.createDataFrame([("p", " a \r# no\rb"), ("q", "")], "project string, content string")
    assert {tuple(r) for r in parse_rules(texts).collect()} == {("p", 1, "a"), ("p", 2, "b")}


def test_runs_keep_history_and_latest(spark, tmp_path):
    path = str(tmp_path / "prompts")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "task_id int, prompt string")
    second = spark.createDataFrame([(1, "new")], "task_id int, prompt string")
    tables.write_prompts(first, path, 1)
    tables.write_prompts(second, path, 2)
    tables.write_prompts(second, path, 2)  # a repeated job changes nothing
    assert tables.read_runs(spark, path).count() == 3
    assert {(r.task_id, r.prompt) for r in tables.read_latest(spark, path, ["task_id"]).collect()} == {(1, "new"), (2, "b")}
    tables.compact(spark, path, ["task_id"], str(tmp_path / "small"))
    assert {(r.task_id, r.prompt) for r in tables.read_runs(spark, str(tmp_path / "small")).collect()} == {(1, "new"), (2, "b")}


def test_results_are_keyed_by_raw_model_name(spark, tmp_path):
    path, schema = str(tmp_path / "results"), "task_id int, model string, result string"
    tables.write_results(spark.createDataFrame([(1, "a/b", "x"), (1, "a:b", "y")], schema), path, 1)
    tables.write_results(spark.createDataFrame([(1, "a:b", "z")], schema), path, 2)
    got = {(r.model, r.result) for r in tables.read_latest(spark, path, ["task_id", "model"]).collect()}
    assert got == {("a/b", "x"), ("a:b", "z")}


def test_parts_are_written_slice_by_slice(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SLICE", 100)
    path = str(tmp_path / "parts")
    parts = spark.range(2000).select((F.col("id") % 3).alias("task_id"), (F.floor(F.col("id") / 3) + 1).alias("seq"), F.lit("x").alias("block"))
    tables.write_prompt_parts(parts.repartition(5), path, 7)
    assert tables.read_latest(spark, path, ["task_id"]).count() == 2000
    written = spark.read.parquet(path + "/run_id=7").withColumn("file", F.input_file_name())
    slices = written.groupBy("task_id", F.floor((F.col("seq") - 1) / 100).alias("s")).agg(F.countDistinct("file").alias("files"))
    assert slices.agg(F.max("files")).first()[0] == 1
    rows = written.withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    assert all((a.task_id, a.seq) < (b.task_id, b.seq) for a, b in zip(rows, rows[1:]) if a.file == b.file)


def test_scratch_is_the_session_folder(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
