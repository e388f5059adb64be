"""Text trees as tables: every regular file, hidden and empty ones included.

Spark's own file sources leave out hidden names and empty files, so folders are listed
and files read in tasks through ``pyarrow.fs``, which serves local, HDFS and object
stores. Large corpora are better landed as Parquet and read with ``spark.read.parquet``.
"""

import math
import os
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from corpusctx.functions.text import decode_text
from corpusctx.sources.scratch import materialize

MAX_FILE_BYTES = 2_000_000_000  # one cell holds no more
TASK_BYTES = 128 * 1024 * 1024
BATCH_BYTES = 32 * 1024 * 1024
LIST_ROWS = 10_000

_LISTING = "path string, is_dir boolean, size bigint"


def _open(uri):
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def _lister(root):
    def children(batches):
        store, _ = _open(root)
        local = isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch["path"]:
                try:
                    found = store.get_file_info(fs.FileSelector(folder, recursive=False))
                except OSError:
                    continue  # a folder that may not be listed contributes nothing
                rows = []
                for info in found:
                    is_dir = info.type == fs.FileType.Directory
                    if is_dir and local and os.path.islink(info.path):
                        continue  # links to folders could lead in circles
                    if is_dir or info.type == fs.FileType.File:
                        rows.append((info.path, is_dir, 0 if is_dir else info.size or 0))
                for start in range(0, len(rows), LIST_ROWS):
                    yield pd.DataFrame(rows[start : start + LIST_ROWS], columns=["path", "is_dir", "size"])

    return children


def list_tree(spark, root):
    """All files below ``root`` (path relative to it, full path, size), one job per folder level."""
    _, base = _open(root)
    base = base.rstrip("/")
    frontier, levels = spark.createDataFrame([(base,)], "path string"), []
    while True:
        spread = frontier.repartition(spark.sparkContext.defaultParallelism, "path")
        level = materialize(spread.mapInPandas(_lister(root), _LISTING), "listing")
        levels.append(level.filter(~F.col("is_dir")))
        frontier = level.filter("is_dir").select("path")
        if frontier.isEmpty():
            break
    files = reduce(lambda a, b: a.unionByName(b), levels)
    return files.select(
        F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path")).alias("path"),
        F.col("path").alias("full_path"),
        "size",
    )


def _reader(root):
    columns = ["path", "size", "content", "read_error"]

    def contents(batches):
        store, _ = _open(root)
        rows, held = [], 0
        for batch in batches:
            for path, full, size in zip(batch["path"], batch["full_path"], batch["size"]):
                content = error = None
                if size > MAX_FILE_BYTES:
                    error = f"{size} bytes do not fit one cell"
                else:
                    try:
                        with store.open_input_stream(full) as source:
                            content = source.read()
                    except OSError as problem:
                        error = str(problem)
                rows.append((path, size, content, error))
                held += len(content or b"")
                if held >= BATCH_BYTES or len(rows) >= LIST_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return contents


def read_listed(listing, root):
    """Contents of listed files as repaired text: path, size, content, read_error."""
    spark = listing.sparkSession
    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total / TASK_BYTES))
    raw = listing.repartition(tasks, "path").mapInPandas(
        _reader(root), "path string, size bigint, content binary, read_error string"
    )
    return raw.withColumn("content", decode_text(F.col("content")))


def read_corpus(spark, root, project):
    """Every regular file below ``root`` as ``project, path, size, content, read_error``."""
    files = read_listed(list_tree(spark, root), root)
    return files.select(F.lit(project).alias("project"), "path", "size", "content", "read_error")
