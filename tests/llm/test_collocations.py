"""Phrase mining against plain counting, with colliding fingerprints and texts cut into segments."""

import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusctx.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang or "und"][" ".join(words[i : i + m])] += 1
    return counts


def brute_force(rows, least, longest=5, top=2000, percent=100):
    out = []
    for lang, counts in plain_counts(rows, longest).items():
        n = sum(c for p, c in counts.items() if " " not in p)
        kept = {p: c for p, c in counts.items() if c >= least and " " in p}
        found = []
        for phrase, a in kept.items():
            if any(f" {phrase} " in f" {other} " and other != phrase and 100 * c >= percent * a for other, c in kept.items()):
                continue
            words = phrase.split(" ")
            cuts = []
            for k in range(1, len(words)):
                left, right = counts[" ".join(words[:k])], counts[" ".join(words[k:])]
                cuts.append((1000 * a * n // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((-score, -a, phrase.encode(), (phrase, a, left, right, n, score)))
        for rank, (*_, row) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, *row))
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


ROWS = [
    (1, "New York city. New York City, new york! The big apple the big apple", "en"),
    (2, "In New York the big apple is big; in new york\tcity it is BIG", "en"),
    (3, "un deux trois un deux trois\nun deux. trois", "fr"),
    (4, None, "en"), (5, "", None), (6, " \t\n.,", "fr"),
    (7, "a a a a a a a É É é", None), (8, "a a a", "und"),
    (9, "un deux trois un deux trois\nun deux. trois", "fr"), (9, "un deux trois un deux trois\nun deux. trois", "fr"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.mark.parametrize("width", [64, 3])
def test_small_texts_with_collisions(spark, width):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(2).withColumns({c: F.lit("x") for c in ("fp", "key", "n", "words", "phrase")})
    if width == 64:
        assert mined(df, min_count=2) == brute_force([r[1:] for r in ROWS], 2)
    assert mined(df, min_count=2, longest=3, top=2, percent=50, width=width) == brute_force([r[1:] for r in ROWS], 2, 3, 2, 50)


def test_empty_table(spark):
    assert mined(spark.createDataFrame([], SCHEMA), longest=2) == []


def test_long_texts_go_by_in_segments(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT", 64)
    long = "the quick brown fox jumps over the lazy dog " * 30 + "x" * 200 + " the quick brown fox. " * 5
    rows = [(1, long, "en"), (2, "  " * 100 + "a b" + " c" * 50, "en"), (3, "y" * 300, "en"), (4, "short one", "en")]
    assert mined(spark.createDataFrame(rows, SCHEMA).coalesce(2), min_count=3, width=16) == brute_force([r[1:] for r in rows], 3)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r)[1:] for r in docs.collect()]
    assert mined(docs.repartition(3), min_count=20, top=300, width=20) == brute_force(rows, 20, top=300)


def test_fingerprints_add_up_before_the_shuffle(spark, monkeypatch):
    """Entries of one task are merged whatever the size of its buffers."""
    monkeypatch.setattr(collocations, "_PENDING", 8)
    df = spark.createDataFrame(ROWS * 3, SCHEMA).coalesce(2)
    assert mined(df, min_count=3) == brute_force([r[1:] for r in ROWS * 3], 3)


def _peak(call):
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_worker():
    """A batch is lowered by segments, entries are merged column by column, and a table is looked up as it was sent."""
    text = "Some words of a text, and More. " * 128
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 8192), pa.array([2] * 8192), pa.array([text] * 8192)], ["key", "salt", "text"])
    first = collocations._all_grams(batch, collocations.Words(), 64, 5)
    assert _peak(lambda: next(first)) < batch.nbytes

    totals, n = collocations._Totals(["fp", "n"], 1 << 20), 1 << 17
    for k in range(8):
        totals.add(np.random.default_rng(k).integers(-(1 << 62), 1 << 62, n), np.ones(n, np.int64))
    held = 8 * n * 16
    assert _peak(totals.merged) < 3.5 * held

    table = np.random.default_rng(1).integers(0, 256, 1 << 20, dtype=np.uint8)
    shared, prints = SimpleNamespace(value=table.tobytes()), np.arange(-1000, 1000)
    assert _peak(lambda: collocations._in_table(collocations._bits(shared), prints)) < table.nbytes
    plain = np.unpackbits(table, bitorder="little").astype(bool)
    assert (collocations._in_table(collocations._bits(shared), prints) == plain[prints % len(plain)]).all()
