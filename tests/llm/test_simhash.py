"""SimHash groups against XXH64 by hand and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusctx.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in nodes}


def by_hand(rows):
    """Rows of (doc_id, fingerprint) with components, by comparing all pairs."""
    ids = sorted({i for i, _ in rows if i is not None})
    prints = {i: {f for j, f in rows if j == i} for i in ids}
    root = plain_components(ids, lambda a, b: any((x ^ y).bit_count() <= 3 for x in prints[a] for y in prints[b]))
    return sorted(((i, f"{f:016x}", None if i is None else root[i]) for i, f in rows), key=str)


def test_given_and_odd_documents(spark):
    docs = [(r.doc_id + 100, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One TWO three"), (5, "one two\x0bthree"), (6, "one two"), (6, "one two"), (7, "É one two É"),
        (8, "lorem ipsum dolor sit amet " * 30_000), (9, "x" * 400_000), (4, "one two"), (None, "one two"), (None, None), (10, docs[0][1].upper()),
    ]
    df = spark.createDataFrame(odd + docs, SCHEMA).withColumns({c: F.lit("x") for c in ("fp", "rep", "fingerprint", "label")})
    got = sorted((tuple(r) for r in simhash.near_duplicates(df.repartition(3)).collect()), key=str)
    assert got == by_hand([(i, plain_print(t)) for i, t in odd + docs])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_slices_of_a_text_keep_its_shingles(monkeypatch):
    text = " ".join(f"w{i % 37}\n\t{'z' * (i % 50)}" for i in range(500))
    whole = simhash.fingerprint(text.encode())
    assert whole == plain_print(text)
    monkeypatch.setattr(simhash, "_SLICE", 16)
    monkeypatch.setattr(simhash, "_HASHED", 3)
    assert simhash.fingerprint(text.encode()) == whole


@pytest.mark.parametrize("checks", [4, 5])
def test_anchors_cover(checks):
    rng, cover = np.random.default_rng(1), simhash.Cover(checks)
    values = rng.integers(0, 1 << cover.bits, 300, np.uint64)
    rows, anchors = cover.anchors(values)
    assert (np.bitwise_count(values[rows] ^ anchors) <= 2).all()
    zero = cover.anchors(anchors)  # anchors are words of the code: at distance 0 of themselves
    assert set(anchors.tolist()) <= set(zero[1].tolist())
    own = [set(anchors[rows == k].tolist()) for k in range(len(values))]
    for flip in range(cover.bits):
        other, found = cover.anchors(values ^ np.uint64(1 << flip))
        assert all(own[k] & set(found[other == k].tolist()) for k in range(len(values)))


def _clusters(seed, n=60):
    rng, out = random.Random(seed), set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(n):
            x = centre
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    half = rng.getrandbits(32)  # fingerprints that share a half and nothing else
    out |= {half << 32 | rng.getrandbits(32) for _ in range(80)}
    return sorted(out)


@pytest.mark.parametrize("group, small", [(4096, 24), (5, 2)])
def test_links_of_hot_anchors(spark, monkeypatch, group, small):
    """Whatever the limit of a group, what is linked is joined, and every link is one."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "_SMALL", small)
    prints = _clusters(group)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(2)).collect()
    pairs = {(r.a % (1 << 64), r.b % (1 << 64)) for r in found}
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in pairs)
    everything = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert plain_components(prints, lambda a, b: (a, b) in pairs or (b, a) in pairs) == everything


def test_rows_of_one_key_span_batches(monkeypatch):
    """Groups that cross batches are compared whole, and larger ones come out whole."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 12, 400))
    prints = rng.integers(0, 1 << 6, 400) | (np.arange(400) << 20)
    table = pa.table({"key_a": keys, "fp": prints})
    for step in (1, 7, 50, 400):
        out = pa.Table.from_batches(list(simhash._compare(iter(table.to_batches(max_chunksize=step)), 35, 1)))
        large = {k for k in range(12) if (keys == k).sum() > 35}
        rest = [(a, f) for a, f, b in zip(*(out[c].to_pylist() for c in ("key_a", "a", "b"))) if b is None]
        assert sorted(rest) == sorted((int(k), int(f)) for k, f in zip(keys, prints) if k in large)
