"""SimHash near-duplicates by anchor-point covering.

Every text becomes a 64-bit fingerprint: a bit is 1 if more than half of the text's word shingles
(repeats included) have it in their XXH64. Texts with equal fingerprints are one class. Classes
link at ``THRESHOLD`` or fewer differing bits, and all that is reachable is one component.

Two linked fingerprints differ by at most one bit in one of their halves. Each half's 32-bit space
is covered by the words of a perfect Hamming code of 31 bits beside one free bit: every half lies
within the covering radius, 1, of an anchor. A fingerprint is replicated to every anchor within
that radius plus the half's share of the threshold, 2 bits in all (at most 17 anchors), so the
anchor nearest to one of two linked fingerprints holds both, and comparing per anchor finds
all links. What leaves a group is a set of links that joins what is linked there, never all pairs.

An anchor with more than ``GROUP`` fingerprints is not compared in one task: its members are covered once
more, by the quarters of their other half (codes of 15 bits and a free one), and what is still larger is
dealt into blocks that meet two by two. Nothing is capped.

Null, empty and blank texts have the fingerprint zero and are linked like any other; a text with
fewer words than a shingle has its whole word sequence as its one shingle. Rows that share a
doc_id are one document: they share a component. A null doc_id is linked with nothing and its
component is null. Repeated rows repeat their result; other columns are never read. An empty table
gives no rows.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from corpusctx.llm.arrow import byte_view, column_udf
from corpusctx.llm.neardup import components
from corpusctx.sources.scratch import materialize

SHINGLE = 3
THRESHOLD = 3
SEED = 42
GROUP = 4096
#: Groups up to this size are compared by offsets, many at once; larger ones from link to link.
_SMALL = 24
_SLICE = 1 << 18
_HASHED = 1 << 14
_BLANK = re.compile(rb"[ \t-\r]")


def _parts(text):
    """Pieces of bounded size that end at blanks."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + _SLICE)
        stop = blank.start() if blank else len(text)
        yield text[at:stop]
        at = stop


def fingerprint(text, size=SHINGLE):
    """Fingerprint of the bytes of one text as an unsigned number."""
    digest = xxhash.xxh64_intdigest
    votes, n, tail = np.zeros(64, np.int64), 0, []

    def vote(hashes):
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return bits.sum(axis=0, dtype=np.int64)

    for part in _parts(text):
        words = tail + part.lower().split()  # of bytes: A-Z and ASCII blanks alone
        if len(words) >= size:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            starts = (ends - lengths)[: len(words) - size + 1].tolist()
            ends = ends[size - 1 :].tolist()
            for at in range(0, len(starts), _HASHED):
                some = zip(starts[at : at + _HASHED], ends[at : at + _HASHED])
                votes += vote([digest(joined[a:b], SEED) for a, b in some])
            n += len(starts)
            tail = words[len(words) - size + 1 :]
        else:
            tail = words
    if not n and tail:
        n, votes = 1, vote([digest(b" ".join(tail), SEED)])
    return sum(1 << k for k in np.flatnonzero(2 * votes > n).tolist())


def fingerprints(docs, size=SHINGLE, text_col="text", id_col="doc_id"):
    """(doc_id, fp) of each row, written once; ``fp`` holds the 64 bits as a signed number."""

    def prepare():
        def run(texts):
            data, offsets = byte_view(texts)
            body, bounds = data.tobytes(), offsets.tolist()
            found = [fingerprint(body[a:b], size) for a, b in zip(bounds, bounds[1:])]
            return pa.array(np.array(found, np.uint64).view(np.int64))

        return run

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), column_udf(prepare, "long")(F.col(text_col)).alias("fp"))
    return materialize(chosen, "fingerprints")


class Cover:
    """Anchors of a space of 2^r bits: the words of the Hamming code of all bits but the last, which is free."""

    def __init__(self, checks):
        self.bits, self.last = 1 << checks, 1 << ((1 << checks) - 1)
        n = self.bits - 1
        # From a word with this syndrome, the flips that lead to all anchors within radius 2.
        self.flips = [np.array([0, self.last], np.uint64)]
        for s in range(1, n + 1):
            near = 1 << (s - 1)
            pairs = [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, n + 1) if i < i ^ s]
            self.flips.append(np.array([near, near | self.last, *pairs], np.uint64))

    def anchors(self, values):
        """(row number, anchor) of every anchor within the covering radius plus one bit of each value."""
        syndrome = np.zeros(len(values), np.uint64)
        for k in range(self.bits - 1):
            syndrome ^= (values >> np.uint64(k) & np.uint64(1)) * np.uint64(k + 1)
        rows, found = [], []
        for s, flips in enumerate(self.flips):
            own = np.flatnonzero(syndrome == s)
            rows.append(np.repeat(own, len(flips)))
            found.append((values[own][:, None] ^ flips).ravel())
        return np.concatenate(rows), np.concatenate(found)


def _keyed(batches, parts, checks):
    """(key_a, key_b, fp) for each anchor of each of the given bit ranges; ``key_a`` is kept if it is there."""
    cover = Cover(checks)
    low = np.uint64((1 << cover.bits) - 1)
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 14):
            rows = batch.slice(at, 1 << 14)
            fps = rows.column(rows.num_columns - 1).to_numpy().view(np.uint64)
            outer = rows.column(0).to_numpy() if rows.num_columns > 1 else np.zeros(len(fps), np.int64)
            # The outer key names the half that has been covered, if any: its other half comes next.
            covered = outer >> 32 & 1
            for k in range(parts):
                first = np.full(len(fps), k * cover.bits) if rows.num_columns == 1 else (1 - covered) * 32 + k * cover.bits
                number, anchor = cover.anchors(fps >> first.astype(np.uint64) & low)
                key = anchor.astype(np.int64) | np.int64(k) << 32
                yield pa.RecordBatch.from_arrays([pa.array(outer[number]), pa.array(key), pa.array(fps[number].view(np.int64))], ["key_a", "key_b", "fp"])


def spanning(fps, threshold=THRESHOLD):
    """Links (as row numbers) that join all that is linked among distinct fingerprints."""
    left, found = np.arange(1, len(fps)), []
    queue = [0]
    while queue or len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        x = queue.pop()
        near = np.bitwise_count(fps[left] ^ fps[x]) <= threshold
        if near.any():
            found.extend((x, int(y)) for y in left[near])
            queue.extend(left[near].tolist())
            left = left[~near]
    return found


def _compare(batches, limit, keys):
    """Links of groups of up to ``limit`` rows, and the rows of larger ones, from rows sorted by key.

    Yields (key_a, key_b, a, b): a link has null keys, a row of a larger group a null ``b``.
    """
    names = ["key_a", "key_b", "a", "b"]

    def links(pairs):
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        none = pa.nulls(len(pairs), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names)

    def rest(key, fps):
        own = [pa.array(np.full(len(fps), k, np.int64)) for k in [*key.tolist(), 0][:2]]
        return pa.RecordBatch.from_arrays([*own, pa.array(fps), pa.nulls(len(fps), pa.int64())], names)

    held, too_large = None, False  # rows of the last key so far
    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1)
        fps = batch.column(keys).to_numpy()
        if not len(fps):
            continue
        if held is not None:
            if too_large and (key[0] == held[0][0]).all():
                same = (key == key[0]).all(axis=1)
                own = len(fps) if same.all() else int(np.argmin(same))
                yield rest(key[0], fps[:own])
                key, fps = key[own:], fps[own:]
                if not len(fps):
                    continue
                held, too_large = None, False
            elif too_large:
                held, too_large = None, False
            else:
                key, fps = np.concatenate([held[0], key]), np.concatenate([held[1], fps])
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        last = int(change[-1]) if len(change) else 0
        out, more = _groups(key[:last], fps[:last], np.concatenate([[0], change]), limit)
        yield links(out)
        for k, f in more:
            yield rest(k, f)
        held, too_large = (key[last:], fps[last:]), False
        if limit and len(held[1]) > limit:
            yield rest(held[0][0], held[1])
            held, too_large = (held[0][:1], held[1][:1]), True
    if held is not None and not too_large:
        out, more = _groups(held[0], held[1], np.array([0, len(held[1])]), limit)
        yield links(out)
        for k, f in more:
            yield rest(k, f)


def _groups(key, fps, bounds, limit):
    """Linked pairs, each with the smaller number first, and the groups beyond ``limit``."""
    out, more = [], []
    if len(bounds) < 2:
        return out, more
    unsigned, sizes = fps.view(np.uint64), np.diff(bounds)
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = np.flatnonzero((sizes <= _SMALL)[group] & (sizes > 1)[group])
    if len(small):
        g, f = group[small], unsigned[small]
        for d in range(1, int(sizes[sizes <= _SMALL].max())):
            near = np.flatnonzero((g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= THRESHOLD) & (f[d:] != f[:-d]))
            if len(near):
                own = fps[small]
                out.append(np.sort(np.stack([own[near], own[near + d]], axis=1), axis=1))
    for k in np.flatnonzero(sizes > _SMALL).tolist():
        own = fps[bounds[k] : bounds[k + 1]]
        if limit and len(own) > limit:
            more.append((key[bounds[k]], own))
            continue
        own = np.unique(own)
        pairs = spanning(own.view(np.uint64))
        if pairs:
            out.append(np.sort(own[np.array(pairs)], axis=1))
    return out, more


_COMPARED = "key_a long, key_b long, a long, b long"


def links(classes):
    """(a, b): links between distinct fingerprints that join everything that is linked."""

    def met(keyed, keys, limit, label):
        chosen = keyed.repartition(*keys).sortWithinPartitions(*keys)
        done = materialize(chosen.select(*keys, "fp").mapInArrow(lambda b: _compare(b, limit, len(keys)), _COMPARED), label)
        return done.where("key_a IS NULL").select("a", "b").distinct(), done.where("key_a IS NOT NULL").select("key_a", "key_b", F.col("a").alias("fp"))

    keyed = "key_a long, key_b long, fp long"
    halves = classes.select("fp").mapInArrow(lambda b: _keyed(b, 2, 5), keyed).select(F.col("key_b").alias("key_a"), "fp")
    first, large = met(halves, ["key_a"], GROUP, "half_links")
    quarters = large.select("key_a", "fp").mapInArrow(lambda b: _keyed(b, 2, 4), keyed)
    second, large = met(quarters, ["key_a", "key_b"], GROUP, "quarter_links")
    large = materialize(large, "large")
    blocks = large.groupBy("key_a", "key_b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
    dealt = large.join(materialize(blocks, "blocks"), ["key_a", "key_b"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = {"low": F.least("block", "other").cast("long"), "high": F.greatest("block", "other").cast("long")}
    third, _ = met(dealt.withColumns(pair).select("key_a", "key_b", "low", "high", "fp"), ["key_a", "key_b", "low", "high"], 0, "block_links")
    return first.union(second).union(third).distinct()


def near_duplicates(docs, size=SHINGLE, text_col="text", id_col="doc_id"):
    """(doc_id, fingerprint, component_id) of each row; the fingerprint as 16 hex digits."""
    rows = fingerprints(docs, size, text_col, id_col)
    known = rows.where("doc_id IS NOT NULL")
    classes = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = links(classes)
    for name in "ab":
        side = classes.select(F.col("fp").alias(name), F.col("rep").alias(f"rep_{name}"))
        found = found.join(side, name)
    found = found.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # One document with several fingerprints links their classes.
    several = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("doc_id", "low")
    same = known.join(materialize(several, "several"), "doc_id").where("fp != low").select("fp", "low").distinct()
    same = same.join(classes.withColumnRenamed("rep", "a"), "fp").join(classes.select(F.col("fp").alias("low"), F.col("rep").alias("b")), "low")
    joined = components(found.union(same.select("a", "b")).distinct()).select(F.col("doc_id").alias("rep"), "label")
    named = materialize(classes.join(joined, "rep", "left").select("fp", F.coalesce("label", "rep").alias("component")), "named")
    out = rows.join(named, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component)
