"""Near-duplicate detection: SetSketch bands propose pairs, likelihood thins them, full sets decide.

1. Every text becomes its set of hashed word shingles, kept as a 128-bit class key and a sketch.
   Texts with equal sets are one class; only its smallest document goes on.
2. Documents that share a band of registers share a bucket. In each bucket the document with the
   most bucket mates is the hub, and every other member is compared with it: one pair per member,
   however large the bucket. Verified pairs give first components.
3. Members of one bucket that are still in different components are compared inside tasks, in
   blocks of a bounded size. Members of the bucket's largest component need not meet each other:
   they are copied once per block of the others. Only links that join components come out. So no
   link between components is lost, and no group, of copies or not, ever emits all its pairs.
4. Those links join first components to the final ones.

A document without words (null or empty text too) is linked with nothing. Rows that share a
doc_id count as one document: they share a component. A null doc_id is never linked: its
component is null and it is kept. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusctx.llm import setsketch
from corpusctx.llm.arrow import byte_view, column_udf, releasing, slices
from corpusctx.llm.shingles import Words, mix, shingle_sets
from corpusctx.sources.scratch import materialize

PERCENT = 80
#: A pair whose estimate lies this far under the threshold is not verified: six standard errors.
SLACK = 0.15
BLOCK = 512
#: Pairs of sketches that are compared at once.
_AT_ONCE = 1 << 13
#: Registers are equal with a probability of at least the similarity; below this the estimate is not made.
FEWEST_EQUAL = setsketch.REGISTERS // 2


def sketches(docs, size, text_col="text", id_col="doc_id"):
    """(doc_id, n_shingles, key_a, key_b, registers) of each document, written once."""

    def run(batches):
        words = Words()
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            for a, b in slices(offsets):
                sets, sizes = shingle_sets(words, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                full = np.flatnonzero(sizes)
                keys = []
                for salt in (1, 2):
                    key = np.zeros(len(sizes), np.uint64)
                    if len(full):
                        key[full] = np.add.reduceat(mix(sets, salt), (np.cumsum(sizes) - sizes)[full])
                    keys.append(pa.array(key.view(np.int64)))
                packed = setsketch.registers(sets, sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), *keys, pa.array([r.tobytes() for r in packed], pa.binary())],
                    ["doc_id", "n_shingles", "key_a", "key_b", "registers"],
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(chosen.mapInArrow(releasing(run), "doc_id long, n_shingles long, key_a long, key_b long, registers binary"), "sketches")


def _matrix(column):
    """Registers of a binary column as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, setsketch.REGISTERS)


def bands(classes):
    """(bucket, doc_id): one row per class and band."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                keys = setsketch.band_keys(_matrix(rows.column(1)))
                ids = np.repeat(rows.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["bucket", "doc_id"])

    return materialize(classes.select("doc_id", "registers").mapInArrow(releasing(run), "bucket long, doc_id long"), "bands")


def shared_buckets(band_rows):
    """(bucket, doc_id, mates, hub) of the members of buckets with two or more documents."""
    sizes = band_rows.groupBy("bucket").agg((F.count("*") - 1).alias("mates")).where("mates > 0")
    members = materialize(band_rows.join(sizes, "bucket"), "members")
    degree = members.groupBy("doc_id").agg(F.sum("mates").alias("degree"))
    ranked = members.join(materialize(degree, "degrees"), "doc_id")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("degree", -F.col("doc_id"))).alias("top"))
    hubs = materialize(hubs.select("bucket", (-F.col("top.col2")).alias("hub")), "hubs")
    return materialize(members.join(hubs, "bucket"), "shared")


def _estimate(a, b, n_a, n_b):
    """Estimated similarity; pairs whose sizes alone rule a link out get 0."""
    fits = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    out = np.zeros(len(a))
    if fits.any():
        out[fits] = setsketch.similarity(a[fits], b[fits], n_a[fits], n_b[fits])
    return out


def likely(pairs, classes):
    """Pairs (a, b) whose jointly estimated similarity is near or above the threshold."""

    def prepare():
        def run(rows):
            a, b, n_a, n_b = rows.flatten()
            return pa.array(_estimate(_matrix(a), _matrix(b), n_a.to_numpy(), n_b.to_numpy()))

        return run

    side = classes.select("doc_id", "n_shingles", "registers")
    for name in "ab":
        pairs = pairs.join(side.withColumnsRenamed({"doc_id": name, "n_shingles": f"n_{name}", "registers": f"r_{name}"}), name)
    estimate = column_udf(prepare, "double")(F.struct("r_a", "r_b", "n_a", "n_b"))
    return materialize(pairs.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")).where(estimate >= PERCENT / 100 - SLACK).select("a", "b"), "likely")


def grouped(batches, keys):
    """Record batches of one group each, from batches that are sorted by their first ``keys`` columns."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts, starts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class _Group:
    """Members of one bucket, or of two blocks of it, that may still be linked."""

    def __init__(self, table, sketch):
        self.low, self.high = table["low"][0].as_py(), table["high"][0].as_py()
        self.ids, self.label, self.block, self.hub = (table[c].to_numpy() for c in ("doc_id", "label", "block", "is_hub"))
        self.bucket, self.sketch = table["bucket"][0].as_py(), sketch

    def pairs(self, sizes):
        """Row numbers of pairs from different components, near or above the threshold by estimate.

        Pairs with the hub have been compared; a pair that shares several buckets belongs to the
        one of its first common band.
        """
        if self.label.min() == self.label.max():
            return
        keys = setsketch.band_keys(self.sketch)
        left, right = np.flatnonzero((self.block == self.low) & ~self.hub), np.flatnonzero((self.block == self.high) & ~self.hub)
        step = max(1, _AT_ONCE // max(1, len(right)))
        for at in range(0, len(left), step):
            i, j = left[at : at + step, None], right[None, :]
            apart = (self.label[i] != self.label[j]) & (100 * np.minimum(sizes[i], sizes[j]) >= PERCENT * np.maximum(sizes[i], sizes[j]))
            if self.low == self.high:
                apart &= self.ids[i] < self.ids[j]
            x, y = np.nonzero(apart)
            x, y = left[at + x], right[y]
            same = (self.sketch[x] == self.sketch[y]).sum(axis=1) >= FEWEST_EQUAL
            x, y = x[same], y[same]
            x, y = (r[keys[x, (keys[x] == keys[y]).argmax(axis=1)] == self.bucket] for r in (x, y))
            near = _estimate(self.sketch[x], self.sketch[y], sizes[x], sizes[y]) >= PERCENT / 100 - SLACK
            if near.any():
                yield x[near], y[near]


_GROUP = ["bucket", "low", "high"]
_SLIM = ["bucket", "low", "high", "block", "doc_id", "label", "is_hub"]


def unsettled_blocks(labelled):
    """(bucket, low, high, block, doc_id, label, is_hub): the members of buckets with several components, once per group.

    ``labelled``: (bucket, doc_id, mates, hub, label), written. A bucket of up to ``BLOCK`` members is one group. In a larger one
    the members outside its largest component (the loose ones) and those in it have blocks of their own, and every block of loose
    members meets every block. Two members of different components so share exactly one group, and n members with r loose
    ones make about n + 2 n r / ``BLOCK`` rows.
    """
    parts = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    parts = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("n", -F.col("label"))).alias("top"))
    split = parts.where("parts > 1").select("bucket", F.col("top.n").alias("n_top"), (-F.col("top.col2")).alias("top"))
    members = labelled.join(materialize(split, "split"), "bucket").withColumn("large", F.col("mates") + 1 > BLOCK)
    members = members.withColumn("loose", ~F.col("large") | (F.col("label") != F.col("top")))

    def blocks(n):
        return F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")

    members = members.withColumns({
        "n_loose": F.when(F.col("large"), blocks(F.col("mates") + 1 - F.col("n_top"))).otherwise(1),
        "n_others": F.when(F.col("large"), blocks(F.col("n_top"))).otherwise(0),
    })
    place = F.xxhash64("doc_id")
    block = F.when(F.col("loose"), F.pmod(place, "n_loose")).otherwise(F.col("n_loose") + F.pmod(place, F.greatest(F.lit(1), "n_others")))
    met = F.col("n_loose") + F.when(F.col("loose"), F.col("n_others")).otherwise(0)
    members = members.withColumns({"block": block.cast("int"), "is_hub": F.col("hub").eqNullSafe(F.col("doc_id")), "met": met})
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("met") - 1)))
    return members.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).select(*_SLIM)


def remaining_links(shared, labels, classes, docs, size, text_col="text", id_col="doc_id"):
    """Links between components, as pairs (a, b) of labels: two members that share a bucket are verified.

    Members meet in the groups of ``unsettled_blocks``. Sketches say which members of a group can have a link there; only those get their full sets
    and meet once more. Pairs never leave a task, only links that join components do.
    """
    own = F.coalesce("label", "doc_id")
    labelled = shared.join(labels, "doc_id", "left").select("bucket", "doc_id", "mates", "hub", own.alias("label"))
    labelled = materialize(labelled, "labelled")
    placed = unsettled_blocks(labelled).join(classes.select("doc_id", "n_shingles", "registers"), "doc_id")
    placed = placed.select(*_SLIM, "n_shingles", "registers")

    def choose(batches):
        for table in grouped(batches, 3):
            found = [np.concatenate(p) for p in _Group(table, _matrix(table["registers"])).pairs(table["n_shingles"].to_numpy())]
            if found:
                yield from table.select(_SLIM).take(np.unique(np.concatenate(found))).to_batches()

    schema = "bucket long, low int, high int, block int, doc_id long, label long, is_hub boolean"
    chosen = materialize(placed.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(releasing(choose), schema), "chosen")
    sets = full_sets(chosen.select("doc_id"), docs, size, text_col, id_col)

    def confirm(batches):
        for table in grouped(batches, 3):
            sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            group = _Group(table, setsketch.registers(np.concatenate(sets), sizes))
            parent = {int(x): int(x) for x in group.label}

            def root(x):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            links = []
            for x, y in group.pairs(sizes):
                for i, j in zip(x.tolist(), y.tolist()):
                    a, b = root(int(group.label[i])), root(int(group.label[j]))
                    if a != b and _linked(sets[i], sets[j]):
                        parent[a] = b
                        links.append(sorted((int(group.label[i]), int(group.label[j]))))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    full = chosen.join(sets, "doc_id").select(*_SLIM, "shingles")
    return materialize(full.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(releasing(confirm), "a long, b long").distinct(), "more_links")


def _linked(a, b):
    """Whether two sorted sets meet the threshold."""
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def full_sets(ids, docs, size, text_col="text", id_col="doc_id"):
    """(doc_id, shingles): the full sets of these documents, whose texts are read again."""

    def read_sets(batches):
        words = Words()
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            for a, b in slices(offsets):
                sets, sizes = shingle_sets(words, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                ends = np.cumsum(sizes)
                packed = [sets[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(packed, pa.binary())], ["doc_id", "shingles"])

    wanted = materialize(ids.distinct(), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(wanted, "doc_id", "left_semi")
    return materialize(texts.mapInArrow(releasing(read_sets), "doc_id long, shingles binary"), "sets")


def verified(pairs, docs, size, text_col="text", id_col="doc_id"):
    """Pairs whose full shingle sets meet the threshold."""

    def prepare():
        def linked(rows):
            pairs = zip(*(c.to_pylist() for c in rows.flatten()))
            return pa.array([_linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in pairs], pa.bool_())

        return linked

    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, size, text_col, id_col)
    for name in "ab":
        pairs = pairs.join(sets.withColumnsRenamed({"doc_id": name, "shingles": f"s_{name}"}), name)
    return materialize(pairs.where(column_udf(prepare, "boolean")(F.struct("s_a", "s_b"))).select("a", "b").distinct(), "links")


def _only_stars(edges):
    """Whether every node has one smaller neighbour and no larger one, or larger ones alone."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return ends.where("up > 1 OR up > 0 AND down > 0").isEmpty()


def components(links):
    """(doc_id, label): each linked document's smallest reachable one, by alternating star contractions."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    while not _only_stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(materialize(least, "least"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u > v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(materialize(least, "least"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u > v").distinct(), "edges")
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("label"))


def near_duplicates(docs, size=5, text_col="text", id_col="doc_id"):
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``; ``size`` words per shingle."""
    table = sketches(docs, size, text_col, id_col)
    full = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n_shingles", "registers"), "doc_id").alias("s"))
    classes = materialize(classes.select("doc_id", "key_a", "key_b", "s.*"), "classes")
    shared = shared_buckets(bands(classes))
    stars = shared.where("doc_id != hub").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    links = verified(likely(materialize(stars, "stars"), classes), docs, size, text_col, id_col)
    first = components(links)
    joined = components(remaining_links(shared, first, classes, docs, size, text_col, id_col)).select(F.col("doc_id").alias("first"), "label")
    named = classes.join(first, "doc_id", "left").select("key_a", "key_b", F.coalesce("label", "doc_id").alias("first"))
    named = materialize(named, "named").join(joined, "first", "left").select("key_a", "key_b", F.coalesce("label", "first").alias("component"))
    named = materialize(named, "named")
    rows = table.select("doc_id", "n_shingles", "key_a", "key_b").join(named, ["key_a", "key_b"], "left")
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
    rows = rows.select("doc_id", "n_shingles", F.coalesce(linked, F.col("doc_id")).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
