"""Ordered text of groups of any size, as numbered chunks of bounded length.

All chunks of a text but its last have exactly ``chunk_chars`` characters, so a chunk is a plain
function of the whole text, and the chunks in order are the whole text. No group is ever held in
one cell or one task, and small and large groups go the same way.
"""

from pyspark.sql import Window, functions as F

from corpusctx.operators.joins import join_on
from corpusctx.operators.ordering import place_rows
from corpusctx.sources.scratch import materialize

CHUNK_CHARS = 1 << 16


def text_starts(df, keys, order, value):
    """(keys, order, _start): the characters of its group before each row's text."""
    sized = df.select(*keys, *order, F.length(value).cast("bigint").alias("_len")).where("_len > 0")
    # Written first, as finding the ranges would measure every text twice.
    placed = place_rows(materialize(sized, "lengths"), keys, order)
    runs = placed.groupBy(*keys, "_part").agg(F.sum("_len").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")), "runs")
    before = Window.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("_within", F.coalesce(F.sum("_len").over(before), F.lit(0)))
    return join_on(within, runs, [*keys, "_part"]).select(*keys, *order, (F.col("_base") + F.col("_within")).alias("_start"))


def _pieces(value, start, chunk_chars):
    """Cuts of a text that begins at ``start``: (chunk_no, at, piece) for every chunk it reaches into."""
    size = F.lit(chunk_chars).cast("bigint")
    reached = F.sequence(F.floor(start / size), F.floor((start + F.length(value) - 1) / size))

    def cut(k):
        at = F.greatest(k * size, start)
        begin, length = (at - start + 1).cast("int"), ((k + 1) * size - at).cast("int")
        return F.struct(k.alias("chunk_no"), at.alias("at"), F.substring(value, begin, length).alias("piece"))

    return F.transform(reached, cut)


def text_chunks(df, keys, order, value, chunk_chars=CHUNK_CHARS):
    """Ordered concatenation of ``value`` per group: ``keys, chunk_no`` (from 0), ``n_chars, chunk``.

    ``order`` names columns; (keys, order) must be unique. Only keys and lengths are ordered;
    texts meet their place in a join and move once more to their chunk. Null and empty texts add
    nothing, and a group of nothing else has no chunk.
    """
    starts = text_starts(df, keys, order, value)
    placed = join_on(df.select(*keys, *order, F.col(value).alias("_value")), starts, [*keys, *order])
    cut = placed.select(*keys, F.explode(_pieces(F.col("_value"), F.col("_start"), chunk_chars)).alias("c"))
    # A chunk has as many pieces as characters at most.
    pieces = F.array_sort(F.collect_list(F.struct("c.at", "c.piece")))
    chunks = cut.groupBy(*keys, F.col("c.chunk_no").alias("chunk_no")).agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("chunk"))
    return chunks.select(*keys, "chunk_no", F.length("chunk").cast("bigint").alias("n_chars"), "chunk")


def cut_chunks(df, keys, value, chunk_chars=CHUNK_CHARS):
    """One text per row as chunks: ``keys, chunk_no, n_chars, chunk``; empty and null texts have none."""
    cut = df.where(F.length(value) > 0).select(*keys, F.explode(_pieces(F.col(value), F.lit(0).cast("bigint"), chunk_chars)).alias("c"))
    return cut.select(*keys, F.col("c.chunk_no").alias("chunk_no"), F.length("c.piece").cast("bigint").alias("n_chars"), F.col("c.piece").alias("chunk"))


def append_chunks(tasks, chunks, keys, tail, payload="chunk", finish=lambda c: c, chunk_chars=CHUNK_CHARS):
    """Chunks of each task: those of its group, then ``tail`` (a text per task) from a new chunk on.

    ``payload`` may be a digest of the chunk instead; ``finish`` makes the same of the tail's chunks.
    A chunk meets its tasks on its own number, so a group of many chunks is spread out.
    """
    counts = materialize(chunks.groupBy(*keys).agg((F.max("chunk_no") + 1).alias("_n")), "counts")
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("chunk_no")
    wanted = join_on(tasks, counts, keys).select("task_id", *keys, numbers)
    shared = join_on(wanted, chunks, [*keys, "chunk_no"]).select("task_id", "chunk_no", "n_chars", payload)
    own = join_on(tasks, counts, keys, "left").select("task_id", F.coalesce("_n", F.lit(0)).alias("_n"), tail.alias("_tail"))
    own = own.where(F.length("_tail") > 0).select("task_id", "_n", F.explode(_pieces(F.col("_tail"), F.lit(0).cast("bigint"), chunk_chars)).alias("c"))
    piece = F.col("c.piece")
    own = own.select("task_id", (F.col("_n") + F.col("c.chunk_no")).alias("chunk_no"), F.length(piece).cast("bigint").alias("n_chars"), finish(piece).alias(payload))
    return shared.unionByName(own)
