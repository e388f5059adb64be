"""Prompts stored once: texts by their address, tasks by reference.

The text of a chunk is kept once, whatever the number of groups, tasks or runs that hold it; its
address is the SHA-256 of its text. ``places`` says which chunks a group has, ``heads`` which
group a task has and how many chunks come before its own, ``tails`` where its own chunks are.
What moves to store the prompts of a run grows with the different texts and with the number of
tasks, not with their product; texts meet their tasks only when prompts are read.

Null keys are keys like any other, a task without a group has its own chunks only, and empty
texts have none. Rows of ``tasks`` must be unique by task_id.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpusctx.functions.text import sha256
from corpusctx.operators import chunks
from corpusctx.operators.assemble import Templates, task_tail
from corpusctx.operators.joins import join_on, join_wide
from corpusctx.sources.scratch import materialize


@dataclass
class PromptStore:
    """Tables of one run: contents (address, n_chars, chunk), places (keys, chunk_no, n_chars, address),
    heads (task_id, keys, n_shared, n_chunks, n_chars), tails (task_id, chunk_no, n_chars, address)."""

    contents: DataFrame
    places: DataFrame
    heads: DataFrame
    tails: DataFrame
    keys: tuple


def _once(texts):
    """Each different text once. Only addresses are grouped; of the texts just the repeated ones are dropped."""
    named = materialize(texts, "addressed")
    first = named.groupBy("address").agg(F.min("place").alias("_first"), F.count("*").alias("_n"))
    repeats = join_on(named.select("address", "place"), first.where("_n > 1").select("address", "_first"), ["address"])
    repeats = materialize(repeats.where("place <> _first").select("address", "place"), "repeats")
    return join_on(named, repeats, ["address", "place"], "left_anti").select("address", "n_chars", "chunk")


def prompt_store(bodies, tasks, keys=("project",), templates=Templates(), chunk_chars=chunks.CHUNK_CHARS):
    """The store of the prompts that ``prompt_chunks`` would spell out; ``bodies`` comes from ``body_chunks``."""
    keys = list(keys)
    wanted = materialize(tasks.select(*keys).distinct(), "groups")
    place = lambda kind, *columns: F.to_json(F.struct(F.lit(kind).alias("of"), *columns))
    shared = join_on(bodies, wanted, keys, "left_semi").withColumn("address", sha256(F.col("chunk")))
    shared = materialize(shared.withColumn("place", place("group", *keys, "chunk_no")), "shared")
    places = shared.select(*keys, "chunk_no", "n_chars", "address")

    own = chunks.cut_chunks(tasks.select("task_id", task_tail(templates).alias("_tail")), ["task_id"], "_tail", chunk_chars)
    own = own.withColumn("address", sha256(F.col("chunk")))
    own = materialize(own.withColumn("place", place("task", "task_id", "chunk_no")), "own")

    sizes = places.groupBy(*keys).agg((F.max("chunk_no") + 1).alias("n_shared"), F.sum("n_chars").alias("_shared"))
    sizes = materialize(sizes, "group_sizes")
    tail_sizes = own.groupBy("task_id").agg(F.count("*").alias("_own"), F.sum("n_chars").alias("_chars"))
    zero = F.lit(0).cast("bigint")
    heads = join_on(tasks.select("task_id", *keys), sizes, keys, "left").join(tail_sizes, "task_id", "left")
    n_shared = F.coalesce("n_shared", zero)
    heads = materialize(heads.select(
        "task_id", *keys, n_shared.alias("n_shared"), (n_shared + F.coalesce("_own", zero)).alias("n_chunks"),
        (F.coalesce("_shared", zero) + F.coalesce("_chars", zero)).alias("n_chars"),
    ), "heads")
    tails = join_on(own, heads.select("task_id", "n_shared"), ["task_id"])
    tails = tails.select("task_id", (F.col("n_shared") + F.col("chunk_no")).alias("chunk_no"), "n_chars", "address")
    columns = ["address", "place", "n_chars", "chunk"]
    return PromptStore(_once(shared.select(*columns).unionByName(own.select(*columns))), places, heads, tails, tuple(keys))


def references(store):
    """``task_id, chunk_no, n_chars, address`` of every chunk of every prompt; no text moves.

    A chunk meets its tasks on its own number, with a copy of its reference per so many tasks.
    """
    keys = list(store.keys)
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_shared") - 1)).alias("chunk_no")
    wanted = store.heads.where("n_shared > 0").select("task_id", *keys, numbers)
    shared = join_wide(wanted, store.places, [*keys, "chunk_no"])
    return shared.select("task_id", "chunk_no", "n_chars", "address").unionByName(store.tails)


def narrowed(store, wanted):
    """The store with the tasks of ``wanted`` (task_id) alone."""
    wanted = wanted.select("task_id").distinct()
    return PromptStore(
        store.contents, store.places, store.heads.join(wanted, "task_id", "left_semi"),
        store.tails.join(wanted, "task_id", "left_semi"), store.keys,
    )


def spelled_out(store):
    """``task_id, chunk_no, n_chars, chunk``: the prompts with their texts."""
    used = references(store)
    return join_on(used, store.contents.select("address", "chunk"), ["address"]).select("task_id", "chunk_no", "n_chars", "chunk")
