"""Blocks, parts, prompts and manifests.

The canonical prompt is its numbered chunks (``body_chunks``, ``prompt_chunks``) or, block by
block, its parts: both hold every character of prompts of any size. A request needs its prompt in
one cell: that form (``assemble_bodies``, ``assemble_prompts``) exists only where it fits, and
elsewhere the request is an error row.
"""

from dataclasses import dataclass

from pyspark.sql import functions as F

from corpusctx.functions import paths, text
from corpusctx.operators import chunks
from corpusctx.operators.joins import join_on, join_wide, without_keys
from corpusctx.operators.ordering import number_rows, path_order
from corpusctx.sources.scratch import materialize

# A request is one cell; a prompt beyond this many characters can only be had in chunks or parts.
MAX_CELL_CHARS = 64_000_000

# Parts of one group that may meet its tasks in one place.
PARTS_PER_SLICE = 100_000


@dataclass(frozen=True)
class Templates:
    """Wording around contents; every piece can be replaced."""

    # The frames of a file block and of a file that could not be read.
    file_open: str = "## Source: "
    file_head: str = "\n\n"
    file_close: str = "\n\n---\n\n"
    error_open: str = "```\n--- ERROR READING FILE ---\nError reading "
    error_close: str = "\n```"
    # Own wording around the task text.
    task_open: str = "\n======\n\n# Current task\n\nFollow the instructions below; everything above is context.\n\n"
    task_close: str = "\n\n------\n\n# Answer format\n\nAnswer in plain Markdown and put full link addresses in the text.\n"


# Fixed values of the manifest lines.
NO_SOURCES = "*   (No specific files listed - likely included './')"
NO_MODELS = "None"
COMMIT_CHARS = 10


def _read_error(files):
    return F.col("read_error") if "read_error" in files.columns else F.lit(None).cast("string")


def _body(files, t):
    path, error = F.col("path"), _read_error(files)
    failed = F.concat(F.lit(t.error_open), path, F.lit(": "), error, F.lit(t.error_close))
    return F.when(error.isNotNull(), failed).otherwise(text.unify_newlines(F.coalesce("content", F.lit(""))))


def project_blocks(files, templates=Templates()):
    """Replace content by the file's block: header with path, content or error, separator."""
    t, path = templates, F.col("path")
    block = F.concat(F.lit(t.file_open), path, F.lit(t.file_head), _body(files, t), F.lit(t.file_close))
    return files.withColumn("block", block).drop("content", "read_error")


def block_chars(files, templates=Templates()):
    """Length of each block without building it."""
    t = templates
    frame = len(t.file_open) + len(t.file_head) + len(t.file_close)
    chars = F.length("path") + F.length(_body(files, t)) + F.lit(frame)
    return files.withColumn("block_chars", chars.cast("bigint")).drop("content", "read_error")


def text_sizes(df, keys, value):
    """Rows and characters of ``value`` per group."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.length(value).cast("bigint")).cast("bigint").alias("chars")
    )


def slice_join(tasks, numbered, keys, columns):
    """Tasks with the numbered rows (``seq``) of their group, met slice by slice of the group."""
    counts = numbered.groupBy(*keys).agg(F.max("seq").alias("_n"))
    slices = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / PARTS_PER_SLICE))
    placed = tasks.join(counts, keys).select("task_id", *keys, F.explode(slices).alias("_slice"))
    sliced = numbered.withColumn("_slice", F.floor((F.col("seq") - 1) / PARTS_PER_SLICE))
    return placed.join(sliced, [*keys, "_slice"]).select("task_id", *columns)


def task_files(tasks, files, keys=("project",)):
    """The files of each task with their place in its prompt: task_id and the columns of ``files``."""
    keys = list(keys)
    return slice_join(tasks, path_order(files, keys), keys, [c for c in files.columns if c != "task_id"] + ["seq"])


def join_texts(df, keys, order, value, out, max_chars=MAX_CELL_CHARS):
    """Ordered concatenation of ``value`` per group: ``keys, n, chars, out``.

    Sizes are summed first. Groups beyond ``max_chars`` never reach the collecting aggregate nor
    its shuffle: they keep their exact counts and a null text; ``text_chunks`` has them whole.
    """
    probe = text_sizes(df, keys, value).filter(F.col("chars") > max_chars).persist()
    n_large = probe.count()
    if n_large:
        large = materialize(probe, "large")
        df = without_keys(df, large, n_large, keys, order)
    probe.unpersist()
    entry = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("v"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]), "")
    texts = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.length(value).cast("bigint")).cast("bigint").alias("chars"), joined.alias(out)
    )
    return texts.unionByName(large.withColumn(out, F.lit(None).cast("string"))) if n_large else texts


def body_chunks(blocks, keys=("project",), chunk_chars=chunks.CHUNK_CHARS):
    """The text of each group, blocks in path order, as chunks: ``keys, chunk_no, n_chars, chunk``.

    Tasks over the same files share it. (keys, path) must be unique.
    """
    ordered = blocks.select(*keys, paths.order_key(F.col("path")).alias("_path"), "block")
    return chunks.text_chunks(ordered, list(keys), ["_path"], "block", chunk_chars)


def task_tail(templates=Templates()):
    """What follows the files in a task's prompt."""
    return F.concat(F.lit(templates.task_open), F.coalesce("definition", F.lit("")), F.lit(templates.task_close))


def prompt_chunks(bodies, tasks, payload="chunk", keys=("project",), templates=Templates(), finish=lambda c: c, chunk_chars=chunks.CHUNK_CHARS):
    """``task_id, chunk_no, n_chars, payload``: every character of each prompt; the task's own text begins a chunk."""
    return chunks.append_chunks(tasks, bodies, list(keys), task_tail(templates), payload, finish, chunk_chars)


def assemble_bodies(blocks, keys=("project",), max_chars=MAX_CELL_CHARS):
    """One text per group: blocks in path order, for requests."""
    return join_texts(blocks, list(keys), [paths.order_key(F.col("path"))], "block", "body", max_chars)


def task_chars(t):
    return F.length(F.coalesce("definition", F.lit(""))) + len(t.task_open) + len(t.task_close)


def assemble_prompts(bodies, tasks, keys=("project",), templates=Templates()):
    """``task_id, n_files, prompt_chars, prompt``; prompt is null when its body is too large for a cell."""
    t = templates
    joined = join_wide(tasks, bodies, list(keys))
    body = F.when(F.col("n").isNull(), F.lit("")).otherwise(F.col("body"))
    prompt = F.concat(body, F.lit(t.task_open), F.coalesce("definition", F.lit("")), F.lit(t.task_close))
    return joined.select(
        "task_id",
        F.coalesce("n", F.lit(0)).alias("n_files"),
        (F.coalesce("chars", F.lit(0)) + task_chars(t)).cast("bigint").alias("prompt_chars"),
        prompt.alias("prompt"),
    )


def prompt_totals(files, tasks, keys=("project",), templates=Templates(), ratio=text.DEFAULT_RATIO):
    """Files, characters and token estimate of each task's whole prompt, summed, never built."""
    sizes = block_chars(files, templates).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("block_chars").alias("chars"))
    total = (F.coalesce("chars", F.lit(0)) + task_chars(templates)).cast("bigint")
    return tasks.join(sizes, list(keys), "left").select(
        "task_id",
        F.coalesce("n", F.lit(0)).alias("n_files"),
        total.alias("total_chars"),
        text.estimate_tokens(total, ratio).alias("est_tokens"),
    )


def file_parts(blocks, keys=("project",)):
    """Number the files of each group in path order; (keys, path) must be unique.

    Only the paths are ordered. Blocks, or digests of them, meet their number in a join on
    the unique path, so contents are read once.
    """
    keys = list(keys)
    return join_on(blocks, path_order(blocks.select(*keys, "path"), keys), [*keys, "path"])


def prompt_parts(parts, tasks, payload="block", keys=("project",), templates=Templates(), finish=lambda c: c):
    """``task_id, seq, kind, payload``: files in order, then task header, task text, footer.

    ``parts`` comes from ``file_parts``; ``finish`` is applied to the three task pieces, so a
    payload that is a digest of the block stays one digest per file and is joined, not recomputed.
    Files meet tasks slice by slice of the numbered group, so a huge group is spread out.
    """
    t, keys = templates, list(keys)
    counts = parts.groupBy(*keys).agg(F.max("seq").alias("_n"))
    files = slice_join(tasks, parts, keys, ["seq", F.lit("file").alias("kind"), payload])
    pieces = [("header", F.lit(t.task_open)), ("task", F.coalesce("definition", F.lit(""))), ("footer", F.lit(t.task_close))]
    tail = F.explode(
        F.array(
            *[
                F.struct(F.lit(i + 1).alias("i"), F.lit(kind).alias("kind"), finish(piece).alias("p"))
                for i, (kind, piece) in enumerate(pieces)
            ]
        )
    )
    ends = (
        tasks.join(counts, keys, "left")
        .select("task_id", F.coalesce("_n", F.lit(0)).alias("_n"), tail.alias("t"))
        .select("task_id", (F.col("_n") + F.col("t.i")).alias("seq"), F.col("t.kind").alias("kind"), F.col("t.p").alias(payload))
    )
    return files.unionByName(ends)


def remote_lines(remotes):
    """Manifest line of each remote source (task_id, base_url, branch, commit, folder)."""
    named = F.when(F.col("branch").isNotNull(), F.concat(F.lit(" (Branch: "), F.col("branch"), F.lit(")")))
    line = F.concat(
        F.lit("*   (git) "),
        F.col("base_url"),
        F.coalesce(named, F.lit("")),
        F.lit(" (Commit: "),
        F.left("commit", F.lit(COMMIT_CHARS)),
        F.lit(") -> `"),
        F.col("folder"),
        F.lit("`\n"),
    )
    return remotes.withColumn("line", line)


def local_lines(files, keys):
    return files.select(*keys, "path", F.concat(F.lit("*   `"), F.col("path"), F.lit("`\n")).alias("line"))


def manifest_chunks(files, tasks, remotes=None, keys=("project",), chunk_chars=chunks.CHUNK_CHARS):
    """The source lines of each task's manifest, whatever their number: ``task_id, chunk_no, n_chars, chunk``.

    Local lines are cut once per group and shared by its tasks; remote lines begin a chunk. The
    chunks in order are ``sources_text``. (keys, path) must be unique.
    """
    keys = list(keys)
    lines = local_lines(files, keys).select(*keys, paths.order_key(F.col("path")).alias("_path"), "line")
    local = materialize(chunks.text_chunks(lines, keys, ["_path"], "line", chunk_chars), "local")
    counts = materialize(local.groupBy(*keys).agg((F.max("chunk_no") + 1).alias("_n")), "counts")
    placed = join_on(tasks.select("task_id", *keys), counts, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    if remotes is None:
        placed = placed.withColumn("_all", F.col("_n"))
    else:
        # Equal lines may be repeated: their number tells them apart.
        named = remote_lines(remotes).select("task_id", paths.name(F.col("folder")).alias("_name"), "line")
        numbered = number_rows(named, ["task_id"], ["_name", "line"])
        far = materialize(chunks.text_chunks(numbered, ["task_id"], ["seq"], "line", chunk_chars), "remote")
        far_counts = materialize(far.groupBy("task_id").agg((F.max("chunk_no") + 1).alias("_r")), "remote_counts")
        placed = placed.join(far_counts, "task_id", "left")
        placed = placed.withColumn("_all", F.col("_n") + F.coalesce("_r", F.lit(0))).drop("_r")
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("chunk_no")
    wanted = placed.where("_n > 0").select("task_id", *keys, "_all", numbers)
    out = join_on(wanted, local, [*keys, "chunk_no"]).select("task_id", "chunk_no", "_all", "chunk")
    none = placed.where("_all = 0").select("task_id", F.lit(0).cast("bigint").alias("chunk_no"), F.lit(1).cast("bigint").alias("_all"), F.lit(NO_SOURCES + "\n").alias("chunk"))
    out = out.unionByName(none)
    if remotes is not None:
        own = placed.select("task_id", "_n", "_all").join(far, "task_id")
        out = out.unionByName(own.select("task_id", (F.col("_n") + F.col("chunk_no")).alias("chunk_no"), "_all", "chunk"))
    # The last line has no line end.
    ended = F.when(F.col("chunk_no") == F.col("_all") - 1, F.left("chunk", F.length("chunk") - 1)).otherwise(F.col("chunk"))
    return out.withColumn("chunk", ended).where("chunk <> ''").select("task_id", "chunk_no", F.length("chunk").cast("bigint").alias("n_chars"), "chunk")


def task_manifest(files, tasks, totals, remotes=None, keys=("project",), max_chars=MAX_CELL_CHARS):
    """One record per task: source lines, model list, token estimate.

    Local lines are joined once per group and shared by its tasks. Lists too long for a
    cell leave ``sources_text`` null; ``manifest_chunks`` has every line, and ``n_sources`` is always whole.
    """
    lines = local_lines(files, keys)
    local = join_texts(lines, list(keys), [paths.order_key(F.col("path"))], "line", "local_text", max_chars)
    joined = join_wide(tasks, local.withColumnsRenamed({"n": "n_local", "chars": "local_chars"}), list(keys))
    if remotes is None:
        joined = joined.withColumns({"n_remote": F.lit(0), "remote_text": F.lit("")})
    else:
        far = join_texts(
            remote_lines(remotes), ["task_id"], [paths.name(F.col("folder")), F.col("line")], "line", "remote_text", max_chars
        )
        joined = joined.join(far.withColumnRenamed("n", "n_remote").drop("chars"), "task_id", "left")

    def lines_of(count, column):
        return F.when(F.col(count).isNull(), F.lit("")).otherwise(F.col(column))

    every = F.concat(lines_of("n_local", "local_text"), lines_of("n_remote", "remote_text"))
    return joined.join(totals.select("task_id", "est_tokens"), "task_id", "left").select(
        "task_id",
        "name",
        "definition",
        (F.coalesce("n_local", F.lit(0)) + F.coalesce("n_remote", F.lit(0))).alias("n_sources"),
        F.when(every == "", F.lit(NO_SOURCES)).otherwise(F.left(every, F.length(every) - 1)).alias("sources_text"),
        F.when(F.size("models") > 0, F.array_join("models", ", ")).otherwise(F.lit(NO_MODELS)).alias("models_text"),
        "est_tokens",
    )


def render_manifest(manifest, created):
    """The manifest as one Markdown text per task; ``created`` is a UTC ISO time."""
    rendered = F.concat(
        F.lit("# Task: "), F.col("name"), F.lit("\n\n"), F.col("definition"),
        F.lit("\n\n---\n\n## Sources\n\n"), F.col("sources_text"),
        F.lit(f"\n\n---\n\n## Record\n\n*   **Created:** {created}\n*   **Estimated Tokens:** ~"),
        F.col("est_tokens").cast("string"), F.lit("\n*   **Models:** "), F.col("models_text"), F.lit("\n"),
    )
    return manifest.select("task_id", rendered.alias("manifest"))
