"""Document fingerprints: a Merkle tree of sentences, paragraphs and sections.

A text splits into paragraphs at line feeds and paragraphs into sentences after ``.``, ``!`` or
``?`` and a blank; sections end at paragraphs whose own hash says so, so an edit moves only the
section borders next to it. Each node's hash covers its children's; the root is the fingerprint:
equal roots mean equal texts, and where roots differ, only branches that differ need a look.

Only DataFrame functions are used. Null text counts as empty; the empty text is one empty
sentence. Repeated rows give repeated fingerprints, whatever other columns they have.
"""

from pyspark.sql import Window, functions as F

from corpusctx.sources.scratch import materialize

#: One paragraph in so many ends a section.
SECTION = 8
_POSITION_BITS = 33


def _hash(parts):
    return F.sha2(F.concat_ws("", parts), 256)


def paragraphs(text):
    """Array of structs of one text: paragraph hash and its sentences' hashes."""

    def one(paragraph):
        sentences = F.transform(F.split(paragraph, r"(?<=[.!?])(?=[\x20\t])"), lambda s: F.sha2(s, 256))
        return F.struct(_hash(sentences).alias("hash"), sentences.alias("sentences"))

    return F.transform(F.split(text, "\n"), one)


def sections(hashes):
    """Array of section hashes over an array of paragraph hashes."""
    numbers = F.sequence(F.lit(1), F.size(hashes))

    def closes(i):
        return (F.conv(F.substring(F.element_at(hashes, i), 1, 4), 16, 10).cast("int") % SECTION == 0) | (i == F.size(hashes))

    ends = F.filter(numbers, closes)
    return F.transform(ends, lambda e, i: _hash(F.slice(hashes, _start(ends, i) + 1, e - _start(ends, i))))


def _start(ends, i):
    return F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))


def trees(df, text_col="text", prefix="tree"):
    """``df`` with a struct column ``prefix``: root, section, paragraph and sentence hashes of the text."""
    step = f"_{prefix}"
    df = df.withColumn(step, paragraphs(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn(f"{step}_p", F.transform(step, lambda p: p["hash"]))
    df = df.withColumn(f"{step}_s", sections(F.col(f"{step}_p")))
    tree = F.struct(
        _hash(F.col(f"{step}_s")).alias("root"),
        F.col(f"{step}_s").alias("sections"),
        F.col(f"{step}_p").alias("paragraphs"),
        F.flatten(F.transform(step, lambda p: p["sentences"])).alias("sentences"),
    )
    return df.withColumn(prefix, tree).drop(step, f"{step}_p", f"{step}_s")


def leaf_keys(tree):
    """Distinct 64-bit keys of a tree's sentences: what ``likeness`` compares."""
    return F.array_distinct(F.transform(tree["sentences"], lambda s: F.xxhash64(s)))


def likeness(root_a, leaves_a, root_b, leaves_b):
    """1 for equal roots, else the share of distinct sentences that two trees have in common."""
    common = F.size(F.array_intersect(leaves_a, leaves_b)).cast("double")
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(common / (F.size(leaves_a) + F.size(leaves_b) - common))


def edited_paragraphs(a, b):
    """Numbers (from 0) of the paragraphs of tree ``a`` that tree ``b`` lacks: where an edit lies."""
    lost = F.array_except(a["paragraphs"], b["paragraphs"])
    all_of = F.sequence(F.lit(0), F.size(a["paragraphs"]) - 1)
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(
        F.filter(all_of, lambda i: F.array_contains(lost, F.get(a["paragraphs"], i)))
    )


def _key(column):
    return F.coalesce(F.concat(F.lit("d"), F.col(column).cast("string")), F.lit("n"))


def neighbours(docs, text_col="text", id_col="doc_id"):
    """(doc_id, n_chars, row_key, previous_id, previous_chars): who comes before each doc_id in descending order.

    The first document follows the last one. Of rows that share a doc_id, the one with the
    smallest text hash stands for them, and the longest sets how much is needed of the next.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ids = slim.groupBy("doc_id").agg(F.max(F.length("t")).alias("n_chars"), F.min(F.xxhash64("t")).alias("row_key"))
    ids = materialize(ids, "ids")
    order = F.col("doc_id").desc_nulls_last()
    placed = ids.repartitionByRange(order).sortWithinPartitions(order)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "in_order")
    placed = placed.withColumn("_part", F.shiftright("_at", _POSITION_BITS))
    inside = Window.partitionBy("_part").orderBy("_at")
    entry = F.struct("doc_id", "n_chars")
    lagged = placed.withColumn("_before", F.lag(entry).over(inside))
    # One row per range: its last document comes before the next range's first.
    ends = placed.groupBy("_part").agg(F.max_by(entry, "_at").alias("_end"))
    ranges = Window.orderBy("_part")
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("_part", F.coalesce(F.lag("_end").over(ranges), F.last("_end").over(whole)).alias("_end"))
    joined = lagged.join(materialize(ends, "range_ends"), "_part")
    before = F.coalesce("_before", "_end")
    return materialize(joined.select("doc_id", "row_key", before["doc_id"].alias("previous_id"), before["n_chars"].alias("previous_chars")), "neighbours")


def compare_with_edits(docs, text_col="text", id_col="doc_id"):
    """Fingerprints of each text and of its edited text, and how like they are.

    The edited text has its last half replaced by as much of the start of the next document, by
    descending id. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Texts move once to meet their neighbour's id, and of each the part
    that the document before it needs moves once more.
    """
    # One key column that is never null: both joins and the aggregate then share their partitioning.
    links = neighbours(docs, text_col, id_col)
    links = links.select(_key("doc_id").alias("key"), "row_key", _key("previous_id").alias("previous_key"), "previous_chars")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), _key(id_col).alias("key"))
    both = trees(texts.join(links, "key"))
    both = both.withColumn("leaves", leaf_keys(F.col("tree"))).withColumn("root", F.col("tree.root"))
    # As an equality of two sides the test would become a join key, and texts would be dealt anew for it.
    part = F.expr("substring(text, 1, cast(floor(previous_chars / 2) as int))")
    ahead = both.where(F.xxhash64("text").bitwiseXOR(F.col("row_key")) == 0).select(
        F.col("previous_key").alias("key"), part.alias("next_part"), F.col("root").alias("next_root"), F.col("leaves").alias("next_leaves")
    )
    ahead = ahead.groupBy("key").agg(F.first(F.struct("next_part", "next_root", "next_leaves")).alias("next")).select("key", "next.*")
    # The id comes back out of the key, so that both sides need the same columns and texts are dealt once.
    doc_id = F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)).cast(docs.schema[id_col].dataType)
    here = both.select("key", doc_id.alias("doc_id"), "text", F.length("text").alias("n_chars"), "root", "leaves")
    met = here.join(ahead, "key")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n_chars - cast(floor(n_chars / 2) as int))"), F.col("next_part").substr(F.lit(1), half))
    done = trees(met.withColumn("edited", edited), "edited", "edited_tree")
    done = done.withColumn("edited_leaves", leaf_keys(F.col("edited_tree")))
    return done.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("leaves"), F.col("edited_tree.root"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("root"), F.col("leaves"), F.col("next_root"), F.col("next_leaves")).alias("near_next"),
    )
