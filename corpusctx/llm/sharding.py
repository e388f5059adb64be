"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks, the partitions they are read in. How many rows of each block go to each shard
is drawn first, from the exact joint distribution that a uniform shuffle has: block by block,
shard by shard, a hypergeometric number of what is left. Each block then permutes its rows and
deals them by its line of the matrix; each shard permutes what it gets. All draws are functions
of the seed and of row places in a written table, so a lost task repeats them.

Only DataFrame functions are used. Shard sizes differ by one row at most. Null columns, empty
texts and repeated rows are rows like any other; an empty table gives no rows.
"""

from pyspark.sql import Window, functions as F

from corpusctx.sources.scratch import materialize

#: Blocks that one row of the draw splits among; more blocks take one more level.
FAN_OUT = 256
#: About this many rows of a shard are ordered by one task.
BUCKET_ROWS = 1 << 16
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _uniform(*parts):
    """A number in [0, 1) that is a function of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _let(value, body):
    """``body`` of a value that is computed once; inside a lambda an expression is computed at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(total, good, draws, uniform):
    """How many of ``good`` are among ``draws`` out of ``total``, by inversion of ``uniform``.

    Probabilities come from the ratios of neighbours, summed up to nine standard deviations
    and a few more steps on either side of the mode; beyond lies less than a double can hold.
    """
    given = F.struct(total.alias("total"), good.alias("good"), draws.alias("draws"), uniform.alias("u"))
    return _let(given, lambda p: _let(_support(p["total"], p["good"], p["draws"]), lambda s: _invert(s, p["u"])))


def _support(total, good, draws):
    t, g, d = (c.cast("double") for c in (total, good, draws))
    mode = F.floor((d + 1) * (g + 1) / (t + 2))
    least = F.greatest(t, F.lit(1.0))
    spread = F.sqrt(d * g / least * (1 - g / least) * (t - d) / F.greatest(t - 1, F.lit(1.0)))
    width = F.ceil(9 * spread) + 12
    low = F.greatest(F.lit(0).cast("bigint"), draws - (total - good), mode - width)
    high = F.least(draws, good, mode + width)
    return F.struct(t.alias("t"), g.alias("g"), d.alias("d"), low.alias("low"), high.alias("high"))


def _invert(s, uniform):
    def following(weight, k):
        k = k.cast("double")
        return weight * (s["g"] - k) * (s["d"] - k) / ((k + 1) * (s["t"] - s["g"] - s["d"] + k + 1))

    start = F.struct(F.lit(1e-280).alias("w"), F.lit(0.0).alias("sum"), s["low"].alias("at"))

    def walk(goal):
        def step(a, k):
            at = F.when(a["sum"] <= goal, k).otherwise(a["at"])
            return F.struct(following(a["w"], k).alias("w"), (a["sum"] + a["w"]).alias("sum"), at.alias("at"))

        return F.aggregate(F.sequence(s["low"], s["high"]), start, step)

    found = _let(uniform * walk(F.lit(0.0))["sum"], lambda goal: walk(goal)["at"])
    return F.when(s["low"] >= s["high"], s["low"]).otherwise(found)


def _take(sizes_left, count, seed, *where):
    """Draw ``count`` rows from shards that have ``sizes_left`` room: array of counts per shard."""

    def draw(state, shard):
        room = F.element_at(sizes_left, shard)
        drawn = hypergeometric(state["total"], room, state["open"], _uniform(F.lit(seed), *where, shard))
        return _let(
            drawn,
            lambda n: F.struct(F.concat(state["taken"], F.array(n)).alias("taken"), (state["open"] - n).alias("open"), (state["total"] - room).alias("total")),
        )

    zero = F.lit(0).cast("bigint")
    total = F.aggregate(sizes_left, zero, lambda a, x: a + x)
    start = F.struct(F.array().cast("array<bigint>").alias("taken"), count.cast("bigint").alias("open"), total.alias("total"))
    return F.aggregate(F.sequence(F.lit(1), F.size(sizes_left)), start, draw)["taken"]


def communication_matrix(block_sizes, shard_sizes, blocks, seed):
    """(block, counts): rows of each block for each shard. ``block_sizes``: (block, n), blocks 0 to ``blocks`` - 1.

    Drawn down a tree: a node knows how many of its rows go to each shard and splits them among
    at most ``FAN_OUT`` children, one after the other; nodes of a level are independent.
    """
    spark = block_sizes.sparkSession
    levels = 1
    while FAN_OUT**levels < blocks:
        levels += 1
    room = F.array(*[F.lit(int(n)).cast("bigint") for n in shard_sizes])
    nodes = spark.range(1).select(F.lit(0).cast("bigint").alias("node"), room.alias("counts"))
    for level in range(levels - 1, -1, -1):
        child = F.floor(F.col("block") / F.lit(FAN_OUT**level)).cast("bigint")
        sizes = block_sizes.groupBy(child.alias("child")).agg(F.sum("n").alias("n"))
        parents = sizes.groupBy(F.floor(F.col("child") / FAN_OUT).cast("bigint").alias("node"))
        # FAN_OUT children at most in one cell.
        children = parents.agg(F.sort_array(F.collect_list(F.struct("child", "n"))).alias("children"))

        def split(state, child):
            def put(taken):
                rest = F.zip_with(state["left"], taken, lambda a, b: a - b)
                return F.struct(rest.alias("left"), F.concat(state["out"], F.array(F.struct(child["child"].alias("node"), taken.alias("counts")))).alias("out"))

            return _let(_take(state["left"], child["n"], seed, child["child"], F.lit(level)), put)

        empty = F.array().cast("array<struct<node:bigint,counts:array<bigint>>>")
        drawn = F.aggregate("children", F.struct(F.col("counts").alias("left"), empty.alias("out")), split, lambda s: s["out"])
        nodes = nodes.join(children, "node").select(F.inline(drawn))
        if level:
            nodes = materialize(nodes, "nodes")
    return nodes.select(F.col("node").alias("block"), "counts")


def shuffle_into_shards(df, shards, seed=0):
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... in each shard), a uniform shuffle.

    The rows are written once, with their block; pass the columns that are needed.
    """
    names = ["_row", "_block", "_n", "_rank", "_counts", "_ends", "_key", "_bucket", "_first", "_in_bucket"]
    if clash := [c for c in df.columns if c in names]:
        raise ValueError(f"columns {clash} are used by the shuffle itself")
    df = df.drop("shard", "slot")
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    rows = rows.withColumn("_block", F.shiftright("_row", _ROW_BITS))
    sizes = materialize(rows.groupBy(F.col("_block").alias("block")).agg(F.count("*").alias("n")), "blocks")
    told = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("block"), F.lit(0)).alias("last")).first()
    share, more = divmod(told["n"], shards)
    matrix = communication_matrix(sizes, [share + (s < more) for s in range(shards)], told["last"] + 1, seed)
    ends = F.transform("counts", lambda c, i: F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    matrix = materialize(matrix.select(F.col("block").alias("_block"), ends.alias("_ends")), "matrix")
    # The first permutation: rows of a block in the order of a hash of their place.
    order = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed), F.lit("deal"), "_row"), "_row")
    dealt = rows.withColumn("_rank", F.row_number().over(order)).join(matrix, "_block")
    dealt = dealt.withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
    # The second: a shard's rows in the order of another hash, its top bits a bucket of bounded size.
    buckets = max(1, -(-share // BUCKET_ROWS))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("slot"), "_row"), 1)
    dealt = dealt.withColumn("_key", key).withColumn("_bucket", F.floor(F.col("_key") / F.lit(float(1 << 63)) * buckets))
    dealt = materialize(dealt.drop("_rank", "_ends", "_block"), "dealt")
    counts = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_key", "_row"))
    placed = dealt.withColumn("_in_bucket", place).join(materialize(first, "first"), ["shard", "_bucket"])
    return placed.select(*df.columns, "shard", (F.col("_first") + F.col("_in_bucket") - 1).cast("bigint").alias("slot"))
