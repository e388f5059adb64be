"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Vectors are lengthened so that the largest inner product becomes the smallest distance. Every
block of rows keeps, for each of a few random projections, its rows sorted by their projection.
A query opens a window around its own projection in every array and widens all windows step by
step (virtual rehashing: the same arrays serve every radius). A row collides once per window it
lies in; rows that collide more often than the threshold are candidates. Widening stops when a
block has enough of them, and their exact inner products decide.

The work is dealt as pairs of a block of rows and a block of queries, so it spreads over as many
tasks as there are pairs and no task holds more than two blocks. Vectors that are null, zero, of
another length than most, or hold null or non-finite numbers take no part. Repeated ids are
separate rows; a query's own id is never its neighbour. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from corpusctx.sources.scratch import materialize

NEIGHBOURS = 20
PROJECTIONS = 64
#: Places in a block's sorted arrays must fit 16 bits.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096
#: Half widths of the windows, in standard deviations of a projection.
WIDTHS = (1.0, 1.4, 1.7, 2.0, 2.3, 2.6, 3.0)
#: A candidate collides in at least this share of windows, once they are ``WIDTHS[i]`` wide.
COLLISIONS = 0.85
#: Windows widen until this share of a block's rows are candidates.
CANDIDATES = 0.2


def usable(df, vector_col, id_col):
    """(vec_id, vector) of the rows that can take part."""
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return df.select(F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL").where(sound)


def _vectors(column):
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def search_block(ids, vectors, query_ids, queries, neighbours, longest, seed):
    """(query, neighbour, score) of one block of rows for one block of queries."""
    rng = np.random.default_rng(seed)
    n, size = vectors.shape
    directions = rng.standard_normal((size + 1, PROJECTIONS))
    # All rows get the length of the longest vector; queries keep theirs and a last component of 0.
    lift = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    projected = vectors @ directions[:size] + lift[:, None] * directions[size]
    scale = longest / np.linalg.norm(queries, axis=1)
    centres = (queries * scale[:, None]) @ directions[:size]
    order = np.argsort(projected, axis=0, kind="stable")
    # Place of every row in every sorted array: a row lies in a window when its place does.
    place = np.empty((PROJECTIONS, n), np.uint16)
    wanted = min(n, max(neighbours + 1, int(CANDIDATES * n)))
    widths = np.array(WIDTHS) * longest
    low = np.empty((len(widths), PROJECTIONS, len(queries)), np.uint16)
    reach = np.empty_like(low)
    for p in range(PROJECTIONS):
        place[p, order[:, p]] = np.arange(n)
        values = projected[order[:, p], p]
        for w, width in enumerate(widths):
            low[w, p] = np.searchsorted(values, centres[:, p] - width, "left")
            reach[w, p] = np.searchsorted(values, centres[:, p] + width, "right") - low[w, p]
    shifted, inside, out = np.empty_like(place), np.empty(place.shape, bool), []
    for q in range(len(queries)):
        for w in range(len(widths)):
            np.subtract(place, low[w, :, q, None], out=shifted)
            np.less(shifted, reach[w, :, q, None], out=inside)
            hits = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
            found = np.flatnonzero(hits >= COLLISIONS * PROJECTIONS)
            if len(found) >= wanted:
                break
        else:
            found = np.arange(n)
        found = found[ids[found] != query_ids[q]]
        scores = (vectors[found] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[found], -scores))[:neighbours]
        out.append((np.full(len(best), query_ids[q]), ids[found[best]], scores[best]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest(vectors, queries, neighbours=NEIGHBOURS, vector_col="embedding", id_col="vec_id", seed=11):
    """(query_id, rank, vec_id, score): each query's nearest rows by largest inner product, ties to smaller ids."""
    rows = materialize(usable(vectors, vector_col, id_col), "vectors")
    # A repeated query is asked once, else its finds would take several ranks each.
    asked = materialize(usable(queries, vector_col, id_col).dropDuplicates(["vec_id", "vector"]), "queries")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    told = rows.agg(F.count("*").alias("n"), F.max(norm).alias("longest"), F.mode(F.size("vector"), deterministic=True).alias("size")).first()
    n_queries = asked.count()
    if not told["n"] or not n_queries:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, longest = told["size"], told["longest"]
    parts = [-(-told["n"] // BLOCK_ROWS), -(-n_queries // BLOCK_QUERIES)]
    # Blocks by a hash of the whole row, so that repeated ids spread as well.
    own = [F.pmod(F.xxhash64("vec_id", "vector"), F.lit(k)).cast("int") for k in parts]
    every = [F.explode(F.sequence(F.lit(0), F.lit(k - 1))) for k in parts]
    sides = [
        rows.select(own[0].alias("block"), every[1].alias("asked"), F.lit(False).alias("is_query"), "vec_id", "vector"),
        asked.select(every[0].alias("block"), own[1].alias("asked"), F.lit(True).alias("is_query"), "vec_id", "vector"),
    ]

    def run(table):
        query = table["is_query"].to_numpy()
        ids, all_vectors = table["vec_id"].to_numpy(), _vectors(table["vector"])
        found = search_block(ids[~query], all_vectors[~query], ids[query], all_vectors[query], neighbours, longest, seed)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    both = sides[0].union(sides[1]).where(F.size("vector") == size)
    near = both.groupBy("block", "asked").applyInArrow(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
