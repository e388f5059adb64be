"""Bounded choices from tables of any size, made without sending every partition's best to the driver."""

from pyspark.sql import functions as F

_BINS = 16  # per doubling of the count


def most_frequent(counts, limit, n_col="n"):
    """Rows with the largest counts, at most ``limit``: all rows of the highest count bins that fit whole.

    ``counts`` is read twice: pass a written table. The driver sees one row per bin.
    """
    height = F.floor(F.log2(F.col(n_col)) * _BINS)
    bins = counts.where(F.col(n_col) > 0).groupBy(height.alias("bin")).agg(F.count("*").alias("rows")).collect()
    least, total = None, 0
    for row in sorted(bins, key=lambda r: -r["bin"]):
        total += row["rows"]
        if total > limit:
            break
        least = row["bin"]
    return counts.where(F.lit(False) if least is None else (F.col(n_col) > 0) & (height >= least))


def hashed_sample(ids, limit, id_col="doc_id"):
    """About ``limit`` rows at most, chosen by a hash of the id, the same ones whatever the partitions."""
    n = ids.count()
    if n <= limit:
        return ids
    share = int((1 << 30) * (limit * 0.95 / n))
    return ids.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share).limit(limit)
