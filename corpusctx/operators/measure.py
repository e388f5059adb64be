"""Token and character accounting."""

from pyspark.sql import Window, functions as F

from corpusctx.functions import paths, text


def doc_tokens(files, ratio=text.DEFAULT_RATIO):
    """Folder, name, characters and token estimate of each file; unreadable content counts nothing."""
    path = F.col("path")
    chars = F.coalesce(F.length("content"), F.lit(0)).cast("bigint")
    return files.select(
        *[c for c in files.columns if c not in ("content", "read_error")],
        paths.folder(path).alias("folder"),
        paths.name(path).alias("name"),
        chars.alias("n_chars"),
        text.estimate_tokens(chars, ratio).alias("est_tokens"),
    )


def folder_tokens(files, by=("project",), ratio=text.DEFAULT_RATIO):
    """Sum of file estimates per direct parent folder, and the first path in it."""
    if "read_error" in files.columns:
        files = files.filter(F.col("read_error").isNull())
    return (
        doc_tokens(files, ratio)
        .groupBy(*by, "folder")
        .agg(F.sum("est_tokens").cast("bigint").alias("tokens"), F.min(paths.order_key(F.col("path"))).alias("first_path"))
    )


def top_folders(folders, by=("project",), k=5):
    """The k largest folders of each group; ties go to the folder met first in path order."""
    largest = Window.partitionBy(*by).orderBy(F.col("tokens").desc(), F.col("first_path"))
    return folders.withColumn("rank", F.row_number().over(largest)).filter(F.col("rank") <= k)
