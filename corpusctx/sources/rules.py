"""Ignore files: one pattern per line."""

from pyspark.sql import functions as F

from corpusctx.functions import paths
from corpusctx.functions.text import strip, unify_newlines
from corpusctx.sources.corpus import list_tree, read_listed


def parse_rules(texts, by=("project",), column="content"):
    """Patterns of each rule text in line order: trimmed, without blank and ``#`` lines."""
    lines = F.transform(F.split(unify_newlines(F.col(column)), "\n"), strip)
    kept = F.filter(lines, lambda line: (line != "") & ~F.startswith(line, F.lit("#")))
    return texts.select(*by, F.posexplode(kept).alias("_pos", "pattern")).select(
        *by, (F.col("_pos") + 1).cast("bigint").alias("ordinal"), "pattern"
    )


def read_rules(spark, root, file_name=".gitignore"):
    """Rules of every rule file below ``root``; the project is the file's folder, ``.`` at the top."""
    found = list_tree(spark, root).filter(paths.name(F.col("path")) == file_name)
    texts = read_listed(found, root).select(paths.folder(F.col("path")).alias("project"), "content")
    return parse_rules(texts)
