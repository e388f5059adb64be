"""Where to look: include patterns, search roots, files under roots."""

from functools import reduce

from pyspark.sql import functions as F

from corpusctx.functions import paths
from corpusctx.functions.globs import compile_segments
from corpusctx.functions.urls import REMOTE_PREFIXES, is_remote
from corpusctx.operators.matching import IncludeList, match_by_table

# Fixed value: the include that stands for the project root.
WHOLE_ROOT = "./"

# Join keys the top folder is split into.
TOP_KEYS = 256


def split_local_remote(includes_df, include="include"):
    """Add ``is_remote`` to a table of includes."""
    return includes_df.withColumn("is_remote", is_remote(F.col(include)))


def local_includes(includes):
    return [i for i in includes if not i.startswith(REMOTE_PREFIXES)]


def include_problems(includes):
    """Patterns that cannot be used, with the reason; the operators skip them."""
    compiled = [compile_segments(i) for i in local_includes(includes)]
    return {g.pattern: g.error for g in compiled if g.error}


def _globs(includes):
    compiled = [compile_segments(i) for i in local_includes(includes)]
    return [g for g in compiled if not g.error]


def expand_includes(files, includes):
    """Files matched by an include, or lying in a matched folder, with the first such include.

    A folder match is a match of a path prefix that ends at a slash, so one regex per
    pattern covers files and folders and no folder list is built.
    """
    hits = [F.when(F.col("path").rlike(g.members), F.lit(g.pattern)) for g in _globs(includes)]
    if not hits:
        return files.withColumn("first_pattern", F.lit(None).cast("string")).filter(F.lit(False))
    return files.withColumn("first_pattern", F.coalesce(*hits)).filter(F.col("first_pattern").isNotNull())


def expand_by_table(files, includes, by=("task_id",), root_when_no_local=True):
    """``expand_includes`` with patterns from a table (by, ordinal, pattern), matched on the ``by`` columns.

    A file keeps one row and its first pattern. Unusable patterns match nothing. A group without
    any local pattern takes every file. Rules meet files as in ``classify_by_table``.
    """
    by = list(by)
    local = includes.filter(~is_remote(F.col("pattern"))).where("ordinal IS NOT NULL").select(*by, "ordinal", "pattern")

    def compile_book(rules):
        book = IncludeList(pattern for _, pattern in rules)
        return lambda path: (book.first(path), "y")

    joined = match_by_table(files, local, by, [F.col("path")], compile_book, ["_first", "_has"])
    whole = F.when(F.col("_has").isNull() & F.lit(root_when_no_local), F.lit(WHOLE_ROOT))
    joined = joined.withColumn("first_pattern", F.coalesce(whole, "_first")).drop("_first", "_has")
    return joined.filter(F.col("first_pattern").isNotNull())


def search_paths(files, includes, remote_paths=None, root_when_no_local=True):
    """Distinct places to look: ``path, kind`` with kind root, glob or remote.

    ``files`` lists the paths that exist; folders are taken from the distinct parents.
    """
    local = local_includes(includes)
    whole = WHOLE_ROOT in local or (not local and root_when_no_local)
    found = files.sparkSession.range(0, int(whole), 1, 1).select(F.lit(paths.ROOT).alias("path"), F.lit("root").alias("kind"))
    globs = [g for g in _globs(includes) if g.pattern != WHOLE_ROOT]

    def matching(df, regexes):
        return df.filter(reduce(lambda a, b: a | b, [F.col("path").rlike(r) for r in regexes])).select(
            "path", F.lit("glob").alias("kind")
        )

    if globs:
        parents = files.select(paths.folder(F.col("path")).alias("path")).distinct()
        folders = parents.select(F.explode(paths.self_and_ancestors(F.col("path"))).alias("path"))
        found = found.unionByName(matching(folders, [g.folders for g in globs]))
        if any(g.files for g in globs):
            found = found.unionByName(matching(files.select("path"), [g.files for g in globs if g.files]))
    if remote_paths is not None:
        found = found.unionByName(remote_paths.select("path", F.lit("remote").alias("kind")))
    return found.distinct()


def _spread_top(folder, path):
    """Join key of a folder above ``path``; the top, above everything, is split over many keys."""
    slot = F.pmod(F.xxhash64(path), F.lit(TOP_KEYS)).cast("string")
    return F.when(folder == paths.ROOT, F.concat(F.lit(WHOLE_ROOT), slot)).otherwise(folder)


def _with_keys(roots):
    """Roots with the keys under which paths look for them."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(TOP_KEYS - 1)), lambda i: F.concat(F.lit(WHOLE_ROOT), i.cast("string")))
    return roots.select("root", F.explode(F.when(F.col("root") == paths.ROOT, slots).otherwise(F.array("root"))).alias("_key"))


def drop_covered_roots(roots):
    """Distinct roots that lie under no other root; an anti join on exploded ancestors."""
    roots = roots.select("root").distinct()
    keys = F.transform(paths.ancestors(F.col("root")), lambda a: _spread_top(a, F.col("root")))
    above = roots.select("root", F.explode(keys).alias("_key"))
    covered = above.join(_with_keys(roots).select("_key"), "_key", "left_semi").select("root")
    return roots.join(covered, "root", "left_anti")


def files_under_roots(files, roots):
    """Files at or below a root, with that root; roots must not cover one another.

    An equi join on each file's own path and ancestors: without a shuffle while the roots
    are small, else with Spark splitting the keys of crowded folders.
    """
    keys = F.transform(paths.self_and_ancestors(F.col("path")), lambda a: _spread_top(a, F.col("path")))
    places = files.withColumn("_key", F.explode(keys))
    return places.join(_with_keys(roots), "_key").select(*files.columns, "root")
