"""Tasks that select alike: what they select is found, and their context built, once for all of them."""

from pyspark.sql import functions as F

from corpusctx.functions.urls import is_remote
from corpusctx.operators import assemble, naming, roots, selection
from corpusctx.operators.joins import join_on
from corpusctx.operators.ordering import number_rows
from corpusctx.sources.scratch import materialize

# Sums of so many independent 64-bit hashes tell lists apart: rows are added up, never gathered.
HASHES = 2
NO_COMMIT = "not landed"


def select_profiles(tasks, includes, rules):
    """``tasks`` with ``profile``: the least task_id of the same project with the same includes and rules.

    ``includes``: task_id, ordinal, pattern; ``rules``: task_id, rule_set, ordinal, pattern (and any_level).
    A task without rows has empty lists. Lists are compared by count and ``HASHES`` sums of hashes.
    """
    any_level = F.col("any_level") if "any_level" in rules.columns else F.lit(False)
    rows = includes.select("task_id", F.lit("include").alias("list"), "ordinal", "pattern", F.lit(False).alias("any_level"))
    rows = rows.unionByName(rules.select("task_id", F.col("rule_set").alias("list"), "ordinal", "pattern", any_level.alias("any_level")))
    sums = [F.sum(F.xxhash64(F.lit(i), "list", "ordinal", "pattern", "any_level").cast("decimal(20,0)")).alias(f"_s{i}") for i in range(HASHES)]
    lists = rows.groupBy("task_id").agg(F.count("*").alias("_rows"), *sums)
    marked = materialize(tasks.join(lists, "task_id", "left"), "marked")
    alike = ["project", "_rows", *[f"_s{i}" for i in range(HASHES)]]
    profiles = materialize(marked.groupBy(*alike).agg(F.min("task_id").alias("profile")), "profiles")
    return materialize(join_on(marked, profiles, alike).drop(*alike[1:]), "profiled")


def of_profiles(rows, profiled):
    """The rows (task_id, ..) of each profile's own task, keyed by ``profile``."""
    own = profiled.where(F.col("task_id") == F.col("profile")).select("task_id")
    return rows.join(own, "task_id", "left_semi").withColumnRenamed("task_id", "profile")


def remote_folders(tasks, includes, registry, checkout="checkouts"):
    """Folder, below ``checkout``, of each remote include of each task: known ones from the registry, others numbered after them.

    ``registry``: project, repo_key, folder and optionally commit, one row per key. Returns
    ``task_id, project, base_url, branch, commit, folder, is_new``, one row per task and source.
    """
    asked = includes.where(is_remote(F.col("pattern"))).withColumnRenamed("pattern", "url")
    sources = materialize(naming.normalize_sources(asked.join(tasks.select("task_id", "project"), "task_id")), "remotes")
    known = registry if "commit" in registry.columns else registry.withColumn("commit", F.lit(None).cast("string"))
    folders = naming.resolve_sources(sources, known, F.struct("task_id", "ordinal"))
    folders = folders.join(known.select("project", "repo_key", "commit"), ["project", "repo_key"], "left")
    once = sources.groupBy("task_id", "project", "repo_key").agg(F.min("base_url").alias("base_url"), F.min("branch").alias("branch"))
    placed = once.join(materialize(folders, "folders"), ["project", "repo_key"])
    commit = F.coalesce("commit", F.lit(NO_COMMIT))
    return placed.select("task_id", "project", "base_url", "branch", commit.alias("commit"), F.concat(F.lit(checkout + "/"), "folder").alias("folder"), "is_new")


def chosen_files(files, profiled, includes, remotes):
    """``profile, project, path`` of every file a profile looks at: by its own includes, or landed below one of its remotes.

    Only paths move. A file that both lead to counts once.
    """
    profiles = profiled.where(F.col("task_id") == F.col("profile")).select("task_id", "project")
    paths = files.select("project", "path")
    seen = assemble.task_files(profiles, paths).withColumnRenamed("task_id", "profile").drop("seq")
    local = roots.expand_by_table(seen, of_profiles(includes, profiled), ["profile"]).select("profile", "project", "path")
    # Folders of one name lie in many projects, so a root begins with its project.
    whole = lambda below: F.concat_ws("/", F.coalesce("project", F.lit("")), below)
    wanted = of_profiles(remotes, profiled).select("profile", "project", whole(F.col("folder")).alias("root")).distinct()
    wanted = materialize(wanted, "remote_roots")
    below = paths.select("project", F.col("path").alias("_path"), whole(F.col("path")).alias("path"))
    landed = roots.files_under_roots(below, roots.drop_covered_roots(wanted))
    far = landed.select("root", F.col("_path").alias("path")).join(wanted, "root").select("profile", "project", "path")
    return local.unionByName(far).distinct()


def profile_rules(rules, profiled, builtin=selection.DEFAULT_EXCLUDES):
    """Rules of each profile: its ignore list, and the built-in excludes together with its own, in order of the pattern."""
    own = of_profiles(rules, profiled)
    if "any_level" not in own.columns:
        own = own.withColumn("any_level", F.lit(False))
    profiles = profiled.select("profile").distinct()
    common = [F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.any_level).alias("any_level")) for r in selection.as_rules(builtin)]
    given = own.where("rule_set = 'exclude'").select("profile", "pattern", "any_level")
    if common:
        given = given.unionByName(profiles.select("profile", F.inline(F.array(*common))))
    # Excludes have no order of their own: the first one is the least, so the pattern stands in for a number.
    excludes = given.groupBy("profile", "pattern").agg(F.max("any_level").alias("any_level"))
    excludes = number_rows(excludes, ["profile"], ["pattern"]).select("profile", F.lit("exclude").alias("rule_set"), F.col("seq").cast("bigint").alias("ordinal"), "pattern", "any_level")
    ignore = own.where("rule_set = 'ignore'").select("profile", "rule_set", F.col("ordinal").cast("bigint").alias("ordinal"), "pattern", "any_level")
    return materialize(ignore.unionByName(excludes), "rules")
