"""Numbers, names and registries."""

from pyspark.sql import functions as F

from corpusctx.functions import urls
from corpusctx.functions.text import slugify
from corpusctx.operators.joins import join_on
from corpusctx.operators.ordering import number_rows

# Fixed values of folder names: ``NNN-name``; two digits until number 99 exists, then three.
# Prefixes beyond 18 digits do not fit a BIGINT and count as plain names.
NUMBERED = "^([0-9]{1,18})-(.+)$"
NARROW, WIDE, WIDE_FROM = 2, 3, 99
RESULT_SUFFIX = ".md"


def folder_number(name):
    """Numeric prefix of a folder name, null when it has none."""
    return F.nullif(F.regexp_extract(name, NUMBERED, 1), F.lit("")).cast("bigint")


def pad_number(number, width):
    digits = number.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(digits), F.lit(0))), digits)


def number_width(largest):
    return F.when(largest >= WIDE_FROM, WIDE).otherwise(NARROW)


def folder_mapping(folders):
    """New name and number of every folder of every project (project, name, mtime).

    Unnumbered folders continue after the largest number, oldest first, keeping their
    name; then all prefixes get the width the largest number asks for. All folders are placed
    once, numbered ones first; the largest number and the counts of a project ride on the
    sums that number its rows, so no project, whatever its share, meets in one join task.
    A null project is a group like any other.
    """
    named = folders.select("project", "name", "mtime").withColumn("number", folder_number(F.col("name")))
    loose = F.col("number").isNull()
    totals = {
        "_max": (F.max("number"), F.max),
        "_numbered": (F.count("number"), F.sum),
        "_loose": (F.count_if(loose), F.sum),
    }
    placed = number_rows(named, ["project"], [loose, F.when(loose, F.col("mtime")), "name"], totals=totals)
    largest = F.coalesce("_max", F.lit(0))
    number = F.coalesce("number", largest + F.col("seq") - F.col("_numbered"))
    base = F.when(loose, F.col("name")).otherwise(F.regexp_extract("name", NUMBERED, 2))
    width = number_width(largest + F.col("_loose"))
    return placed.select(
        "project", F.col("name").alias("old_name"), number.alias("number"), F.concat(pad_number(number, width), F.lit("-"), base).alias("new_name")
    )


def next_numbers(folders):
    """Next free number of each project and its padded form."""
    mapped = folder_mapping(folders).groupBy("project").agg(F.max("number").alias("_max"))
    following = F.col("_max") + 1
    return mapped.select("project", following.alias("number"), pad_number(following, number_width(F.col("_max"))).alias("label"))


def allocate_numbers(existing, new, order, group="project"):
    """Number new rows of each group after the largest prefix among existing folder names, in ``order``.

    The largest prefix of a group is one more row of it, placed in front of the new ones, so it
    reaches them with the sums that number them and not by a join on the group.
    """
    taken = existing.groupBy(group).agg(F.max(folder_number(F.col("folder"))).alias("_taken"))
    taken = taken.select(F.col(group).cast(new.schema[group].dataType).alias(group), "_taken", F.lit(False).alias("_new"))
    both = new.withColumn("_new", F.lit(True)).unionByName(taken, allowMissingColumns=True)
    totals = {"_max": (F.max("_taken"), F.max), "_ahead": (F.count_if(~F.col("_new")), F.sum)}
    numbered = number_rows(both, [group], ["_new", *order], totals=totals).where("_new")
    number = F.coalesce("_max", F.lit(0)) + F.col("seq") - F.col("_ahead")
    return numbered.select(*new.columns, number.alias("number"), pad_number(number, number_width(number - 1)).alias("label"))


def normalize_sources(sources):
    """Add base_url, branch, repo_key and repo_name to rows with a ``url``."""
    return (
        sources.withColumn("base_url", urls.base_url(F.col("url")))
        .withColumn("branch", urls.branch(F.col("url")))
        .withColumn("repo_key", urls.repo_key(F.col("base_url"), F.col("branch")))
        .withColumn("repo_name", urls.repo_name(F.col("base_url")))
    )


def latest_wins(entries, keys, order, value, prior=None):
    """Last value of each key; with ``prior`` (keys, value) also whether it changed."""
    latest = entries.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))
    if prior is None:
        return latest
    before = prior.select(*keys, F.col(value).alias("_before"))
    return join_on(latest, before, keys, "left").select(
        *keys, value, (~F.col(value).eqNullSafe(F.col("_before"))).alias("changed")
    )


def resolve_sources(sources, registry, order):
    """Folder of each distinct source key of each project: the registered one, else a new numbered one.

    ``sources`` are normalized rows with a project; ``registry`` has project, repo_key, folder
    with one row per key. New keys are numbered in the order they are first met.
    """
    keys = sources.groupBy("project", "repo_key").agg(
        F.min(order).alias("_first"), F.min_by("repo_name", order).alias("repo_name")
    )
    looked_up = keys.join(registry.select("project", "repo_key", "folder"), ["project", "repo_key"], "left")
    known = looked_up.filter(F.col("folder").isNotNull()).select("project", "repo_key", "folder", F.lit(False).alias("is_new"))
    fresh = looked_up.filter(F.col("folder").isNull()).drop("folder")
    fresh = allocate_numbers(registry, fresh, ["_first", "repo_key"]).select(
        "project", "repo_key", F.concat("label", F.lit("-"), "repo_name").alias("folder"), F.lit(True).alias("is_new")
    )
    return known.unionByName(fresh)


def _distinct_names(slugs):
    """Give each slug of a list the first free of slug, slug-1, slug-2, … in list order."""

    def free(taken, slug):
        tries = F.transform(F.sequence(F.lit(1), F.size(taken)), lambda i: F.concat(slug, F.lit("-"), i.cast("string")))
        return F.get(F.filter(tries, lambda t: ~F.array_contains(taken, t)), F.lit(0))

    return F.aggregate(
        slugs,
        F.array().cast("array<string>"),
        lambda taken, slug: F.array_append(
            taken, F.when(F.array_contains(taken, slug), free(taken, slug)).otherwise(slug)
        ),
    )


def result_names(tasks):
    """File name per task and model; equal slugs within a task's list get suffixes.

    A task's model list is one array cell, so names are settled inside the row.
    """
    names = _distinct_names(F.transform("models", lambda m: slugify(m)))
    pairs = F.arrays_zip(F.col("models").alias("model"), names.alias("name"))
    return tasks.select("task_id", F.posexplode(pairs).alias("_pos", "p")).select(
        "task_id",
        (F.col("_pos") + 1).cast("bigint").alias("ordinal"),
        F.col("p.model").alias("model"),
        F.concat("p.name", F.lit(RESULT_SUFFIX)).alias("file_name"),
    )
