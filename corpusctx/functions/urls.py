"""Source URLs: base, branch, lookup key, short name."""

from pyspark.sql import Column, functions as F

from corpusctx.functions.text import slugify

# What marks an include as remote, and the branch part of keys without one.
REMOTE_PREFIXES = ("http://", "https://", "git@")
DEFAULT_BRANCH = "DEFAULT"

_IN_PATH = r"(?s)\A(.*?)/(?:tree|commits)/([^/]+)(.*)\z"


def is_remote(include) -> Column:
    hits = [F.startswith(include, F.lit(p)) for p in REMOTE_PREFIXES]
    return hits[0] | hits[1] | hits[2]


def base_url(url) -> Column:
    before = F.substring_index(url, "#", 1)
    cleaned = F.regexp_replace(before, "/tree/[^/]+/?", "/")
    cleaned = F.regexp_replace(cleaned, "/commits/[^/]+/?", "/")
    cut = F.concat(F.regexp_extract(url, _IN_PATH, 1), F.regexp_extract(url, _IN_PATH, 3))
    return (
        F.when(F.contains(url, F.lit("#")), cleaned)
        .when(url.rlike(_IN_PATH), F.rtrim(cut, F.lit("/")))
        .otherwise(url)
    )


def branch(url) -> Column:
    """Branch named by ``#branch``, else by the URL path; null when there is none."""
    after = F.substring(url, F.locate("#", url) + F.lit(1), F.length(url))
    named = F.when(F.contains(url, F.lit("#")), after).otherwise(F.regexp_extract(url, _IN_PATH, 2))
    return F.when(named != "", named)


def repo_key(base, branch_col) -> Column:
    return F.concat(base, F.lit("#"), F.coalesce(branch_col, F.lit(DEFAULT_BRANCH)))


def repo_name(base) -> Column:
    return slugify(F.replace(F.substring_index(base, "/", -1), F.lit(".git"), F.lit("")))
