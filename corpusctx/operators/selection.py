"""Rule-driven file selection with an audit of the deciding rule."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from corpusctx.functions import paths
from corpusctx.functions.globs import compile_glob, glob_test
from corpusctx.operators.matching import RuleList, match_by_table, match_list, needs_name

# Patterns excluded unless told otherwise.
DEFAULT_EXCLUDES = [
    ".git/",
    "__pycache__/",
    "node_modules/",
    ".vscode/",
    "*.log",
    "*.png",
    "*.jpg",
    "*.jpeg",
    "*.gif",
    "*.svg",
    "*.webp",
    "*.ico",
    "*.bmp",
    ".DS_Store",
    "*.pyc",
    "*.pyo",
    "*~$*",
    ".env",
    "venv/",
    ".venv/",
    "dist/",
    "build/",
    "*.egg-info/",
]

IGNORED, EXCLUDED, INCLUDED = "ignored", "excluded", "included"

# Fixed value: the one folder pattern that matches at any depth by itself.
ANY_LEVEL = ".git/"

# Above this many rules the per-rule branches no longer fit compiled code; the rules become lookups.
INLINE_RULES = 200


@dataclass(frozen=True)
class Rule:
    pattern: str
    any_level: bool = False


def as_rules(patterns):
    return [p if isinstance(p, Rule) else Rule(p) for p in patterns]


def pattern_table(spark, patterns, rule_set):
    """A rule list as a one-task table: rule_set, ordinal, pattern, any_level."""
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(r.pattern).alias("pattern"), F.lit(r.any_level).alias("any_level"))
            for i, r in enumerate(as_rules(patterns))
        ]
    ).cast("array<struct<ordinal:int,pattern:string,any_level:boolean>>")
    return spark.range(0, 1, 1, 1).select(F.lit(rule_set).alias("rule_set"), F.inline(entries))


def ignore_match(path, name, pattern):
    """Ignore-file rule: plain glob on path or name."""
    glob = compile_glob(pattern)
    hit = glob_test(path, glob)
    return hit | glob_test(name, glob) if needs_name(pattern, glob) else hit


def exclude_match(path, name, rule):
    """Exclude rule: a folder when it ends in ``/``, else a glob on path or name."""
    if not rule.pattern.endswith("/"):
        return ignore_match(path, name, rule.pattern)
    top = F.startswith(path, F.lit(rule.pattern)) | (path == rule.pattern[:-1])
    if rule.any_level or rule.pattern == ANY_LEVEL:
        return top | F.contains(path, F.lit("/" + rule.pattern))
    return top


def _slashes(path):
    return F.translate(path, "\\", "/")


def _first(tests):
    tests = list(tests)
    if not tests:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(hit, F.lit(pattern)) for pattern, hit in tests])


def _verdict(df):
    verdict = F.when(F.col("_ignored").isNotNull(), IGNORED).when(F.col("_excluded").isNotNull(), EXCLUDED)
    return (
        df.withColumn("verdict", verdict.otherwise(INCLUDED))
        .withColumn("first_rule", F.coalesce("_ignored", "_excluded"))
        .drop("_ignored", "_excluded")
    )


def classify_files(files, ignore=(), excludes=()):
    """Add ``verdict`` and ``first_rule`` to files; rule lists apply to every file, in list order.

    The rules are compiled into the projection, or above ``INLINE_RULES`` into lookups in the
    tasks: no join, no shuffle, no content read either way, and the same result.
    """
    ignore, excludes = list(ignore), as_rules(excludes)
    path, name = _slashes(F.col("path")), paths.name(F.col("path"))
    if len(ignore) + len(excludes) > INLINE_RULES:
        rules = [("ignore", i, p, False) for i, p in enumerate(ignore)]
        rules += [("exclude", i, r.pattern, r.any_level) for i, r in enumerate(excludes)]
        found = files.withColumn("_found", match_list([path, name], _book_of("rule_set", "ordinal", "pattern", "any_level"), rules, _RULES))
        return _verdict(found.withColumns({c: F.col(f"_found.{c}") for c in _RULES}).drop("_found"))
    marked = files.withColumn("_ignored", _first((p, ignore_match(path, name, p)) for p in ignore)).withColumn(
        "_excluded", _first((r.pattern, exclude_match(path, name, r)) for r in excludes)
    )
    return _verdict(marked)


_RULES = ["_ignored", "_excluded"]


def _book_of(*columns):
    """Function from the rules of a book, with these columns, to what it says of a path and a name."""
    at = {c: i for i, c in enumerate(columns)}

    def compile_book(rules):
        lists = []
        for rule_set in ("ignore", "exclude"):
            own = []
            for rule in rules:
                if rule[at["rule_set"]] == rule_set:
                    pattern = rule[at["pattern"]]
                    any_level = bool(rule[at["any_level"]]) or pattern == ANY_LEVEL
                    own.append((pattern, rule_set == "exclude" and pattern.endswith("/"), any_level))
            lists.append(RuleList(own))
        ignore, exclude = lists
        return lambda path, name: (ignore.first(path, name), exclude.first(path, name))

    return compile_book


def classify_by_table(files, rules, by=("project",)):
    """``classify_files`` with rules from a table, matched to files on the ``by`` columns.

    Rules: ``by``, rule_set (``ignore``/``exclude``), ordinal, pattern and optionally
    any_level; rules without a pattern match nothing. A table of a counted, bounded size goes to every task; a larger one meets
    the files by key, dealt into parts, so no key's files are one task and no book is one cell.
    """
    if "any_level" not in rules.columns:
        rules = rules.withColumn("any_level", F.lit(False))
    columns = ["ordinal", "pattern", "rule_set", "any_level"]
    rules = rules.where("pattern IS NOT NULL AND ordinal IS NOT NULL").select(*by, *columns)
    path, name = _slashes(F.col("path")), paths.name(F.col("path"))
    return _verdict(match_by_table(files, rules, by, [path, name], _book_of(*columns), _RULES))


def included(classified):
    return classified.filter(F.col("verdict") == INCLUDED).drop("verdict", "first_rule")


def selection_counts(classified, by=("project",)):
    """Scanned, ignored, excluded and included files per group, in one pass."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in (IGNORED, EXCLUDED, INCLUDED)]
    return classified.groupBy(*by).agg(F.count("*").alias("scanned"), *counts)


def effective_excludes(layers, by=()):
    """Distinct patterns of ``{layer name: DataFrame(by, pattern)}`` with the first layer that has each."""
    ranked = [
        df.select(*by, "pattern", F.struct(F.lit(i).alias("rank"), F.lit(layer).alias("name")).alias("layer"))
        for i, (layer, df) in enumerate(layers.items())
    ]
    every = ranked[0]
    for more in ranked[1:]:
        every = every.unionByName(more)
    return every.groupBy(*by, "pattern").agg(F.min("layer")["name"].alias("from_layer"))
