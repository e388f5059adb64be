"""Rule books of any length against one rule at a time, in all the ways they meet files."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusctx.functions.globs import compile_glob, compile_segments, literal_ends, segment_head
from corpusctx.operators import matching, roots, selection

PIECES = st.lists(st.sampled_from(["a", "b", "/", ".", "*", "**", "?", "[ab]", "[!a]", "[", "\\", "é", "\n"]), max_size=6).map("".join)
VALUES = st.lists(st.sampled_from(["a", "b", "/", ".", "[", "é", "\n", "z"]), max_size=7).map("".join)


def one_by_one(pattern, value):
    glob = compile_glob(pattern)
    tests = {
        "literal": lambda: value == glob.text,
        "prefix": lambda: value.startswith(glob.text),
        "suffix": lambda: value.endswith(glob.text),
        "contains": lambda: glob.text in value,
        "regex": lambda: re.match(glob.text[: -len(r"\z")] + r"\Z", value) is not None,
    }
    return tests[glob.kind]()


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=8), st.lists(VALUES, max_size=5))
def test_first_match_is_the_first_that_matches(patterns, values):
    rules = matching.RuleList([(p, False, False) for p in patterns])
    for value in values:
        name = value.rsplit("/", 1)[-1]

        def hits(p, value=value, name=name):
            return one_by_one(p, value) or matching.needs_name(p, compile_glob(p)) and one_by_one(p, name)

        assert rules.first(value, name) == next((p for p in patterns if hits(p)), None)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES.map(lambda p: p.replace("\n", "c")), max_size=6), st.lists(VALUES, max_size=5))
def test_first_include_is_the_first_that_matches(patterns, values):
    rules = matching.IncludeList(patterns)
    for value in values:
        members = [(p, compile_segments(p).members) for p in patterns]
        hits = [p for p, m in members if m is not None and re.match(m.removesuffix(r"\z") + r"\Z", value)]
        assert rules.first(value) == (hits[0] if hits else None)


def test_literal_ends():
    assert literal_ends("a*b?c.py") == ("a", "c.py") and literal_ends("[x") == ("[x", "[x") and literal_ends("*") == ("", "")
    assert segment_head("./src//a*/b") == "src/a" and segment_head("docs/") == "docs" and segment_head("**/x") == ""


def book(n, seed=3):
    """As many rules of all kinds, folders and levels among them."""
    rng = random.Random(seed)
    shapes = ["*.x{}", "lib{}/", "a{}*", "*mid{}*", "d{}/f.txt", "p{}?q*.[ch]", "n{}[!0-9].md", "vendor{}/"]
    rules = [selection.Rule(rng.choice(shapes).format(rng.randrange(4 * n)), rng.random() < 0.3) for _ in range(n)]
    return rules


def paths_for(rules, seed=5):
    rng, out = random.Random(seed), ["plain.txt", "a/b/c", "", "é.md"]
    for r in rules[:: max(len(rules) // 80, 1)]:
        text = r.pattern.replace("*", "zz").replace("?", "y").replace("[ch]", "c").replace("[!0-9]", "k")
        out += [text, "sub/" + text, text + "/deep", text.upper(), rng.choice("ab") + text]
    return sorted(set(out))


def told(df, *keys):
    return sorted((*[r[k] for k in keys], r.path, r.verdict, r.first_rule) for r in df.collect())


@pytest.mark.parametrize("n", [199, 200, 201, 2000])
def test_all_forms_agree_at_any_number_of_rules(spark, monkeypatch, n):
    excludes = book(n - 20)
    ignore = [r.pattern for r in book(20, seed=9)]
    files = spark.createDataFrame([(p,) for p in paths_for(excludes)], "path string").repartition(3)
    if n > 1000:
        expected = told(selection.classify_files(files, ignore, excludes))
        lists = [[(p, False, False) for p in ignore], [(r.pattern, r.pattern.endswith("/"), r.any_level) for r in excludes]]
        first, second = (matching.RuleList(x) for x in lists)
        for path, verdict, rule in expected:
            name = path.rsplit("/", 1)[-1]
            found = first.first(path, name), second.first(path, name)
            assert (verdict, rule) == (("ignored", found[0]) if found[0] else ("excluded", found[1]) if found[1] else ("included", None))
    else:
        monkeypatch.setattr(selection, "INLINE_RULES", n)
        expected = told(selection.classify_files(files, ignore, excludes))
        assert {v for _, v, _ in expected} == {"ignored", "excluded", "included"}
        monkeypatch.setattr(selection, "INLINE_RULES", n - 1)
        looked_up = selection.classify_files(files, ignore, excludes)
        assert "Exchange" not in looked_up.select("path", "verdict")._jdf.queryExecution().executedPlan().toString().replace("REPARTITION", "").split("ArrowEvalPython")[0]
        assert told(looked_up) == expected
    rules = [("p", "ignore", i, p, False) for i, p in enumerate(ignore)] + [("p", "exclude", i, r.pattern, r.any_level) for i, r in enumerate(excludes)]
    rules += [("q", "exclude", 0, "*", None), (None, "exclude", 0, "*", False), ("r", "exclude", None, "*", False), ("r", "exclude", 0, None, False)]
    table = spark.createDataFrame(rules, "project string, rule_set string, ordinal int, pattern string, any_level boolean")
    keyed = files.crossJoin(spark.createDataFrame([("p", 1), ("q", 2), ("r", 3), (None, 4)], "project string, more int"))
    wanted = sorted([("p", *r) for r in expected] + [("q", r[0], "excluded", "*") for r in expected] + [(k, r[0], "included", None) for k in ("r", "") for r in expected])
    for limit in (matching.BOOK_BYTES, -1):
        monkeypatch.setattr(matching, "BOOK_BYTES", limit)
        got = selection.classify_by_table(keyed, table)
        assert got.columns == ["path", "project", "more", "verdict", "first_rule"]
        assert told(got.withColumn("project", F.coalesce("project", F.lit(""))), "project") == wanted


def test_equal_ordinals_and_repeated_files(spark, monkeypatch):
    table = spark.createDataFrame([("p", "exclude", 1, "*.b"), ("p", "exclude", 1, "*.a"), ("p", "exclude", 0, "zzz")], "project string, rule_set string, ordinal int, pattern string")
    files = spark.createDataFrame([("p", "x.a"), ("p", "x.b"), ("p", "x.a"), ("p", None)], "project string, path string")
    for limit in (matching.BOOK_BYTES, -1):
        monkeypatch.setattr(matching, "BOOK_BYTES", limit)
        got = sorted(((r.path, r.first_rule) for r in selection.classify_by_table(files, table).collect()), key=str)
        assert got == sorted([("x.a", "*.a"), ("x.b", "*.b"), ("x.a", "*.a"), (None, None)], key=str)
        assert selection.classify_by_table(files.limit(0), table).count() == 0
        assert {r.verdict for r in selection.classify_by_table(files, table.limit(0)).collect()} == {"included"}


def test_includes_meet_files_either_way(spark, monkeypatch):
    files = spark.createDataFrame([(t, f) for t in (1, 2, 3, 4) for f in ("a/x.py", "a/b/y.py", "top.md")], "task_id int, path string")
    includes = [(1, 0, "*.md"), (1, 1, "a/b"), (2, 0, "https://h/r"), (3, 0, "/bad"), (None, 0, "**")]
    table = spark.createDataFrame(includes, "task_id long, ordinal int, pattern string")
    found = []
    for limit in (matching.BOOK_BYTES, -1):
        monkeypatch.setattr(matching, "BOOK_BYTES", limit)
        found.append(sorted(tuple(r) for r in roots.expand_by_table(files, table).collect()))
    whole = [(t, f, "./") for t in (2, 4) for f in ("a/x.py", "a/b/y.py", "top.md")]
    assert found[0] == found[1] == sorted([(1, "top.md", "*.md"), (1, "a/b/y.py", "a/b"), *whole])
