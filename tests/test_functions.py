import os
import posixpath
import random
import re
import unicodedata
from fnmatch import fnmatchcase

import pytest
from pyspark.sql import functions as F

from corpusctx.functions import params, paths, text, urls
from corpusctx.functions.globs import compile_glob, compile_segments, glob_test


def test_token_estimate(values):
    assert values(["", None, "a", "a" * 7, "a" * 8], lambda c: text.text_tokens(F.col(c))) == [0, 0, 1, 1, 2]
    assert values(["a" * 8], lambda c: text.text_tokens(F.col(c), 0)) == [2]
    assert values(["a" * 9], lambda c: text.text_tokens(F.col(c), 3.0)) == [3]
    assert values(["𐍈éß𐍈"], lambda c: text.text_tokens(F.col(c))) == [1]  # code points, not bytes


def expected_slug(name):
    name = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    if re.search(r"\A\W*\.txt\n?\Z", name):
        return "----------.txt"
    slug = re.sub(r"[^\w.\-]+", "-", re.sub(r"[\s/\\:]+", "-", name)).strip("-").lower()
    return slug[:100] or "unnamed"


def test_slug_examples(values):
    examples = {
        "test file.txt": "test-file.txt",
        "test/file:name?.txt": "test-file-name-.txt",
        "téśt.txt": "test.txt",
        '?*/\\:"<>|.txt': "----------.txt",
        "Straße ﬁn": "strae-fin",
        "??": "unnamed",
        "A--b": "a--b",
        "-x-": "x",
        "über uns": "uber-uns",
        "": "unnamed",
    }
    assert dict(zip(examples, values(list(examples), lambda c: text.slugify(F.col(c))))) == examples
    assert values(["a" * 200 + ".txt"], lambda c: text.slugify(F.col(c))) == ["a" * 100]


def test_slug_of_every_character(values):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    lines = ["x".join(chars[i : i + 40]) for i in range(0, len(chars), 40)]
    lines = [line for i, line in enumerate(lines) if i < 2000 or i % 16 == 0]
    assert values(lines, lambda c: text.slugify(F.col(c))) == [expected_slug(line) for line in lines]


def test_masks(values):
    key = "sk-or-masktest1234567890abcdefghijklmnopqrstuvwxyz"
    assert values([key, "a" * 12, "b" * 13], lambda c: text.mask_key(F.col(c))) == [
        "sk-or-ma...wxyz", "***", "bbbbbbbb...bbbb",
    ]
    hexa = "0123456789abcdef" * 2 + "01234567"
    said = [f"{hexa} and {key}", "nothing here", f"x{hexa}", hexa + "\n" + hexa, ""]
    assert values(said, lambda c: text.mask_keys(F.col(c))) == [
        "01234567...4567 and sk-or-ma...wxyz", "nothing here", "x01234567...4567", "01234567...4567\n01234567...4567", "",
    ]
    assert values(said, lambda c: F.size(text.find_keys(F.col(c)))) == [2, 0, 1, 2, 0]


def test_text_repair(values):
    raw = [b"\xe2\x82abc\xff", b"a\r\nb\rc\n", b"", "héllo".encode()]
    assert values([bytearray(r) for r in raw], lambda c: text.decode_text(F.col(c)), "binary") == [
        "�abc�", "a\nb\nc\n", "", "héllo",
    ]


def test_blank(values):
    data = ["", " \t\n", "　\xa0", "x", None]
    assert values(data, lambda c: text.is_blank(F.col(c))) == [True, True, True, False, True]


def test_path_pieces(values):
    data = ["README.md", "a/b/c.py", "."]
    assert values(data, lambda c: paths.folder(F.col(c))) == [".", "a/b", "."]
    assert values(data, lambda c: paths.name(F.col(c))) == ["README.md", "c.py", "."]
    assert values(data, lambda c: paths.ancestors(F.col(c))) == [["."], [".", "a", "a/b"], []]


def test_relative_paths(rows):
    pool = ["/home/user/project/file.txt", "/home/user/project", "/home/user/other/file.txt", "/", "/home/./user//project/../x/y", "/a"]
    pairs = [(t, b) for t in pool for b in pool]
    got = rows(pairs, "t string, b string").select("t", "b", paths.relative(F.col("t"), F.col("b"))).collect()
    for target, base, relative in got:
        assert relative == posixpath.relpath(posixpath.normpath(target), posixpath.normpath(base)), (target, base)


def test_source_urls(rows):
    cases = [
        ("https://h/o/r.git#main", "https://h/o/r.git", "main"),
        ("https://h/o/r.git", "https://h/o/r.git", None),
        ("git@h:o/r.git#dev", "git@h:o/r.git", "dev"),
        ("https://h/o/r/tree/dev", "https://h/o/r", "dev"),
        ("https://h/o/r/tree/dev/src", "https://h/o/r/src", "dev"),
        ("https://h/o/r/commits/v1#rel", "https://h/o/r/", "rel"),
        ("https://h/o/r#", "https://h/o/r", None),
        ("https://h/o/r/tree/a/tree/b", "https://h/o/r/tree/b", "a"),
    ]
    df = rows([(c[0],) for c in cases], "url string")
    base, branch = urls.base_url(F.col("url")), urls.branch(F.col("url"))
    got = df.select("url", base, branch, urls.repo_key(base, branch), urls.repo_name(base)).collect()
    assert [tuple(r[:3]) for r in got] == cases
    assert [r[3] for r in got][:2] == ["https://h/o/r.git#main", "https://h/o/r.git#DEFAULT"]
    assert [r[4] for r in got] == ["r", "r", "r", "r", "src", "unnamed", "r", "b"]


def python_value(value):
    if value == "":
        return "clear", None
    try:
        number = float(value)
        return ("int", str(int(number))) if number.is_integer() else ("float", number)
    except ValueError:
        return ("bool", value.lower()) if value.lower() in ("true", "false") else ("string", value)


def test_param_values(rows):
    data = ["1e3", "0.5", "TRUE", "text", "", "1_000", "1__0", " 7 ", "1d", ".5", "5.", "+3", "-0.25", "0x10", "1e", "1e-2",
            "false", "nan", "-inf", "Infinity", "١", " true", "1 2", "1.0", "-5"]
    got = params.coerce(rows([(v,) for v in data], "v string")).select("v", "typed").collect()
    for value, typed in got:
        if value == "١":
            continue  # only ASCII digits count as numbers here
        kind, expected = python_value(value)
        assert typed["type"] == kind, value
        if kind == "float":
            assert typed["d"] == expected or (typed["d"] != typed["d"] and expected != expected)
        elif kind == "int":
            assert str(typed["i"]) == expected
        elif kind == "bool":
            assert typed["b"] == (expected == "true")
        else:
            assert typed["s"] == expected


PATTERNS = ["*.py", "test_*.txt", "docs/", "*", "?", "a[bc", "[!a]*", "[]x]*", "[a-c]?.md", "[z-a]", "[!z-a]x", "*~$*", "*.egg-info/",
            "src?/en/*", "a**b", "[[]x", "[a&&b]", "[a-]", "[--a]", "[\\]", "a.b", "(x)", "a+", "^a$", "{a,b}", "é*", "", "[!]]", "**"]


def test_globs_match_like_the_shell(spark, rows):
    rnd = random.Random(7)
    alphabet = "ab.[]!-*?/\\&^$\né𐍈"
    patterns = PATTERNS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 7))) for _ in range(150)]
    patterns = [p for p in patterns if not re.search(r"\[[^\]]*.-.?!", p)]  # reversed range before a bang reads oddly
    subjects = ["file.py", "a/b/c.py", "x/test_data.txt", "docs/", "a[bc", "x/~$a.doc", "src1/en/d.md", "src10/en/d", "a\nb", "", "a", "]x",
                "[x", "&", "-", "\\", "z", "ax", "(x)", "^a$", "a+", "{a,b}", "é", "𐍈", "a𐍈"]
    subjects += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 6))) for _ in range(300)]
    df = rows([(s,) for s in subjects], "s string")
    for start in range(0, len(patterns), 60):
        chunk = patterns[start : start + 60]
        got = df.select("s", *[glob_test(F.col("s"), compile_glob(p)).alias(f"p{i}") for i, p in enumerate(chunk)]).collect()
        for row in got:
            for i, pattern in enumerate(chunk):
                assert row[i + 1] == fnmatchcase(row[0], pattern), (row[0], pattern)


@pytest.mark.parametrize("pattern", ["/abs", "", "a/b**", "**x/y"])
def test_unusable_includes(pattern):
    assert compile_segments(pattern).error


def test_segment_globs_match_like_a_folder_walk(tmp_path, spark, rows):
    files = ["a.py", "src/main.py", "src/sub/x.py", "src/sub/deep/y.md", ".hidden/z.py", ".env", "docs/a/b.md", "srcx/main.py", "src/.dot", "s/[x].md"]
    for name in files:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    df = rows([(f,) for f in files], "path string")
    for pattern in ["*.py", "**/*.py", "src/**", "src", "src/*", "s*/main.py", "**/sub", "src/**/y.md", "./src", "docs/", "*", "[a-d]*", "?/*",
                    "**/b.md", "*/**/x.py", "src/[!.]*", "s/[[]x].md", "**", "src//sub"]:
        expected = set()
        for hit in tmp_path.glob(pattern):
            below = [hit] if hit.is_file() else [p for p in hit.rglob("*") if p.is_file()]
            expected |= {os.path.relpath(p, tmp_path) for p in below}
        regex = compile_segments(pattern).members
        assert {r[0] for r in df.filter(F.col("path").rlike(regex)).collect()} == expected, pattern


def test_slug_by_its_start_equals_the_whole(values):
    rng = random.Random(5)
    pieces = ["a", "Z", "_", "-", ".", " ", "/", "\n", "\u00e9", "\u4e2d", "\ufb01", "!", "....", "----", "   ", ".txt", "0"]
    texts = [
        "".join(rng.choices(pieces, [rng.random() ** 4 for _ in pieces], k=rng.choice([3, 40, 99, 100, 101, 300, 700])))
        + rng.choice(["", ".txt", ".txt\n", "x.txt"])
        for _ in range(1500)
    ]
    texts += ["." * n + end for n in (90, 95, 96, 97, 100, 300, 400) for end in (".txt", ".txt\n", "a.txt", "txt", "a")]
    texts += ["\u4e2d" * 400 + "word", "-" * 500 + "b" * 200, "", None, "a" * 99 + "-" * 400 + "b"]
    assert values(texts, lambda c: text.slugify(F.col(c))) == values(texts, lambda c: text.whole_slug(F.col(c)))
    assert values(texts, lambda c: text.slugify(F.col(c), 3)) == values(texts, lambda c: text.whole_slug(F.col(c), 3))
