import random

import pytest
from pyspark.sql import functions as F

from corpusctx.functions import text
from corpusctx.operators import assemble, chunks, dispatch, measure, naming, results, roots, selection, settings
from corpusctx.operators.ordering import number_rows, path_order

PATHS = ["file.py", "a/b/c.py", "x/test_data.txt", "docs/readme.md", "docs", "x/docs/readme.md", "sub/node_modules/x.js",
         "project/.git/HEAD", ".git", ".git/config", "sub/.git", "something-git/file", "config/.env", "a/b.log", "x/~$a.doc",
         "src1/en/doc_12.md", "src10/en/doc_3.md", "a[bc", "win\\dir\\a.log", "dist/x", "q/dist/x", "odd\\name.cfg"]


IGNORE = ["*_1?.md", "docs/", "HEAD", "[!a-z]*"]
EXCLUDES = [*selection.DEFAULT_EXCLUDES, "docs/", "test_*.txt", "src?/en/*", "a[bc", "odd?name*", "*.js"]
# What each path must get, by hand.
EXPECTED = {
    "file.py": ("included", None),
    "a/b/c.py": ("included", None),
    "x/test_data.txt": ("excluded", "test_*.txt"),
    "docs/readme.md": ("excluded", "docs/"),
    "docs": ("excluded", "docs/"),
    "x/docs/readme.md": ("included", None),
    "sub/node_modules/x.js": ("excluded", "*.js"),
    "project/.git/HEAD": ("ignored", "HEAD"),
    ".git": ("ignored", "[!a-z]*"),
    ".git/config": ("ignored", "[!a-z]*"),
    "sub/.git": ("ignored", "[!a-z]*"),
    "something-git/file": ("included", None),
    "config/.env": ("ignored", "[!a-z]*"),
    "a/b.log": ("excluded", "*.log"),
    "x/~$a.doc": ("ignored", "[!a-z]*"),
    "src1/en/doc_12.md": ("ignored", "*_1?.md"),
    "src10/en/doc_3.md": ("included", None),
    "a[bc": ("excluded", "a[bc"),
    "win\\dir\\a.log": ("excluded", "*.log"),
    "dist/x": ("excluded", "dist/"),
    "q/dist/x": ("included", None),
    "odd\\name.cfg": ("excluded", "odd?name*"),
}


def pairs(df):
    return {r["path"]: (r["verdict"], r["first_rule"]) for r in df.collect()}


def test_classification(rows):
    files = rows([("p", p) for p in PATHS], "project string, path string")
    expected = EXPECTED
    assert pairs(selection.classify_files(files, IGNORE, EXCLUDES)) == expected
    rules = [("p", "ignore", i, p) for i, p in enumerate(IGNORE)] + [("p", "exclude", i, p) for i, p in enumerate(EXCLUDES)]
    table = rows(rules + [("other", "exclude", 0, "*")], "project string, rule_set string, ordinal int, pattern string")
    assert pairs(selection.classify_by_table(files, table)) == expected


def test_many_rules_use_the_table(rows):
    many = [f"*.x{i}" for i in range(300)] + EXCLUDES
    files = rows([(p,) for p in [*PATHS, "f.x250"]], "path string")
    got = selection.classify_files(files, IGNORE, many)
    assert got.columns == ["path", "verdict", "first_rule"]
    assert pairs(got) == {**EXPECTED, "f.x250": ("excluded", "*.x250")}


def test_any_level_and_no_rules(rows):
    files = rows([(p,) for p in PATHS], "path string")
    assert {v for v, _ in pairs(selection.classify_files(files)).values()} == {"included"}
    got = pairs(selection.classify_files(files, (), [selection.Rule("node_modules/", any_level=True)]))
    assert [p for p, v in got.items() if v[0] == "excluded"] == ["sub/node_modules/x.js"]


def test_counts_partition_the_files(rows):
    files = rows([(p[:1], p) for p in PATHS], "project string, path string")
    for r in selection.selection_counts(selection.classify_files(files, IGNORE, EXCLUDES)).collect():
        assert r.scanned == r.ignored + r.excluded + r.included == sum(p[:1] == r.project for p in PATHS)


def test_effective_excludes(rows):
    layers = {"builtin": rows([("a",), ("b",)], "pattern string"), "run": rows([("b",), ("c",), ("c",)], "pattern string")}
    got = {tuple(r) for r in selection.effective_excludes(layers).collect()}
    assert got == {("a", "builtin"), ("b", "builtin"), ("c", "run")}


def test_roots(rows):
    names = ["src1", "src1/en", "src10", "src2/fr", "src2/fr/doc_1.md", "src1"]
    kept = roots.drop_covered_roots(rows([(n,) for n in names], "root string"))
    assert {r[0] for r in kept.collect()} == {"src1", "src10", "src2/fr"}
    files = rows([(f,) for f in ["src1/a", "src1/en/b", "src10/c", "src2/fr/doc_1.md", "src2/x", "src1"]], "path string")
    got = {tuple(r) for r in roots.files_under_roots(files, kept).collect()}
    assert got == {("src1/a", "src1"), ("src1/en/b", "src1"), ("src10/c", "src10"), ("src2/fr/doc_1.md", "src2/fr"), ("src1", "src1")}
    everything = roots.drop_covered_roots(rows([(".",), ("src1",)], "root string"))
    assert [r[0] for r in everything.collect()] == ["."]
    assert roots.files_under_roots(files, everything).count() == 6


def test_search_paths(rows):
    files = rows([(f,) for f in ["a/x.py", "a/b/y.py", "c/z.md", "top.py"]], "path string")

    def found(includes, **more):
        return {tuple(r) for r in roots.search_paths(files, includes, **more).collect()}

    assert found([]) == {(".", "root")}
    assert found(["https://h/r"]) == {(".", "root")}
    assert found(["https://h/r"], root_when_no_local=False) == set()
    assert found(["*.py", "a", "/bad"]) == {("top.py", "glob"), ("a", "glob")}
    assert found(["./", "a/**"]) == {(".", "root"), ("a", "glob"), ("a/b", "glob")}
    far = rows([("out/01-r",)], "path string")
    assert found(["c/"], remote_paths=far) == {("c", "glob"), ("out/01-r", "remote")}
    assert roots.include_problems(["/bad", "ok", "x**"]).keys() == {"/bad", "x**"}


def test_includes_per_task(rows):
    files = rows([(t, f) for t in (1, 2, 3, 4) for f in ("a/x.py", "a/b/y.py", "top.md")], "task_id int, path string")
    includes = rows([(1, 0, "*.md"), (1, 1, "a/b"), (2, 0, "https://h/r"), (3, 0, "/bad")], "task_id int, ordinal int, pattern string")

    def found(**more):
        return {tuple(r) for r in roots.expand_by_table(files, includes, **more).select("task_id", "path", "first_pattern").collect()}

    own = {(1, "top.md", "*.md"), (1, "a/b/y.py", "a/b")}
    whole = {(t, f, "./") for t in (2, 4) for f in ("a/x.py", "a/b/y.py", "top.md")}
    assert found() == own | whole
    assert found(root_when_no_local=False) == own


def test_numbering_of_a_hot_group(spark, rows):
    """One group spans many partitions; numbers stay exact and do not depend on input order."""
    rnd = random.Random(3)
    data = [("hot" if i % 3 else f"g{i % 50}", f"{rnd.choice('ab-')}/{rnd.choice(['x', 'x-y', 'z'])}/{i}") for i in range(6000)]
    data += [(None, "n/1"), (None, "n/0")]
    expected = {}
    for group in {g for g, _ in data}:
        members = sorted((p.split("/") for g, p in data if g == group))
        expected.update({(group, "/".join(p)): i + 1 for i, p in enumerate(members)})
    before = spark.conf.get("spark.sql.adaptive.enabled")
    for adaptive, order in (("false", 1), ("true", 2)):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        random.Random(order).shuffle(data)
        numbered = path_order(rows(data, "project string, path string").repartition(7))
        got = {(r.project, r.path): r.seq for r in numbered.collect()}
        assert got == expected
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spread = number_rows(rows(data, "project string, path string"), ["project"], ["path"])
    assert spread.count() == len(data)
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_path_order_is_by_component(rows):
    got = path_order(rows([("p", x) for x in ["a-b", "a/b", "a", "B/c"]], "project string, path string")).orderBy("seq").collect()
    assert [r.path for r in got] == ["B/c", "a", "a/b", "a-b"]


FILES = [("p", "b/two.md", "second\r\nfile", None), ("p", "a.md", "", None), ("p", "b-x.md", None, "gone"), ("q", "z.md", "zz" * 40, None)]
FILE_SCHEMA = "project string, path string, content string, read_error string"
TASKS = [(1, "one", "do it", "p", ["m/1"]), (2, "two", "and that", "q", []), (3, "three", "", "none", ["x"]), (4, "four", "again", "p", ["m/1", "m/2"])]
TASK_SCHEMA = "task_id bigint, name string, definition string, project string, models array<string>"


def expected_prompts():
    t, out = assemble.Templates(), {}
    for task_id, _, definition, project, _ in TASKS:
        body = ""
        for _, path, content, error in sorted((f for f in FILES if f[0] == project), key=lambda f: f[1].split("/")):
            shown = t.error_open + path + ": " + error + t.error_close if error else content.replace("\r\n", "\n")
            body += t.file_open + path + t.file_head + shown + t.file_close
        out[task_id] = body + t.task_open + definition + t.task_close
    return out


def test_prompts_parts_and_totals_agree(rows):
    files, tasks = rows(FILES, FILE_SCHEMA), rows(TASKS, TASK_SCHEMA)
    expected = expected_prompts()
    blocks = assemble.project_blocks(files)
    prompts = assemble.assemble_prompts(assemble.assemble_bodies(blocks), tasks).collect()
    assert {r.task_id: r.prompt for r in prompts} == expected
    parts = assemble.prompt_parts(assemble.file_parts(blocks), tasks).orderBy("task_id", "seq").collect()
    joined = {}
    for r in parts:
        joined[r.task_id] = joined.get(r.task_id, "") + r.block
    assert joined == expected
    assert [r.kind for r in parts if r.task_id == 1] == ["file"] * 3 + ["header", "task", "footer"]
    for r in assemble.prompt_totals(files, tasks).collect():
        assert (r.total_chars, r.est_tokens) == (len(expected[r.task_id]), len(expected[r.task_id]) // 4)
    assert {r.task_id: r.prompt_chars for r in prompts} == {k: len(v) for k, v in expected.items()}


def test_oversized_prompts_keep_counts_and_parts(rows):
    files, tasks = rows(FILES, FILE_SCHEMA), rows(TASKS, TASK_SCHEMA)
    bodies = assemble.assemble_bodies(assemble.project_blocks(files), max_chars=110)
    got = {r.task_id: r for r in assemble.assemble_prompts(bodies, tasks).collect()}
    expected = expected_prompts()
    assert got[1].prompt is None and got[1].prompt_chars == len(expected[1]) and got[1].n_files == 3
    assert got[2].prompt == expected[2] and got[3].prompt == expected[3]
    requests = dispatch.build_requests(dispatch.dispatch_plan(tasks), assemble.assemble_prompts(bodies, tasks))
    asked = []
    answers = dispatch.dispatch_batch(requests, lambda model, body: asked.append(body) or body).collect()
    assert {(r.task_id, r.raw is None, r.error is None) for r in answers} == {(1, True, False), (4, True, False)}


def test_chunks_lose_nothing(rows):
    """Any chunk size gives the same text, cut every so many characters, oversized blocks too."""
    files, tasks = rows(FILES, FILE_SCHEMA), rows(TASKS, TASK_SCHEMA)
    expected, t = expected_prompts(), assemble.Templates()
    tails = {task_id: t.task_open + definition + t.task_close for task_id, _, definition, _, _ in TASKS}
    for size in (7, 60, 1 << 16):
        bodies = assemble.body_chunks(assemble.project_blocks(files), chunk_chars=size)
        got = assemble.prompt_chunks(bodies, tasks, chunk_chars=size).orderBy("task_id", "chunk_no").collect()
        for task_id, whole in expected.items():
            own = [r for r in got if r.task_id == task_id]
            body = whole[: len(whole) - len(tails[task_id])]
            assert [r.chunk for r in own] == [part[i : i + size] for part in (body, tails[task_id]) for i in range(0, len(part), size)]
            assert [r.chunk_no for r in own] == list(range(len(own))) and all(r.n_chars == len(r.chunk) for r in own)


def test_text_chunks_over_many_partitions(rows):
    texts = {(g, i): "é😀x"[: i % 4] * (i % 9) for g in ("p", None) for i in range(150)}
    df = rows([(g, i, v or (None if i % 2 else "")) for (g, i), v in texts.items()], "g string, i bigint, v string").repartition(13)
    got = chunks.text_chunks(df, ["g"], ["i"], "v", 11).collect()
    for g in ("p", None):
        whole = "".join(texts[g, i] for i in range(150))
        own = {r.chunk_no: r.chunk for r in got if r.g == g}
        assert own == {k: whole[11 * k : 11 * k + 11] for k in range(-(-len(whole) // 11))}
    assert chunks.text_chunks(df.where("v = ''"), ["g"], ["i"], "v").count() == 0


def test_folder_tokens(rows):
    files = rows([("p", "a/x", "1" * 8, None), ("p", "a/y", "", None), ("p", "t", "1", None), ("p", "e/z", "", None), ("p", "a/bad", None, "no")], FILE_SCHEMA)
    folders = measure.folder_tokens(files)
    assert {(r.folder, r.tokens) for r in folders.collect()} == {("a", 2), (".", 1), ("e", 0)}
    more = rows([("p", f"{n}/f", "1" * 4) for n in "cbadfe"], "project string, path string, content string")
    top = measure.top_folders(measure.folder_tokens(more), k=5).orderBy("rank").collect()
    assert [r.folder for r in top] == list("abcde")
    per_file = measure.doc_tokens(files).agg(F.sum("est_tokens")).first()[0]
    assert per_file == folders.agg(F.sum("tokens")).first()[0]


def test_manifest(rows):
    files, tasks = rows(FILES, FILE_SCHEMA), rows(TASKS, TASK_SCHEMA)
    totals = assemble.prompt_totals(files, tasks)
    remotes = rows([(1, "https://h/r", "dev", "0123456789abcdef", "out/02-r"), (1, "https://h/a", None, "ff" * 20, "out/01-a")],
                   "task_id bigint, base_url string, branch string, commit string, folder string")
    manifest = assemble.task_manifest(files, tasks, totals, remotes)
    got = {r.task_id: r for r in manifest.collect()}
    assert got[1].sources_text.split("\n") == [
        "*   `a.md`", "*   `b/two.md`", "*   `b-x.md`",
        "*   (git) https://h/a (Commit: ffffffffff) -> `out/01-a`",
        "*   (git) https://h/r (Branch: dev) (Commit: 0123456789) -> `out/02-r`",
    ]
    assert (got[1].n_sources, got[3].n_sources, got[3].sources_text) == (5, 0, assemble.NO_SOURCES)
    assert (got[2].models_text, got[4].models_text) == ("None", "m/1, m/2")
    assert assemble.task_manifest(files, tasks, totals).filter("task_id = 1").first().n_sources == 3
    text_ = {r.task_id: r.manifest for r in assemble.render_manifest(manifest, "2024-01-01T00:00:00+00:00").collect()}[4]
    assert text_.startswith("# Task: four\n\nagain\n") and "2024-01-01T00:00:00+00:00" in text_ and "m/1, m/2" in text_


def test_manifest_chunks_hold_every_line(rows):
    files, tasks = rows(FILES, FILE_SCHEMA), rows(TASKS, TASK_SCHEMA)
    remotes = rows([(1, "https://h/r", "dev", "0123456789abcdef", "out/02-r")] * 2 + [(3, "https://h/a", None, "ff" * 20, "out/01-a")],
                   "task_id bigint, base_url string, branch string, commit string, folder string")
    totals = assemble.prompt_totals(files, tasks)
    for far in (remotes, None):
        # The cell is null beyond its limit; the chunks are whole at every size.
        assert assemble.task_manifest(files, tasks, totals, far, max_chars=20).where("task_id = 1").first().sources_text is None
        expected = {r.task_id: r.sources_text for r in assemble.task_manifest(files, tasks, totals, far).collect()}
        for size in (7, 1000):
            got = {}
            for r in assemble.manifest_chunks(files, tasks, far, chunk_chars=size).orderBy("task_id", "chunk_no").collect():
                assert r.n_chars == len(r.chunk) <= max(size, len(assemble.NO_SOURCES))
                got[r.task_id] = got.get(r.task_id, "") + r.chunk
            assert got == expected


def mapping(rows, names):
    data = [("p", n, i) for i, n in enumerate(names)]
    df = rows(data, "project string, name string, mtime bigint")
    return {r.old_name: r.new_name for r in naming.folder_mapping(df).collect()}, {r.project: r.label for r in naming.next_numbers(df).collect()}


def test_folder_numbers(rows):
    new, following = mapping(rows, ["001-old-task", "002-another-task", "unnumbered-task", "00A-bad-prefix"])
    assert new == {"001-old-task": "01-old-task", "002-another-task": "02-another-task", "unnumbered-task": "03-unnumbered-task",
                   "00A-bad-prefix": "04-00A-bad-prefix"}
    assert following == {"p": "05"}
    assert mapping(rows, ["98-x"]) == ({"98-x": "98-x"}, {"p": "99"})
    assert mapping(rows, ["98-x", "loose"]) == ({"98-x": "098-x", "loose": "099-loose"}, {"p": "100"})
    assert mapping(rows, ["99-x", "1-y"]) == ({"99-x": "099-x", "1-y": "001-y"}, {"p": "100"})
    assert mapping(rows, ["1000-x", "5-"]) == ({"1000-x": "1000-x", "5-": "1001-5-"}, {"p": "1002"})
    assert mapping(rows, ["01-a", "1-b"])[0] == {"01-a": "01-a", "1-b": "01-b"}


def greedy(models, slug):
    taken = []
    for m in models:
        name, n = slug(m), 1
        while name in taken:
            name, n = f"{slug(m)}-{n}", n + 1
        taken.append(name)
    return taken


def test_result_names(rows):
    lists = [["a/b", "a:b", "A/b"], ["a-b-1", "a/b", "a:b"], ["a/b", "a:b", "a-b-1"], [], ["x"] * 5 + ["x-2", "x-2-1", "x", "x-2"]]
    rnd = random.Random(1)
    lists += [[rnd.choice(["a", "a-1", "a-1-1", "a-2", "A"]) for _ in range(12)] for _ in range(30)]
    tasks = rows(list(enumerate(lists)), "task_id int, models array<string>")
    got = {}
    for r in naming.result_names(tasks).orderBy("task_id", "ordinal").collect():
        got.setdefault(r.task_id, []).append(r.file_name)
    for i, models in enumerate(lists):
        slug = lambda m: m.lower().replace("/", "-").replace(":", "-")
        assert got.get(i, []) == [n + ".md" for n in greedy(models, slug)]


def test_registry(rows):
    sources = naming.normalize_sources(
        rows([("p", 1, "https://h/new.git#dev"), ("p", 2, "https://h/old"), ("p", 3, "https://h/new.git#dev"), ("p", 4, "https://h/new2"),
              ("q", 5, "https://h/old")], "project string, id int, url string"))
    registry = rows([("p", "https://h/old#DEFAULT", "098-kept")], "project string, repo_key string, folder string")
    got = {(r.project, r.repo_key): (r.folder, r.is_new) for r in naming.resolve_sources(sources, registry, "id").collect()}
    assert got == {
        ("p", "https://h/old#DEFAULT"): ("098-kept", False),
        ("p", "https://h/new.git#dev"): ("99-new", True),
        ("p", "https://h/new2#DEFAULT"): ("100-new2", True),
        ("q", "https://h/old#DEFAULT"): ("01-old", True),
    }


def test_latest_wins(rows):
    entries = rows([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, "new")], "k string, n int, v string")
    prior = rows([("a", "x"), ("b", "z")], "k string, v string")
    got = {tuple(r) for r in naming.latest_wins(entries, ["k"], ["n"], "v", prior).collect()}
    assert got == {("a", "y", True), ("b", "z", False), ("c", "new", True)}


def test_task_intake(rows):
    requests = rows(
        [(1, "n", "text", None, ["m"]), (2, "", "text", None, ["m"]), (3, "n", "a", "f", ["m"]), (4, "n", None, None, ["m"]),
         (5, "n", None, "f", ["m"]), (6, "n", None, "missing", ["m"]), (7, "n", " \n", None, ["m"]), (8, "n", "t", None, [])],
        "task_id int, name string, inline string, task_file string, models array<string>")
    contents = rows([("f", "from\r\nfile")], "task_file string, content string")
    taken = settings.intake_tasks(requests, contents)
    got = {r.task_id: (r.definition, r.error, r.skip_reason) for r in taken.collect()}
    assert got[1] == ("text", None, None) and got[5] == ("from\nfile", None, None)
    assert [bool(got[i][1]) for i in range(1, 9)] == [False, True, True, True, False, True, False, False]
    assert (got[7][2], got[8][2]) == ("empty definition", "no models")
    assert {r.task_id for r in settings.dispatchable_tasks(taken.filter("error is null")).collect()} == {1, 5}


def test_settings_layers(rows):
    data = [("p", 0, 1, "include", "./"), ("p", 1, 2, "include", "src"), ("p", 2, 3, "include", None), ("p", 0, 4, "exclude", "a"),
            ("p", 2, 5, "exclude", "b"), ("p", 1, 6, "exclude", "a"), ("q", 0, 7, "include", "./")]
    got = settings.resolve_settings(rows(data, "project string, layer int, ordinal int, k string, v string"))
    assert {tuple(r) for r in got.collect()} == {
        ("p", "include", "src", 1), ("p", "exclude", "a", 0), ("p", "exclude", "b", 2), ("q", "include", "./", 0)}


def test_params_and_overrides(rows):
    flat = rows([(1, ["m", "k", "1", "m", "j", "x"]), (2, ["m", "k"]), (3, [])], "run int, params array<string>")
    got = {(r.run, r.model, r.k, r.v, r.ordinal, r.error is None) for r in settings.split_params(flat).collect()}
    assert got == {(1, "m", "k", "1", 1, True), (1, "m", "j", "x", 2, True), (2, None, None, None, None, False)}
    schema = "task_id int, model string, k string, ordinal int, v string"
    saved = rows([(1, "m/1", "temperature", 9, "0.2"), (1, "m/1", "seed", 1, "5"), (1, "m/2", "top", 1, "x")], schema)
    given = rows([(1, "m/1", "temperature", 1, "0.7"), (1, "m/1", "note", 2, 'a"b'), (1, "m/2", "top", 1, "")], schema)
    merged = settings.merge_overrides([saved, given])
    assert {(r.model, r.k, r.type, r.value_text) for r in merged.collect()} == {
        ("m/1", "temperature", "float", "0.7"), ("m/1", "seed", "int", "5"), ("m/1", "note", "string", 'a"b')}


def test_requests_and_dispatch(rows):
    import json

    tasks = rows([(1, "say \"hi\"\n", ["m/1", "by-hand", "m/2", "m/1"]), (2, " ", ["m/1"]), (3, "x", [])], "task_id int, definition string, models array<string>")
    schema = "task_id int, model string, k string, ordinal int, v string"
    given = rows([(1, "m/1", "temperature", 1, "0.5"), (1, "m/1", "stop", 2, "é\"q"), (1, "m/1", "seed", 3, "7"), (1, "m/1", "stream", 4, "true")], schema)
    plan = dispatch.dispatch_plan(tasks, settings.overrides_by_model(settings.merge_overrides([given])))
    assert {(r.task_id, r.model, r.route, r.initial_status) for r in plan.collect()} == {
        (1, "m/1", "api", "Queued..."), (1, "m/2", "api", "Queued..."), (1, "by-hand", "manual", "Manual Input")}
    prompts = tasks.select("task_id", F.col("definition").alias("prompt"))
    requests = dispatch.build_requests(plan, prompts)
    bodies = {r.model: json.loads(r.body) for r in requests.collect()}
    assert bodies["m/1"] == {"model": "m/1", "messages": [{"role": "user", "content": "say \"hi\"\n"}], "temperature": 0.5, "timeout": 60,
                             "stop": "é\"q", "seed": 7, "stream": True}
    assert bodies["m/2"] == {"model": "m/2", "messages": [{"role": "user", "content": "say \"hi\"\n"}], "temperature": 1.0, "timeout": 60}

    def provider(model, body):
        if model == "m/2":
            raise ValueError("down")
        return f'{{"echo": {len(body)}}}'

    answers = dispatch.dispatch_batch(requests, provider)
    assert answers.rdd.getNumPartitions() == dispatch.CONCURRENCY
    got = {r.model: (r.raw, r.error) for r in answers.collect()}
    assert got["m/2"] == (None, "Error: down") and got["m/1"][0].startswith('{"echo"') and got["m/1"][1] is None


@pytest.mark.parametrize(
    "log, outcome, used, waits",
    [
        ([(404, False), (404, False), (200, True)], "OK", 3, 3),
        ([(404, False), (404, False), (404, False)], "FAILED", 3, 3),
        ([(200, False), (200, True)], "EMPTY", 1, 0),
        ([(500, False)], "FAILED", 1, 0),
        ([(204, False), (204, False), (204, False)], "EXHAUSTED", 3, 0),
        ([(204, False), (404, False), (200, True)], "OK", 3, 1),
        ([(404, False)], "PENDING", 1, 1),
        ([(404, False), (204, False), (204, False), (200, True)], "EXHAUSTED", 3, 1),
    ],
)
def test_attempts(rows, log, outcome, used, waits):
    df = rows([("g", i + 1, c, d) for i, (c, d) in enumerate(log)], "generation_id string, attempt int, code int, has_data boolean")
    r = results.resolve_attempts(df).first()
    assert (r.outcome, r.attempts_used, r.wait_seconds) == (outcome, used, waits)


def test_costs(rows):
    done = rows([(1, "Done", 0.1), (1, "Done", 0.2), (1, "Error", 5.0), (2, "Error", 1.0), (1, "Queued", 9.0)], "task_id int, status string, cost double")
    got = {r.task_id: (r.n_done, r.n_error, str(r.total_cost)) for r in results.run_costs(done).collect()}
    assert got == {1: (2, 1, "0.300000"), 2: (0, 1, "0.000000")}


def test_hot_keys_in_joins(rows, monkeypatch):
    """Slices, copies and salts change where rows meet, not what comes out."""
    from corpusctx.operators import joins

    files = rows([("p" if i % 3 else "q", f"d/{i}", "x" * (i % 7)) for i in range(300)], "project string, path string, content string")
    tasks = rows([(i, f"do {i}", "p" if i % 5 else "q", ["m"]) for i in range(120)], "task_id bigint, definition string, project string, models array<string>")
    blocks = assemble.project_blocks(files)

    def outputs():
        parts = assemble.prompt_parts(assemble.file_parts(blocks), tasks)
        prompts = assemble.assemble_prompts(assemble.assemble_bodies(blocks, max_chars=3500), tasks)
        return {tuple(r) for r in parts.collect()}, {tuple(r) for r in prompts.collect()}

    plain = outputs()
    monkeypatch.setattr(assemble, "PARTS_PER_SLICE", 9)
    monkeypatch.setattr(joins, "TASKS_PER_COPY", 4)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert outputs() == plain
    assert {r[3] is None for r in plain[1]} == {True, False}
