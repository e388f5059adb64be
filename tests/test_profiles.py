from corpusctx.operators import profiles, store
from corpusctx.run import prepare_each

REQUEST = "task_id int, project string, name string, inline string, task_file string, models array<string>"
INCLUDE, RULE = "task_id int, ordinal int, pattern string", "task_id int, rule_set string, ordinal int, pattern string"
REGISTRY = "project string, repo_key string, folder string, commit string"


def _given(rows):
    files = rows(
        [("p", path, path) for path in ("a/x.py", "a/y.md", "b/z.py", "checkouts/007-r/in.py", "checkouts/08-s/far.py", "a/skip.log")]
        + [("q", path, path) for path in ("a/x.py", "checkouts/01-r/in.py", "checkouts/007-r/not_mine.py")],
        "project string, path string, content string",
    )
    requests = rows([
        (1, "p", "first", "text", None, ["m/a"]), (2, "p", "second", "other", None, ["m/a"]), (3, "p", "third", None, "t.md", []),
        (4, "q", "fourth", "text", None, ["m/a"]), (5, "p", "", "text", None, ["m/a"]), (6, None, "nowhere", "text", None, ["m/a"]),
    ], REQUEST)
    contents = rows([("t.md", "from a file\r\n")], "task_file string, content string")
    includes = rows([
        (1, 1, "a/*.py"), (1, 2, "https://h/r"), (2, 1, "a/*.py"), (2, 2, "https://h/r"), (3, 1, "https://h/s"),
        (4, 1, "a/"), (4, 2, "https://h/r"), (5, 1, "a/"),
    ], INCLUDE)
    rules = rows([(1, "exclude", 1, "b/"), (2, "exclude", 1, "b/"), (3, "ignore", 1, "*.md"), (4, "ignore", 1, "x.*")], RULE)
    registry = rows([("p", "https://h/r#DEFAULT", "007-r", "c0ffee")], REGISTRY)
    return files, requests, contents, includes, rules, registry


def test_each_task_by_its_own_lists(rows):
    run = prepare_each(*_given(rows), builtin=("*.log",))
    profile = {r.task_id: r.profile for r in run.tasks.collect()}
    assert profile == {1: 1, 2: 1, 3: 3, 4: 4, 6: 6}  # 1 and 2 select alike, 5 has no name
    found = {}
    for r in run.classified.where("verdict = 'included'").collect():
        found.setdefault(r.profile, []).append(r.path)
    assert {k: sorted(v) for k, v in found.items()} == {
        1: ["a/x.py", "checkouts/007-r/in.py"],
        3: ["a/x.py", "b/z.py", "checkouts/007-r/in.py", "checkouts/08-s/far.py"],  # no local include: everything
        4: ["checkouts/01-r/in.py"],
    }
    assert {(r.profile, r.path) for r in run.classified.where("verdict = 'excluded'").collect()} == {(3, "a/skip.log")}
    remotes = {(r.task_id, r.folder, r.commit, r.is_new) for r in run.remotes.collect()}
    assert remotes == {
        (1, "checkouts/007-r", "c0ffee", False), (2, "checkouts/007-r", "c0ffee", False),
        (3, "checkouts/08-s", profiles.NO_COMMIT, True), (4, "checkouts/01-r", profiles.NO_COMMIT, True),
    }
    totals = {r.task_id: (r.n_files, r.total_chars) for r in run.totals.collect()}
    prompts = {r.task_id: r.prompt for r in run.prompts.collect()}
    assert {k: n for k, (n, _) in totals.items()} == {1: 2, 2: 2, 3: 4, 4: 1, 6: 0}
    assert {k: len(p) for k, p in prompts.items()} == {k: c for k, (_, c) in totals.items()}
    assert "from a file\n" in prompts[3] and "other" in prompts[2] and "not_mine" not in prompts[4]
    kept = store.prompt_store(run.bodies, run.tasks, run.keys)
    whole = {}
    for r in store.spelled_out(kept).orderBy("task_id", "chunk_no").collect():
        whole[r.task_id] = whole.get(r.task_id, "") + r.chunk
    assert whole == prompts
    manifest = {r.task_id: r for r in run.manifest.collect()}
    assert manifest[1].n_sources == 3 and "(Commit: c0ffee) -> `checkouts/007-r`" in manifest[1].sources_text
    assert {(r.task_id, r.model) for r in run.plan.collect()} == {(1, "m/a"), (2, "m/a"), (4, "m/a"), (6, "m/a")}


def test_no_tasks_and_no_lists(rows):
    files, requests, contents, includes, rules, registry = _given(rows)
    none = prepare_each(files, requests.limit(0), contents, includes, rules, registry)
    assert none.totals.count() == none.classified.count() == none.remotes.count() == 0
    bare = prepare_each(files, requests.where("task_id < 4"), contents, includes.limit(0), rules.limit(0), registry.limit(0), builtin=())
    assert {r.profile for r in bare.tasks.collect()} == {1}
    assert {r.n_files for r in bare.totals.collect()} == {6}


def test_profiles_tell_lists_apart(rows):
    tasks = rows([(i, "p") for i in range(6)] + [(6, "q"), (7, None), (8, None)], "task_id int, project string")
    includes = rows([(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "a"), (2, 2, "b"), (2, 1, "a"), (6, 1, "a"), (6, 2, "b")], INCLUDE)
    rules = rows([(3, "ignore", 1, "a"), (4, "exclude", 1, "a"), (5, "ignore", 1, "a"), (5, "ignore", 1, "a")], RULE)
    got = {r.task_id: r.profile for r in profiles.select_profiles(tasks, includes, rules).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7}
