"""Operator inputs derived from the given tables; every one grows with them."""

from pyspark.sql import functions as F

from corpusctx.functions import paths

IGNORE = ["*_1?.md", "doc_7.md"]
EXCLUDES = ["src3/", "*/de/doc_[0-4]*", "doc_99*", ".git/"]
INCLUDES = ["src1*/en", "src4/fr/*.md", "src5/**"]
MODELS = ["a/b", "a:b", "manual-review", "A/b", "m/0", "m/1", "m/2"]
CHECKOUTS = "checkouts/"
STAMP = "2024-01-01T00:00:00"
PARAM_KEYS = {"view": "temperature", "click": "timeout", "signup": "top_p", "purchase": "max_tokens", "error": "note"}
STATES = {"view": "Waiting", "click": "Queued", "signup": "Sending", "purchase": "Done"}


_SCHEMAS = {}


def table(spark, sf_dir, name):
    """One of the given tables; its schema is looked up in the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _text(*pieces):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in pieces])


def _string(col):
    return F.col(col).cast("string")


def files(spark, sf_dir):
    path = _text(F.col("source"), "/", F.col("lang"), "/doc_", _string("doc_id"), ".md")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"), path.alias("path"), F.col("text").alias("content"), "doc_id", "lang", "n_chars"
    )


def corpus(spark, sf_dir):
    return files(spark, sf_dir).select("project", "path", "content")


def project_rules(spark, sf_dir):
    lang, source = F.col("lang"), F.col("source")
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source", "lang")
        .agg(F.lit(1))
        .select(
            source.alias("project"),
            F.when(lang.isin("de", "es"), "ignore").otherwise("exclude").alias("rule_set"),
            F.when(lang.isin("de", "en"), 1).otherwise(2).alias("ordinal"),
            F.when(lang == "de", "*/de/doc_[0-4]*")
            .when(lang == "es", "doc_?5*.md")
            .when(lang == "en", _text(source, "/en/doc_1*"))
            .otherwise(_text(source, "/fr/"))
            .alias("pattern"),
        )
    )


def roots(spark, sf_dir):
    docs = files(spark, sf_dir)
    path = F.col("path")
    chosen = F.filter(
        F.array(
            F.when(F.startswith("project", F.lit("src1")), F.col("project")),
            F.when(F.col("lang") != "en", paths.folder(path)),
            path,
        ),
        lambda x: x.isNotNull(),
    )
    return docs.select(F.explode(chosen).alias("root")).distinct()


def tasks(spark, sf_dir):
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("task_id"),
        _text("Task ", _string("item_id")).alias("name"),
        F.when(item % 7 == 0, "  ").otherwise(F.col("text")).alias("definition"),
        _text("src", (item % 20).cast("string")).alias("project"),
        F.filter(F.array(*[F.lit(m) for m in MODELS]), lambda m, i: (item + i + 1) % 3 != 0).alias("models"),
    )


def task_rules(spark, sf_dir):
    """Each task's own ignore and exclude patterns."""
    item = F.col("item_id")
    rule = lambda rule_set, ordinal, pattern: F.struct(
        F.lit(rule_set).alias("rule_set"), F.lit(ordinal).alias("ordinal"), pattern.alias("pattern")
    )
    rules = F.array(
        rule("ignore", 1, _text("doc_*", (item % 10).cast("string"), ".md")),
        rule("exclude", 1, _text("*/", F.when(item % 2 == 0, "en").otherwise("de"), "/doc_[2-4]*")),
        rule("exclude", 2, _text("src", (item % 20).cast("string"), "/fr/")),
    )
    return table(spark, sf_dir, "benchmark").select(item.alias("task_id"), F.inline(rules))


def task_includes(spark, sf_dir):
    """Each task's own include patterns; some are remote or unusable."""
    item = F.col("item_id")
    project = _text("src", (item % 20).cast("string"))
    patterns = F.array(
        _text(project, "/e?/*1*.md"),
        F.when(item % 3 == 0, _text("**/fr")).when(item % 3 == 1, "/abs").otherwise("https://h/r"),
        F.when(item % 4 == 0, _text(project, "/de/")).otherwise(_text(project, "/d[!x]/doc_2*")),
    )
    return table(spark, sf_dir, "benchmark").select(item.alias("task_id"), F.posexplode(patterns).alias("ordinal", "pattern"))


def task_requests(spark, sf_dir):
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("task_id"),
        F.when(item % 11 == 0, "").otherwise(_text("Task ", _string("item_id"))).alias("name"),
        F.when(item % 4 < 2, F.when(item % 7 == 1, " \t").otherwise(F.col("text"))).alias("inline"),
        F.when((item % 4 == 1) & (item % 3 == 0) | (item % 4 == 2), _text("doc_", (item * 13).cast("string"))).alias("task_file"),
        F.when(item % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a/b"))).alias("models"),
    )


def own_requests(spark, sf_dir):
    """The requests of tasks, each in a project."""
    return task_requests(spark, sf_dir).withColumn("project", _text("src", (F.col("task_id") % 20).cast("string")))


#: The remote source that tasks name, and its folder where it is known and where it is the first new one.
REMOTE_KEY, KNOWN_FOLDER, NEW_FOLDER = "https://h/r#DEFAULT", "041-r", "01-r"


def remote_registry(spark, sf_dir):
    """Projects that know the remote source, with the last commit seen there."""
    pages = table(spark, sf_dir, "pages").select(_text("src", (F.col("page_id") % 10).cast("string")).alias("project"), F.md5("html").alias("commit"))
    return pages.groupBy("project").agg(F.max("commit").alias("commit")).select(
        "project", F.lit(REMOTE_KEY).alias("repo_key"), F.lit(KNOWN_FOLDER).alias("folder"), "commit"
    )


def landed(spark, sf_dir):
    """Documents, and pages as files landed from the remote source."""
    page = F.col("page_id")
    folder = F.when(page % 20 < 10, KNOWN_FOLDER).otherwise(NEW_FOLDER)
    pages = table(spark, sf_dir, "pages").select(
        _text("src", (page % 20).cast("string")).alias("project"),
        _text(CHECKOUTS, folder, "/page_", page.cast("string"), ".html").alias("path"),
        F.col("html").alias("content"),
    )
    return corpus(spark, sf_dir).unionByName(pages)


def task_contents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        _text("doc_", _string("doc_id")).alias("task_file"), F.col("text").alias("content")
    )


def sources(spark, sf_dir):
    page = F.col("page_id")
    bare = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    url = (
        F.when(page % 4 == 0, F.col("url"))
        .when(page % 4 == 1, _text(bare, "/tree/dev/x"))
        .when(page % 4 == 2, _text(bare, ".git#main"))
        .otherwise(_text(bare, "/commits/v1#rel"))
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", F.substring_index("url", ":", 1).alias("project"), url.alias("url"), F.md5("html").alias("commit")
    )


def landed_sources(spark, sf_dir):
    """The sources that an earlier run has landed: every page under its plain address."""
    return table(spark, sf_dir, "pages").select("page_id", F.substring_index("url", ":", 1).alias("project"), "url", F.md5("html").alias("commit"))


def folders(spark, sf_dir):
    event = F.col("event_id")
    numbered = _text(F.lpad((event % 130 + 1).cast("string"), 3, "0"), "-", F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("project"),
        F.when(event % 3 == 0, numbered).otherwise(_text(F.col("event_type"), "_", _string("event_id"))).alias("name"),
        F.col("ts").alias("mtime"),
    )


def _mapped(col, table_, otherwise):
    out = F.lit(otherwise)
    for key, value in table_.items():
        out = F.when(F.col(col) == key, value).otherwise(out)
    return out


def params(spark, sf_dir):
    event = F.col("event_id")
    value = (
        F.when(event % 6 == 0, (event % 9).cast("string"))
        .when(event % 6 == 1, "0.5")
        .when(event % 6 == 2, "TRUE")
        .when(event % 6 == 3, "false")
        .when(event % 6 == 4, "text")
        .otherwise("")
    )
    # Values are dealt to all tasks, whose ids run from 0.
    n_tasks = F.lit(max(table(spark, sf_dir, "benchmark").count(), 1)).cast("bigint")
    return table(spark, sf_dir, "events").select(
        (event % n_tasks).alias("task_id"),
        event.alias("ordinal"),
        F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % len(MODELS) + 1).cast("int")).alias("model"),
        _mapped("event_type", PARAM_KEYS, "other").alias("k"),
        value.alias("v"),
    )


def param_layers(spark, sf_dir):
    """Saved defaults (every third row) below the values of the run."""
    rows = params(spark, sf_dir)
    return rows.filter(F.col("ordinal") % 3 == 0), rows.filter(F.col("ordinal") % 3 != 0)


def flat_params(spark, sf_dir):
    rows = params(spark, sf_dir)
    triple = F.array("model", "k", "v")
    return rows.select(
        F.col("ordinal").alias("run"),
        F.when(F.col("ordinal") % 5 == 0, F.array_append(triple, F.lit("rest")))
        .when(F.col("ordinal") % 5 == 1, F.concat(triple, F.array(F.lit("m/9"), F.lit("seed"), _string("ordinal"))))
        .otherwise(triple)
        .alias("params"),
    )


def settings(spark, sf_dir):
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("project"),
        (event % 3).alias("layer"),
        event.alias("ordinal"),
        F.col("event_type").alias("k"),
        F.when(event % 4 != 0, (event % 1000).cast("string")).alias("v"),
    )


def status_events(spark, sf_dir):
    user = F.col("user_id")
    prefix = F.when(user % 4 == 0, "manual-").otherwise("m/")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        (user % 15).alias("run"),
        F.concat(prefix, user.cast("string")).alias("model"),
        _mapped("event_type", STATES, "Error").alias("status"),
        "value",
        "user_id",
    )


def results(spark, sf_dir):
    return status_events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("task_id"), "status", F.col("value").alias("cost")
    )


CODES = {"purchase": 200, "signup": 200, "view": 404, "click": 204}


def attempts(spark, sf_dir):
    from pyspark.sql import Window

    in_turn = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("generation_id"),
        F.row_number().over(in_turn).alias("attempt"),
        _mapped("event_type", CODES, 500).alias("code"),
        (F.col("event_type") == "purchase").alias("has_data"),
    )


def response_log(spark, sf_dir):
    event = F.col("event_id")
    text_id = event.cast("string")
    usage = (
        F.when(event % 3 == 0, "0")
        .when(event % 3 == 1, "0.001")
        .otherwise(
            _text('{"prompt_tokens":', (event % 50).cast("string"), ',"completion_tokens":', _string("user_id"),
                  ',"generation_id":"gen-', text_id, '"}')
        )
    )
    raw = _text(
        "{",
        F.when(event % 5 == 0, "").otherwise(_text('"id":"gen-', text_id, '",')),
        '"choices":[{"message":{"content":"',
        F.when(event % 11 == 0, "").otherwise(_text("answer ", text_id)),
        '"}}],"usage":',
        usage,
        F.when(event % 17 == 0, "").otherwise("}"),
    )
    return table(spark, sf_dir, "events").select(
        event.alias("request_id"), F.col("user_id").alias("task_id"), _text("m/", (F.col("user_id") % 3).cast("string")).alias("model"), raw.alias("raw")
    )


#: The answers to the lookups of each kind of event, in order: code, and whether details came with it.
LOOKUPS = {
    "purchase": [(200, True)],
    "signup": [(404, False), (200, True)],
    "view": [(404, False), (404, False), (404, False)],
    "click": [(200, False)],
    "error": [(500, False)],
}
#: The same for events of a small value: not ended yet, and never an answer to settle on.
RARE_LOOKUPS = {"view": [(404, False)], "click": [(204, False), (204, False), (204, False)]}
RARE_BELOW = 10


def lookup_log(spark, sf_dir):
    """Every attempt to look up the details of every answer."""
    def tries(answers):
        return F.array(*[F.struct(F.lit(i + 1).alias("attempt"), F.lit(c).alias("code"), F.lit(d).alias("has_data")) for i, (c, d) in enumerate(answers)])

    log = F.when(F.lit(False), tries(LOOKUPS["purchase"]))
    for kind, answers in RARE_LOOKUPS.items():
        log = log.when((F.col("event_type") == kind) & (F.col("value") < RARE_BELOW), tries(answers))
    for kind, answers in LOOKUPS.items():
        log = log.when(F.col("event_type") == kind, tries(answers))
    return table(spark, sf_dir, "events").select(_text("gen-", _string("event_id")).alias("generation_id"), F.inline(log))


def generation(spark, sf_dir):
    """The details that the lookups found."""
    event = F.col("event_id")
    found = [kind for kind, answers in LOOKUPS.items() if answers[-1] == (200, True)]
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin(found)).select(
        _text("gen-", event.cast("string")).alias("generation_id"),
        F.when(event % 4 == 0, 0.0).otherwise(F.col("value")).alias("usage"),
        F.col("value").alias("total_cost"),
        F.col("user_id").alias("tokens_prompt"),
        (event % 50).alias("tokens_completion"),
    )


def turns(spark, sf_dir):
    block = _text(F.col("role"), ": ", F.col("text"), "\n\n")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", block.alias("block"))
