"""One query per operator: ``(spark, sf_dir) -> DataFrame``."""

from pyspark.sql import functions as F

from corpusctx import run
from corpusctx.functions import paths, text
from corpusctx.operators import assemble, chunks, dispatch, measure, naming, profiles, results, roots, selection, settings, store
from corpusctx.operators.ordering import path_order as number_paths
from corpusctx.plans import inputs
from corpusctx.sources.responses import read_response_log
from corpusctx.sources.rules import parse_rules
from corpusctx.sources.scratch import materialize
from corpusctx.streaming import status

TOP = 3
MANIFEST_CHARS = 1 << 10


def _classified(spark, d, content=False):
    files = inputs.corpus(spark, d)
    return selection.classify_files(files if content else files.drop("content"), inputs.IGNORE, inputs.EXCLUDES)


def _selected(spark, d):
    return selection.included(_classified(spark, d, content=True))


def files_classified(spark, d):
    return _classified(spark, d).select("path", "verdict", "first_rule")


def files_classified_by_project(spark, d):
    files = inputs.corpus(spark, d).drop("content")
    return selection.classify_by_table(files, inputs.project_rules(spark, d)).select("path", "verdict", "first_rule")


def selection_counts(spark, d):
    return selection.selection_counts(_classified(spark, d))


def rules_parsed(spark, d):
    texts = inputs.corpus(spark, d).select(F.col("path").alias("project"), "content")
    return parse_rules(texts)


def effective_excludes(spark, d):
    docs = inputs.files(spark, d)
    folder = F.concat(paths.folder(F.col("path")), F.lit("/"))
    ending = F.concat(F.lit("*_"), (F.col("doc_id") % 100).cast("string"), F.lit(".md"))
    builtin = selection.pattern_table(spark, selection.DEFAULT_EXCLUDES, "exclude")
    layers = {
        "builtin": builtin,
        "project": docs.select(F.explode(F.array(folder, F.lit("*.log"))).alias("pattern")),
        "run": docs.select(F.explode(F.array(folder, ending)).alias("pattern")),
    }
    return selection.effective_excludes(layers)


def includes_expanded(spark, d):
    files = inputs.corpus(spark, d).select("path")
    return roots.expand_includes(files, inputs.INCLUDES)


def includes_split(spark, d):
    urls = inputs.sources(spark, d).select(F.col("url").alias("include"))
    local = inputs.corpus(spark, d).select(F.col("path").alias("include"))
    return roots.split_local_remote(urls.unionByName(local)).select("include", "is_remote")


def _registry(spark, d):
    known = naming.normalize_sources(inputs.landed_sources(spark, d))
    folder = F.concat(naming.pad_number(F.col("page_id") + 1, 3), F.lit("-known"))
    return naming.latest_wins(known.withColumn("folder", folder), ["project", "repo_key"], ["page_id"], "folder")


def registry_resolved(spark, d):
    return naming.resolve_sources(naming.normalize_sources(inputs.sources(spark, d)), _registry(spark, d), "page_id")


def search_paths(spark, d):
    files = inputs.corpus(spark, d).select("path")
    remotes = registry_resolved(spark, d).select(
        F.concat(F.lit(inputs.CHECKOUTS), "project", F.lit("/"), "folder").alias("path")
    )
    return roots.search_paths(files, ["./", *inputs.INCLUDES], remotes)


def roots_kept(spark, d):
    return roots.drop_covered_roots(inputs.roots(spark, d))


def files_under_roots(spark, d):
    files = inputs.corpus(spark, d).select("path")
    return roots.files_under_roots(files, roots_kept(spark, d))


def doc_tokens(spark, d):
    return measure.doc_tokens(inputs.corpus(spark, d)).select("path", "folder", "name", "n_chars", "est_tokens")


def tokens_by_ratio(spark, d):
    """Estimates with a ratio per language; an unusable ratio counts as the default."""
    ratio = F.when(F.col("lang") == "de", 3.0).when(F.col("lang") == "fr", 0.0).otherwise(4.5)
    return inputs.files(spark, d).select("path", text.text_tokens(F.col("content"), ratio).alias("est_tokens"))


def paths_relative(spark, d):
    doc = F.col("doc_id")
    target = F.concat(F.lit("/data/./"), "path")
    base = F.concat(F.lit("/data/src"), (doc % 20 + F.when(doc % 3 == 0, 1).otherwise(0)).cast("string"), F.lit("/en/"))
    return inputs.files(spark, d).select("path", paths.relative(target, base).alias("relative"))


def _folders(spark, d):
    return measure.folder_tokens(inputs.corpus(spark, d))


def folder_tokens(spark, d):
    return _folders(spark, d).select("project", "folder", "tokens")


def top_folders(spark, d):
    return measure.top_folders(_folders(spark, d), k=TOP).select("project", "folder", "tokens", F.col("rank").cast("bigint").alias("rank"))


def path_order(spark, d):
    return number_paths(inputs.corpus(spark, d).select("project", "path"))


def blocks(spark, d):
    return assemble.project_blocks(inputs.corpus(spark, d)).select(
        "path", F.length("block").cast("bigint").alias("block_chars"), text.sha256(F.col("block")).alias("block_sha256")
    )


def prompt_parts(spark, d):
    hashed = assemble.project_blocks(_selected(spark, d)).select(
        "project", "path", text.sha256(F.col("block")).alias("part_sha256")
    )
    return assemble.prompt_parts(
        assemble.file_parts(hashed), inputs.tasks(spark, d), payload="part_sha256", finish=text.sha256
    )


def _bodies(spark, d):
    """Chunks of each source's text, digested: chunks are shared by tasks, so only their hashes move on."""
    bodies = assemble.body_chunks(assemble.project_blocks(_selected(spark, d)))
    return materialize(bodies.withColumn("chunk_sha256", text.sha256(F.col("chunk"))).drop("chunk"), "bodies")


def prompts(spark, d):
    """Every chunk of every prompt, by length and hash."""
    return assemble.prompt_chunks(_bodies(spark, d), inputs.tasks(spark, d), payload="chunk_sha256", finish=text.sha256)


def _store(spark, d):
    return store.prompt_store(assemble.body_chunks(assemble.project_blocks(_selected(spark, d))), inputs.tasks(spark, d))


def prompt_references(spark, d):
    """Every chunk of every prompt by address; texts are stored once and do not meet the tasks."""
    return store.references(_store(spark, d))


def prompt_contents(spark, d):
    """The different texts of all prompts, each once."""
    return _store(spark, d).contents.select("address", "n_chars")


def conversations_joined(spark, d):
    joined = chunks.text_chunks(inputs.turns(spark, d), ["conv_id"], ["turn"], "block")
    return joined.select("conv_id", "chunk_no", "n_chars", text.sha256(F.col("chunk")).alias("chunk_sha256"))


def _task_files(spark, d):
    return assemble.task_files(inputs.tasks(spark, d), inputs.corpus(spark, d).drop("content"))


def task_files(spark, d):
    return _task_files(spark, d).select("task_id", "path", "seq")


def task_selection(spark, d):
    """Every task with its own include and rule lists."""
    chosen = roots.expand_by_table(_task_files(spark, d), inputs.task_includes(spark, d))
    classified = selection.classify_by_table(chosen, inputs.task_rules(spark, d), ["task_id"])
    return classified.select("task_id", "path", "first_pattern", "verdict", "first_rule")


def run_prepared(spark, d):
    """Tasks with texts, includes, rules and remote sources of their own, from requests to prompts measured whole."""
    found = run.select_each(
        inputs.landed(spark, d), inputs.own_requests(spark, d), inputs.task_contents(spark, d),
        inputs.task_includes(spark, d), inputs.task_rules(spark, d), inputs.remote_registry(spark, d),
    )
    return assemble.prompt_totals(found.chosen, found.tasks, ["profile"])


def run_remotes(spark, d):
    """The folder of each remote source of each task."""
    tasks = inputs.own_requests(spark, d)
    return profiles.remote_folders(tasks, inputs.task_includes(spark, d), inputs.remote_registry(spark, d)).drop("project", "branch")


def prompt_totals(spark, d):
    return assemble.prompt_totals(_selected(spark, d), inputs.tasks(spark, d))


def _remotes(spark, d, tasks):
    # Sources are dealt to all tasks, whose ids run from 0.
    n_tasks = F.lit(max(tasks.count(), 1)).cast("bigint")
    return naming.normalize_sources(inputs.sources(spark, d)).select(
        (F.col("page_id") % n_tasks).alias("task_id"), "base_url", "branch", "commit",
        F.concat(F.lit(inputs.CHECKOUTS), F.col("page_id").cast("string")).alias("folder"),
    )


def task_manifest(spark, d):
    files = _selected(spark, d)
    tasks = inputs.tasks(spark, d)
    manifest = assemble.task_manifest(files, tasks, assemble.prompt_totals(files, tasks), _remotes(spark, d, tasks))
    return manifest.select("task_id", "name", "n_sources", "sources_text", "models_text", "est_tokens")


def manifest_chunks(spark, d):
    """The source lines of every manifest whole, whatever their number."""
    tasks = inputs.tasks(spark, d)
    files = _classified(spark, d).filter(F.col("verdict") == selection.INCLUDED)
    cut = assemble.manifest_chunks(files, tasks, _remotes(spark, d, tasks), chunk_chars=MANIFEST_CHARS)
    return cut.select("task_id", "chunk_no", "n_chars", text.sha256(F.col("chunk")).alias("chunk_sha256"))


def tasks_intake(spark, d):
    taken = settings.intake_tasks(inputs.task_requests(spark, d), inputs.task_contents(spark, d))
    return taken.select("task_id", "definition", "error", "skip_reason")


def slugs(spark, d):
    return inputs.files(spark, d).select(F.col("doc_id").alias("id"), text.slugify(F.col("content")).alias("slug"))


def result_names(spark, d):
    return naming.result_names(inputs.tasks(spark, d))


def sources_normalized(spark, d):
    return naming.normalize_sources(inputs.sources(spark, d)).select("page_id", "base_url", "branch", "repo_key", "repo_name")


def folder_mapping(spark, d):
    return naming.folder_mapping(inputs.folders(spark, d))


def next_numbers(spark, d):
    return naming.next_numbers(inputs.folders(spark, d))


def params_typed(spark, d):
    typed = settings.coerce_params(inputs.params(spark, d))
    return typed.select("task_id", "model", "k", "ordinal", F.col("typed.type").alias("type"), "value_text")


def params_split(spark, d):
    return settings.split_params(inputs.flat_params(spark, d)).select("run", "model", "k", "v", "ordinal", "error")


def params_latest(spark, d):
    saved, given = inputs.param_layers(spark, d)
    keys = ["task_id", "model", "k"]
    prior = naming.latest_wins(saved, keys, ["ordinal"], "v")
    return naming.latest_wins(given, keys, ["ordinal"], "v", prior)


def _overrides(spark, d):
    return settings.merge_overrides(inputs.param_layers(spark, d))


def overrides(spark, d):
    return _overrides(spark, d).select("task_id", "model", "k", "type", "value_text")


def settings_resolved(spark, d):
    return settings.resolve_settings(inputs.settings(spark, d), additive=("error",))


def _plan(spark, d):
    return dispatch.dispatch_plan(inputs.tasks(spark, d), settings.overrides_by_model(_overrides(spark, d)))


def dispatch_plan(spark, d):
    return _plan(spark, d).select("task_id", "model", "route", "initial_status")


def requests(spark, d):
    fields = dispatch.request_fields(_plan(spark, d).filter(F.col("route") == "api"))
    return fields.join(prompts(spark, d), "task_id").select(
        "task_id", "model", "temperature", "timeout", "n_overrides", "chunk_no", "chunk_sha256"
    )


def _responses(spark, d):
    return read_response_log(inputs.response_log(spark, d))


def responses_parsed(spark, d):
    return _responses(spark, d).select("request_id", "content", "generation_id", "tokens_prompt", "tokens_completion", "error")


def lookups(spark, d):
    return results.distinct_lookups(_responses(spark, d))


def attempts_resolved(spark, d):
    return results.resolve_attempts(inputs.attempts(spark, d)).drop("last_code")


def _usage(spark, d):
    return results.attach_generation(_responses(spark, d), inputs.generation(spark, d))


def usage_joined(spark, d):
    return _usage(spark, d).select("request_id", "cost", "tokens_prompt", "tokens_completion", "total_tokens", "cost_known")


def _final(spark, d):
    """Responses with the details and outcomes of their lookups, settled in one plan."""
    outcomes = results.resolve_attempts(inputs.lookup_log(spark, d))
    usage = results.attach_generation(_responses(spark, d), inputs.generation(spark, d), outcomes)
    return results.finalize_results(usage, inputs.STAMP, carried=("task_id",))


def results_final(spark, d):
    return _final(spark, d).select("request_id", "status", text.sha256(F.col("result")).alias("result_sha256"), "error")


def answers_costs(spark, d):
    """Costs per task of the settled answers: log, lookups, details, results and sums end to end."""
    return results.run_costs(_final(spark, d))


def run_costs(spark, d):
    return results.run_costs(inputs.results(spark, d))


def secrets_masked(spark, d):
    masked = text.mask_keys(F.col("text"))
    return inputs.table(spark, d, "documents").select(
        "doc_id", F.size(text.find_keys(F.col("text"))).cast("bigint").alias("n_masked"), text.sha256(masked).alias("text_sha256")
    )


def _status(spark, d):
    return status.latest_status(inputs.status_events(spark, d))


def latest_status(spark, d):
    stamp = F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return _status(spark, d).select("run", "model", "status", stamp.alias("last_ts"))


def run_progress(spark, d):
    return status.run_progress(_status(spark, d))


def context_by_source(spark, d):
    """Flagship: the assembled context of every source, chunk by chunk."""
    bodies = assemble.body_chunks(assemble.project_blocks(_selected(spark, d)))
    return bodies.select(
        F.col("project").alias("source"), "chunk_no", "n_chars",
        text.estimate_tokens(F.col("n_chars")).alias("est_tokens"), text.sha256(F.col("chunk")).alias("chunk_sha256"),
    )


QUERIES = {
    q.__name__: q
    for q in (
        files_classified, files_classified_by_project, selection_counts, rules_parsed, effective_excludes,
        includes_expanded, includes_split, search_paths, roots_kept, files_under_roots, doc_tokens, tokens_by_ratio,
        paths_relative, folder_tokens, top_folders, path_order, blocks, prompt_parts, prompts, prompt_references, prompt_contents, conversations_joined,
        task_files, task_selection, run_prepared, run_remotes, prompt_totals, task_manifest, manifest_chunks, tasks_intake, slugs, result_names, sources_normalized, registry_resolved,
        folder_mapping, next_numbers, params_typed, params_split, params_latest, overrides, settings_resolved,
        dispatch_plan, requests, responses_parsed, lookups, attempts_resolved, usage_joined, results_final, answers_costs, run_costs,
        secrets_masked, latest_status, run_progress, context_by_source,
    )
}
