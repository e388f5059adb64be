"""A whole run over tables: select, measure and assemble before the models, reconcile after."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpusctx.functions.text import DEFAULT_RATIO
from corpusctx.operators import assemble, dispatch, measure, profiles, results, roots, selection, settings
from corpusctx.operators.joins import join_on
from corpusctx.sources.responses import read_response_log
from corpusctx.sources.scratch import materialize


@dataclass
class Prepared:
    """Everything known before a model is asked. Building it sums sizes and orders paths; the rest is computed when used.

    ``chunks`` holds every character of every prompt; ``prompts`` are the whole texts that requests
    need, null beyond one cell. ``tasks`` and ``bodies`` are what ``prompt_store`` takes to keep them
    once, by ``keys``; ``remotes`` are the folders of remote includes, where tasks name any.
    """

    classified: DataFrame
    counts: DataFrame
    folders: DataFrame
    totals: DataFrame
    chunks: DataFrame
    prompts: DataFrame
    manifest: DataFrame
    manifest_chunks: DataFrame
    plan: DataFrame
    requests: DataFrame
    tasks: DataFrame
    bodies: DataFrame
    keys: tuple
    remotes: DataFrame | None = None


def prepare(
    files,
    tasks,
    includes=(roots.WHOLE_ROOT,),
    ignore=(),
    excludes=(),
    param_layers=(),
    keys=("project",),
    templates=assemble.Templates(),
    ratio=DEFAULT_RATIO,
):
    """Prepare every task of a table at once.

    ``files``: project, path, content (and read_error); ``tasks``: task_id, name, definition,
    project, models. The given excludes come on top of the built-in ones. Remote includes are
    expected to be landed among the files already.
    """
    if roots.local_includes(includes) and roots.WHOLE_ROOT not in includes:
        files = roots.expand_includes(files, includes).drop("first_pattern")
    patterns = {r.pattern: r for r in selection.as_rules([*selection.DEFAULT_EXCLUDES, *excludes])}
    classified = selection.classify_files(files, ignore, [patterns[p] for p in sorted(patterns)])
    return _prepared(classified, selection.included(classified), tasks, list(keys), param_layers, templates, ratio)


def _prepared(classified, chosen, tasks, keys, param_layers, templates, ratio, remotes=None):
    totals = assemble.prompt_totals(chosen, tasks, keys, templates, ratio)
    blocks = assemble.project_blocks(chosen, templates)
    bodies = assemble.body_chunks(blocks, keys)
    prompts = assemble.assemble_prompts(assemble.assemble_bodies(blocks, keys), tasks, keys, templates)
    overrides = settings.overrides_by_model(settings.merge_overrides(param_layers)) if param_layers else None
    plan = dispatch.dispatch_plan(tasks, overrides)
    return Prepared(
        classified=classified.drop("content"),
        counts=selection.selection_counts(classified, keys),
        folders=measure.top_folders(measure.folder_tokens(chosen, keys, ratio), keys),
        totals=totals,
        chunks=assemble.prompt_chunks(bodies, tasks, keys=keys, templates=templates),
        prompts=prompts,
        manifest=assemble.task_manifest(chosen, tasks, totals, remotes, keys=keys),
        manifest_chunks=assemble.manifest_chunks(chosen, tasks, remotes, keys=keys),
        plan=plan,
        requests=dispatch.build_requests(plan, prompts),
        tasks=tasks,
        bodies=bodies,
        keys=tuple(keys),
        remotes=remotes,
    )


@dataclass
class Selected:
    """What tasks with lists of their own look at: ``tasks`` with their profile, the folders of their ``remotes``,
    the ``classified`` paths of each profile, and its ``chosen`` files with contents."""

    tasks: DataFrame
    remotes: DataFrame
    classified: DataFrame
    chosen: DataFrame


def select_each(files, requests, contents, includes, rules, registry, builtin=selection.DEFAULT_EXCLUDES, checkout="checkouts"):
    """Settle and select for tasks that each have a text, includes, rules and remote sources of their own.

    ``requests``: task_id, project, name, inline, task_file, models, with texts from ``contents``
    (task_file, content); requests with an error go no further. ``includes``: task_id, ordinal,
    pattern; ``rules``: task_id, rule_set, ordinal, pattern; ``registry``: project, repo_key, folder
    (and commit) of the sources that have a folder. Remote includes get folders, known ones first
    and new ones numbered after them, and files that lie below ``checkout`` in such a folder belong
    to the tasks that ask for it. Tasks that select alike share one profile, whose files are
    selected once. (project, path) must be unique in ``files``.
    """
    taken = settings.intake_tasks(requests, contents, carried=("project",)).where("error IS NULL").drop("error", "skip_reason")
    tasks = profiles.select_profiles(taken, includes, rules)
    remotes = materialize(profiles.remote_folders(tasks, includes, registry, checkout), "remote_folders")
    looked = profiles.chosen_files(files, tasks, includes, remotes)
    classified = selection.classify_by_table(looked, profiles.profile_rules(rules, tasks, builtin), ["profile"])
    classified = materialize(classified, "classified")
    chosen = join_on(files, selection.included(classified).select("profile", "project", "path"), ["project", "path"])
    return Selected(tasks, remotes, classified, chosen)


def prepare_each(files, requests, contents, includes, rules, registry, param_layers=(), templates=assemble.Templates(), ratio=DEFAULT_RATIO, **places):
    """``select_each`` and everything before the models are asked, by profile: a context is built once for all tasks that share it."""
    found = select_each(files, requests, contents, includes, rules, registry, **places)
    return _prepared(found.classified, found.chosen, found.tasks, ["profile"], param_layers, templates, ratio, found.remotes)


def reconcile(log, generation, timestamp, attempts=None):
    """Final results of a response log (request_id, task_id, model, raw) and their costs per task.

    An ``error`` column of the log, as the dispatcher leaves it, wins over what the body says.
    ``generation`` holds the details found; ``attempts`` the log of lookups, which tells why
    details are missing.
    """
    # Written once: a lazy log would ask its provider again at every use.
    log = materialize(log, "answers")
    outcomes = None if attempts is None else results.resolve_attempts(attempts)
    usage = results.attach_generation(read_response_log(log), generation, outcomes)
    final = results.finalize_results(usage, timestamp, carried=("task_id",))
    return final, results.run_costs(final)
