"""Tasks, layered settings and model parameters."""

from functools import reduce

from pyspark.sql import functions as F

from corpusctx.functions import params, text

# Fixed value: parameters come as model, key, value.
PARAM_GROUP = 3


def intake_tasks(requests, contents, carried=()):
    """Settle each task's text from an inline value or a file; ``error`` says why a row cannot run.

    ``requests``: task_id, name, inline, task_file, models; ``contents``: task_file, content.
    ``skip_reason`` marks good tasks that are not worth dispatching. Columns named in ``carried`` stay.
    """
    asked = requests.select("task_file").distinct()
    contents = contents.select("task_file", F.col("content").alias("_text")).join(asked, "task_file", "left_semi")
    joined = requests.join(contents, "task_file", "left")
    error = (
        F.when(F.coalesce("name", F.lit("")) == "", "name is required")
        .when(F.col("inline").isNotNull() & F.col("task_file").isNotNull(), "give either a task text or a task file")
        .when(F.col("inline").isNull() & F.col("task_file").isNull(), "a task text or a task file is required")
        .when(F.col("inline").isNull() & F.col("_text").isNull(), "task file cannot be read")
    )
    definition = F.when(error.isNull(), F.coalesce("inline", text.unify_newlines(F.col("_text"))))
    return joined.select(
        "task_id",
        "name",
        "models",
        definition.alias("definition"),
        error.alias("error"),
        F.when(error.isNull(), skip_reason(F.col("models"), definition)).alias("skip_reason"),
        *carried,
    )


def skip_reason(models, definition):
    """Why a task is not sent to any model; null when it is."""
    return F.when(F.coalesce(F.size(models), F.lit(0)) <= 0, "no models").when(text.is_blank(definition), "empty definition")


def dispatchable_tasks(tasks):
    return tasks.filter(skip_reason(F.col("models"), F.col("definition")).isNull())


def resolve_settings(settings, additive=("exclude",), keys=("project", "k")):
    """Effective settings from layered rows (project, layer, ordinal, k, v); null is not set.

    Replacing keys keep the value of the highest layer that sets them, one row each.
    Additive keys keep every distinct value, one row each, with the lowest layer having it.
    """
    present = settings.filter(F.col("v").isNotNull())
    adds = F.col("k").isin(*additive)
    top = F.max(F.struct("layer", "ordinal", "v"))
    replaced = present.filter(~adds).groupBy(*keys).agg(top.alias("t")).select(*keys, "t.v", F.col("t.layer").alias("from_layer"))
    added = present.filter(adds).groupBy(*keys, "v").agg(F.min("layer").alias("from_layer"))
    return replaced.unionByName(added)


def split_params(flat, column="params"):
    """Rows (model, k, v, ordinal) from a flat list cell; a short last group gives ``error`` instead."""
    size = F.size(column)
    groups = F.when(
        size >= PARAM_GROUP, F.sequence(F.lit(1), F.floor(size / PARAM_GROUP).cast("int"))
    ).otherwise(F.array().cast("array<int>"))
    whole = F.transform(
        groups,
        lambda g: F.struct(
            F.get(column, (g - 1) * PARAM_GROUP).alias("model"),
            F.get(column, (g - 1) * PARAM_GROUP + 1).alias("k"),
            F.get(column, (g - 1) * PARAM_GROUP + 2).alias("v"),
            g.cast("bigint").alias("ordinal"),
        ),
    )
    rest = [c for c in flat.columns if c != column]
    bad = size % PARAM_GROUP != 0
    good = flat.filter(~bad).select(*rest, F.inline(whole)).withColumn("error", F.lit(None).cast("string"))
    none = {c: F.lit(None).cast(t) for c, t in (("model", "string"), ("k", "string"), ("v", "string"), ("ordinal", "bigint"))}
    wrong = flat.filter(bad).select(*rest, *[v.alias(c) for c, v in none.items()]).withColumn(
        "error", F.lit("expected groups of model, key, value")
    )
    return good.unionByName(wrong)


def coerce_params(rows):
    """Add the typed value of ``v`` and its text form."""
    return params.coerce(rows).withColumn("value_text", params.value_text(F.col("typed")))


def merge_overrides(layers, keys=("task_id", "model", "k")):
    """Overlay parameter rows (keys, ordinal, v), first layer weakest; empty text clears a key."""
    stacked = reduce(
        lambda a, b: a.unionByName(b),
        [df.select(*keys, F.lit(i).alias("layer"), "ordinal", "v") for i, df in enumerate(layers)],
    )
    latest = stacked.groupBy(*keys).agg(F.max_by("v", F.struct("layer", "ordinal")).alias("v"))
    typed = coerce_params(latest).withColumn("type", F.col("typed.type"))
    return typed.filter(F.col("type") != "clear").select(
        *keys, "type", "value_text", params.value_json(F.col("typed")).alias("value_json")
    )


def overrides_by_model(overrides, keys=("task_id", "model")):
    """Overrides of each model as one map cell from key to JSON value."""
    entry = F.struct("k", "value_json")
    return overrides.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("overrides"))
