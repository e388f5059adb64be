"""Typed values from parameter strings."""

from pyspark.sql import Column, functions as F

from corpusctx.functions.text import json_literal, strip

_DIGITS = "[0-9]+(?:_[0-9]+)*"
NUMBER = rf"\A[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
NOT_FINITE = r"(?i)\A[+-]?(?:nan|inf|infinity)\z"

# Integral values at or past this size do not fit BIGINT and stay floating point.
_INT_LIMIT = 9.2e18


def coerce(rows, value="v", out="typed"):
    """Add ``out``, a struct(type, i, d, b, s); type is int, float, bool, string or clear (empty text).

    Built in steps, so each regex runs once per row.
    """
    bare, number, kind = F.col("_bare"), F.col("_number"), F.col("_kind")
    integral = (number == F.rint(number)) & (F.abs(number) < _INT_LIMIT)
    special = (
        F.when(F.lower(bare).contains("nan"), F.lit(float("nan")))
        .when(F.startswith(bare, F.lit("-")), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    staged = (
        rows.withColumn("_bare", strip(F.col(value)))
        .withColumn("_number", F.when(bare.rlike(NUMBER), F.replace(bare, F.lit("_"), F.lit(""))).try_cast("double"))
        .withColumn(
            "_kind",
            F.when(F.col(value) == "", "clear")
            .when(integral, "int")
            .when(number.isNotNull(), "float")
            .when(F.lower(value).isin("true", "false"), "bool")
            .when(bare.rlike(NOT_FINITE), "float")
            .otherwise("string"),
        )
    )
    typed = F.struct(
        kind.alias("type"),
        F.when(kind == "int", number).try_cast("bigint").alias("i"),
        F.when(kind == "float", F.coalesce(number, special)).alias("d"),
        F.when(kind == "bool", F.lower(value) == "true").alias("b"),
        F.when(kind == "string", F.col(value)).alias("s"),
    )
    return staged.withColumn(out, typed).drop("_bare", "_number", "_kind")


def value_text(typed) -> Column:
    return F.coalesce(
        typed["i"].cast("string"), typed["d"].cast("string"), typed["b"].cast("string"), typed["s"]
    )


def value_json(typed) -> Column:
    """JSON text of a typed value. JSON has no numbers that are not finite: they become strings."""
    number = typed["d"].cast("string")
    finite = ~F.isnan(typed["d"]) & (F.abs(typed["d"]) < float("inf"))
    return F.coalesce(
        typed["i"].cast("string"), F.when(finite, number), F.when(number.isNotNull(), json_literal(number)), typed["b"].cast("string"), json_literal(typed["s"])
    )
