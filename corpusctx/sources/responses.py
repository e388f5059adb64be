"""Response logs: raw JSON bodies to columns."""

from pyspark.sql import functions as F

EMPTY_CONTENT = "no content in the answer"
BAD_BODY = "the answer is not JSON"
NO_CHOICES = "no choices in the answer"


def read_response_log(df, raw="raw"):
    """Content, generation id, token counts and error of each response body.

    The body is parsed once into a VARIANT; ``usage`` may be a number or an object.
    """
    parsed = df.withColumn(
        "_v", F.when(F.endswith(F.rtrim(F.col(raw), F.lit(" \t\r\n")), F.lit("}")), F.try_parse_json(F.col(raw)))
    )

    def field(path, kind="string"):
        return F.try_variant_get("_v", path, kind)

    def text(path):
        return F.nullif(field(path), F.lit(""))

    choices = F.size(field("$.choices", "array<variant>"))
    error = (
        F.when(F.col("_v").isNull(), BAD_BODY)
        .when(choices == 0, NO_CHOICES)
        .when(text("$.choices[0].message.content").isNull(), EMPTY_CONTENT)
    )
    if "error" in df.columns:  # the request itself failed
        error = F.coalesce("error", error)
    rest = [c for c in df.columns if c not in (raw, "error")]
    return parsed.select(
        *rest,
        text("$.choices[0].message.content").alias("content"),
        F.coalesce(text("$.id"), text("$.usage.generation_id")).alias("generation_id"),
        F.coalesce(field("$.usage.prompt_tokens", "bigint"), F.lit(0)).cast("bigint").alias("tokens_prompt"),
        F.coalesce(field("$.usage.completion_tokens", "bigint"), F.lit(0)).cast("bigint").alias("tokens_completion"),
        field("$.usage.total_tokens", "bigint").alias("reported_total"),
        error.alias("error"),
    )
