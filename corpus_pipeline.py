"""Training corpus from raw documents: five stages, each written and read again by the next."""

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from corpusctx.llm import bpe, langid, neardup, packing, pii, toxicity
from corpusctx.sources.scratch import scratch_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_filter(spark, docs, sf_dir):
    """Documents that the classifier trained on ``labels`` doesn't find toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.fit(docs, labels))
    return scored.where("predicted = 0").select(*COLUMNS)


def language_filter(spark, docs, sf_dir):
    """Documents that the field finds to be in their language, and in one; ``lang`` stays as it is.

    Texts without a letter, gibberish, code-switched texts and texts in another language than their ``lang`` go.
    """
    return langid.in_one_language(docs.select(*COLUMNS), langid.fit(docs)).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies, the one with the smallest id; of repeated ids one row."""
    kept = neardup.near_duplicates(docs, size=5).where("kept").groupBy("doc_id").agg(F.count("*").alias("rows"))
    repeated = kept.where("doc_id IS NOT NULL").agg(F.max("rows")).first()[0]
    one = docs.select(*COLUMNS).join(kept.where("doc_id IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    if (repeated or 0) > 1:
        one = one.dropDuplicates(["doc_id"])
    return one.union(docs.select(*COLUMNS).where("doc_id IS NULL"))


def sanitised(spark, docs, sf_dir):
    """Texts without personal data; ``n_chars`` counts what is left."""
    clean = pii.sanitise(docs.select(*COLUMNS))
    n_chars = F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n_chars).select(*COLUMNS)


def packed(spark, docs, sf_dir):
    """Windows of tokens in the corpus's own mixture of sources, as pieces with their ids."""
    return packing.pack(docs, bpe.Vocabulary(VOCABULARY))


# Texts of thousands of bytes: a worker should hold a few megabytes of them at once, not Spark's defaults (in the first column).
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),
}
STAGES = [("toxicity", toxicity_filter), ("language", language_filter), ("near_dedup", near_dedup), ("pii", sanitised), ("packing", packed)]
# Trained classifiers, sketches and token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply all stages to ``documents``; between stages the rows are written and read again.

    Batches to Python workers are made smaller in a session that leaves them at Spark's defaults.
    """
    for key, (default, own) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{scratch_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
