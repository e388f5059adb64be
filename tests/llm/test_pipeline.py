"""The registered queries and the pipeline's stages, each stage judged on its own input."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from corpusctx.llm import neardup, pii

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} <= {q.split("_")[0] for q in contract.queries()}


def test_queries_return_every_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in contract.EXTRA.items():
        if name.startswith("op") and name not in ("op2_ann", "op8_packing", "op11_collocations"):
            assert query(spark, SF).count() == n, name


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    awkward = [(90_001, None, None, None, 0), (90_002, "", "en", "a", 0), (90_003, "12 !", "en", None, 4), (None, "no id here", "en", "a", 10)]
    docs = docs.union(spark.createDataFrame(awkward, docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
        before, after = {r.doc_id: r.text for r in docs.collect()}, [r.doc_id for r in out.collect()]
        if name == "toxicity":
            assert len(after) > 0.7 * len(before)
        elif name == "language":
            assert set(before) - set(after) == {i for i in (90_001, 90_002, 90_003) if i in before}
        elif name == "near_dedup":
            kept = {r.doc_id for r in neardup.near_duplicates(docs, 5).where("kept").collect()}
            assert sorted(after, key=str) == sorted(kept, key=str)
        elif name == "pii":
            assert set(after) == set(before) and all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in out.collect())
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert sum(r.length for r in out.collect()) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in before.values())
        docs = out
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_language_stage_judges_by_the_field(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.lang: r.text for r in docs.where("n_chars BETWEEN 900 AND 1500 AND text NOT LIKE '%!!%'").orderBy("doc_id").collect()}
    gibberish = "xqzt vvkp wrrrt zzgh qqpl mnbv xkcd pqrs tvwx zbcd ghjk lmnp"
    rows = [(90_001, gibberish, "en"), (90_002, text["en"][:500] + " " + text["de"][:500], "en"), (90_003, text["es"], "en"), (90_004, text["en"], None), (90_005, "Re.", "en")]
    added = docs.union(spark.createDataFrame([(i, t, lang, "a", len(t)) for i, t, lang in rows], docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_filter(spark, added, SF).collect()}
    assert kept & {i for i, _, _ in rows} == {90_004, 90_005}
    assert len(kept) >= 0.99 * docs.count()
    unlabelled = added.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_filter(spark, unlabelled, SF).count() == added.count()
