"""The corpus pipeline, stage by stage, on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from strataloom.llm import mixing
from strataloom.llm.common import staged


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "personal data":
            assert docs.where("text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9-]+'").count() == 0
    assert counts[1] >= 0.97 * counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[5] == counts[4] > 0
    assert docs.where("NOT lossless").count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, "/nowhere"), "nothing")
        assert docs.count() == 0


def test_stages_with_odd_rows(spark):
    """Nulls in every column, empty, repeated and long texts, and a clashing extra column, through all stages."""
    sf_dir = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    text = real.where("lang = 'en' AND length(text) > 500").first().text
    clean = "Plain prose about rivers and houses, " * 30 + "and nothing else."
    odd = [(90_000, None, None, None, None), (90_001, "", "en", "s", 0), (None, clean.replace("river", "tower"), None, None, None), (90_002, text, None, None, None), (90_003, "x" * 200_000, "en", None, 1), (90_004, clean, "en", "s", 5), (90_004, clean, "en", "s", 5), (90_005, clean.replace("houses", "ships"), "en", None, None)]
    docs = real.unionByName(spark.createDataFrame(odd, SCHEMA)).withColumn("kept", F.lit("x")).withColumn("copies", F.lit(1))
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        counts[name] = docs.count()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language ID":
            assert not {90_000, 90_001} & ids
        if name == "near duplicates":
            assert 90_002 not in ids and 90_004 in ids and docs.where("doc_id = 90004").count() == 2
    assert counts["SentencePiece"] == counts["mixing"] > 0


def test_the_mix_of_repeated_rows(spark):
    """Rows that are the same share out the copies of them all: the stage takes as many words as the mix."""
    rows = [(i % 40, "word " * (10 + 7 * (i % 40)), "en", "ab"[i % 2], i % 3) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = corpus_pipeline.mix(spark, docs, "/nowhere").groupBy("doc_id").count().collect()
    want = mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    assert {r.doc_id: r["count"] for r in taken} == {r.doc_id: r.n for r in want}
