"""Corpus pipeline: the stages in order, each written as Parquet and read again as the next one's documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Contract. No documents make no rows. A null text, or one without a letter, has no language and goes in the first stage.
Null ids and sources are kept. Rows that share an id count as one document in the second stage, which drops an id with
all of its rows; rows that are the same in every column stay rows of their own. Extra columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.llm import langid_centroid, minmax_dedup, mixing, pii_crf, sentencepiece_lattice
from strataloom.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language's centroid stay, labelled with the predicted language."""
    model = langid_centroid.fit(langid_centroid.train_rows(docs))
    kept = langid_centroid.predict(docs.select(*COLUMNS), model).where("accepted")
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the least id stays."""
    found = minmax_dedup.near_duplicates(docs, k=5)
    dropped = found.where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text gives way to its kind in brackets."""
    cleaned = pii_crf.find(docs.select(*COLUMNS), pii_crf.fit(docs.select("doc_id", "text")), redact=True)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that are the same share out what the mix takes of them all."""
    key = F.xxhash64(F.col("doc_id").cast("long"), "source", "text")
    mixed = mixing.mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"))
    copies = staged(mixed.groupBy("row_key").agg(F.sum("copies").alias("total"), F.count("*").alias("n")).where("total > 0"), "copies")
    keyed = docs.select(*COLUMNS).withColumn("row_key", key)
    once = keyed.join(copies.where("n = 1"), "row_key").withColumn("times", F.col("total"))
    place = F.row_number().over(W.partitionBy("row_key").orderBy("lang", "n_chars"))
    more = keyed.join(copies.where("n > 1"), "row_key").withColumn("place", place)
    more = more.withColumn("times", F.floor(F.col("total") / F.col("n")) + (F.col("place") <= F.col("total") % F.col("n")).cast("long"))
    taken = once.select(*COLUMNS, "times").union(more.select(*COLUMNS, "times")).where("times > 0")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document that the mix took."""
    coded = sentencepiece_lattice.encode(docs.select("doc_id", "lang", "source", "text"), verified="lossless")
    return coded.withColumn("n_pieces", F.size("piece_ids"))


STAGES = [
    ("language ID", language),
    ("near duplicates", deduplicate),
    ("personal data", redact),
    ("mixing", mix),
    ("SentencePiece", tokenize),
]

#: Learnt models and hashes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
