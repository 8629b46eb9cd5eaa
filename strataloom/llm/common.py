"""What the training-data operators share: tables, the shared folder, words and skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); only where it is unset, a new one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one."""
    return f"{shared_dir(spark)}/strataloom-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged; to be called once its results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_bucket(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds (null ids count as fold 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def lookup(left: DataFrame, keyed: DataFrame, key: str, spread: Column, heavy_parts: int = 2000, join: str | None = None, total: int | None = None) -> DataFrame:
    """Left join to a table with one row per `key` and `n_key`, the number of left rows that have it.

    Keys with over total/heavy_parts rows number fewer than heavy_parts, so they are broadcast; their rows
    are then dealt out by `spread` instead of the key, and no task gets more than a small share of the rows.
    `join` names a join strategy for the rest, so that plans are alike at every size; `total` is the sum of n_key, where
    it is known.
    """
    values = [c for c in keyed.columns if c not in (key, "n_key")]
    total = keyed.agg(F.sum("n_key")).first()[0] or 0 if total is None else total
    heavy = F.col("n_key") > max(total // heavy_parts, 1000)
    hot = keyed.where(heavy).select(key, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot"))
    cold = keyed.where(~heavy).select(F.col(key).alias("_cold_key"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    marked = left.join(F.broadcast(hot), key, "left")
    numeric = left.schema[key].dataType.typeName() == "long"
    elsewhere = F.xxhash64(spread, F.lit(1)) if numeric else F.concat(F.lit("~"), F.xxhash64(spread).cast("string"))
    dealt = F.coalesce(F.when(F.col("_hot").isNull(), F.col(key)), elsewhere)
    cold = cold.withColumnRenamed("_cold_key", "_dealt")
    cold = cold.hint(join) if join else cold
    joined = marked.withColumn("_dealt", dealt).join(cold, "_dealt", "left")
    both = [F.coalesce(F.col(f"_hot_{c}"), F.col(f"_cold_{c}")).alias(c) for c in values]
    return joined.select(*[left[c] for c in left.columns], *both)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A counter-based generator: 64 well-mixed bits for each 64-bit input."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(texts: list[str], limit: int = 500_000):
    """Index ranges of `texts` with at most about `limit` characters each, and at least one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
