"""Filters over subjects, variants, samples and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VARIANT = ["chrom", "pos", "ref", "alt"]


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without null in the columns used; others may be null."""
    return df.dropna(subset=cols)


def subset(df: DataFrame, cols: list[str], tuples: list[tuple]) -> DataFrame:
    """Rows whose `cols` equal one of the tuples; `subgroup` is the first such tuple's index."""
    index = F.coalesce(*[F.when(F.expr("true") if not t else _equals(cols, t), F.lit(i)) for i, t in enumerate(tuples)])
    return df.withColumn("subgroup", index).where("subgroup IS NOT NULL")


def _equals(cols: list[str], values: tuple):
    found = F.lit(True)
    for c, v in zip(cols, values, strict=True):
        found = found & (F.col(c) == F.lit(v))
    return found


def extract(variants: DataFrame, chrom, start: int | None = None, end: int | None = None, overlap: bool = False) -> DataFrame:
    """A chromosome, or its closed position range; with `overlap` also records whose REF reaches into the range."""
    found = variants.where(F.col("chrom") == chrom)
    if start is not None:
        first = F.col("pos") + F.length("ref") - 1 if overlap else F.col("pos")
        found = found.where((first >= start) & (F.col("pos") <= end))
    return found


def extract_list(variants: DataFrame, listed: DataFrame, order: str) -> DataFrame:
    """Variants at listed (chrom, pos); of several records at a position the first by `order`."""
    first = W.partitionBy("chrom", "pos").orderBy(order)
    hit = variants.join(listed.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")
    return hit.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def biallelic(variants: DataFrame) -> DataFrame:
    return variants.where((F.size(F.split("alt", ",")) <= 1) | (F.col("alt") == "."))


def pass_only(variants: DataFrame) -> DataFrame:
    return variants.where(F.col("filter") == "PASS")


def all_phased(gt: DataFrame, key: str = "variant") -> DataFrame:
    """Variants of which every sample is phased."""
    return gt.groupBy(key).agg(F.bool_and("phased").alias("ok")).where("ok").select(key)


def no_missing_gt(gt: DataFrame, key: str = "variant", g: str = "g") -> DataFrame:
    """Variants without a missing genotype."""
    return gt.groupBy(key).agg(F.bool_and(F.col(g).isNotNull()).alias("ok")).where("ok").select(key)


def min_alt_count(gt: DataFrame, k: int, samples: DataFrame | None = None, key: str = "variant") -> DataFrame:
    """(key, alt_count) of variants with at least k ALT alleles among the samples."""
    rows = gt if samples is None else gt.join(samples, "iid", "left_semi")
    return rows.groupBy(key).agg(F.sum(F.coalesce("g", F.lit(0))).cast("long").alias("alt_count")).where(F.col("alt_count") >= k)


def min_allele_count(gt: DataFrame, k: int, samples: DataFrame | None = None, key: str = "variant") -> DataFrame:
    """Variants of which each allele 0 ... n_alt occurs at least k times; `alleles array<int>`, `n_alt int`."""
    rows = gt if samples is None else gt.join(samples, "iid", "left_semi")
    possible = rows.groupBy(key).agg(F.max("n_alt").alias("n_alt")).select(key, F.explode(F.sequence(F.lit(0), "n_alt")).alias("allele"))
    seen = rows.select(key, F.explode("alleles").alias("allele")).groupBy(key, "allele").agg(F.count("*").alias("n"))
    least = possible.join(seen, [key, "allele"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("least"))
    return least.where(F.col("least") >= k)


def by_id(variants: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Include or exclude by `id`; where both are given the include list is ignored."""
    if exclude is not None:
        return variants.join(exclude, "id", "left_anti")
    return variants if include is None else variants.join(include, "id", "left_semi")


def subset_samples(gt: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    if include is not None:
        gt = gt.join(include, "iid", "left_semi")
    return gt if exclude is None else gt.join(exclude, "iid", "left_anti")


def group_filter(stats: DataFrame, maf_ub: float = 0.05, cr_lb: float = 0.0, fold: bool = False) -> DataFrame:
    """Variants of a gene analysis: frequency bound (of ALT, or folded) and least call rate."""
    af = F.least("alt_af", 1 - F.col("alt_af")) if fold else F.col("alt_af")
    return stats.where((af <= maf_ub) & (F.col("call_rate") >= cr_lb))


def flag_filter(reads: DataFrame, require: int = 0, exclude: int = 0) -> DataFrame:
    flag = F.col("flag")
    return reads.where((flag.bitwiseAND(F.lit(exclude)) == 0) & (flag.bitwiseAND(F.lit(require)) == require))


def reads_in_region(reads: DataFrame, rname, start: int, end: int, overlap: bool = True) -> DataFrame:
    """Reads that overlap [start, end), or lie within it; `align_end` is inclusive."""
    within = (F.col("pos") < end) & (F.col("align_end") >= start) if overlap else (F.col("pos") >= start) & (F.col("align_end") < end)
    return reads.where((F.col("rname") == rname) & within)


def outcome_errors(df: DataFrame, model: str) -> DataFrame:
    """One row: rows whose outcome the model can't take (logistic: y; cox: status, entry, exit)."""
    if model == "logistic":
        bad = ~F.col("y").isin(0, 1)
    elif model == "cox":
        bad = ~F.col("status").isin(0, 1) | (F.col("entry") < 0) | (F.col("entry") > F.col("exit"))
    else:
        bad = F.lit(False)
    return df.agg(F.count("*").alias("n"), F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias("n_bad"))


def validate_outcome(df: DataFrame, model: str) -> DataFrame:
    """`df` itself; raises where outcome_errors finds any."""
    found = outcome_errors(df, model).first()
    if found.n_bad:
        raise ValueError(f"{found.n_bad} of {found.n} rows have an outcome that {model} can't take")
    return df
