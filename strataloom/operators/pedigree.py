"""Pedigrees: frequencies, families, Mendelian and twin checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.operators.link import trios


def allele_freq(persons: DataFrame, markers: DataFrame, method: str = "all", x: bool = False) -> DataFrame:
    """(marker, allele, n, freq): all, founders (alleles seen only in others count 1), or equal. X: males count once."""
    rows = markers.join(persons.select("fid", "pid", "fat", "sex"), ["fid", "pid"])
    alleles = F.when(F.lit(x) & (F.col("sex") == 1), F.array("a1")).otherwise(F.array("a1", "a2"))
    long = rows.select("marker", "fat", F.explode(alleles).alias("allele")).where("allele > 0")
    founder = F.count(F.when(F.col("fat").isNull(), 1))
    counts = long.groupBy("marker", "allele").agg(F.count("*").alias("n_all"), founder.alias("n_founders"))
    by = W.partitionBy("marker")
    if method == "founders":
        n = F.when(F.sum("n_founders").over(by) == 0, F.col("n_all")).otherwise(F.greatest("n_founders", F.lit(1)))
    else:
        n = F.lit(1) if method == "equal" else F.col("n_all")
    return counts.withColumn("n", n.cast("long")).select("marker", "allele", "n", (F.col("n") / F.sum("n").over(by)).alias("freq"))


def lump_alleles(markers: DataFrame, threshold: float) -> DataFrame:
    """(marker, allele, code): 1, 2, ... by falling frequency; alleles of at most int(total * threshold) become OTHER."""
    counts = markers.select("marker", F.explode(F.array("a1", "a2")).alias("allele")).where("allele > 0").groupBy("marker", "allele").agg(F.count("*").alias("n"))
    rare = F.col("n") <= F.floor(F.sum("n").over(W.partitionBy("marker")) * threshold)
    rank = F.row_number().over(W.partitionBy("marker", rare).orderBy(F.desc("n"), "allele"))
    return counts.select("marker", "allele", F.when(rare, "OTHER").otherwise(rank.cast("string")).alias("code"))


def families(persons: DataFrame) -> DataFrame:
    return persons.groupBy("fid").agg(F.count("*").alias("size"), F.count(F.when(F.col("fat").isNull(), 1)).alias("founders"))


def sibships(persons: DataFrame) -> DataFrame:
    return persons.where("fat IS NOT NULL AND mot IS NOT NULL").groupBy("fid", "fat", "mot").agg(F.sort_array(F.collect_list("pid")).alias("sibs"))


def mendel_errors(persons: DataFrame, markers: DataFrame, x: bool = False) -> DataFrame:
    """Children incompatible with their parents; X-linked: heterozygous males, sons against mothers, daughters both."""
    t = trios(persons, markers).where("a1 > 0 AND a2 > 0 AND f1 > 0 AND f2 > 0 AND m1 > 0 AND m2 > 0")
    plain = "NOT ((a1 IN (f1, f2) AND a2 IN (m1, m2)) OR (a2 IN (f1, f2) AND a1 IN (m1, m2)))"
    if not x:
        return t.where(plain)
    daughter = "NOT ((a1 = f1 AND a2 IN (m1, m2)) OR (a2 = f1 AND a1 IN (m1, m2)))"
    return t.where(f"CASE WHEN sex = 1 THEN a1 <> a2 OR a1 NOT IN (m1, m2) ELSE {daughter} END")


def sibship_errors(persons: DataFrame, markers: DataFrame) -> DataFrame:
    """Sibships that no two parents could have: over four genotypes or alleles, or four alleles and one in over two."""
    rows = persons.where("fat IS NOT NULL").join(markers.where("a1 > 0 AND a2 > 0"), ["fid", "pid"])
    genotype = F.struct(F.least("a1", "a2"), F.greatest("a1", "a2"))
    key = ["fid", "fat", "mot", "marker"]
    some = rows.groupBy(*key).agg(F.count_distinct(genotype).alias("genotypes"), F.count_distinct(F.when(F.col("a1") == F.col("a2"), F.col("a1"))).alias("homozygous"))
    alleles = rows.select(*key, F.explode(F.array("a1", "a2")).alias("allele"), genotype.alias("g")).groupBy(*key, "allele").agg(F.count_distinct("g").alias("within")).groupBy(*key).agg(F.count("*").alias("alleles"), F.max("within").alias("most"))
    return some.join(alleles, key).where("genotypes > 4 OR alleles + homozygous > 4 OR (alleles = 4 AND most > 2)")


def twin_check(persons: DataFrame, markers: DataFrame) -> DataFrame:
    """(fid, twin, marker, discordant, a1, a2): known genotypes of identical twins compared, missing ones filled."""
    rows = persons.where("twin IS NOT NULL").select("fid", "pid", "twin").join(markers, ["fid", "pid"])
    known = F.when((F.col("a1") > 0) & (F.col("a2") > 0), F.struct(F.least("a1", "a2").alias("a1"), F.greatest("a1", "a2").alias("a2")))
    return rows.groupBy("fid", "twin", "marker").agg((F.count_distinct(known) > 1).alias("discordant"), F.min(known).alias("g")).select("fid", "twin", "marker", "discordant", "g.a1", "g.a2")


def merged_twins(persons: DataFrame) -> DataFrame:
    """(fid, twin, merged, affected): ids joined by $, affected if any is."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("pid")), lambda p: p.cast("string")), "$")
    return persons.where("twin IS NOT NULL").groupBy("fid", "twin").agg(ids.alias("merged"), F.max("affected").alias("affected"))


def merge_twins(persons: DataFrame) -> DataFrame:
    """One person per twin group; parent ids follow."""
    twins = merged_twins(persons)
    names = persons.where("twin IS NOT NULL").select("fid", "pid", "twin").join(twins.select("fid", "twin", "merged"), ["fid", "twin"])

    def renamed(df, col):
        look = names.select("fid", F.col("pid").alias(col), F.col("merged").alias("_m"))
        return df.join(look, ["fid", col], "left").withColumn(col, F.coalesce("_m", F.col(col).cast("string"))).drop("_m")

    out = renamed(renamed(renamed(persons, "fat"), "mot"), "pid")
    aff = twins.select("fid", F.col("merged").alias("pid"), F.col("affected").alias("_a"))
    return out.dropDuplicates(["fid", "pid"]).join(aff, ["fid", "pid"], "left").withColumn("affected", F.coalesce("_a", "affected")).drop("_a")


def extract_on_affection(persons: DataFrame, affection: str, traits: list[str], status: int = 2) -> DataFrame:
    return persons.withColumns({t: F.when(F.col(affection) == status, F.col(t)) for t in traits})
