"""Joins: subjects to genotypes, genes to variants, as-of lookups, intervals, regions, trios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.operators.running import running


def last_row(df: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row per key: the last by `order`; without an order duplicates raise."""
    if order is None:
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"duplicate {key}; name the column that orders the rows")
        return df
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def link(pheno: DataFrame, gt: DataFrame, order: str | None = "") -> DataFrame:
    """Genotype rows with their subject's phenotypes. `order` "" trusts unique ids; see last_row otherwise."""
    pheno = pheno if order == "" else last_row(pheno, "iid", order)
    return gt.join(pheno, "iid")


def link_probs(pheno: DataFrame, probs: DataFrame) -> DataFrame:
    """Pairwise inclusion probabilities of linked subjects, per study."""
    ids = pheno.select("iid")
    known = probs.join(ids.withColumnRenamed("iid", "iid_i"), "iid_i", "left_semi")
    return known.join(ids.withColumnRenamed("iid", "iid_j"), "iid_j", "left_semi")


def attach_conditions(pheno: DataFrame, gt: DataFrame, variants: list, sites: DataFrame | None = None) -> DataFrame:
    """Condition variants' genotypes as covariates c_<variant>; subjects missing any are dropped.

    With `sites` (variant, alt) a multi-allelic condition variant raises; `absent_conditions` reports those that don't exist.
    """
    if sites is not None:
        several = [r.variant for r in sites.where(F.col("variant").isin(variants) & F.col("alt").contains(",")).select("variant").collect()]  # of the list
        if several:
            raise ValueError(f"multi-allelic condition variants: {sorted(several)}")
    wide = gt.where(F.col("variant").isin(variants)).groupBy("iid").agg(*[F.max(F.when(F.col("variant") == v, F.col("g"))).cast("double").alias(f"c_{v}") for v in variants])
    return pheno.join(wide, "iid").dropna(subset=[f"c_{v}" for v in variants])


def absent_conditions(listed: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows of a condition list (chrom, pos) at which no variant exists."""
    return listed.select("chrom", "pos").distinct().join(sites.select("chrom", "pos"), ["chrom", "pos"], "left_anti")


def group_variants(groups: DataFrame, variants: DataFrame) -> DataFrame:
    """(gene, ...variant columns): genes' variants that exist."""
    return variants.join(groups, ["chrom", "pos"])


def empty_groups(groups: DataFrame, variants: DataFrame) -> DataFrame:
    """Genes of which no variant exists."""
    return groups.select("gene").distinct().join(group_variants(groups, variants).select("gene").distinct(), "gene", "left_anti")


def asof_values(obs: DataFrame, grid: DataFrame, how: str = "left", left: str | float | None = None, right: str | float | None = None) -> DataFrame:
    """Value of each subject's covariate at its grid times. obs: iid, time, value; grid: iid, time.

    left: last at or before; right: first at or after; nearest (ties go right); linear; baseline: the first value.
    Outside the observed range: `left`/`right` give a constant, or "edge" the nearest end's value, else null.
    """
    points = obs.select("iid", "time", F.col("value").cast("double").alias("value"), F.lit(False).alias("asked"))
    asked = grid.select("iid", "time", F.lit(None).cast("double").alias("value"), F.lit(True).alias("asked"))
    by = W.partitionBy("iid").orderBy("time")
    seen = F.when(~F.col("asked"), F.struct("time", "value"))
    # range frames, so that an observation at the very time counts on both sides
    back, ahead = by.rangeBetween(W.unboundedPreceding, W.currentRow), by.rangeBetween(W.currentRow, W.unboundedFollowing)
    rows = points.unionByName(asked).withColumns({"lo": F.last(seen, True).over(back), "hi": F.first(seen, True).over(ahead), "first": F.first(seen, True).over(by.rangeBetween(W.unboundedPreceding, W.unboundedFollowing))})
    rows = rows.where("asked")
    lo, hi, t = F.col("lo"), F.col("hi"), F.col("time")
    near = F.when(hi["time"] - t <= t - lo["time"], hi["value"]).otherwise(lo["value"])
    line = F.when(hi["time"] == lo["time"], lo["value"]).otherwise(lo["value"] + (hi["value"] - lo["value"]) * (t - lo["time"]) / (hi["time"] - lo["time"]))
    inner = {"left": lo["value"], "right": hi["value"], "nearest": near, "linear": line, "baseline": F.col("first")["value"]}[how]

    def outside(rule, edge):
        return edge if rule == "edge" else F.lit(None if rule is None else float(rule)).cast("double")

    value = F.when(lo.isNull() & hi.isNull(), None).when(lo.isNull(), outside(left, hi["value"])).when(hi.isNull(), outside(right, lo["value"])).otherwise(inner)
    if how == "baseline":
        value = inner
    return rows.select("iid", "time", value.alias("value"))


def merge_regions(df: DataFrame, by: str = "chrom") -> DataFrame:
    """Merged overlapping or touching half-open regions per chromosome; empty ones are dropped."""
    good = running(df.where("start < end").select(by, "start", "end"), [by], ["start", "end"], current=False, maxima={"_reach": F.col("end")})
    fresh = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), 1).otherwise(0)
    islands = running(good.withColumn("_fresh", fresh), [by], ["start", "end"], sums={"island": F.col("_fresh")})
    return islands.groupBy(by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def in_regions(positions: DataFrame, merged: DataFrame, by: str = "chrom") -> DataFrame:
    """`positions` with inside: whether pos lies in a merged region. Merged regions follow each other, so the furthest end
    of those that start at or before a position tells; regions and positions are put in one order, in ranges."""
    starts = merged.select(F.col(by), F.col("start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("end").cast("long").alias("_end"))
    asked = positions.select(F.col(by), F.col("pos").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct(*positions.columns).alias("_row"))
    found = running(starts.unionByName(asked, allowMissingColumns=True), [by], ["_at", "_kind"], maxima={"_reach": F.col("_end")}).where("_kind = 1")
    inside = F.col(by).isNotNull() & F.coalesce(F.col("_at") < F.col("_reach"), F.lit(False))
    return found.select("_row.*", inside.alias("inside"))


def interval_join(a: DataFrame, b: DataFrame, how: str = "overlapping", by: str = "chrom", width: int | None = None, fan: int = 32, levels: int = 5) -> DataFrame:
    """Pairs of closed intervals (a_id, b_id): overlapping, containing (a contains b), contained (a in b).

    Both sides spread over bins, joined on (chromosome, bin); a pair is kept in the bin where both first meet. Bins are
    about as wide as most intervals (`width`, if not given, from the lengths' 90 % quantile); an interval of over `fan`
    bins is at home on a coarser level with bins `fan` times as wide, so none is copied to more than fan + 1 of them, but
    for the last level. Two intervals meet on the coarser one of their levels; levels above the longest interval's are left
    out, so intervals of about one length are joined once.
    """
    measure = lambda df: df.agg(F.percentile_approx(F.col("end") - F.col("start"), 0.9, 1000).alias("most"), F.max(F.col("end") - F.col("start")).alias("top"))
    most, top = measure(a if a is b else a.select("start", "end").union(b.select("start", "end"))).first()
    width = width or max(16, int(most or 0))
    levels = next((k for k in range(1, levels) if (top or 0) <= width * fan**k), levels)
    size = lambda level: F.lit(width).cast("long") * F.pow(F.lit(fan), level).cast("long")

    def spread(df, p):
        home = F.lit(0)
        for k in range(1, levels):
            home = F.when(F.col("end") - F.col("start") > width * fan**k, k).otherwise(home)
        rows = df.select(F.col("id").alias(f"{p}_id"), F.col(by), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), home.alias("home"))
        rows = rows.select("*", F.explode(F.sequence("home", F.lit(levels - 1))).alias("level"))
        bins = F.sequence(F.floor(F.col(f"{p}_start") / size(F.col("level"))), F.floor(F.col(f"{p}_end") / size(F.col("level"))))
        return rows.select(f"{p}_id", by, f"{p}_start", f"{p}_end", "level", (F.col("home") == F.col("level")).alias("at_home"), F.explode(bins).alias("bin"))

    left, right, keys = spread(a, "a"), spread(b, "b"), [by, "level", "bin"]
    pairs = left.drop("at_home").join(right.drop("at_home"), keys) if levels == 1 else left.where("at_home").drop("at_home").join(right.drop("at_home"), keys).unionByName(left.where("NOT at_home").drop("at_home").join(right.where("at_home").drop("at_home"), keys))
    pairs = pairs.where(F.col("bin") == F.floor(F.greatest("a_start", "b_start") / size(F.col("level"))))
    test = {
        "overlapping": "a_start <= b_end AND b_start <= a_end",
        "containing": "a_start <= b_start AND b_end <= a_end",
        "contained": "b_start <= a_start AND a_end <= b_end",
    }[how]
    return pairs.where(test).select("a_id", "b_id")


def exclude_positions(pileup: DataFrame, listed: DataFrame) -> DataFrame:
    return pileup.join(listed.select("rname", "pos"), ["rname", "pos"], "left_anti")


def trios(persons: DataFrame, markers: DataFrame) -> DataFrame:
    """Per child and marker: its alleles and both parents'."""
    def of(p, i):
        return markers.select("fid", F.col("pid").alias(i), "marker", F.col("a1").alias(f"{p}1"), F.col("a2").alias(f"{p}2"))

    child = persons.where("fat IS NOT NULL AND mot IS NOT NULL").join(markers, ["fid", "pid"])
    return child.join(of("f", "fat"), ["fid", "fat", "marker"]).join(of("m", "mot"), ["fid", "mot", "marker"])


def common_rows(a: DataFrame, b: DataFrame, key: str = "iid") -> DataFrame:
    return a.join(b.select(key), key, "left_semi")
