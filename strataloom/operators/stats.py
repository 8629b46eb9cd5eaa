"""Per-variant statistics, weighted moments, cluster sums and other aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def variant_stats(linked: DataFrame, key: str | list[str] = "variant", case: str | None = None, dosage: bool = False) -> DataFrame:
    """Counts over linked subjects; g is null where missing. `case`: a 0/1 outcome or event column."""
    g = F.col("g")
    known = F.count("g")
    aggs = {
        "n_total": F.count(F.lit(1)),
        "n": known,
        "alt_ac": F.round(F.coalesce(F.sum("g"), F.lit(0))).cast("long"),
        "alt_af": F.sum("g") / (2 * known),
        "call_rate": known / F.count(F.lit(1)),
    }
    if dosage:
        aggs["n_dose"] = known
    else:
        aggs |= {name: F.sum(F.when(g == v, 1).otherwise(0)) for name, v in (("n_ref", 0), ("n_het", 1), ("n_alt", 2))}
    if case:
        hit = F.col(case).cast("int") == 1
        aggs |= {"n_case": F.count(F.when(hit, g)), "alt_af_case": F.sum(F.when(hit, g)) / (2 * F.count(F.when(hit, g)))}
    return linked.groupBy(*([key] if isinstance(key, str) else key)).agg(*[v.alias(k) for k, v in aggs.items()])


def moments(rows: DataFrame, x: list, y, w, by: list[str]) -> DataFrame:
    """Weighted cross moments per group: arrays sxx (row-major) and sxy, and syy, sw, n."""
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    named = rows.select(*by, w.alias("_w"), y.alias("_y"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(x)])
    aggs = [F.sum(F.expr(f"_w * _x{i} * _x{j}")).alias(f"_s{i}_{j}") for i, j in pairs]
    aggs += [F.sum(F.expr(f"_w * _x{i} * _y")).alias(f"_b{i}") for i in range(p)]
    out = named.groupBy(*by).agg(*aggs, F.sum(F.expr("_w * _y * _y")).alias("syy"), F.sum("_w").alias("sw"), F.count("*").alias("n"))
    sxx = F.array(*[F.col(f"_s{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    return out.select(*by, sxx.alias("sxx"), F.array(*[F.col(f"_b{i}") for i in range(p)]).alias("sxy"), "syy", "sw", "n")


def cluster_meat(scores: DataFrame, u: list[str], by: list[str], fid: str = "fid") -> DataFrame:
    """Sum over families of the outer product of the family's score sums, row-major: two grouped sums."""
    families = scores.groupBy(*by, fid).agg(*[F.sum(c).alias(c) for c in u])
    meat = families.groupBy(*by).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"_{i}_{j}") for i, a in enumerate(u) for j, b in enumerate(u) if i <= j])
    return meat.select(*by, F.array(*[F.col(f"_{min(i, j)}_{max(i, j)}") for i in range(len(u)) for j in range(len(u))]).alias("meat"))


def residual_variance(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """sum(w r^2) / sum(w), overall or per stratum; columns w and r."""
    return df.groupBy(*(by or [])).agg((F.sum(F.expr("w * r * r")) / F.sum("w")).alias("sigma2"))


def design_weights(probs: DataFrame, pheno: DataFrame) -> DataFrame:
    """(study, iid_i, iid_j, delta): w_i w_j within a family, (p_ij - p_i p_j) w_i w_j / p_ij across."""
    own = probs.where("iid_i = iid_j").select("study", F.col("iid_i").alias("iid"), F.col("pi").alias("p"))
    info = pheno.select("iid", "fid", "wt").join(own, "iid")
    left = info.select("study", F.col("iid").alias("iid_i"), F.col("fid").alias("fi"), F.col("wt").alias("wi"), F.col("p").alias("pi_i"))
    right = info.select("study", F.col("iid").alias("iid_j"), F.col("fid").alias("fj"), F.col("wt").alias("wj"), F.col("p").alias("pi_j"))
    both = probs.join(left, ["study", "iid_i"]).join(right, ["study", "iid_j"])
    delta = F.when(F.col("fi") == F.col("fj"), F.col("wi") * F.col("wj")).otherwise((F.col("pi") - F.col("pi_i") * F.col("pi_j")) * F.col("wi") * F.col("wj") / F.col("pi"))
    return both.select("study", "iid_i", "iid_j", delta.alias("delta"))


def design_meat(scores: DataFrame, delta: DataFrame, u: list[str]) -> DataFrame:
    """Row-major U' Delta U over all studies; scores: iid and the columns u."""
    left = scores.select(F.col("iid").alias("iid_i"), *[F.col(c).alias(f"l_{c}") for c in u])
    right = scores.select(F.col("iid").alias("iid_j"), *[F.col(c).alias(f"r_{c}") for c in u])
    half = delta.join(right, "iid_j").groupBy("study", "iid_i").agg(*[F.sum(F.col("delta") * F.col(f"r_{c}")).alias(f"r_{c}") for c in u])
    sums = half.join(left, "iid_i").agg(*[F.sum(F.col(f"l_{a}") * F.col(f"r_{b}")).alias(f"{a}_{b}") for a in u for b in u])
    return sums.select(F.array(*[F.col(f"{a}_{b}") for a in u for b in u]).alias("meat"))


def running_stats(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """n, mean, sample variance and SD (0 below two values)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), zero(F.var_samp(col)).alias("variance"), zero(F.stddev_samp(col)).alias("sd"))


def medians(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.median(c).alias(f"median_{c}") for c in cols])


def fraction_alive(df: DataFrame, by: list[str] | None = None, event: str = "event") -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(F.when(F.col(event).cast("boolean"), 0.0).otherwise(1.0)).alias("fraction_alive"), F.count("*").alias("n"))


def kept_counts(df: DataFrame, used: list[str], by: list[str]) -> DataFrame:
    """Rows kept and rows skipped for a null in a used column, per stratum and subgroup."""
    whole = F.lit(True)
    for c in used:
        whole = whole & F.col(c).isNotNull()
    return df.groupBy(*by).agg(F.sum(whole.cast("long")).alias("kept"), F.sum((~whole).cast("long")).alias("skipped"))
