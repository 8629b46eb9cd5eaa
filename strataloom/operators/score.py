"""Null models, score tests per variant and per gene."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import stats, survival
from strataloom.operators.running import cut_points
from strataloom.operators.staging import shuffled, staged
from strataloom.operators.survival import residuals
from strataloom.operators.wald import ITERATIONS, MARGIN, TOLERANCE, event_times, family_sizes

#: About how many subjects a block of a gene's products holds.
BLOCK = 4096


def fit_null_linear(pheno: DataFrame, covariates: list[str] = (), weighted: bool = False, stratum: str | None = None) -> dict:
    """theta, sigma2 and the inverse of sum(w x x') of y on [1, covariates]: one aggregation, a driver solve.

    With `stratum`, a residual variance for each (`sigma2s`), refitted in turn with theta; a null stratum is one of its own.
    """
    w = F.col("wt").cast("double") if weighted else F.lit(1.0)
    x = [F.lit(1), *[F.col(c) for c in covariates]]
    p = len(x)
    r = stats.moments(pheno, x, F.col("y").cast("double"), w, []).first()
    a, b = np.reshape(r.sxx, (p, p)), np.asarray(r.sxy)
    theta = np.linalg.solve(a, b)
    null = {"theta": theta, "sigma2": float((r.syy - theta @ b) / r.sw), "a": a, "covariates": list(covariates), "weighted": weighted, "sw": float(r.sw), "n": int(r.n)}
    if stratum is None:
        return null
    level = F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("level")
    rows = stats.moments(pheno.select("*", level), x, F.col("y").cast("double"), w, ["level"]).orderBy("level").collect()  # a row per stratum
    a, b = np.array([np.reshape(q.sxx, (p, p)) for q in rows]), np.array([q.sxy for q in rows])
    syy, sw = np.array([q.syy for q in rows]), np.array([q.sw for q in rows])
    spread = np.full(len(rows), null["sigma2"])
    for _ in range(ITERATIONS):
        before, was = theta, spread
        theta = np.linalg.solve((a / spread[:, None, None]).sum(0), (b / spread[:, None]).sum(0))
        spread = (syy - 2 * b @ theta + np.einsum("i,kij,j->k", theta, a, theta)) / sw
        if np.abs(theta - before).sum() + np.abs(spread - was).sum() < TOLERANCE:
            return null | {"theta": theta, "sigma2s": {q.level: float(v) for q, v in zip(rows, spread)}}
    raise ValueError("the null model did not converge")


def _adjusted(pheno: DataFrame, gt: DataFrame, null: dict, stats_: DataFrame, key: str) -> DataFrame:
    """Per variant and subject: w, the null's residual r, and e = g - h'x, the genotype adjusted for the null's terms."""
    p = len(null["theta"])
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in null["covariates"]]]
    w = F.col("wt").cast("double") if null["weighted"] else F.lit(1.0)
    r = F.col("y") - sum((F.lit(float(t)) * c for t, c in zip(null["theta"], x)), F.lit(0.0))
    people = family_sizes(pheno, gt).select("iid", "fid", "fam_size", w.alias("w"), r.alias("r"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    full = gt.join(stats_.select(key, "alt_af"), key).withColumn("g", F.coalesce(F.col("g").cast("double"), 2 * F.col("alt_af")))
    rows = full.join(shuffled(people), "iid")
    cross = rows.groupBy(key).agg(*[F.sum(F.expr(f"w * g * x{i}")).alias(f"c{i}") for i in range(p)])
    inverse = np.linalg.inv(null["a"])
    h = [sum((F.lit(float(inverse[i, j])) * F.col(f"c{j}") for j in range(p)), F.lit(0.0)).alias(f"h{i}") for i in range(p)]
    return rows.join(cross.select(key, *h), key).withColumn("e", F.col("g") - sum((F.col(f"h{i}") * F.col(f"x{i}") for i in range(p)), F.lit(0.0)))


def _tested(sums: DataFrame, weighted: bool) -> DataFrame:
    """`sums` (u, v0, v_a, gg: the unadjusted sum of squares) with v, beta, se and chisq; all null for a variant of which
    the null's terms leave nothing, such as one without variation or without a call."""
    varied = (F.col("v_a") > 1e-12 * F.col("gg")) & (F.col("v0") > 0)
    sums = sums.withColumns({n: F.when(varied, F.col(n)) for n in ("u", "v0", "v_a")})
    less = F.try_divide(F.lit(1.0), "v0") < F.try_divide(F.lit(1.0), "v_a") - MARGIN
    sums = sums.withColumn("v", F.col("v0") if weighted else F.when(less, F.col("v_a")).otherwise(F.col("v0")))
    return sums.withColumns({"beta": F.try_divide("u", "v"), "se": F.try_divide(F.lit(1.0), F.sqrt("v")), "chisq": F.try_divide(F.col("u") * F.col("u"), "v")})


def linear_score(pheno: DataFrame, gt: DataFrame, null: dict, stats_: DataFrame, rescale: str | None = None, key: str = "variant") -> DataFrame:
    """One row per variant: u, v, beta, se, chisq, pvalue; missing genotypes are imputed by their mean.

    The score of g adjusted for the null's nuisance terms is r (g - h'x): its family sums give v; where the unweighted
    result has 1/v below the model's 1/v_a less a margin, v_a takes its place.
    """
    s2, adjusted = null["sigma2"], _adjusted(pheno, gt, null, stats_, key)
    families = adjusted.groupBy(key, "fid").agg(F.first("fam_size").alias("size"), *[F.sum(F.expr(e)).alias(n) for n, e in (("s", "w * r * e"), ("q", "w * w * e * e"), ("a", "w * e * e"), ("g", "w * g * g"))], F.count("*").alias("m"))
    out = families.groupBy(key).agg(F.sum("m").alias("n"), (F.sum("s") / s2).alias("u"), F.sum(F.when(F.col("size") == 1, F.col("q") / s2).otherwise(F.col("s") * F.col("s") / (s2 * s2))).alias("v0"), (F.sum("a") / s2).alias("v_a"), (F.sum("g") / s2).alias("gg"))
    out = _tested(out, null["weighted"])
    if rescale == "naive" and null["weighted"]:
        k = null["n"] / null["sw"]
        out = out.withColumns({"u": F.col("u") * k, "v": F.col("v") * k * k})
    elif rescale == "optimal":
        k = F.when((F.col("v0") > 0) & (F.col("v_a") > 0), F.col("v_a") / F.col("v0")).otherwise(null["n"] / null["sw"] if null["weighted"] else 1.0)
        out = out.withColumns({"u": F.col("u") * k, "v": F.col("v") * k * k})
    return out.select(key, "n", "u", "v", "beta", "se", "chisq")


def fit_null_logistic(pheno: DataFrame, covariates: list[str] = (), weighted: bool = False) -> dict:
    """theta of y on [1, covariates] by one aggregation per Newton step."""
    from strataloom.operators.wald import logistic_regression

    if covariates:
        fitted = logistic_regression(pheno, "y", list(covariates), "wt" if weighted else None).collect()  # a row a term
        return {"theta": np.array([r.beta for r in fitted]), "covariates": list(covariates), "weighted": weighted}
    w = F.col("wt").cast("double") if weighted else F.lit(1.0)
    mean = pheno.where("y IS NOT NULL").agg(F.sum(F.col("y") * w) / F.sum(w)).first()[0]
    if mean in (None, 0.0, 1.0):
        raise ValueError("the outcome does not vary")
    return {"theta": np.array([np.log(mean / (1 - mean))]), "covariates": [], "weighted": weighted}


def logistic_score(pheno: DataFrame, gt: DataFrame, null: dict, stats_: DataFrame, key: str = "variant") -> DataFrame:
    """One row per variant: u and v of the logistic score test, model and cluster variance as in linear_score."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in null["covariates"]]]
    p = len(x)
    eta = sum((F.lit(float(t)) * c for t, c in zip(null["theta"], x)), F.lit(0.0))
    mu = 1 / (1 + F.exp(-eta))
    people = family_sizes(pheno, gt).select("iid", "fid", "fam_size", (F.col("y") - mu).alias("r"), (mu * (1 - mu)).alias("d"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    a = people.agg(*[F.sum(F.expr(f"d * x{i} * x{j}")).alias(f"a{i}_{j}") for i in range(p) for j in range(p)]).first()
    inverse = np.linalg.inv(np.reshape(list(a), (p, p)))
    full = gt.join(stats_.select(key, "alt_af"), key).withColumn("g", F.coalesce(F.col("g").cast("double"), 2 * F.col("alt_af")))
    rows = full.join(shuffled(people), "iid")
    cross = rows.groupBy(key).agg(*[F.sum(F.expr(f"d * g * x{i}")).alias(f"c{i}") for i in range(p)])
    h = [sum((F.lit(float(inverse[i, j])) * F.col(f"c{j}") for j in range(p)), F.lit(0.0)).alias(f"h{i}") for i in range(p)]
    adjusted = rows.join(cross.select(key, *h), key).withColumn("e", F.col("g") - sum((F.col(f"h{i}") * F.col(f"x{i}") for i in range(p)), F.lit(0.0)))
    families = adjusted.groupBy(key, "fid").agg(F.first("fam_size").alias("size"), *[F.sum(F.expr(e)).alias(n) for n, e in (("s", "r * e"), ("q", "d * e * e"), ("g", "d * g * g"))], F.count("*").alias("m"))
    out = families.groupBy(key).agg(F.sum("m").alias("n"), F.sum("s").alias("u"), F.sum(F.when(F.col("size") == 1, F.col("q")).otherwise(F.col("s") * F.col("s"))).alias("v0"), F.sum("q").alias("v_a"), F.sum("g").alias("gg"))
    return _tested(out, False).select(key, "n", "u", "v", "beta", "se", "chisq")


def fit_null_cox(surv: DataFrame, covariates: list[str], weighted: bool = False) -> dict:
    """theta of a Cox model with late entry on the covariates, all subjects in one risk set."""
    if not covariates:
        return {"theta": np.zeros(0), "covariates": []}
    return survival.cox_fit(surv.withColumn("stratum", F.lit(0)), list(covariates), weight="wt" if weighted else None)


def cox_score(surv: DataFrame, gt: DataFrame, null: dict, weighted: bool = False, robust: bool = False, key: str = "variant") -> DataFrame:
    """One row per variant: u, v, beta, se, chisq of the Cox score test; without covariates the log-rank score test.

    Missing genotypes are imputed by their mean. v sums squared family scores, where families of one subject count by
    the spread at their own event unless `robust`; v_a is the model's information, which unweighted takes the place of v where
    1/v lies below 1/v_a less a margin. Risk sums run over each variant's distinct times, all variants at once. A variant
    without variation or a call has nulls.
    """
    covariates, theta = list(null["covariates"]), [0.0, *map(float, null["theta"])]
    centre = surv.agg(*[F.avg(c).alias(c) for c in covariates]).first() if covariates else {}
    p = 1 + len(covariates)
    xs, pairs = [f"x{i}" for i in range(p)], [(i, j) for i in range(p) for j in range(i, p)]
    spread, cuts = [f"c{i}_{j}" for i, j in pairs], cut_points(surv, "exit")
    means = gt.groupBy(key).agg(F.avg(F.col("g").cast("double")).alias("_mean"))
    people = family_sizes(surv, gt).join(shuffled(gt.join(means, key)), "iid")
    g = F.coalesce(F.col("g").cast("double"), "_mean")
    rows = people.select(F.col(key).cast("long").alias("stratum"), "iid", "fid", "fam_size", F.col("entry").cast("double").alias("entry"), F.col("exit").cast("double").alias("exit"), F.col("event").cast("boolean").alias("event"), (F.col("wt").cast("double") if weighted else F.lit(1.0)).alias("w"), g.alias("x0"), *[(F.col(c).cast("double") - centre[c]).alias(f"x{i}") for i, c in enumerate(covariates, 1)])
    rows = staged(rows, "score")  # read by six sums: they are made once
    found = rows.withColumn("e", F.exp(sum((F.lit(t) * F.col(c) for t, c in zip(theta[1:], xs[1:])), F.lit(0.0))))
    t = staged(event_times(found, xs, cuts), "times")
    square = F.array(*[F.col(f"v{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]).alias("a")
    sums = t.groupBy("stratum").agg(F.sum(F.expr("o0 - hits * a0 / s0")).alias("u"), *[F.sum(F.expr(f"hits * c{i}_{j}")).alias(f"v{i}_{j}") for i, j in pairs])
    counts = rows.groupBy("stratum").agg(F.count("*").alias("n"), (F.max("x0") > F.min("x0")).alias("varied"))

    def adjust(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                info = np.reshape(r.a, (p, p)) if r.a is not None else np.full((p, p), np.nan)
                mix = np.r_[1.0, -np.linalg.solve(info[1:, 1:], info[1:, 0])] if np.isfinite(info).all() else np.full(p, np.nan)
                out.append((r.stratum, r.n, bool(r.varied), r.u, mix.tolist(), float(mix @ info @ mix)))
            yield pd.DataFrame(out, columns=["stratum", "n", "varied", "u", "mix", "v_a"])

    held = counts.join(sums.select("stratum", "u", square), "stratum", "left").withColumn("varied", F.coalesce("varied", F.lit(False))).mapInPandas(adjust, "stratum long, n long, varied boolean, u double, mix array<double>, v_a double")
    scores = residuals(found, xs, F.col("e"), t.withColumn("km", F.lit(1.0)), ["stratum", "iid", "fid", "fam_size", "w"], cuts, spread).join(held.select("stratum", "mix"), "stratum")
    mixed = sum((F.get("mix", F.lit(i)) * F.col(f"w{i}") for i in range(p)), F.lit(0.0))
    own = sum((F.get("mix", F.lit(i)) * F.get("mix", F.lit(j)) * F.col(f"c{i}_{j}") * (1 if i == j else 2) for i, j in pairs), F.lit(0.0))
    families = scores.groupBy("stratum", "fid").agg(F.first((F.col("fam_size") == 1) & F.lit(not robust)).alias("alone"), F.sum(F.col("w") * mixed).alias("s"), F.sum(F.col("w") * F.col("w") * own).alias("q"))
    meat = families.groupBy("stratum").agg(F.sum(F.when(F.col("alone"), F.col("q")).otherwise(F.col("s") * F.col("s"))).alias("v0"))
    fine = F.col("varied") & ~F.isnan("v_a") & (F.col("v_a") > 0)
    out = held.join(meat, "stratum", "left").withColumns({n: F.when(fine, F.col(n)) for n in ("u", "v0", "v_a")})
    less = (F.col("v0") <= 0) | (F.try_divide(F.lit(1.0), "v0") < F.try_divide(F.lit(1.0), "v_a") - MARGIN)
    v = F.col("v0") if weighted else F.when((F.col("v0") > 0) & less, F.col("v_a")).otherwise(F.col("v0"))
    out = out.withColumn("v", v)
    positive = F.when(F.col("v") > 0, F.col("v"))
    return out.select(F.col("stratum").alias("variant"), "n", "u", "v", "v_a", F.try_divide(F.col("u"), positive).alias("beta"), F.try_divide(F.lit(1.0), F.sqrt(positive)).alias("se"), F.try_divide(F.col("u") * F.col("u"), positive).alias("chisq"))


def _gene_products(rows: DataFrame, groups: DataFrame, subjects: int, key: str) -> DataFrame:
    """(gene, i, j, v): sums of e_i * e_j over subjects. rows: key, iid, e; blocks of about BLOCK subjects give m x m
    products each, and only these are shuffled and added."""
    blocks = max(-(-subjects // BLOCK), 1)

    def cross(block: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(block[key].to_numpy(), return_inverse=True)
        who = np.unique(block["iid"].to_numpy(), return_inverse=True)[1]
        e = np.zeros((who.max() + 1, len(names)))
        e[who, at] = block["e"]
        i, j = np.tril_indices(len(names))
        return pd.DataFrame({"gene": block["gene"].iloc[0], "i": names[i], "j": names[j], "v": (e.T @ e)[i, j]})

    kinds = groups.schema["gene"].dataType.simpleString(), groups.schema[key].dataType.simpleString()
    parts = rows.join(groups.select("gene", key), key).select("gene", key, "iid", "e", F.pmod(F.xxhash64("iid"), F.lit(blocks)).alias("block"))
    return parts.groupBy("gene", "block").applyInPandas(cross, f"gene {kinds[0]}, i {kinds[1]}, j {kinds[1]}, v double").groupBy("gene", "i", "j").agg(F.sum("v").alias("v"))


def gene_score(pheno: DataFrame, gt: DataFrame, groups: DataFrame, stats_: DataFrame, key: str = "variant") -> DataFrame:
    """(gene, i, j, v): lower triangle of each gene's score variance under the intercept-only linear null.

    The model form V = sum (g_i - mean)(g_j - mean) / sigma2 is used.
    """
    s2, n = pheno.agg(F.var_pop("y"), F.count("*")).first()
    rows = gt.join(stats_.select(key, "alt_af"), key).select(key, "iid", (F.coalesce(F.col("g").cast("double"), 2 * F.col("alt_af")) - 2 * F.col("alt_af")).alias("e"))
    return _gene_products(rows, groups, n, key).withColumn("v", F.col("v") / s2)


def gene_moments(pheno: DataFrame, gt: DataFrame, groups: DataFrame, null: dict, stats_: DataFrame, key: str = "variant") -> DataFrame:
    """(gene, i, j, u, v) under a linear null with covariates: v the score variance's lower triangle in the model form,
    u the score of variant i, on the diagonal alone."""
    adjusted = _adjusted(pheno, gt, null, stats_, key)
    u = adjusted.groupBy(F.col(key).alias("i")).agg((F.sum(F.expr("w * r * e")) / null["sigma2"]).alias("u"))
    v = _gene_products(adjusted.select(key, "iid", (F.sqrt("w") * F.col("e")).alias("e")), groups, null["n"], key)
    return v.join(u, "i").select("gene", "i", "j", F.when(F.col("i") == F.col("j"), F.col("u")).alias("u"), (F.col("v") / null["sigma2"]).alias("v"))
