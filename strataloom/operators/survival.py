"""Survival operators on the distinct-time table of each stratum: no theta joins, running sums in ranges of time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.scalar import chi2_sf, chi2_tail
from strataloom.operators.running import ROWS, cut_points, running
from strataloom.operators.staging import shuffled, staged

S = "stratum"


def at_times(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on stratum and time; a null stratum is one of its own."""
    other = right.withColumnsRenamed({S: "_stratum", "time": "_time"})
    return left.join(other, left[S].eqNullSafe(other["_stratum"]) & (left["time"] == other["_time"]), how).drop("_stratum", "_time")


def risk_table(df: DataFrame, sums: dict | None = None, cuts: list[float] | None = None) -> DataFrame:
    """(stratum, time, events, at_risk, ...): df has stratum, entry, exit, event; at risk: entry <= time <= exit.

    `sums` names columns to sum over the risk set. Suffix sums by exit time less suffix sums by later entry.
    """
    sums = {"at_risk": F.lit(1), **(sums or {})}
    leave = df.select(S, F.col("exit").alias("time"), F.col("event").cast("int").alias("d"), *[c.cast("double").alias(n) for n, c in sums.items()], F.lit(0).alias("side"))
    # a subject is not yet at risk at times before its entry: take it off there
    enter = df.select(S, F.col("entry").alias("time"), F.lit(0).alias("d"), *[(-c).cast("double").alias(n) for n, c in sums.items()], F.lit(1).alias("side"))
    points = leave.unionByName(enter).groupBy(S, "time").agg(
        F.sum("d").alias("events"),
        *[x for n in sums for x in (F.sum(F.when(F.col("side") == 0, F.col(n)).otherwise(0.0)).alias(f"l_{n}"), F.sum(F.when(F.col("side") == 1, F.col(n)).otherwise(0.0)).alias(f"e_{n}"))],
        F.max(F.when(F.col("side") == 0, 1).otherwise(0)).alias("is_exit"),
    )
    # both sums run down in time; those of later entries leave out the time itself
    run = running(points, [S], ["time"], down=True, sums={f"s_{n}": F.col(f"l_{n}") + F.col(f"e_{n}") for n in sums}, cuts=cut_points(df, "exit") if cuts is None else cuts)
    return run.where("is_exit = 1").select(S, "time", "events", *[(F.col(f"s_{n}") - F.col(f"e_{n}")).alias(n) for n in sums])


def kaplan_meier(df: DataFrame, continuity: str = "right", cuts: list[float] | None = None) -> DataFrame:
    """(stratum, time, at_risk, events, survival) at each distinct exit time; left: the value just before it."""
    cuts = cut_points(df, "exit") if cuts is None else cuts
    table = risk_table(df, cuts=cuts)
    alive = F.col("events") < F.col("at_risk")
    factor = F.when(alive, F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)
    table = running(table, [S], ["time"], current=continuity == "right", sums={"_log": factor, "_dead": F.when(alive, 0).otherwise(1)}, cuts=cuts)
    survival = F.when(F.col("_dead") > 0, 0.0).otherwise(F.exp(F.coalesce("_log", F.lit(0.0))))
    return table.select(S, "time", F.col("at_risk").cast("long").alias("at_risk"), F.col("events").cast("long").alias("events"), survival.alias("survival"))


def ties_constant(df: DataFrame) -> DataFrame:
    """(R - D) / (R - 1) at each event time, 1 where R = 1."""
    t = risk_table(df).where("events > 0")
    return t.select(S, "time", F.when(F.col("at_risk") == 1, 1.0).otherwise((F.col("at_risk") - F.col("events")) / (F.col("at_risk") - 1)).alias("ties"))


def risk_sums(df: DataFrame, x: str, beta: float = 0.0, cuts: list[float] | None = None) -> DataFrame:
    """S0, S1, S2 of exp(beta x) over the risk set, and events and their x sum, per event time."""
    e = F.exp(F.lit(float(beta)) * F.col(x))
    table = risk_table(df, {"s0": e, "s1": e * F.col(x), "s2": e * F.col(x) * F.col(x)}, cuts).where("events > 0")
    own = df.where(F.col("event").cast("boolean")).groupBy(S, F.col("exit").alias("time")).agg(F.sum(x).alias("event_x"))
    return at_times(table, own)


def log_rank(df: DataFrame, x: str, km: bool = False, ties: bool = False) -> DataFrame:
    """One row: score u and information v at beta 0, chi-square u^2/v, and the Peto estimate u/v."""
    cuts = cut_points(df, "exit")
    t = risk_sums(df, x, cuts=cuts)
    weight = F.lit(1.0)
    if km:
        left = kaplan_meier(df, "left", cuts).select(S, "time", "survival")
        t, weight = at_times(t, left), F.col("survival")
    mean = F.col("s1") / F.col("s0")
    spread = F.col("s2") / F.col("s0") - mean * mean
    if ties:
        spread = spread * F.when(F.col("at_risk") == 1, 1.0).otherwise((F.col("at_risk") - F.col("events")) / (F.col("at_risk") - 1))
    out = t.agg(F.sum(weight * (F.col("event_x") - F.col("events") * mean)).alias("u"), F.sum(weight * weight * F.col("events") * spread).alias("v"))
    # without variation there is no test
    return out.select("u", "v", F.try_divide(F.col("u") * F.col("u"), "v").alias("chisq"), F.try_divide("u", "v").alias("peto"))


def influence(df: DataFrame, x: str, beta: float = 0.0, key: str = "iid", km: bool = False) -> DataFrame:
    """Per-subject influence (key, w) on the score: own event term less the events it was at risk for, with late entry.

    `km` weights each event time by the Kaplan-Meier estimate just before it.
    """
    return score_residuals(df, [x], [beta], key, km).withColumnRenamed("w0", "w")


def dual_log_rank(a: DataFrame, b: DataFrame, x: str, key: str = "iid", km: bool = False) -> DataFrame:
    """Covariance and correlation of two outcomes' log-rank scores over common subjects."""
    wa, wb = influence(a, x, 0.0, key, km).withColumnRenamed("w", "wa"), influence(b, x, 0.0, key, km).withColumnRenamed("w", "wb")
    sums = wa.join(wb, key).agg(F.sum(F.col("wa") * F.col("wb")).alias("covariance"))
    va, vb = log_rank(a, x, km).select(F.col("v").alias("va")), log_rank(b, x, km).select(F.col("v").alias("vb"))
    one = sums.join(F.broadcast(va)).join(F.broadcast(vb))  # three one-row tables
    return one.select("covariance", F.try_divide("covariance", F.sqrt(F.col("va") * F.col("vb"))).alias("correlation"))


def _predictor(x: list[str], theta) -> object:
    return sum((F.lit(float(t)) * F.col(c) for t, c in zip(theta, x)), F.lit(0.0))


def _cox_step(rows: DataFrame, x: list[str], theta, km: bool, ties: bool, cuts: list[float]) -> tuple[np.ndarray, np.ndarray, float]:
    """Score, information and log likelihood at theta, summed over strata and event times: one row to the driver."""
    p, e = len(x), F.col("_w") * F.exp(_predictor(x, theta))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = {"s0": e} | {f"a{i}": e * F.col(c) for i, c in enumerate(x)} | {f"b{i}_{j}": e * F.col(x[i]) * F.col(x[j]) for i, j in pairs}
    own = rows.where("event").groupBy(S, F.col("exit").alias("time")).agg(F.sum("_w").alias("hits"), F.sum(F.col("_w") * _predictor(x, theta)).alias("eta"), *[F.sum(F.col("_w") * F.col(c)).alias(f"o{i}") for i, c in enumerate(x)])
    t, weight = at_times(risk_table(rows, sums, cuts).where("events > 0"), own), F.lit(1.0)
    if km:
        t, weight = at_times(t, kaplan_meier(rows, "left", cuts).select(S, "time", "survival")), F.col("survival")
    constant = F.when(F.col("at_risk") == 1, 1.0).otherwise((F.col("at_risk") - F.col("events")) / (F.col("at_risk") - 1)) if ties else F.lit(1.0)
    mean = [F.col(f"a{i}") / F.col("s0") for i in range(p)]
    r = t.agg(
        F.sum(F.col("eta") - F.col("hits") * F.log("s0")).alias("ll"), *[F.sum(weight * (F.col(f"o{i}") - F.col("hits") * mean[i])).alias(f"u{i}") for i in range(p)],
        *[F.sum(weight * constant * F.col("hits") * (F.col(f"b{i}_{j}") / F.col("s0") - mean[i] * mean[j])).alias(f"v{i}_{j}") for i, j in pairs],
    ).first()
    if r.ll is None:
        raise ValueError("there is no event")
    return np.array([r[f"u{i}"] for i in range(p)]), np.array([[r[f"v{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]), r.ll


def cox_fit(df: DataFrame, x: list[str], km: bool = False, ties: bool = False, weight: str | None = None) -> dict:
    """theta and information of a Cox model; strata (column stratum) have risk sets of their own.

    One pass of window sums per Newton step, at most 50 steps, each halved up to 10 times while the likelihood falls.
    """
    rows = df.select(S, "entry", "exit", F.col("event").cast("boolean").alias("event"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), *[F.col(c).cast("double").alias(c) for c in x])
    rows = rows.dropna(subset=[c for c in rows.columns if c != S]).persist()
    theta, cuts = np.zeros(len(x)), cut_points(rows, "exit")
    try:
        u, info, ll = _cox_step(rows, x, theta, km, ties, cuts)
        for _ in range(50):
            step = np.linalg.solve(info, u)
            for _ in range(10):
                after = _cox_step(rows, x, theta + step, km, ties, cuts)
                if km or after[2] >= ll - 1e-9 * abs(ll):  # the weighted score is not this likelihood's gradient
                    break
                step = step / 2
            theta, (u, info, ll) = theta + step, after
            if np.abs(step).sum() < 1e-8:
                return {"theta": theta, "info": info, "covariates": list(x)}
        raise ValueError("Cox regression did not converge")
    finally:
        rows.unpersist()


def score_residuals(df: DataFrame, x: list[str], theta, key: str = "iid", km: bool = False) -> DataFrame:
    """(key, w0, w1, ...): each subject's part of the score, with late entry: own event term less the events while at risk."""
    e = F.exp(_predictor(x, theta))
    cuts = cut_points(df, "exit")
    t = risk_table(df, {"s0": e, **{f"a{i}": e * F.col(c) for i, c in enumerate(x)}}, cuts).where("events > 0")
    t = at_times(t, kaplan_meier(df, "left", cuts).select(S, "time", F.col("survival").alias("km"))) if km else t.withColumn("km", F.lit(1.0))
    return residuals(df, x, e, t.withColumn("hits", F.col("events")), [key], cuts)


def residuals(df: DataFrame, x: list[str], e: Column, t: DataFrame, keys: list[str], cuts: list[float], spread: list[str] = ()) -> DataFrame:
    """(keys, w0, w1, ...) for relative risks e and the event times t (stratum, time, hits, km, s0, a0, a1, ...); `spread`
    names columns of t whose values at a subject's own event are added."""
    names = range(len(x))
    t = staged(t, "times")
    hits = F.col("km") * F.col("hits")
    rises = {"h": hits / F.col("s0")} | {f"h{i}": hits * F.col(f"a{i}") / F.col("s0") ** 2 for i in names}
    steps = t.select(S, F.col("time").cast("double"), F.lit(1).alias("kind"), *[c.alias(f"_{n}") for n, c in rises.items()])
    # events at the entry time count (entry <= time), so its probe comes before them; the exit's comes after. Sums run over distinct
    # times alone, and are looked up for the subjects
    probe = lambda at, kind: df.select(S, F.col(at).cast("double").alias("time"), F.lit(kind).alias("kind")).distinct()
    both = steps.unionByName(probe("entry", 0).unionByName(probe("exit", 2)), allowMissingColumns=True)
    both = staged(running(both, [S], ["time", "kind"], sums={n: F.coalesce(f"_{n}", F.lit(0.0)) for n in rises}, cuts=cuts).where("kind <> 1").select(S, "time", "kind", *rises), "probes")
    few = F.broadcast if both.count() <= ROWS else shuffled
    rows = df.select(*keys, *([] if S in keys else [S]), F.col("entry").cast("double").alias("_entry"), F.col("exit").cast("double").alias("_exit"), F.col("event").cast("boolean").alias("_event"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x)], e.alias("_e"))
    for at, kind in (("_entry", 0), ("_exit", 2)):
        sums = both.where(F.col("kind") == kind).select(F.col(S).alias(f"_s{kind}"), F.col("time").alias(f"_t{kind}"), *[F.col(n).alias(f"{n}_{kind}") for n in rises])
        rows = rows.join(few(sums), rows[S].eqNullSafe(F.col(f"_s{kind}")) & (F.col(at) == F.col(f"_t{kind}")), "left")
    means = t.select(F.col(S).alias("_s"), F.col("time").cast("double").alias("_t"), "km", *spread, *[(F.col(f"a{i}") / F.col("s0")).alias(f"m{i}") for i in names])
    rows = rows.join(few(means), rows[S].eqNullSafe(F.col("_s")) & (F.col("_exit") == F.col("_t")) & F.col("_event"), "left")
    risen = lambda n: F.coalesce(F.col(f"{n}_2"), F.lit(0.0)) - F.coalesce(F.col(f"{n}_0"), F.lit(0.0))
    spent = [F.sum(F.col("_e") * (F.col(f"_x{i}") * risen("h") - risen(f"h{i}"))) for i in names]
    own = [F.sum(F.coalesce(F.when(F.col("_event"), F.col("km") * (F.col(f"_x{i}") - F.col(f"m{i}"))), F.lit(0.0))) for i in names]
    return rows.groupBy(*keys).agg(*[(own[i] - spent[i]).alias(f"w{i}") for i in names], *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in spread])


def cox_regression(df: DataFrame, x: list[str], robust: bool = False, km: bool = False, ties: bool = False) -> DataFrame:
    """One row per term: beta, se, z, pvalue; robust: inverse information around the sum of squared score residuals."""
    fit = cox_fit(df, x, km, ties)
    theta, cov = fit["theta"], np.linalg.inv(fit["info"])
    if robust:
        cov = cov @ _cross(score_residuals(df, x, theta), score_residuals(df, x, theta), len(x)) @ cov
    se = np.sqrt(np.diag(cov))
    rows = [(t, float(b), float(s), float(b / s), chi2_tail(float((b / s) ** 2))) for t, b, s in zip(x, theta, se)]
    return df.sparkSession.createDataFrame(rows, "term string, beta double, se double, z double, pvalue double")


def _cross(a: DataFrame, b: DataFrame, p: int, key: str = "iid") -> np.ndarray:
    """Sum over common subjects of the outer products of two models' residuals."""
    both = a.join(b.select(key, *[F.col(f"w{j}").alias(f"z{j}") for j in range(p)]), key)
    r = both.agg(*[F.sum(F.col(f"w{i}") * F.col(f"z{j}")).alias(f"c{i}_{j}") for i in range(p) for j in range(p)]).first()
    return np.array([[r[f"c{i}_{j}"] or 0.0 for j in range(p)] for i in range(p)])


def dual_covariance(a: DataFrame, b: DataFrame, x: list[str], key: str = "iid") -> DataFrame:
    """(term_a, term_b, covariance, correlation) of the estimates of two outcomes' Cox models over common subjects."""
    fa, fb = cox_fit(a, x), cox_fit(b, x)
    ia, ib = np.linalg.inv(fa["info"]), np.linalg.inv(fb["info"])
    cov = ia @ _cross(score_residuals(a, x, fa["theta"], key), score_residuals(b, x, fb["theta"], key), len(x), key) @ ib
    rows = [(s, t, float(cov[i, j]), float(cov[i, j] / np.sqrt(ia[i, i] * ib[j, j]))) for i, s in enumerate(x) for j, t in enumerate(x)]
    return a.sparkSession.createDataFrame(rows, "term_a string, term_b string, covariance double, correlation double")


#: Fixed value: two-sided five per cent point of the normal distribution.
Z_95 = 1.9599639845


def summarize(df: DataFrame) -> DataFrame:
    """`df` (estimate, variance) with squared, se, z, pvalue, ci_width; a negative variance gives nulls."""
    se = F.when(F.col("variance") >= 0, F.sqrt("variance"))
    z = F.when(se > 0, F.col("estimate") / se)
    return df.withColumns({"squared": F.col("estimate") * F.col("estimate"), "se": se, "z": z, "ci_width": 2 * Z_95 * se}).withColumn("pvalue", chi2_sf(F.col("z") * F.col("z")))


def summarize_log_rank(df: DataFrame) -> DataFrame:
    """`df` (u, v) with se = sqrt(v) and the Peto estimate u / v, its variance 1 / v and error 1 / sqrt(v)."""
    ok = F.when(F.col("v") > 0, F.col("v"))
    return df.withColumns({"squared": F.col("u") * F.col("u"), "se": F.sqrt(ok), "peto": F.col("u") / ok, "peto_variance": 1 / ok, "peto_se": 1 / F.sqrt(ok)})
