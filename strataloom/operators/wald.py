"""Wald tests per variant and plain regression summaries.

The linear test is two grouped aggregations and a p x p solve: moments per variant, then score sums per family and
variant. Logistic and Cox fits take Newton steps for all variants at once, an aggregation each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.scalar import chi2_tail
from strataloom.operators import stats
from strataloom.operators.running import cut_points
from strataloom.operators.staging import shuffled, staged
from strataloom.operators.survival import at_times, residuals, risk_table

# fixed values: convergence constants of the method
TOLERANCE, ITERATIONS, MARGIN, STEP_CAP = 1e-4, 500, 1e-8, 500.0
#: Moments with a greater condition number at unit size are those of linearly dependent terms.
CONDITION = 1e12
RESULT = "variant long, n long, beta double, se double, chisq double, pvalue double, status string, theta array<double>, cov array<double>"


def family_sizes(pheno: DataFrame, gt: DataFrame | None = None) -> DataFrame:
    """`pheno` with fam_size, the number of its family's subjects; with `gt` only subjects with genotypes are left."""
    if gt is not None:
        pheno = pheno.join(shuffled(gt.select("iid").distinct()), "iid", "left_semi")
    return pheno.join(shuffled(pheno.groupBy("fid").agg(F.count("*").alias("fam_size"))), "fid")


def regular(a: np.ndarray) -> bool:
    """Whether moments `a` of terms, each taken at unit size, can be inverted."""
    size = np.sqrt(np.diag(a))
    return bool((size > 0).all() and np.isfinite(a).all()) and np.linalg.cond(a / np.outer(size, size)) < CONDITION


def result_row(variant, n, theta, cov, status: str = "ok") -> dict:
    """The output row of a fit; a non-positive or undefined variance gives nulls."""
    var = cov[0, 0] if cov is not None else np.nan
    if cov is None or not np.isfinite(cov).all() or not (np.diag(cov) > 0).all():
        return {"variant": variant, "n": n, "beta": None, "se": None, "chisq": None, "pvalue": None, "status": status if status != "ok" else "variance", "theta": None, "cov": None}
    chisq = float(theta[0] ** 2 / var)
    return {"variant": variant, "n": n, "beta": float(theta[0]), "se": float(np.sqrt(var)), "chisq": chisq, "pvalue": chi2_tail(chisq), "status": status, "theta": theta.tolist(), "cov": cov.ravel().tolist()}


def linear_wald(pheno: DataFrame, gt: DataFrame, covariates: list[str] = (), weighted: bool = False, robust: bool = False, extras: list[str] = (), key: str = "variant") -> DataFrame:
    """One row per variant: least squares on [g, 1, extras, covariates] with family-clustered variance.

    Families of one subject use the model's variance unless `robust`. `extras` are column expressions over linked
    rows, such as "g * x1". Unweighted variances under the model's own, less a margin, give way to it.
    """
    centre = pheno.agg(F.avg("y").alias("y"), *[F.avg(c).alias(c) for c in covariates]).first()
    rows = family_sizes(pheno, gt).join(shuffled(gt.where("g IS NOT NULL")), "iid")
    x = [F.col("g"), F.lit(1), *[F.expr(e) for e in extras], *[F.col(c) - centre[c] for c in covariates]]
    p = len(x)
    w = F.col("wt").cast("double") if weighted else F.lit(1.0)
    rows = rows.select(F.col(key).cast("long").alias("variant"), "fid", "fam_size", w.alias("w"), (F.col("y") - centre["y"]).alias("y0"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)])
    xs = [f"x{i}" for i in range(p)]
    sums = stats.moments(rows, [F.col(c) for c in xs], F.col("y0"), F.col("w"), ["variant"])

    def solve(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                a, b = np.reshape(r.sxx, (p, p)), np.asarray(r.sxy)
                inverse = np.linalg.inv(a) if regular(a) else None
                theta = inverse @ b if inverse is not None else np.full(p, np.nan)
                sigma2 = (r.syy - 2 * theta @ b + theta @ a @ theta) / r.sw
                out.append((r.variant, r.n, theta.tolist(), float(sigma2), None if inverse is None else inverse.ravel().tolist()))
            yield pd.DataFrame(out, columns=["variant", "n", "theta", "sigma2", "inverse"])

    fits = sums.mapInPandas(solve, "variant long, n long, theta array<double>, sigma2 double, inverse array<double>")
    residual = F.col("y0") - sum((F.col("theta")[i] * F.col(c) for i, c in enumerate(xs)), F.lit(0.0))
    scored = rows.join(fits.select("variant", "theta", "sigma2"), "variant").withColumn("r", residual)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    alone = (F.col("fam_size") == 1) & F.lit(not robust)
    families = scored.groupBy("variant", "fid").agg(
        F.first("sigma2").alias("sigma2"), F.first(alone).alias("alone"), *[F.sum(F.expr(f"w * r * {c}")).alias(f"u{i}") for i, c in enumerate(xs)], *[F.sum(F.expr(f"w * w * x{i} * x{j}")).alias(f"q{i}_{j}") for i, j in pairs]
    )
    meat = families.groupBy("variant").agg(*[F.sum(F.when(F.col("alone"), F.col("sigma2") * F.col(f"q{i}_{j}")).otherwise(F.col(f"u{i}") * F.col(f"u{j}"))).alias(f"b{i}_{j}") for i, j in pairs])
    meat = meat.select("variant", F.array(*[F.col(f"b{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]).alias("meat"))

    def finish(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.inverse is None:
                    out.append(result_row(r.variant, int(r.n), None, None, "singular"))
                    continue
                inverse = np.reshape(r.inverse, (p, p))
                cov = inverse @ np.reshape(r.meat, (p, p)) @ inverse
                if not weighted and cov[0, 0] < r.sigma2 * inverse[0, 0] - MARGIN:
                    cov = r.sigma2 * inverse
                out.append(result_row(r.variant, r.n, np.asarray(r.theta), cov))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    # a variant without a call is a row as well
    named = gt.select(F.col(key).cast("long").alias("variant")).distinct().join(fits, "variant", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return named.join(meat, "variant", "left").mapInPandas(finish, RESULT)


def linear_wald_hetero(pheno: DataFrame, gt: DataFrame, covariates: list[str] = (), stratum: str = "stratum", weighted: bool = False, robust: bool = False, key: str = "variant") -> DataFrame:
    """linear_wald with a residual variance per stratum, refitted in turn with the coefficients until both settle.

    Moments per variant and stratum are aggregated once; the iteration runs on them alone. A null stratum is one of its own.
    """
    centre = pheno.agg(F.avg("y").alias("y"), *[F.avg(c).alias(c) for c in covariates]).first()
    rows = family_sizes(pheno, gt).join(shuffled(gt.where("g IS NOT NULL")), "iid")
    x = [F.col("g"), F.lit(1), *[F.col(c) - centre[c] for c in covariates]]
    p = len(x)
    xs = [f"x{i}" for i in range(p)]
    w = F.col("wt").cast("double") if weighted else F.lit(1.0)
    level = F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("level")
    rows = rows.select(F.col(key).cast("long").alias("variant"), level, "fid", "fam_size", w.alias("w"), (F.col("y") - centre["y"]).alias("y0"), *[c.cast("double").alias(n) for n, c in zip(xs, x)])
    sums = stats.moments(rows, [F.col(c) for c in xs], F.col("y0"), F.col("w"), ["variant", "level"])

    def solve(group: pd.DataFrame) -> pd.DataFrame:  # a row per stratum
        a = np.array([np.reshape(m, (p, p)) for m in group["sxx"]])
        b = np.array([np.asarray(m) for m in group["sxy"]])
        syy, sw = group["syy"].to_numpy(), group["sw"].to_numpy()
        residual = lambda t: syy - 2 * b @ t + np.einsum("i,kij,j->k", t, a, t)
        out = pd.DataFrame({"variant": group["variant"], "level": group["level"], "n": int(group["n"].sum()), "theta": None, "sigma2": np.nan, "inverse": None, "status": "singular"})
        try:
            theta = np.linalg.solve(a.sum(0), b.sum(0))
            sigma2 = np.full(len(sw), residual(theta).sum() / sw.sum())
            for _ in range(ITERATIONS):
                before, spread = theta, sigma2
                theta = np.linalg.solve((a / sigma2[:, None, None]).sum(0), (b / sigma2[:, None]).sum(0))
                sigma2 = residual(theta) / sw
                if np.abs(theta - before).sum() + np.abs(sigma2 - spread).sum() < TOLERANCE:
                    break
            else:
                return out.assign(status="not converged")
            inverse = np.linalg.inv((a / sigma2[:, None, None]).sum(0))
        except np.linalg.LinAlgError:
            return out
        if not np.isfinite(inverse).all() or not (sigma2 > 0).all():
            return out.assign(status="variance")
        return out.assign(theta=[theta.tolist()] * len(out), sigma2=sigma2, inverse=[inverse.ravel().tolist()] * len(out), status="ok")

    fits = sums.groupBy("variant").applyInPandas(solve, "variant long, level string, n long, theta array<double>, sigma2 double, inverse array<double>, status string")
    r = F.col("y0") - sum((F.col("theta")[i] * F.col(c) for i, c in enumerate(xs)), F.lit(0.0))
    scored = rows.join(fits.where("status = 'ok'").select("variant", "level", "theta", "sigma2"), ["variant", "level"]).withColumn("r", r)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    families = scored.groupBy("variant", "fid").agg(
        F.first((F.col("fam_size") == 1) & F.lit(not robust)).alias("alone"), *[F.sum(F.expr(f"w * r * {c} / sigma2")).alias(f"u{i}") for i, c in enumerate(xs)], *[F.sum(F.expr(f"w * w * x{i} * x{j} / sigma2")).alias(f"q{i}_{j}") for i, j in pairs]
    )
    meat = families.groupBy("variant").agg(*[F.sum(F.when(F.col("alone"), F.col(f"q{i}_{j}")).otherwise(F.col(f"u{i}") * F.col(f"u{j}"))).alias(f"b{i}_{j}") for i, j in pairs])
    meat = meat.select("variant", F.array(*[F.col(f"b{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]).alias("meat"))

    def finish(batches):
        for batch in batches:
            out = []
            for f in batch.itertuples():
                if f.status != "ok":
                    out.append(result_row(f.variant, f.n, None, None, f.status))
                    continue
                inverse = np.reshape(f.inverse, (p, p))
                cov = inverse @ np.reshape(f.meat, (p, p)) @ inverse
                if not weighted and cov[0, 0] < inverse[0, 0] - MARGIN:
                    cov = inverse
                out.append(result_row(f.variant, f.n, np.asarray(f.theta), cov))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    one = fits.groupBy("variant").agg(F.first("n").alias("n"), F.first("theta").alias("theta"), F.first("inverse").alias("inverse"), F.first("status").alias("status"))
    return one.join(meat, "variant", "left").mapInPandas(finish, RESULT)


def feature_wald(pheno: DataFrame, features: DataFrame, test=None, **options) -> DataFrame:
    """A Wald scan (`test`, linear by default) over a feature matrix (feature_id, iid, g): feature_id replaces variant."""
    keyed = features.withColumn("variant", F.xxhash64("feature_id"))
    names = keyed.select("variant", "feature_id").distinct()
    found = (test or linear_wald)(pheno, keyed.select("variant", "iid", "g"), **options)
    return names.join(found, "variant").drop("variant")


def interaction_test(results: DataFrame, k: int, first: int = 2) -> DataFrame:
    """G x E: p of g, of its k interactions (theta from `first` on: 2, but 1 for Cox) and of both, from a Wald scan with extras."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                row = [r.variant]
                if r.theta is None:
                    out.append([*row, *[None] * 6])
                    continue
                theta, p = np.asarray(r.theta), len(r.theta)
                cov = np.reshape(r.cov, (p, p))
                for at in ([0], list(range(first, first + k)), [0, *range(first, first + k)]):
                    try:
                        q = float(theta[at] @ np.linalg.solve(cov[np.ix_(at, at)], theta[at]))
                    except np.linalg.LinAlgError:
                        q = float("nan")
                    row += [q, chi2_tail(q, len(at))] if q > 0 and np.isfinite(q) else [None, None]
                out.append(row)
            yield pd.DataFrame(out, columns=["variant", "chisq_g", "p_g", "chisq_inter", "p_inter", "chisq_both", "p_both"])

    return results.select("variant", "theta", "cov").mapInPandas(run, "variant long, chisq_g double, p_g double, chisq_inter double, p_inter double, chisq_both double, p_both double")


def logistic_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Newton fit: theta, information at theta, converged."""
    theta = np.zeros(x.shape[1])
    for _ in range(ITERATIONS):
        mu = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        a = (x * (w * mu * (1 - mu))[:, None]).T @ x
        try:
            step = np.linalg.solve(a, x.T @ (w * (y - mu)))
        except np.linalg.LinAlgError:
            return theta, a, False
        theta = theta + step
        if not np.isfinite(theta).all() or np.abs(theta).max() > STEP_CAP:
            return theta, a, False
        if np.abs(step).sum() < TOLERANCE:
            mu = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
            return theta, (x * (w * mu * (1 - mu))[:, None]).T @ x, True
    return theta, a, False


def _family_meat(scored: DataFrame, xs: list[str], r: str, v: str, robust: bool) -> DataFrame:
    """(variant, meat): sums over families of squared scores w r x, those of one subject by their variance factor v unless
    `robust`. scored: variant, fid, fam_size, w, the columns xs, and what the expressions r and v need."""
    p = len(xs)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    families = scored.groupBy("variant", "fid").agg(
        F.first((F.col("fam_size") == 1) & F.lit(not robust)).alias("alone"), *[F.sum(F.expr(f"w * ({r}) * {c}")).alias(f"u{i}") for i, c in enumerate(xs)], *[F.sum(F.expr(f"w * w * ({v}) * {xs[i]} * {xs[j]}")).alias(f"q{i}_{j}") for i, j in pairs]
    )
    meat = families.groupBy("variant").agg(*[F.sum(F.when(F.col("alone"), F.col(f"q{i}_{j}")).otherwise(F.col(f"u{i}") * F.col(f"u{j}"))).alias(f"b{i}_{j}") for i, j in pairs])
    return meat.select("variant", F.array(*[F.col(f"b{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]).alias("meat"))


def logistic_wald(pheno: DataFrame, gt: DataFrame, covariates: list[str] = (), weighted: bool = False, robust: bool = False, key: str = "variant") -> DataFrame:
    """One row per variant: logistic regression of y (0/1) on [g, 1, covariates], all variants at once.

    A Newton step is one aggregation of scores and information by variant with the coefficients joined; variants that have
    settled or failed are left out of the next one. Steps are staged; no task holds a variant's subjects.
    """
    x = [F.col("g"), F.lit(1), *[F.col(c) for c in covariates]]
    p = len(x)
    xs, pairs = [f"x{i}" for i in range(p)], [(i, j) for i in range(p) for j in range(i, p)]
    full = F.array(*[F.col(f"a{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]).alias("a")
    rows = family_sizes(pheno, gt).join(shuffled(gt.where("g IS NOT NULL")), "iid")
    rows = rows.select(F.col(key).cast("long").alias("variant"), "fid", "fam_size", F.col("y").cast("double").alias("y"), (F.col("wt").cast("double") if weighted else F.lit(1.0)).alias("w"), *[c.cast("double").alias(n) for n, c in zip(xs, x)])
    rows = staged(rows, "logistic")  # each step reads them: they are made once
    state = "variant long, n long, theta array<double>, inverse array<double>, last boolean, status string"
    names = [c.split()[0] for c in state.split(", ")]

    def begin(batches):
        for batch in batches:
            fine = [regular(np.reshape(a, (p, p))) for a in batch["a"]]
            yield pd.DataFrame({"variant": batch["variant"], "n": batch["n"], "theta": [[0.0] * p] * len(batch), "inverse": None, "last": False, "status": ["running" if f else "singular" for f in fine]})

    def advance(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                theta, a = np.asarray(r.theta), np.reshape(r.a, (p, p))
                inverse, last, status = None, bool(r.last), "running"
                try:
                    if last:
                        inverse, status = np.linalg.inv(a).ravel().tolist(), "ok"
                    else:
                        step = np.linalg.solve(a, np.asarray(r.u))
                        theta, last = theta + step, bool(np.abs(step).sum() < TOLERANCE)
                        if not np.isfinite(theta).all() or np.abs(theta).max() > STEP_CAP:
                            status = "not converged"
                except np.linalg.LinAlgError:
                    status = "not converged"
                out.append((r.variant, r.n, theta.tolist(), inverse, last, status))
            yield pd.DataFrame(out, columns=names)

    def at(fits: DataFrame) -> DataFrame:  # rows with the variance factor v and the residual r at theta
        eta = sum((F.get("theta", F.lit(i)) * F.col(c) for i, c in enumerate(xs)), F.lit(0.0))
        found = rows.join(fits.select("variant", "theta"), "variant").withColumn("_m", 1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(40.0)), F.lit(-40.0)))))
        return found.withColumns({"r": F.expr("y - _m"), "v": F.expr("_m * (1 - _m)")})

    first = rows.groupBy("variant").agg(F.count("*").alias("n"), *[F.sum(F.expr(f"w * x{i} * x{j}")).alias(f"a{i}_{j}") for i, j in pairs])
    fits = staged(first.select("variant", "n", full).mapInPandas(begin, state), "logistic")
    for _ in range(ITERATIONS + 1):
        going = fits.where("status = 'running'")
        if not going.count():
            break
        sums = at(going).groupBy("variant").agg(*[F.sum(F.expr(f"w * r * {c}")).alias(f"u{i}") for i, c in enumerate(xs)], *[F.sum(F.expr(f"w * v * x{i} * x{j}")).alias(f"a{i}_{j}") for i, j in pairs])
        moved = going.join(sums.select("variant", F.array(*[f"u{i}" for i in range(p)]).alias("u"), full), "variant").mapInPandas(advance, state)
        fits = staged(moved.unionByName(fits.where("status <> 'running'")), "logistic")
    meat = _family_meat(at(fits.where("status = 'ok'")), xs, "r", "v", robust)

    def finish(batches):
        for batch in batches:
            out = []
            for f in batch.itertuples():
                if f.status != "ok":
                    out.append(result_row(f.variant, int(f.n), None, None, "not converged" if f.status == "running" else f.status))
                    continue
                inverse = np.reshape(f.inverse, (p, p))
                cov = inverse @ np.reshape(f.meat, (p, p)) @ inverse
                out.append(result_row(f.variant, int(f.n), np.asarray(f.theta), inverse if not weighted and cov[0, 0] < inverse[0, 0] - MARGIN else cov))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return fits.join(meat, "variant", "left").mapInPandas(finish, RESULT)


def cox_sums(x, w, entry, exit_, event, theta):
    """Sorted-time risk sums: per distinct event time S0, S1, S2, weighted events, by two suffix sums."""
    e = w * np.exp(np.clip(x @ theta, -60, 60))
    times = np.unique(exit_[event])
    p = x.shape[1]
    terms = np.column_stack([e, e[:, None] * x, (e[:, None, None] * x[:, :, None] * x[:, None, :]).reshape(len(x), p * p)])

    def suffix(at, side):
        order = np.argsort(at, kind="stable")
        run = np.vstack([np.cumsum(terms[order][::-1], axis=0)[::-1], np.zeros(terms.shape[1])])
        return run[np.searchsorted(at[order], times, side=side)]

    total = suffix(exit_, "left") - suffix(entry, "right")  # exit >= t, less entry > t
    return times, total[:, 0], total[:, 1 : 1 + p], total[:, 1 + p :].reshape(-1, p, p), e


def cox_fit(x, w, entry, exit_, event):
    """Newton fit with Breslow ties: theta, information, converged."""
    theta = np.zeros(x.shape[1])
    for _ in range(ITERATIONS):
        times, s0, s1, s2, _ = cox_sums(x, w, entry, exit_, event, theta)
        at = np.searchsorted(times, exit_[event])
        we = np.bincount(at, w[event], len(times))
        mean = s1 / s0[:, None]
        score = (w[event][:, None] * x[event]).sum(0) - (we[:, None] * mean).sum(0)
        info = (we[:, None, None] * (s2 / s0[:, None, None] - mean[:, :, None] * mean[:, None, :])).sum(0)
        try:
            step = np.linalg.solve(info, score)
        except np.linalg.LinAlgError:
            return theta, info, False
        theta = theta + np.clip(step, -STEP_CAP, STEP_CAP)
        if not np.isfinite(theta).all():
            return theta, info, False
        if np.abs(step).sum() < TOLERANCE:
            times, s0, s1, s2, _ = cox_sums(x, w, entry, exit_, event, theta)
            mean = s1 / s0[:, None]
            return theta, (we[:, None, None] * (s2 / s0[:, None, None] - mean[:, :, None] * mean[:, None, :])).sum(0), True
    return theta, info, False


def cox_scores(x, w, entry, exit_, event, theta):
    """Per-subject score residuals, by prefix sums over event times evaluated at exit less entry."""
    times, s0, s1, _, _ = cox_sums(x, w, entry, exit_, event, theta)
    at = np.searchsorted(times, exit_[event])
    we = np.bincount(at, w[event], len(times))
    h0 = np.r_[0, np.cumsum(we / s0)]
    h1 = np.vstack([np.zeros(x.shape[1]), np.cumsum((we / s0**2)[:, None] * s1, axis=0)])
    upto, before = np.searchsorted(times, exit_, side="right"), np.searchsorted(times, entry, side="left")
    r = np.exp(np.clip(x @ theta, -60, 60))
    u = -r[:, None] * (x * (h0[upto] - h0[before])[:, None] - (h1[upto] - h1[before]))
    u[event] += x[event] - (s1 / s0[:, None])[at]
    return u


#: Cox steps without gain after which a fit is given up.
STOPS = 5


def event_times(found: DataFrame, xs: list[str], cuts: list[float]) -> DataFrame:
    """(stratum, time, hits, s0, a.., b.., c.., o..): at each event time weighted events, risk sums of e, e x and e x x', the
    spread of x and the events' sums of x. found: stratum, entry, exit, event, w, e and the columns xs."""
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    we = F.col("w") * F.col("e")
    sums = {"s0": we} | {f"a{i}": we * F.col(c) for i, c in enumerate(xs)} | {f"b{i}_{j}": we * F.col(xs[i]) * F.col(xs[j]) for i, j in pairs}
    own = found.where("event").groupBy("stratum", F.col("exit").alias("time")).agg(F.sum("w").alias("hits"), *[F.sum(F.expr(f"w * {c}")).alias(f"o{i}") for i, c in enumerate(xs)])
    t = at_times(risk_table(found, sums, cuts).where("events > 0"), own)
    return t.withColumns({f"c{i}_{j}": F.expr(f"b{i}_{j} / s0 - (a{i} / s0) * (a{j} / s0)") for i, j in pairs})


def cox_wald(surv: DataFrame, gt: DataFrame, covariates: list[str] = (), weighted: bool = False, robust: bool = False, key: str = "variant") -> DataFrame:
    """One row per variant: Cox regression on [g, covariates] with left truncation and family-clustered variance, all
    variants at once.

    A Newton step runs risk sums over each variant's distinct times with its coefficients joined; variants that have settled
    or failed are left out of the next one. Steps are staged; no task holds a variant's subjects. Families of one subject
    count by the spread at their own event unless `robust`. `packed.wald_scan` is the form for many variants.
    """
    centre = surv.agg(*[F.avg(c).alias(c) for c in covariates]).first() if covariates else {}
    x = [F.col("g"), *[F.col(c) - centre[c] for c in covariates]]
    p = len(x)
    xs, pairs = [f"x{i}" for i in range(p)], [(i, j) for i in range(p) for j in range(i, p)]
    full = lambda c: F.array(*[F.col(f"{c}{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]).alias("a")
    rows = family_sizes(surv, gt).join(shuffled(gt.where("g IS NOT NULL")), "iid")
    rows = rows.select(F.col(key).cast("long").alias("stratum"), "iid", "fid", "fam_size", F.col("entry").cast("double").alias("entry"), F.col("exit").cast("double").alias("exit"), F.col("event").cast("boolean").alias("event"), (F.col("wt").cast("double") if weighted else F.lit(1.0)).alias("w"), *[c.cast("double").alias(n) for n, c in zip(xs, x)])
    rows, cuts = staged(rows, "cox"), cut_points(surv, "exit")  # each step reads the rows: they are made once
    state = "stratum long, n long, theta array<double>, inverse array<double>, size double, stops int, last boolean, status string"
    names = [c.split()[0] for c in state.split(", ")]

    def begin(batches):
        for batch in batches:
            fine = [regular(np.reshape(a, (p + 1, p + 1))) for a in batch["a"]]
            yield pd.DataFrame({"stratum": batch["stratum"], "n": batch["n"], "theta": [[0.0] * p] * len(batch), "inverse": None, "size": np.inf, "stops": 0, "last": False, "status": ["running" if f else "singular" for f in fine]})

    def advance(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                theta, inverse, last, status, size, stops = np.asarray(r.theta), None, bool(r.last), "not converged", r.size, int(r.stops)
                try:
                    if r.u is not None:  # else no event
                        a = np.reshape(r.a, (p, p))
                        if last:
                            inverse, status = np.linalg.inv(a).ravel().tolist(), "ok"
                        else:
                            step = np.clip(np.linalg.solve(a, np.asarray(r.u)), -STEP_CAP, STEP_CAP)
                            theta, size = theta + step, float(np.abs(step).sum())
                            stops += size >= r.size - TOLERANCE
                            last = size < TOLERANCE
                            status = "running" if np.isfinite(theta).all() and (last or stops <= STOPS) else status
                except np.linalg.LinAlgError:
                    pass
                out.append((r.stratum, r.n, theta.tolist(), inverse, size, stops, last, status))
            yield pd.DataFrame(out, columns=names)

    def at(fits: DataFrame) -> DataFrame:  # rows with the relative risk e
        eta = sum((F.get("theta", F.lit(i)) * F.col(c) for i, c in enumerate(xs)), F.lit(0.0))
        return rows.join(fits.select("stratum", "theta"), "stratum").withColumn("e", F.exp(F.greatest(F.least(eta, F.lit(60.0)), F.lit(-60.0))))

    terms = [*map(F.col, xs), F.lit(1.0)]
    first = rows.groupBy("stratum").agg(F.count("*").alias("n"), *[F.sum(F.col("w") * terms[i] * terms[j]).alias(f"m{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)])
    square = F.array(*[F.col(f"m{min(i, j)}_{max(i, j)}") for i in range(p + 1) for j in range(p + 1)]).alias("a")
    fits = staged(first.select("stratum", "n", square).mapInPandas(begin, state), "cox")
    for _ in range(ITERATIONS + 1):
        going = fits.where("status = 'running'")
        if not going.count():
            break
        t = event_times(at(going), xs, cuts)
        sums = t.groupBy("stratum").agg(*[F.sum(F.expr(f"o{i} - hits * a{i} / s0")).alias(f"u{i}") for i in range(p)], *[F.sum(F.expr(f"hits * c{i}_{j}")).alias(f"v{i}_{j}") for i, j in pairs])
        moved = going.join(sums.select("stratum", F.array(*[f"u{i}" for i in range(p)]).alias("u"), full("v")), "stratum", "left").mapInPandas(advance, state)
        fits = staged(moved.unionByName(fits.where("status <> 'running'")), "cox")
    found = at(fits.where("status = 'ok'"))
    spread = [f"c{i}_{j}" for i, j in pairs]
    scores = residuals(found, xs, F.col("e"), event_times(found, xs, cuts).withColumn("km", F.lit(1.0)), ["stratum", "iid", "fid", "fam_size", "w"], cuts, spread)
    families = scores.groupBy("stratum", "fid").agg(F.first((F.col("fam_size") == 1) & F.lit(not robust)).alias("alone"), *[F.sum(F.expr(f"w * w{i}")).alias(f"u{i}") for i in range(p)], *[F.sum(F.expr(f"w * w * {c}")).alias(c) for c in spread])
    meat = families.groupBy("stratum").agg(*[F.sum(F.when(F.col("alone"), F.col(f"c{i}_{j}")).otherwise(F.col(f"u{i}") * F.col(f"u{j}"))).alias(f"b{i}_{j}") for i, j in pairs])

    def finish(batches):
        for batch in batches:
            out = []
            for f in batch.itertuples():
                if f.status != "ok":
                    out.append(result_row(f.stratum, int(f.n), None, None, "not converged" if f.status == "running" else f.status))
                    continue
                inverse = np.reshape(f.inverse, (p, p))
                cov = inverse @ np.reshape(f.a, (p, p)) @ inverse
                out.append(result_row(f.stratum, int(f.n), np.asarray(f.theta), inverse if not weighted and cov[0, 0] < inverse[0, 0] - MARGIN else cov))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return fits.join(meat.select("stratum", full("b")), "stratum", "left").mapInPandas(finish, RESULT)


def linear_regression(df: DataFrame, y: str, x: list[str]) -> DataFrame:
    """Plain least squares with intercept: one row per term with beta, se, t, p (chi-square 1 tail); n - p variance."""
    spark = df.sparkSession
    terms = ["(Intercept)", *x]
    r = stats.moments(df.dropna(subset=[y, *x]), [F.lit(1), *[F.col(c) for c in x]], F.col(y).cast("double"), F.lit(1.0), []).first()
    a, b = np.reshape(r.sxx, (len(terms),) * 2), np.asarray(r.sxy)
    theta = np.linalg.solve(a, b)
    cov = (r.syy - theta @ b) / (r.n - len(terms)) * np.linalg.inv(a)
    se = np.sqrt(np.diag(cov))
    return spark.createDataFrame([(t, float(m), float(s), float(m / s), chi2_tail(float((m / s) ** 2))) for t, m, s in zip(terms, theta, se)], "term string, beta double, se double, t double, pvalue double")


def logistic_regression(df: DataFrame, y: str, x: list[str], weight: str | None = None) -> DataFrame:
    """Plain logistic regression with intercept: one aggregation per Newton step, p sums to the driver."""
    terms = ["(Intercept)", *x]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.dropna(subset=[y, *x]).select(F.col(y).cast("double").alias("_y"), w.alias("_w"), F.lit(1.0).alias("_x0"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x, 1)]).persist()
    p, theta = len(terms), np.zeros(len(terms))
    try:
        for _ in range(50):
            eta = sum((F.lit(float(t)) * F.col(f"_x{i}") for i, t in enumerate(theta)), F.lit(0.0))
            mu = rows.withColumn("_m", 1 / (1 + F.exp(-eta)))
            r = mu.agg(*[F.sum(F.expr(f"_w * _x{i} * (_y - _m)")).alias(f"u{i}") for i in range(p)], *[F.sum(F.expr(f"_w * _m * (1 - _m) * _x{i} * _x{j}")).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]).first()
            a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
            step = np.linalg.solve(a, np.array([r[f"u{i}"] for i in range(p)]))
            theta = theta + step
            if np.abs(step).sum() < 1e-8:
                break
        else:
            raise ValueError("logistic regression did not converge")
    finally:
        rows.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(a)))
    return df.sparkSession.createDataFrame([(t, float(m), float(s), float(m / s), chi2_tail(float((m / s) ** 2))) for t, m, s in zip(terms, theta, se)], "term string, beta double, se double, z double, pvalue double")
