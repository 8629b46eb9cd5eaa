"""Wald and score scans over packed genotypes: one row per variant, its dosages in one order of subjects.

Genotypes are never shuffled or exploded: each task reads whole variants and multiplies them with the subjects' design,
which every task has. The design is one row per subject (and study), so it is broadcast, after a check that it and the
design weights stay under LIMIT bytes; beyond that use the long forms in `wald` and `score`, which join and group.

Scores u, information A and the meat B follow one scheme for all models. With unit or sampling weights w, B sums the
outer products of family sums of w u; families of one subject count by the model's own variance unless `robust`. With
pairwise inclusion probabilities, B = U' D U over each study's design weights D, where the singletons' diagonal of D
takes the model's variance unless `robust`.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.scalar import chi2_tail
from strataloom.operators import dosage, stats
from strataloom.operators.staging import shuffled
from strataloom.operators.wald import ITERATIONS, MARGIN, RESULT, STEP_CAP, TOLERANCE, regular, result_row

#: Bytes that a broadcast design may have.
LIMIT = 256 << 20
#: Variants of one batch that are multiplied at a time.
BATCH = 64
#: Variants of a gene's tile; a pair of tiles is one group.
TILE = 512
#: Cox steps without gain after which a fit is given up.
STOPS = 5


@dataclass
class Design:
    """The subjects' arrays in one order; `slots` of the ids tell where a subject's rows are."""

    model: str
    ids: np.ndarray
    x: np.ndarray  # covariates, with a leading 1 but for Cox
    y: np.ndarray
    w: np.ndarray
    weighted: bool
    robust: bool
    order: np.ndarray  # rows by family
    starts: np.ndarray  # where each family starts in `order`
    single: np.ndarray  # rows of families of one
    names: list[str]
    strata: np.ndarray | None = None
    levels: list[str] = field(default_factory=list)
    pairs: tuple | None = None  # rows i, their first pair, rows j, weights, and the singletons' own weights
    env: dict = field(default_factory=dict)
    model_variance: bool = False
    entry: np.ndarray | None = None
    exit: np.ndarray | None = None
    event: np.ndarray | None = None
    study: np.ndarray | None = None
    fid: np.ndarray | None = None
    sink: list | None = None  # where a fit leaves its scores, for B to be made elsewhere

    def without_covariates(self) -> Design:
        """The same subjects with no covariates in the fit; those still serve as environments."""
        return replace(self, x=self.x[:, :0] if self.model == "cox" else self.x[:, :1], names=[])


def _bounded(df: DataFrame, width: int, what: str) -> pd.DataFrame:
    n = df.count()
    if n * width > LIMIT:
        raise ValueError(f"{what} has {n} rows, over {LIMIT} bytes: use `blocked` for design weights, the long forms of the wald and score modules for phenotypes")
    return df.toArrow().to_pandas()  # no row is a Python object


def design(pheno: DataFrame, covariates: list[str] = (), model: str = "linear", weighted: bool = False, robust: bool = False, stratum: str | None = None, probs: DataFrame | None = None, genotyped: DataFrame | None = None, members: DataFrame | None = None) -> Design:
    """Complete cases of `pheno` (iid, fid, wt; y, or entry, exit, event for "cox"; study where there are several).

    With `genotyped` (iid), only subjects that have genotypes count, also in the sizes of families. `probs`: pairwise
    inclusion probabilities (study, iid_i, iid_j, pi), few enough for a broadcast; for more give them as `members`, which
    only takes the studies' subjects from them, and scan by `blocked`. A subject of several studies has a row in each.
    """
    outcome = ["entry", "exit", "event"] if model == "cox" else ["y"]
    study = F.col("study") if "study" in pheno.columns else F.lit(0)
    rows = pheno.select(study.alias("study"), "iid", "fid", "wt", *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*outcome, *covariates])], *([F.col(stratum).cast("string").alias("_stratum")] if stratum else []))
    rows = rows.dropna(subset=[c for c in rows.columns if c not in ("_stratum", "wt" if not weighted and probs is None else "_stratum")])
    if genotyped is not None:
        rows = rows.join(shuffled(genotyped.select("iid").distinct()), "iid", "left_semi")
    if probs is not None or members is not None:
        own = (members if probs is None else probs).select("study", F.col("iid_i").alias("iid")).distinct()
        rows = rows.drop("study").join(own, "iid") if "study" not in pheno.columns else rows.join(own, ["study", "iid"], "left_semi")
    linked = rows
    table = _bounded(rows, 8 * (len(rows.columns) + 6), "the phenotype table").sort_values(["study", "iid"], kind="stable").reset_index(drop=True)
    if not len(table):
        raise ValueError("no subject has a phenotype and a genotype")
    families = table.groupby(["study", "fid"], sort=False).ngroup().to_numpy()
    order = np.argsort(families, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(families[order]) != 0])
    single = np.bincount(families)[families] == 1
    columns = [table[c].to_numpy(float) for c in covariates]
    x = np.column_stack(columns if model == "cox" else [np.ones(len(table)), *columns]) if columns or model != "cox" else np.zeros((len(table), 0))
    out = Design(model, table["iid"].to_numpy(), x, table["y"].to_numpy(float) if model != "cox" else np.zeros(len(table)), table["wt"].to_numpy(float) if weighted else np.ones(len(table)), weighted, robust, order, starts, single, list(covariates))
    out.env = dict(zip(covariates, columns))
    out.study, out.fid = table["study"].to_numpy(), table["fid"].to_numpy()
    if stratum:
        out.strata, levels = pd.factorize(table["_stratum"].fillna(""))
        out.levels = list(levels)
    if model == "cox":
        out.entry, out.exit, out.event = table["entry"].to_numpy(float), table["exit"].to_numpy(float), table["event"].to_numpy(bool)
    if probs is not None:
        if not weighted:
            raise ValueError("inclusion probabilities need weights")
        named = linked.select("study", "iid", "fid", "wt")
        pairs = _bounded(stats.design_weights(probs, named), 32, "the design weights")
        slot = {k: i for i, k in enumerate(zip(table["study"], table["iid"]))}
        i, j = (np.array([slot.get((s, k), -1) for s, k in zip(pairs["study"], pairs[c])], np.int64) for c in ("iid_i", "iid_j"))
        both = (i >= 0) & (j >= 0)
        i, j, delta = i[both], j[both], pairs["delta"].to_numpy(float)[both]
        alone = np.zeros(len(table))
        if not robust:
            mine = (i == j) & single[i]
            alone[i[mine]] = delta[mine]
            i, j, delta = i[~mine], j[~mine], delta[~mine]
        by = np.argsort(i, kind="stable")
        i, j, delta = i[by], j[by], delta[by]
        first = np.flatnonzero(np.r_[True, np.diff(i) != 0]) if len(i) else np.zeros(0, np.int64)
        out.pairs = (i[first], first, j, delta, alone)
    return out


def pack(gt: DataFrame, made: Design, key: str = "variant", absent: float = float("nan"), compact: bool = False) -> DataFrame:
    """(key, g array<double>): the dosages of long genotypes (key, iid, g) in the design's order, null where missing.

    A subject without a row has `absent`: missing, or 0 where only carriers have rows. `compact` gives g as the bytes of
    `dosage`, which the scans read as well. Genotypes in VCF and bed files need none of this: see sources.packed.
    """
    n = len(made.ids)
    slots = gt.sparkSession.createDataFrame(pa.table({"iid": made.ids, "slot": np.arange(n)})).withColumn("iid", F.col("iid").cast(gt.schema["iid"].dataType))
    cells = gt.join(F.broadcast(slots), "iid")  # as long as the design, which is checked
    held = cells.groupBy(key).agg(F.collect_list("slot").alias("slots"), F.collect_list(F.coalesce(F.col("g").cast("double"), F.lit(float("nan")))).alias("values"))

    def fill(batches):
        for batch in batches:
            out = []
            for slots, values in zip(batch["slots"], batch["values"]):
                g = np.full(n, absent)
                g[np.asarray(slots)] = values
                out.append(dosage.encode(g) if compact else g)
            yield pd.DataFrame({key: batch[key], "g": out})

    return held.mapInPandas(fill, f"{key} {gt.schema[key].dataType.simpleString()}, g {'binary' if compact else 'array<double>'}")


def _family_sums(d: Design, s: np.ndarray) -> np.ndarray:
    """Sums over families of the rows of s (subjects x anything)."""
    return np.add.reduceat(s[d.order], d.starts, axis=0)


def meat(d: Design, u: np.ndarray, own) -> np.ndarray:
    """B from subjects' unweighted scores u; own(c) is the model's variance of single families, row i weighing c[i]."""
    if d.sink is not None:
        d.sink.append((u, own))
        return np.zeros((u.shape[1],) * 2)
    if d.pairs is not None:
        rows, first, j, delta, alone = d.pairs
        b = u[rows].T @ np.add.reduceat(delta[:, None] * u[j], first, axis=0) if len(rows) else np.zeros((u.shape[1],) * 2)
        return b if d.robust else b + own(alone)
    sums = _family_sums(d, u * d.w[:, None])
    if d.robust:
        return sums.T @ sums
    several = ~d.single[d.order[d.starts]]
    return sums[several].T @ sums[several] + own(np.where(d.single, d.w**2, 0.0))


def _own(x: np.ndarray, v: np.ndarray):
    return lambda c: (x * (c * v)[:, None]).T @ x


def _sandwich(d: Design, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    inverse = np.linalg.inv(a)
    if d.model_variance or d.sink is not None:
        return inverse
    cov = inverse @ b @ inverse
    return inverse if not d.weighted and cov[0, 0] < inverse[0, 0] - MARGIN else cov


def _linear(d: Design, x: np.ndarray, m: np.ndarray) -> tuple:
    w = d.w * m
    a0, b0 = (x * w[:, None]).T @ x, x.T @ (w * d.y)
    theta = np.linalg.solve(a0, b0)
    r = m * (d.y - x @ theta)
    if d.strata is None:
        s2 = np.full(len(m), (w * r**2).sum() / w.sum())
    else:
        spread = np.full(d.strata.max() + 1, (w * r**2).sum() / w.sum())
        sizes = np.bincount(d.strata, w)
        for _ in range(ITERATIONS):
            before, was = theta, spread
            k = w / spread[d.strata]
            theta = np.linalg.solve((x * k[:, None]).T @ x, x.T @ (k * d.y))
            r = m * (d.y - x @ theta)
            spread = np.where(sizes > 0, np.bincount(d.strata, w * r**2) / np.maximum(sizes, 1e-300), 1.0)
            if np.abs(theta - before).sum() + np.abs(spread - was).sum() < TOLERANCE:
                break
        else:
            return theta, None, "not converged"
        s2 = spread[d.strata]
    a = (x * (w / s2)[:, None]).T @ x
    return theta, _sandwich(d, a, meat(d, x * (r / s2)[:, None], _own(x, m / s2))), "ok"


def _logistic(d: Design, x: np.ndarray, m: np.ndarray) -> tuple:
    theta, w = np.zeros(x.shape[1]), d.w * m
    for _ in range(ITERATIONS):
        mu = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        step = np.linalg.solve((x * (w * mu * (1 - mu))[:, None]).T @ x, x.T @ (w * (d.y - mu)))
        theta = theta + step
        if not np.isfinite(theta).all() or np.abs(theta).max() > STEP_CAP:
            return theta, None, "not converged"
        if np.abs(step).sum() < TOLERANCE:
            break
    else:
        return theta, None, "not converged"
    mu = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
    v = m * mu * (1 - mu)
    a = (x * (d.w * v)[:, None]).T @ x
    return theta, _sandwich(d, a, meat(d, x * (m * (d.y - mu))[:, None], _own(x, v))), "ok"


class Risk:
    """Orders of entry, exit and event times of a Cox design; at risk at t: entry <= t <= exit. Studies share risk sets."""

    def __init__(self, d: Design):
        self.event = d.event
        self.times = np.unique(d.exit[d.event])
        self.by_exit, self.by_entry = np.argsort(d.exit, kind="stable"), np.argsort(d.entry, kind="stable")
        self.at_exit = np.searchsorted(d.exit[self.by_exit], self.times, side="left")
        self.at_entry = np.searchsorted(d.entry[self.by_entry], self.times, side="right")
        self.upto, self.before = np.searchsorted(self.times, d.exit, side="right"), np.searchsorted(self.times, d.entry, side="left")
        self.at = np.where(d.event, np.searchsorted(self.times, d.exit), 0)

    def over(self, values: np.ndarray) -> np.ndarray:
        """Sums over the subjects at risk at each event time."""
        zero = np.zeros((1, *values.shape[1:]))
        suffix = lambda by: np.concatenate([np.cumsum(values[by][::-1], axis=0)[::-1], zero])
        return suffix(self.by_exit)[self.at_exit] - suffix(self.by_entry)[self.at_entry]

    def spent(self, values: np.ndarray) -> np.ndarray:
        """Sums over the event times at which each subject is at risk."""
        run = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
        return run[self.upto] - run[self.before]


def cox_parts(d: Design, risk: Risk, x: np.ndarray, m: np.ndarray, theta: np.ndarray) -> dict:
    """Score, information, per-subject scores u and own(c) of a Cox model at theta, rows with m = 0 left out."""
    e = m * np.exp(np.clip(x @ theta, -60, 60))
    r = d.w * e
    s0, s1 = risk.over(r), risk.over(r[:, None] * x)
    at_event = lambda c: np.bincount(risk.at[risk.event], c[risk.event], len(risk.times))
    safe = np.where(s0 > 0, s0, 1.0)
    mean = np.where(s0[:, None] > 0, s1 / safe[:, None], 0.0)
    hit = at_event(d.w * m)
    hit = np.where(s0 > 0, hit, 0.0)

    def spread(c: np.ndarray) -> np.ndarray:  # the sum over event times of c * (S2 / S0 - mean mean')
        return (x * (r * risk.spent(c / safe))[:, None]).T @ x - (mean * c[:, None]).T @ mean

    u = -e[:, None] * (x * risk.spent(hit / safe)[:, None] - risk.spent((hit / safe)[:, None] * mean))
    u[risk.event] += m[risk.event][:, None] * (x[risk.event] - mean[risk.at[risk.event]])
    score = ((d.w * m)[risk.event][:, None] * x[risk.event]).sum(0) - (hit[:, None] * mean).sum(0)
    return {"score": score, "info": spread(hit), "u": u, "own": lambda c: spread(np.where(s0 > 0, at_event(c * m), 0.0))}


def _cox(d: Design, x: np.ndarray, m: np.ndarray, risk: Risk) -> tuple:
    """Capped Newton steps; a step that is no number starts anew with a tenth of the cap; given up after STOPS steps without gain."""
    x = x - (x * m[:, None]).sum(0) / max(m.sum(), 1)
    theta, cap, last, stops = np.zeros(x.shape[1]), STEP_CAP, np.inf, 0
    if not (m[d.event] > 0).any():
        return theta, None, "no event"
    for _ in range(ITERATIONS):
        part = cox_parts(d, risk, x, m, theta)
        step = np.linalg.solve(part["info"], part["score"])
        small = np.abs(step).max() > cap
        step = np.clip(step, -cap, cap)
        size = np.abs(step).sum()
        if not np.isfinite(size):
            theta, cap, last, stops = np.zeros(x.shape[1]), cap / 10, np.inf, 0
            if cap < 1e-6:
                break
            continue
        stops += size >= last - TOLERANCE and not small
        theta, last = theta + step, size
        if size < TOLERANCE:
            part = cox_parts(d, risk, x, m, theta)
            return theta, _sandwich(d, part["info"], meat(d, part["u"], part["own"])), "ok"
        if stops > STOPS:
            break
    return theta, None, "not converged"


def variants(batches, n: int, each):
    """What `each` gives for the keys and the dosages (a matrix of n columns) of up to BATCH variants at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            yield from each(batch.column(0), dosage.decode(batch.column(1), n))


def _rows(df: DataFrame, run, schema: str) -> DataFrame:
    """`run` gives dicts of the schema's columns for the Arrow batches of df; the rows go back BATCH at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches):
        held = []
        for row in run(batches):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held = []
        yield pa.RecordBatch.from_pylist(held, kinds)

    return df.mapInArrow(work, schema)


def wald_scan(packed: DataFrame, made: Design, envs: list[str] = (), key: str = "variant", variance: str = "sandwich") -> DataFrame:
    """One row per variant of a packed table: the fit of [g, 1, g x envs, covariates] (no 1 for Cox), no shuffle.

    `variance` "model" takes the inverse information alone.

    theta and cov cover all terms in that order, so effects of condition variants among the covariates (`term_rows`)
    and interactions (`interaction_test`) come from the same row. A variant without variance or fit has nulls and a status.
    """
    shared = packed.sparkSession.sparkContext.broadcast(replace(made, model_variance=variance == "model"))  # checked in design()

    def run(batches):
        d = shared.value
        risk = Risk(d) if d.model == "cox" else None
        for name, g in variants(batches, len(d.ids), lambda k, g: list(zip(k.to_pylist(), g))):
            m = np.isfinite(g).astype(float)
            g = np.where(m > 0, g, 0.0)
            ahead = 0 if d.model == "cox" else 1
            x = np.column_stack([g, *([np.ones(len(g))] if ahead else []), *[g * d.env[c] for c in envs], d.x[:, ahead:]]) * m[:, None]
            try:
                terms = x if ahead else np.column_stack([m, x])
                if not regular((terms * d.w[:, None]).T @ terms):
                    raise np.linalg.LinAlgError
                theta, cov, status = _cox(d, x, m, risk) if risk else (_logistic if d.model == "logistic" else _linear)(d, x, m)
            except np.linalg.LinAlgError:
                theta, cov, status = None, None, "singular"
            yield result_row(name, int(m.sum()), theta, cov, status)

    return _rows(packed.select(key, "g"), run, RESULT.replace("variant long", f"variant {packed.schema[key].dataType.simpleString()}"))


def term_rows(results: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(variant, term, beta, se, pvalue) of the named positions of theta, such as a scan's condition variants."""
    width = F.sqrt(F.size("cov")).cast("int")
    rows = results.select("variant", "theta", "cov", width.alias("p"), F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.lit(k).alias("at")) for n, k in terms.items()])).alias("t"))
    rows = rows.select("variant", "t.term", F.get("theta", F.col("t.at")).alias("beta"), F.sqrt(F.get("cov", F.col("t.at") * (F.col("p") + 1))).alias("se"))

    def tails(batches):
        for batch in batches:
            z = batch["beta"] / batch["se"]
            yield batch.assign(pvalue=[chi2_tail(float(v)) if v == v else None for v in z * z])

    return rows.mapInPandas(tails, f"variant {results.schema['variant'].dataType.simpleString()}, term string, beta double, se double, pvalue double")


def covariances(results: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(variant, a, b, cov) for each pair of the named positions, a before or at b: the detail of an interaction scan."""
    pairs = [(a, b, i, j) for i, (a, ka) in enumerate(terms.items()) for j, b in enumerate(terms) if i <= j]
    at = list(terms.values())
    rows = results.select("variant", "cov", F.sqrt(F.size("cov")).cast("int").alias("p"), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(at[i]).alias("i"), F.lit(at[j]).alias("j")) for a, b, i, j in pairs])).alias("t"))
    return rows.select("variant", "t.a", "t.b", F.get("cov", F.col("t.i") * F.col("p") + F.col("t.j")).alias("cov"))


def _null_parts(d: Design, null: dict) -> tuple[np.ndarray, np.ndarray]:
    """Residual and variance factor of each subject under a linear or logistic null."""
    eta = d.x @ np.asarray(null["theta"])
    if d.model == "logistic":
        mu = 1 / (1 + np.exp(-np.clip(eta, -40, 40)))
        return d.y - mu, mu * (1 - mu)
    s2 = np.full(len(eta), null["sigma2"]) if d.strata is None else np.array([null["sigma2s"][level] for level in d.levels])[d.strata]
    return (d.y - eta) / s2, 1 / s2


def _rescaled(u, v, v0, v_a, rescale: str | None, d: Design) -> tuple:
    """u and v by a factor: optimal v_a / v0 where both are positive, else naive: subjects / weights, if weighted."""
    naive = len(d.w) / d.w.sum() if d.weighted else 1.0
    k = naive if rescale == "naive" else v_a / v0 if rescale == "optimal" and v0 > 0 and v_a > 0 else naive if rescale == "optimal" else 1.0
    return u * k, v * k * k


def _imputed(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with missing values replaced by their mean, and the number of known ones."""
    known = np.isfinite(g)
    n = known.sum(1)
    mean = np.where(n > 0, np.where(known, g, 0.0).sum(1) / np.maximum(n, 1), np.nan)
    return np.where(known, g, mean[:, None]), n


SCORE = "n long, n_informative long, u double, v double, v_a double, beta double, se double, chisq double, pvalue double"


def _score_rows(d: Design, u, v0, v_a, n, rescale) -> list[tuple]:
    out = []
    for uu, vv, va, k in zip(u, v0, v_a, n):
        v = va if not d.weighted and (np.isnan(vv) or (vv > 0 and va > 0 and 1 / vv < 1 / va - MARGIN)) else vv
        if not (np.isfinite(v) and v > 0):
            out.append((len(d.y), int(k), *[None] * 7))
            continue
        beta, chisq = uu / v, uu * uu / v
        ru, rv = _rescaled(uu, v, vv, va, rescale, d)
        out.append((len(d.y), int(k), float(ru), float(rv), float(va), float(beta), float(v**-0.5), float(chisq), chi2_tail(float(chisq))))
    return out


def _adjust(d: Design, null: dict, r: np.ndarray, dd: np.ndarray, g: np.ndarray) -> np.ndarray:
    """g less its projection on the null's terms (rows are variants)."""
    k = d.w * dd
    a = np.linalg.solve((d.x * k[:, None]).T @ d.x, ((g * k) @ d.x).T)
    return g - (d.x @ a).T


def _quadratic(d: Design, s: np.ndarray, e: np.ndarray, dd: np.ndarray) -> np.ndarray:
    """v0 of each row: s are r e per subject, unweighted."""
    if d.pairs is not None:
        rows, first, j, delta, alone = d.pairs
        v = (s[:, rows] * np.add.reduceat(s[:, j] * delta, first, axis=1)).sum(1) if len(rows) else np.zeros(len(s))
        return v if d.robust else v + (e * e) @ (alone * dd)
    sums = _family_sums(d, (s * d.w).T)
    if d.robust:
        return (sums**2).sum(0)
    several = ~d.single[d.order[d.starts]]
    return (sums[several] ** 2).sum(0) + (e * e) @ np.where(d.single, d.w**2 * dd, 0.0)


def score_scan(packed: DataFrame, made: Design, null: dict, rescale: str | None = None, key: str = "variant") -> DataFrame:
    """One row per variant of a packed table: score test given a null model's theta; one matrix product a batch, no shuffle.

    Missing dosages are imputed by their mean. v is the adjusted score's variance; unweighted, v_a takes its place where
    1/v lies below 1/v_a less a margin. beta and se come before `rescale` ("naive" or "optimal"), u and v after it. For
    Cox without covariates it is the log-rank score test.
    """
    shared = packed.sparkSession.sparkContext.broadcast((made, null))  # checked in design()

    names = [key, *[c.split()[0] for c in SCORE.split(", ")]]

    def run(batches):
        d, held = shared.value
        cox = CoxNull(d, held) if d.model == "cox" else None
        r, dd = (None, None) if cox else _null_parts(d, held)

        def batch(keys, g):
            g, n = _imputed(g)
            if cox:
                u, v0, v_a = cox.test(np.nan_to_num(g))
                varied = (n > 0) & (np.ptp(np.nan_to_num(g), axis=1) > 0) & d.event.any()
            else:
                g = np.nan_to_num(g)
                e = _adjust(d, held, r, dd, g)
                u, v0, v_a = g @ (d.w * r), _quadratic(d, e * r, e, dd), (e * e) @ (d.w * dd)
                varied = (n > 0) & (v_a > 1e-12 * ((g * g) @ (d.w * dd)))  # else nothing is left of g
            u, v0, v_a = (np.where(varied, c, np.nan) for c in (u, v0, v_a))
            return [dict(zip(names, (name, *row))) for name, row in zip(keys.to_pylist(), _score_rows(d, u, v0, v_a, n, rescale))]

        return variants(batches, len(d.ids), batch)

    return _rows(packed.select(key, "g"), run, f"{key} {packed.schema[key].dataType.simpleString()}, {SCORE}")


class CoxNull:
    """What all variants' score tests share under a Cox null: its weights at risk, and the covariates' own parts."""

    def __init__(self, d: Design, null: dict):
        self.d, self.risk, theta = d, Risk(d), np.asarray(null["theta"], float)
        x = d.x - d.x.mean(0) if d.x.shape[1] else d.x
        self.x, self.e = x, np.exp(np.clip(x @ theta, -60, 60))
        self.r = d.w * self.e
        event = self.risk.event
        at_event = lambda c: np.bincount(self.risk.at[event], c[event], len(self.risk.times))
        self.s0 = self.risk.over(self.r)
        self.safe = np.where(self.s0 > 0, self.s0, 1.0)
        self.hit = np.where(self.s0 > 0, at_event(d.w), 0.0)
        own = d.pairs[4] if d.pairs is not None else np.where(d.single, d.w**2, 0.0)
        self.own = np.zeros_like(self.hit) if d.robust else np.where(self.s0 > 0, at_event(own), 0.0)
        self.mean = self.risk.over(self.r[:, None] * x) / self.safe[:, None]
        self.h, self.k = (self.r * self.risk.spent(c / self.safe) for c in (self.hit, self.own))
        self.h0 = self.risk.spent(self.hit / self.safe)
        self.u = self._scores(x, self.mean)
        self.info, self.spread = (self._cross(x, x, self.mean, self.mean, a, c) for a, c in ((self.h, self.hit), (self.k, self.own)))

    def _scores(self, x: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Per-subject scores of the columns of x, unweighted."""
        event = self.risk.event
        u = -self.e[:, None] * (x * self.h0[:, None] - self.risk.spent((self.hit / self.safe)[:, None] * mean))
        u[event] += x[event] - mean[self.risk.at[event]]
        return u

    @staticmethod
    def _cross(x, y, mean_x, mean_y, at, times):
        return (x * at[:, None]).T @ y - (mean_x * times[:, None]).T @ mean_y

    def test(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, v0, v_a) of each row of g, a batch's risk sums in one running sum."""
        d, x = self.d, (g - g.mean(1, keepdims=True)).T
        if not len(self.risk.times):
            return (np.full(len(g), np.nan),) * 3
        mean = self.risk.over(self.r[:, None] * x) / self.safe[:, None]
        event = self.risk.event
        score = (d.w[event, None] * x[event]).sum(0) - (self.hit[:, None] * mean).sum(0)
        square = lambda at, times: (x * x * at[:, None]).sum(0) - (mean * mean * times[:, None]).sum(0)
        info, own = square(self.h, self.hit), square(self.k, self.own)
        s = self._scores(x, mean)
        if self.x.shape[1]:
            cross = self._cross(x, self.x, mean, self.mean, self.h, self.hit)
            mix = -np.linalg.solve(self.info, cross.T).T  # a row a variant
            s = s + self.u @ mix.T
            info = info + 2 * (mix * cross).sum(1) + ((mix @ self.info) * mix).sum(1)
            own = own + 2 * (mix * self._cross(x, self.x, mean, self.mean, self.k, self.own)).sum(1) + ((mix @ self.spread) * mix).sum(1)
        if d.pairs is not None:
            rows, first, j, delta, _ = d.pairs
            v = (s[rows] * np.add.reduceat(delta[:, None] * s[j], first, axis=0)).sum(0) if len(rows) else np.zeros(len(g))
            return score, v + own, info
        sums = _family_sums(d, s * d.w[:, None])
        several = np.ones(len(sums), bool) if d.robust else ~d.single[d.order[d.starts]]
        return score, (sums[several] ** 2).sum(0) + own, info


def _cox_matrix(d: Design, risk: Risk, null: dict, g: np.ndarray) -> tuple:
    """(U, adjusted per-subject scores, B, A) of the columns of g under a Cox null."""
    k = g.shape[1]
    x = np.column_stack([g, d.x])
    x = x - x.mean(0)
    part = cox_parts(d, risk, x, np.ones(len(g)), np.r_[np.zeros(k), null["theta"]])
    info = part["info"]
    mix = np.vstack([np.eye(k), -np.linalg.solve(info[k:, k:], info[k:, :k])]) if x.shape[1] > k else np.eye(k)
    b = meat(d, part["u"], part["own"])
    return part["score"][:k], mix.T @ b @ mix, mix.T @ info @ mix


def gene_scan(packed: DataFrame, groups: DataFrame, made: Design, null: dict, maf_ub: float = 0.05, cr_lb: float = 0.0, rescale: str | None = None, key: str = "variant", tile: int = TILE) -> DataFrame:
    """(gene, i, j, u, v): each gene's score vector (on i = j) and the lower triangle of its variance, all models.

    Variants without a call, over `maf_ub` or under `cr_lb` are left out first, on packed rows. A gene's variants are dealt
    to tiles of `tile`; each pair of tiles is a group of its own, so that a gene of any size is spread over tasks that hold
    two tiles of genotypes at most. Unweighted, the rows and columns of variants whose 1/v lies below 1/v_a less a margin
    come from the model's variance, and all where the design asks for it. `rescale` takes the sums over the gene for its factor.
    """
    shared = packed.sparkSession.sparkContext.broadcast((made, null))  # checked in design()
    kinds = groups.schema["gene"].dataType.simpleString(), packed.schema[key].dataType.simpleString()

    def known(batches):
        d = shared.value[0]

        def batch(keys, g):
            _, n = _imputed(g)
            af = np.nansum(g, axis=1) / np.maximum(2 * n, 1)
            return [{key: k} for k, ok in zip(keys.to_pylist(), (n > 0) & (af <= maf_ub) & (n >= cr_lb * g.shape[1])) if ok]

        return variants(batches, len(d.ids), batch)

    kept = _rows(packed.select(key, "g"), known, f"{key} {kinds[1]}")
    members = groups.select("gene", key).distinct().join(kept, key)
    # places in a gene's order: thin rows, so a gene's numbers may meet in one window
    members = members.withColumn("tile", F.floor((F.row_number().over(W.partitionBy("gene").orderBy(key)) - 1) / tile).cast("int"))
    tiles = members.withColumn("tiles", F.max("tile").over(W.partitionBy("gene")) + 1)
    pairs = F.sequence(F.lit(0), F.col("tiles") - 1)
    sent = tiles.select("gene", key, "tile", F.explode(pairs).alias("other")).select("gene", key, "tile", F.greatest("tile", "other").alias("a"), F.least("tile", "other").alias("b"))
    met = sent.join(packed.select(key, "g"), key)

    def test(group: pa.Table) -> pa.Table:
        d, held = shared.value
        group = group.sort_by(key)
        a, b = group["a"][0].as_py(), group["b"][0].as_py()
        g, _ = _imputed(dosage.decode(group["g"].combine_chunks(), len(d.ids)))
        names, own = group[key].to_pylist(), np.array(group["tile"].to_pylist())
        if d.model == "cox":
            u, v0, v_a = _cox_matrix(d, Risk(d), held, g.T)
        else:
            r, dd = _null_parts(d, held)
            e = _adjust(d, held, r, dd, g)
            u, v0, v_a = g @ (d.w * r), meat(d, (e * r).T, lambda c: (e * (c * dd)) @ e.T), (e * (d.w * dd)) @ e.T
        diagonal, model = np.diag(v0), np.zeros(len(u), bool)
        if not d.weighted:
            with np.errstate(divide="ignore", invalid="ignore"):
                model = np.isnan(diagonal) | (1 / diagonal < 1 / np.diag(v_a) - MARGIN)
        v = v_a if d.model_variance else np.where(model[:, None] | model[None, :], v_a, v0)
        i, j = np.tril_indices(len(u))
        cross = (own[i] == a) & (own[j] == b) | (own[i] == b) & (own[j] == a)
        i, j = i[cross], j[cross]
        twice = np.where(i == j, 1.0, 2.0)
        return pa.table({"gene": [group["gene"][0].as_py()] * len(i), "i": [names[k] for k in i], "j": [names[k] for k in j], "u": np.where(i == j, u[i], np.nan), "v": v[i, j], "v0": twice * v0[i, j], "v_a": twice * v_a[i, j]})

    out = met.groupBy("gene", "a", "b").applyInArrow(test, f"gene {kinds[0]}, i {kinds[1]}, j {kinds[1]}, u double, v double, v0 double, v_a double")
    out = out.withColumn("u", F.when(~F.isnan("u"), F.col("u")))
    if rescale is None:
        return out.drop("v0", "v_a")
    naive = F.lit(len(made.w) / float(made.w.sum()) if made.weighted else 1.0)
    total = out.groupBy("gene").agg(F.sum("v0").alias("v0"), F.sum("v_a").alias("v_a"))
    k = naive if rescale == "naive" else F.when((F.col("v0") > 0) & (F.col("v_a") > 0), F.col("v_a") / F.col("v0")).otherwise(naive)
    return out.drop("v0", "v_a").join(total.select("gene", k.alias("k")), "gene").select("gene", "i", "j", (F.col("u") * F.col("k")).alias("u"), (F.col("v") * F.col("k") * F.col("k")).alias("v"))
