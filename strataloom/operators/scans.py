"""Scans over long genotypes in the form that holds their subjects: packed, or long where the design is too large to broadcast.

Both forms give the same numbers. The choice needs the number of phenotype rows alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from strataloom.operators import packed, score, stats, wald
from strataloom.operators.staging import shuffled

#: Bytes of a design (packed.design) beyond which scans take the long form: 900,000 subjects' Cox designs (101 MB) took 1362 MB
#: of the driver's memory and 2974 MB of an executor's.
LONG = 112 << 20


def large(pheno: DataFrame, covariates: list[str] = (), model: str = "linear") -> bool:
    """Whether the design of `pheno` is too large for the packed form."""
    return pheno.count() * 8 * (10 + (3 if model == "cox" else 1) + len(covariates)) > LONG


def _complete(pheno: DataFrame, covariates: list[str], model: str, weighted: bool) -> DataFrame:
    outcome = ["entry", "exit", "event"] if model == "cox" else ["y"]
    return pheno.dropna(subset=["iid", "fid", *outcome, *covariates, *(["wt"] if weighted else [])])


def wald_scan(pheno: DataFrame, gt: DataFrame, covariates: list[str] = (), model: str = "linear", envs: list[str] = (), weighted: bool = False) -> DataFrame:
    """One row per variant: the fit of [g, 1, g x envs, covariates] (no 1 for Cox). The long form centres covariates and outcome, so
    that theta and cov of the 1 differ. `envs` are for linear models."""
    covariates = list(covariates)
    if not large(pheno, covariates, model):
        made = packed.design(pheno, covariates, model, weighted, genotyped=gt)
        return packed.wald_scan(packed.pack(gt, made, compact=True), made, envs)
    whole = _complete(pheno, covariates, model, weighted)
    if model == "linear":
        return wald.linear_wald(whole, gt, covariates, weighted, extras=[f"g * {c}" for c in envs])
    if envs:
        raise ValueError("interactions have a long form for linear models alone")
    return (wald.cox_wald if model == "cox" else wald.logistic_wald)(whole, gt, covariates, weighted)


def score_scan(pheno: DataFrame, gt: DataFrame, null: dict, model: str = "linear", rescale: str | None = None) -> DataFrame:
    """One row per variant: n, u, v, beta, se, chisq (v_a for Cox) of the score test under `null` (score.fit_null_...).

    gt has a row, null where missing, for each subject and variant. Rescaling and weights are for linear models.
    """
    covariates, weighted = list(null["covariates"]), bool(null.get("weighted"))
    if not large(pheno, covariates, model):
        made = packed.design(pheno, covariates, model, weighted, genotyped=gt)
        return packed.score_scan(packed.pack(gt, made, compact=True), made, null, rescale)
    whole = _complete(pheno, covariates, model, weighted)
    gt = gt.join(shuffled(whole.select("iid").distinct()), "iid", "left_semi")  # missing dosages are imputed over the design's subjects
    if model == "linear":
        return score.linear_score(whole, gt, null, stats.variant_stats(gt), rescale)
    if weighted or rescale:
        raise ValueError("weights and rescaling have a long form for linear models alone")
    return score.cox_score(whole, gt, null) if model == "cox" else score.logistic_score(whole, gt, null, stats.variant_stats(gt))
