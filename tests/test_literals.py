"""Literal cases and brute-force twins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import scalar
from strataloom.operators import link, model, reads, survival, wald


def test_genotypes(spark):
    df = spark.createDataFrame([("0|1",), ("1/1",), ("0|.",), ("1",), ("./.",), (None,)], "gt string")
    assert [r[0] for r in df.select(scalar.gt_dosage(F.col("gt"))).collect()] == [1, 2, None, 1, None, None]
    ds = spark.sql("SELECT map('DS', '0.5') AS m UNION ALL SELECT map('DS', '.')").select(scalar.ds_dosage(F.col("m")).alias("d"))
    assert sorted(r.d is None for r in ds.collect()) == [False, True]


@pytest.mark.parametrize(("how", "want"), [("left", 10), ("right", 20), ("nearest", 20), ("linear", 15), ("baseline", 10)])
def test_asof(spark, how, want):
    obs = spark.createDataFrame([(1, 1.0, 10.0), (1, 3.0, 20.0)], "iid long, time double, value double")
    grid = spark.createDataFrame([(1, 2.0)], "iid long, time double")
    assert link.asof_values(obs, grid, how).first().value == want


def test_regions(spark):
    df = spark.createDataFrame([("c", 13, 15), ("c", 14, 20), ("c", 25, 26), ("c", 9, 9)], "chrom string, start long, end long")
    merged = link.merge_regions(df)
    assert sorted((r.start, r.end) for r in merged.collect()) == [(13, 20), (25, 26)]
    points = spark.createDataFrame([("c", 13), ("c", 19), ("c", 20), ("c", 25)], "chrom string, pos long")
    assert {r.pos: r.inside for r in link.in_regions(points, merged).collect()} == {13: True, 19: True, 20: False, 25: True}


@pytest.mark.parametrize(("text", "left", "want"), [("445566", True, 2), ("445554555", True, 6), ("665544", False, 2), ("555455544", False, 6), ("4", True, 0)])
def test_trim(spark, text, left, want):
    df = spark.createDataFrame([([int(c) for c in text],)], "q array<int>")
    assert df.select(reads.trim_index(F.col("q"), 5, left).alias("n")).first().n == want


def test_buckets(spark):
    df = spark.createDataFrame([(0.0,), (4.0,), (5.0,), (10.0,)], "x double")
    assert [r.x for r in model.bucketize(df, "x", 2).collect()] == [2.5, 2.5, 7.5, 7.5]


def test_kaplan_meier_and_ties(spark):
    rows = [(1, 1, True), (2, 1, True), (3, 2, False), (4, 3, True)]
    df = spark.createDataFrame(rows, "iid long, exit long, event boolean").selectExpr("iid", "'a' AS stratum", "-1L AS entry", "exit", "event")
    assert [round(r.survival, 9) for r in survival.kaplan_meier(df).orderBy("time").collect()] == [0.5, 0.5, 0.0]
    assert {r.time: r.ties for r in survival.ties_constant(df).collect()}[1] == pytest.approx(2 / 3)


def test_tails():
    assert scalar.chi2_tail(4.0, 2) == pytest.approx(math.exp(-2))
    assert scalar.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert scalar.chi2_tail(9.487729036781154, 4) == pytest.approx(0.05)
    assert scalar.chi2_tail(float("nan")) is None


def test_formula_refuses_unknown_functions(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "y double, a double")
    with pytest.raises(ValueError):
        model.model_matrix(df, "y = java_method(a)")


def test_logistic_fit_against_plain_newton():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 3, 60), np.ones(60)])
    y = (rng.random(60) < 1 / (1 + np.exp(-(0.7 * x[:, 0] - 0.5)))).astype(float)
    theta, info, ok = wald.logistic_fit(x, y, np.ones(60))
    mu = 1 / (1 + np.exp(-x @ theta))
    assert ok and np.abs(x.T @ (y - mu)).max() < 1e-3


def test_cox_sums_against_loops():
    rng = np.random.default_rng(2)
    n = 40
    x, w = rng.normal(size=(n, 2)), rng.integers(1, 4, n).astype(float)
    exit_ = rng.integers(1, 15, n).astype(float)
    entry = np.minimum(exit_, rng.integers(0, 6, n)).astype(float)
    event = rng.random(n) < 0.6
    theta = np.array([0.3, -0.2])
    times, s0, s1, _, e = wald.cox_sums(x, w, entry, exit_, event, theta)
    for k, t in enumerate(times):
        at = (entry <= t) & (t <= exit_)
        assert s0[k] == pytest.approx(e[at].sum())
        assert s1[k] == pytest.approx((e[at][:, None] * x[at]).sum(0))
    u = np.zeros((n, 2))
    for i in range(n):
        for k, t in enumerate(times):
            here = event & (exit_ == t)
            if event[i] and exit_[i] == t:
                u[i] += x[i] - s1[k] / s0[k]
            if entry[i] <= t <= exit_[i]:
                u[i] -= w[here].sum() * np.exp(x[i] @ theta) * (x[i] - s1[k] / s0[k]) / s0[k]
    assert wald.cox_scores(x, w, entry, exit_, event, theta) == pytest.approx(u)


def test_pileup(spark):
    df = spark.createDataFrame([("r", 10, "2M1D2M", "ACGT", "IIII"), ("r", 11, "3M", "CCC", "III")], "rname string, pos long, cigar string, seq string, qual string")
    found = {r.refpos: (r.depth, r.bases) for r in reads.pileup(df, del_as_base=True).collect()}
    assert found == {10: (1, "A"), 11: (2, "CC"), 12: (2, "-C"), 13: (2, "CG"), 14: (1, "T")}


def test_fastq_errors(spark):
    rows = [(1, "@a", "ACGTACGTACGT", "+", "IIIIIIIIIIII"), (5, "@a", "ACGT", "+", "III"), (9, "b", "ACGTACGTACGT", "+b", "IIIIIIIIIIII")]
    df = spark.createDataFrame(rows, "line long, id_line string, seq string, plus string, qual string")
    found = {r.line: set(r.errors) for r in reads.validate_fastq(df).collect()}
    assert "duplicate id" in found[1] and {"read too short", "lengths differ"} <= found[5] and "id line does not start with @" in found[9]


def test_interleaved_pairs(spark):
    rows = [(1, "@a/1 x"), (5, "@a/2"), (9, "@b"), (13, "@b"), (17, "@c/1"), (21, "@d/2"), (25, "@e/1")]
    bad = reads.interleaved_errors(spark.createDataFrame(rows, "line long, id_line string")).orderBy("pair").collect()
    assert [tuple(r) for r in bad] == [(2, "c/1", "d/2"), (3, "e/1", None)]
