"""Inclusion probabilities in blocks against the broadcast form, whose test is plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import blocked, packed, score
from tests.test_packed import frames, people, probs, rows_of  # noqa: F401  fixtures


@pytest.mark.parametrize("model, robust, size, batches", [("linear", False, 7, 1), ("logistic", True, 512, 3), ("cox", False, 16, 2)])
def test_wald_as_the_broadcast_form(frames, probs, model, robust, size, batches):  # noqa: F811
    gt, pheno = frames[1], frames[2].withColumn("y", F.col("yb").cast("double")) if model == "logistic" else frames[2]
    gt = gt.unionByName(gt.select("iid", F.lit(9).cast("long").alias("variant"), F.lit(1).cast("long").alias("g")).distinct())
    whole = packed.design(pheno, ["x1"], model, weighted=True, robust=robust, probs=probs, genotyped=gt)
    made = packed.design(pheno, ["x1"], model, weighted=True, robust=robust, members=probs, genotyped=gt)
    assert made.pairs is None and (made.ids == whole.ids).all()
    want = rows_of(packed.wald_scan(packed.pack(gt, whole), whole))
    found = blocked.wald_scan(packed.pack(gt, made, compact=True), made, probs, size=size, batches=batches)
    got = rows_of(found)
    assert set(got) == set(want) and len(got) == 5 and got[9].status == "singular"
    for v, w in want.items():
        assert (got[v].n, got[v].status, got[v].beta is None) == (w.n, w.status, w.beta is None)
        if w.cov is not None:
            assert np.allclose(got[v].theta, w.theta) and np.allclose(got[v].cov, w.cov)


@pytest.mark.parametrize("model, robust, size, batches", [("linear", False, 7, 1), ("logistic", True, 40, 2)])
def test_score_as_the_broadcast_form(frames, probs, model, robust, size, batches):  # noqa: F811
    gt, pheno = frames[1], frames[2].withColumn("y", F.col("yb").cast("double")) if model == "logistic" else frames[2]
    whole = packed.design(pheno, ["x1"], model, weighted=True, robust=robust, probs=probs, genotyped=gt)
    made = packed.design(pheno, ["x1"], model, weighted=True, robust=robust, members=probs, genotyped=gt)
    null = (score.fit_null_logistic if model == "logistic" else score.fit_null_linear)(pheno, ["x1"], True)
    want = rows_of(packed.score_scan(packed.pack(gt, whole), whole, null))
    got = rows_of(blocked.score_scan(packed.pack(gt, made, compact=True), made, probs, null, size=size, batches=batches))
    assert set(got) == set(want)
    for v, w in want.items():
        assert (got[v].v is None) == (w.v is None)
        assert w.v is None or np.allclose([got[v].u, got[v].v, got[v].beta, got[v].se], [w.u, w.v, w.beta, w.se])
