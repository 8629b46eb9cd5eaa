"""Packed scans against plain numpy and against the long forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import packed, score, stats, wald

N = 90


@pytest.fixture(scope="module")
def people():
    r = np.random.default_rng(3)
    rows = []
    for i in range(N):
        out = int(r.integers(3, 40))
        rows.append((i, i if i % 3 else 1000 + i // 6, "ab"[i % 2], float(1 + i % 4), i % 2, int(r.integers(0, out)), out, bool(r.random() < 0.6), float(r.normal()), float(i % 5), float(r.normal() * (1 + i % 2)), int(r.random() < 0.4)))
    return rows


@pytest.fixture(scope="module")
def frames(spark, people):
    pheno = spark.createDataFrame(people, "iid long, fid long, stratum string, wt double, study int, entry long, exit long, event boolean, x1 double, x2 double, y double, yb int")
    gt = spark.createDataFrame([(p[0], v, None if (p[0] + v) % 29 == 0 else (p[0] * (v + 3)) % 7 % 3) for p in people for v in range(4)], "iid long, variant long, g long")
    return pheno.drop("study").cache(), gt.cache(), pheno


@pytest.fixture(scope="module")
def probs(spark, people):
    """Joint inclusion probabilities within each of two studies."""
    rows = [(p[4], p[0], q[0], 1 / p[3] if p[0] == q[0] else min(1.0, (1 + ((p[0] + q[0]) % 3) * 0.05) / p[3] / q[3])) for p in people for q in people if p[4] == q[4]]
    return spark.createDataFrame(rows, "study int, iid_i long, iid_j long, pi double")


def dense(people, v):
    g = np.array([np.nan if (p[0] + v) % 29 == 0 else (p[0] * (v + 3)) % 7 % 3 for p in people], float)
    return g, {k: np.array([p[i] for p in people], float) for i, k in enumerate("iid fid _ wt study entry exit event x1 x2 y yb".split()) if k != "_"}


def rows_of(df):
    return {r.variant: r for r in df.collect()}


@pytest.mark.parametrize("weighted, robust", [(False, False), (False, True), (True, False), (True, True)])
def test_as_the_long_forms(frames, weighted, robust):
    pheno, gt, _ = frames
    d = packed.design(pheno, ["x1"], weighted=weighted, robust=robust, genotyped=gt)
    table = packed.pack(gt, d)
    close = lambda a, b, *names: all(np.isclose(a[v][n], b[v][n], atol=1e-5) for v in b for n in names)
    assert close(rows_of(packed.wald_scan(table, d)), rows_of(wald.linear_wald(pheno, gt, ["x1"], weighted, robust)), "beta", "se", "n")
    strata = packed.design(pheno, ["x1"], weighted=weighted, robust=robust, stratum="stratum", genotyped=gt)
    assert close(rows_of(packed.wald_scan(table, strata)), rows_of(wald.linear_wald_hetero(pheno, gt, ["x1"], weighted=weighted, robust=robust)), "beta", "se", "n")
    binary = pheno.withColumn("y", F.col("yb"))
    logit = packed.design(binary, ["x1"], "logistic", weighted, robust, genotyped=gt)
    assert close(rows_of(packed.wald_scan(table, logit)), rows_of(wald.logistic_wald(binary, gt, ["x1"], weighted, robust)), "beta", "se")
    cox = packed.design(pheno, ["x1"], "cox", weighted, robust, genotyped=gt)
    assert close(rows_of(packed.wald_scan(table, cox)), rows_of(wald.cox_wald(pheno, gt, ["x1"], weighted, robust)), "beta", "se")
    null = score.fit_null_cox(pheno, ["x1"], weighted)
    assert close(rows_of(packed.score_scan(table, cox, null)), rows_of(score.cox_score(pheno, gt, null, weighted, robust)), "u", "v", "v_a", "beta")
    if not robust:
        null = score.fit_null_linear(pheno, ["x1"], weighted)
        for rescale in (None, "naive", "optimal"):
            assert close(rows_of(packed.score_scan(table, d, null, rescale)), rows_of(score.linear_score(pheno, gt, null, stats.variant_stats(gt), rescale)), "u", "v", "beta", "se")


def delta_of(people, w, fid, study):
    n = len(people)
    pi = lambda i, j: 1 / w[i] if i == j else min(1.0, (1 + ((people[i][0] + people[j][0]) % 3) * 0.05) / w[i] / w[j])
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            if study[i] == study[j]:
                out[i, j] = w[i] * w[j] if fid[i] == fid[j] else (pi(i, j) - pi(i, i) * pi(j, j)) * w[i] * w[j] / pi(i, j)
    return out


@pytest.mark.parametrize("model", ["linear", "logistic", "cox"])
@pytest.mark.parametrize("robust", [False, True])
def test_inclusion_probabilities(people, frames, probs, model, robust):
    """U' Delta U by dense matrices over two studies, at the fitted theta; singletons by the model's variance unless robust."""
    gt, pheno = frames[1], frames[2].withColumn("y", F.col("yb").cast("double")) if model == "logistic" else frames[2]
    d = packed.design(pheno, ["x1"], model, weighted=True, robust=robust, probs=probs, genotyped=gt)
    got = rows_of(packed.wald_scan(packed.pack(gt, d), d))
    for v in range(4):
        g, c = dense(people, v)
        m = np.isfinite(g)
        x = np.column_stack([np.where(m, g, 0), *([np.ones(N)] if model != "cox" else []), c["x1"]]) * m[:, None]
        theta, w = np.array(got[v].theta), c["wt"]
        sizes = {}
        for p in people:
            sizes[p[4], p[1]] = sizes.get((p[4], p[1]), 0) + 1
        single = np.array([sizes[p[4], p[1]] == 1 for p in people])
        delta = delta_of(people, w, c["fid"], c["study"])
        own = np.where(single & (not robust), np.diag(delta), 0.0)
        delta = delta - np.diag(own)
        if model == "cox":
            x, u, a, b0 = x - x[m].mean(0), np.zeros_like(x), 0, 0
            x = x * m[:, None]
            for i in range(N):
                if c["event"][i] and m[i]:
                    risk = m & (c["entry"] <= c["exit"][i]) & (c["exit"] >= c["exit"][i])
                    e = np.where(risk, w * np.exp(x @ theta), 0)
                    mean = e @ x / e.sum()
                    spread = (x * e[:, None]).T @ x / e.sum() - np.outer(mean, mean)
                    a, b0 = a + w[i] * spread, b0 + own[i] * spread
                    u[i] += x[i] - mean
                    u -= w[i] * (np.where(risk, np.exp(x @ theta), 0) / e.sum())[:, None] * (x - mean)
            assert np.allclose((w[:, None] * u).sum(0), 0, atol=1e-3)
        else:
            y = c["yb"] if model == "logistic" else c["y"]
            mu = 1 / (1 + np.exp(-x @ theta)) if model == "logistic" else x @ theta
            s2 = 1.0 if model == "logistic" else (w * m * (y - mu) ** 2).sum() / (w * m).sum()
            var = m * (mu * (1 - mu) if model == "logistic" else 1 / s2)
            u = x * (m * (y - mu) / s2)[:, None]
            assert np.allclose((w[:, None] * u).sum(0), 0, atol=1e-3)
            a, b0 = (x * (w * var)[:, None]).T @ x, (x * (own * var)[:, None]).T @ x
        cov = np.linalg.inv(a) @ (u.T @ delta @ u + b0) @ np.linalg.inv(a)
        if np.diag(cov).min() > 0:
            assert np.isclose(got[v].se, np.sqrt(cov[0, 0]), rtol=1e-4)
        else:
            assert got[v].status == "variance"


def test_scores_with_probabilities_and_strata(people, frames, probs):
    gt, pheno = frames[1], frames[2]
    d = packed.design(pheno, ["x1"], weighted=True, robust=True, stratum="stratum", probs=probs, genotyped=gt)
    null = score.fit_null_linear(pheno, ["x1"], True, "stratum")
    got = rows_of(packed.score_scan(packed.pack(gt, d), d, null))
    for v in range(4):
        g, c = dense(people, v)
        g = np.where(np.isfinite(g), g, np.nanmean(g))
        x, w = np.column_stack([g, np.ones(N), c["x1"]]), c["wt"]
        s2 = np.array([null["sigma2s"][p[2]] for p in people])
        u = x * ((c["y"] - x[:, 1:] @ null["theta"]) / s2)[:, None]
        a, b = (x * (w / s2)[:, None]).T @ x, u.T @ delta_of(people, w, c["fid"], c["study"]) @ u
        k = np.r_[1, -np.linalg.solve(a[1:, 1:], a[1:, 0])]
        assert np.isclose(got[v].u, w @ u[:, 0]) and np.isclose(got[v].v, k @ b @ k) and np.isclose(got[v].v_a, k @ a @ k)


@pytest.mark.parametrize("model", ["linear", "logistic", "cox"])
def test_genes(spark, people, frames, model):
    pheno, gt, _ = frames
    pheno = pheno.withColumn("y", F.col("yb").cast("double")) if model == "logistic" else pheno
    null = {"linear": score.fit_null_linear, "logistic": score.fit_null_logistic, "cox": score.fit_null_cox}[model](pheno, ["x1"])
    groups = spark.createDataFrame([("A", 0), ("A", 1), ("A", 3), ("B", 2), ("B", 1)], "gene string, variant long")
    d = packed.design(pheno, ["x1"], model, genotyped=gt)
    table = packed.pack(gt, d)
    alone = rows_of(packed.score_scan(table, d, null))
    rows = packed.gene_scan(table, groups, d, null, maf_ub=1.0).collect()
    assert {(r.gene, r.i, r.j) for r in rows} == {("A", 0, 0), ("A", 1, 0), ("A", 1, 1), ("A", 3, 0), ("A", 3, 1), ("A", 3, 3), ("B", 1, 1), ("B", 2, 1), ("B", 2, 2)}
    assert all(np.isclose(r.u, alone[r.i].u) and np.isclose(r.v, alone[r.i].v) for r in rows if r.i == r.j)
    robust = packed.design(pheno, ["x1"], model, weighted=True, robust=True, genotyped=gt)
    wide = {(r.i, r.j): r.v for r in packed.gene_scan(table, groups.where("gene = 'A'"), robust, null, maf_ub=1.0).collect()}
    if model != "cox":  # each pair's variance from the family sums of the adjusted scores
        e = {}
        for v in (0, 1, 3):
            g, c = dense(people, v)
            g = np.where(np.isfinite(g), g, np.nanmean(g))
            x, w = np.column_stack([np.ones(N), c["x1"]]), c["wt"]
            eta = x @ null["theta"]
            mu = 1 / (1 + np.exp(-eta)) if model == "logistic" else eta
            dd = mu * (1 - mu) if model == "logistic" else np.full(N, 1 / null["sigma2"])
            r = (c["yb"] - mu) if model == "logistic" else (c["y"] - mu) / null["sigma2"]
            k = w * dd
            e[v] = w * r * (g - x @ np.linalg.solve((x * k[:, None]).T @ x, x.T @ (k * g)))
        sums = lambda v: np.array([e[v][c["fid"] == f].sum() for f in np.unique(c["fid"])])
        assert all(np.isclose(wide[i, j], sums(i) @ sums(j)) for i, j in wide)
    scaled = {(r.i, r.j): r.v for r in packed.gene_scan(table, groups.where("gene = 'A'"), robust, null, maf_ub=1.0, rescale="naive").collect()}
    assert all(np.isclose(scaled[k], wide[k] * (N / robust.w.sum()) ** 2) for k in wide)
    few = packed.gene_scan(table, groups, d, null, maf_ub=0.4).collect()
    af = {r.variant: r.alt_af for r in stats.variant_stats(gt).collect()}
    assert {r.i for r in few} == {v for v in af if af[v] <= 0.4}


def test_terms_and_interactions(frames):
    pheno, gt, _ = frames
    d = packed.design(pheno, ["x1", "x2"], genotyped=gt)
    table = packed.pack(gt, d)
    found = packed.wald_scan(table, d, ["x1"])
    long = rows_of(wald.interaction_test(wald.linear_wald(pheno, gt, ["x1", "x2"], extras=["g * x1"]), 1))
    got = rows_of(wald.interaction_test(found, 1))
    assert all(np.isclose(got[v][c], long[v][c]) for v in long for c in ("p_g", "p_inter", "p_both"))
    terms = {(r.variant, r.term): r for r in packed.term_rows(found, {"g": 0, "g_x_x1": 2}).collect()}
    whole = rows_of(found)
    assert all(np.isclose(terms[v, "g"].se, whole[v].se) and np.isclose(terms[v, "g"].pvalue, whole[v].pvalue) for v in whole)
    cov = {(r.variant, r.a, r.b): r.cov for r in packed.covariances(found, {"g": 0, "g_x_x1": 2}).collect()}
    assert len(cov) == 12 and np.isclose(cov[0, "g_x_x1", "g_x_x1"], terms[0, "g_x_x1"].se ** 2)


def test_no_shuffle_and_odd_variants(spark, frames):
    pheno, _, _ = frames
    d = packed.design(pheno, ["x1"])
    rng = np.random.default_rng(1)
    rows = [(1, [1.0] * N), (2, [float("nan")] * N), (3, rng.integers(0, 3, N).astype(float).tolist())]
    table = spark.createDataFrame(rows, "variant long, g array<double>")
    null = score.fit_null_linear(pheno, ["x1"])
    for out in (packed.wald_scan(table, d), packed.score_scan(table, d, null)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        got = rows_of(out)
        assert got[1].beta is None and got[2].beta is None and got[3].beta is not None
    assert rows_of(packed.wald_scan(table, d))[1].status == "singular"
    with pytest.raises(ValueError, match="no subject"):
        packed.design(pheno.where("iid < 0"), ["x1"])


def test_packing_carriers_only(spark, frames):
    pheno, gt, _ = frames
    d = packed.design(pheno)
    sparse = gt.where("g IS NULL OR g > 0")
    whole = {r.variant: r.g for r in packed.pack(gt, d).collect()}
    assert {r.variant: r.g for r in packed.pack(sparse, d, absent=0.0).collect()} == whole and any(None in g for g in whole.values())


def test_scores_of_a_stream(spark, frames, tmp_path):
    """With a given null model the scan keeps no state, so a stream of variants gives the same rows."""
    pheno, gt, _ = frames
    d = packed.design(pheno, ["x1"])
    table, null = packed.pack(gt, d), score.fit_null_linear(pheno, ["x1"])
    table.write.parquet(f"{tmp_path}/in")
    stream = packed.score_scan(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), d, null)
    query = stream.writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got, want = rows_of(spark.table("streamed")), rows_of(packed.score_scan(table, d, null))
    assert got.keys() == want.keys() and all(np.isclose(got[v].u, want[v].u) and np.isclose(got[v].v, want[v].v) for v in want)
