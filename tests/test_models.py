"""Models without a SQL twin against plain numpy, and the binary source and gene sink on small files."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import score, survival, wald
from strataloom.plans import registry
from strataloom.sources import plink, text


@pytest.fixture(scope="module")
def people():
    r = np.random.default_rng(5)
    rows = []
    for i in range(160):
        out = int(r.integers(2, 30))
        rows.append((i, i if i % 3 else 1000 + i // 6, "ab"[i % 2], float(1 + i % 4), int(r.integers(0, out)), out, bool(r.random() < 0.6), float(r.normal()), float(i % 5), float(r.normal() * (1 + i % 2))))
    return rows


@pytest.fixture(scope="module")
def frames(spark, people):
    surv = spark.createDataFrame(people, "iid long, fid long, stratum string, wt double, entry long, exit long, event boolean, x1 double, x2 double, y double")
    gt = spark.createDataFrame([(p[0], v, None if (p[0] + v) % 29 == 0 else (p[0] * (v + 3)) % 7 % 3) for p in people for v in range(3)], "iid long, variant long, g long")
    return surv.cache(), gt.cache()


def brute_cox(people, x, theta, by=lambda p: 0):
    """Score, information and per-subject residuals by going through all event times and subjects."""
    u, info, w = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2), np.zeros(x.shape)
    for i, p in enumerate(people):
        if not p[6]:
            continue
        risk = [j for j, q in enumerate(people) if by(q) == by(p) and q[4] <= p[5] <= q[5]]
        e = np.exp(x[risk] @ theta)
        mean = e @ x[risk] / e.sum()
        u += x[i] - mean
        info += (x[risk] * e[:, None]).T @ x[risk] / e.sum() - np.outer(mean, mean)
        w[i] += x[i] - mean
        w[risk] -= (x[risk] - mean) * (e / e.sum())[:, None]
    return u, info, w


def test_stratified_cox(people, frames):
    x = np.array([[p[7], p[8]] for p in people])
    by = lambda p: p[2]
    fit = survival.cox_fit(frames[0], ["x1", "x2"])
    u, info, w = brute_cox(people, x, fit["theta"], by)
    assert np.allclose(u, 0, atol=1e-6) and np.allclose(info, fit["info"])
    got = np.array([[r.w0, r.w1] for r in survival.score_residuals(frames[0], ["x1", "x2"], fit["theta"]).orderBy("iid").collect()])
    assert np.allclose(got, w, atol=1e-9)
    inverse = np.linalg.inv(info)
    se = [r.se for r in survival.cox_regression(frames[0], ["x1", "x2"], robust=True).collect()]
    assert np.allclose(se, np.sqrt(np.diag(inverse @ w.T @ w @ inverse)))
    dual = survival.dual_covariance(frames[0], frames[0], ["x1", "x2"]).where("term_a = 'x1' AND term_b = 'x1'").first()
    assert np.isclose(dual.covariance, (inverse @ w.T @ w @ inverse)[0, 0])


def test_cox_options_and_no_event(frames):
    both = survival.cox_regression(frames[0], ["x1"], km=True, ties=True).first()
    assert np.isfinite(both.beta) and both.se > 0
    with pytest.raises(ValueError):
        survival.cox_fit(frames[0].withColumn("event", F.lit(False)), ["x1"])


@pytest.mark.parametrize("robust", [False, True])
def test_cox_score(people, frames, robust):
    null = score.fit_null_cox(frames[0], ["x1"])
    got = {r.variant: r for r in score.cox_score(*frames, null, robust=robust).collect()}
    for v in range(3):
        g = np.array([np.nan if (p[0] + v) % 29 == 0 else (p[0] * (v + 3)) % 7 % 3 for p in people], float)
        x = np.column_stack([np.where(np.isnan(g), np.nanmean(g), g), [p[7] for p in people]])
        theta = np.r_[0.0, null["theta"]]
        u, info, w = brute_cox(people, x, theta)
        mix = np.r_[1.0, -info[0, 1] / info[1, 1]]
        assert np.isclose(got[v].u, (w @ mix).sum()) and np.isclose(got[v].v_a, mix @ info @ mix)
        sums = {}
        for p, s in zip(people, w @ mix):
            sums.setdefault(p[1], []).append(s)
        if robust:
            v0 = sum(sum(s) ** 2 for s in sums.values())
            assert np.isclose(got[v].v, got[v].v_a if 1 / v0 < 1 / got[v].v_a - 1e-8 else v0)


def test_strata_variances(people, frames):
    got = {r.variant: r for r in wald.linear_wald_hetero(*frames, robust=True, weighted=True).collect()}
    for v in range(3):
        rows = [p for p in people if (p[0] + v) % 29]
        x = np.array([[(p[0] * (v + 3)) % 7 % 3, 1.0] for p in rows])
        y, w = np.array([p[9] for p in rows]), np.array([p[3] for p in rows])
        level = np.array([p[2] == "a" for p in rows])
        s = np.ones(len(rows))
        for _ in range(400):
            a = (x * (w / s)[:, None]).T @ x
            theta = np.linalg.solve(a, x.T @ (w / s * y))
            r = y - x @ theta
            for k in (level, ~level):
                s[k] = (w[k] * r[k] ** 2).sum() / w[k].sum()
        u = x * (w * r / s)[:, None]
        families = np.array([sum(u[i] for i, p in enumerate(rows) if p[1] == f) for f in {p[1] for p in rows}])
        inverse = np.linalg.inv(a)
        assert np.isclose(got[v].beta, theta[0], atol=1e-3) and np.isclose(got[v].se, np.sqrt((inverse @ families.T @ families @ inverse)[0, 0]), atol=1e-3)


def test_features_keep_their_names(spark, frames):
    features = frames[1].select(F.concat(F.lit("f"), "variant").alias("feature_id"), "iid", "g")
    named = {r.feature_id: r.beta for r in wald.feature_wald(frames[0], features).collect()}
    assert named == pytest.approx({f"f{r.variant}": r.beta for r in wald.linear_wald(*frames).collect()})


def test_summaries_of_bad_variances(spark):
    r = survival.summarize(spark.createDataFrame([(1.0, -1.0), (1.0, 0.0), (None, 1.0), (1.96, 1.0)], "estimate double, variance double")).collect()
    assert [x.se for x in r] == [None, 0.0, 1.0, 1.0] and [x.z for x in r] == [None, None, None, 1.96] and r[3].pvalue == pytest.approx(0.05, abs=1e-4)


def test_plink(spark, tmp_path):
    (tmp_path / "a.bim").write_text("1\trs1\t0\t10\tA\tG\n1\trs2\t0\t20\tC\tT\n")
    (tmp_path / "a.fam").write_text("".join(f"F{i} S{i} 0 0 1 -9\n" for i in range(5)))
    # five subjects: codes 0 (two copies), 2 (one), 3 (none), 1 (missing), 0 | and all of 3
    (tmp_path / "a.bed").write_bytes(bytes([0x6C, 0x1B, 1, 0b01111000, 0b00, 0xFF, 0b11]))
    rows = plink.read_plink(spark, *[str(tmp_path / f"a.{x}") for x in ("bed", "bim", "fam")]).orderBy("pos", "iid").collect()
    assert [r.g for r in rows] == [2, 1, 0, None, 2, 0, 0, 0, 0, 0] and rows[5].id == "rs2" and rows[4].iid == "S4"
    (tmp_path / "a.bed").write_bytes(bytes([0x6C, 0x1B, 0, 0, 0, 0, 0]))
    with pytest.raises(Exception, match="SNP-major"):
        plink.read_plink(spark, *[str(tmp_path / f"a.{x}") for x in ("bed", "bim", "fam")]).count()


def test_plink_gathers_no_cells(spark, tmp_path):
    """Cells look as few as their blocks to Spark: they are not broadcast, nor are the subjects; sites of all blocks stay in order."""
    rng, n, m = np.random.default_rng(5), 7, 11
    codes = rng.integers(0, 4, (m, 8))
    (tmp_path / "a.bim").write_text("".join(f"{v % 3}\trs{v}\t0\t{10 * v}\tA\tG\n" for v in range(m)))
    (tmp_path / "a.fam").write_text("".join(f"F{i} S{i} 0 0 1 -9\n" for i in range(n)))
    (tmp_path / "a.bed").write_bytes(plink.HEADER + bytes((codes.reshape(m, 2, 4) << np.array([0, 2, 4, 6])).sum(2).astype(np.uint8).tobytes()))
    held = plink.CELLS, plink.ROWS
    try:
        plink.CELLS, plink.ROWS = 21, 10  # three variants a block, ten cells at a time
        found = plink.read_plink(spark, *[str(tmp_path / f"a.{x}") for x in ("bed", "bim", "fam")])
        rows = {(r.pos, r.id, r.chrom, r.fid, r.iid): r.g for r in found.collect()}
    finally:
        plink.CELLS, plink.ROWS = held
    assert rows == {(10 * v, f"rs{v}", str(v % 3), f"F{i}", f"S{i}"): [2, None, 1, 0][codes[v, i]] for v in range(m) for i in range(n)}
    above = found._jdf.queryExecution().executedPlan().toString().split("MapIn")[0]
    assert "SortMergeJoin" in above and "Broadcast" not in above


def _broadcast_scans(df, table):
    """Lines of the plan below its broadcasts that read `table`."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda x: depth(x) > depth(line), lines[i + 1 :])
            found += [x for x in below if f"{table}.parquet" in x]
    return found


@pytest.mark.parametrize("name", ["T1_odd_variants_long", "T10_odd_variants_long", "T6_odd_variants_linear", "T6_odd_variants_cox"])
def test_subjects_are_not_broadcast(spark, name):
    data = "/root/testdata/sf0.001"
    found = registry.queries()[name](spark, data)
    assert not _broadcast_scans(found, "customer") and found._jdf.queryExecution().executedPlan().toString().count("customer.parquet")
    fams = wald.family_sizes(registry.fx.surv(spark, data), registry.fx.geno(spark, data))
    assert not _broadcast_scans(fams, "customer") and not _broadcast_scans(fams, "orders")


def test_gene_summaries(spark, tmp_path):
    scores = spark.createDataFrame([("G", 1, "1:5", 0.1, 2, 9, 7, 2, 0, 0.5), ("G", 2, "1:9", 0.2, 3, 9, 6, 3, 0, -1.0)], "gene string, variant long, id string, af double, ac long, n long, n_ref long, n_het long, n_alt long, u double")
    cov = spark.createDataFrame([("G", 1, 1, 2.0), ("G", 2, 2, 4.0), ("G", 2, 1, 3.0)], "gene string, i long, j long, v double")
    text.write_mass(scores, cov, 9, str(tmp_path / "m"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert sorted(lines) == ["#Samples = 9", "G\t1:5\t0.1\t2\t9\t7\t2\t0\t0.5\t2.0\t0", "G\t1:9\t0.2\t3\t9\t6\t3\t0\t-1.0\t3.0\t4.0"]


def brute_weights(people, by):
    """Kaplan-Meier just before each subject's exit, in its group, by going through all earlier event times."""
    out = []
    for p in people:
        alive = 1.0
        for t in sorted({q[5] for q in people if q[6] and by(q) == by(p) and q[5] < p[5]}):
            risk = sum(by(q) == by(p) and q[4] <= t <= q[5] for q in people)
            died = sum(q[6] and by(q) == by(p) and q[5] == t for q in people)
            alive *= 1 - died / risk
        out.append(alive)
    return np.array(out)


def test_weighted_log_rank_and_influence(people, frames):
    """Kaplan-Meier weights and the ties constant against sums over all event times and subjects."""
    by = lambda p: p[2]
    before, x = brute_weights(people, by), np.array([p[8] for p in people])
    u, v, w = 0.0, 0.0, np.zeros(len(people))
    for i, p in enumerate(people):
        if not p[6]:
            continue
        risk = [j for j, q in enumerate(people) if by(q) == by(p) and q[4] <= p[5] <= q[5]]
        died = sum(q[6] and by(q) == by(p) and q[5] == p[5] for q in people)
        mean, k = x[risk].mean(), before[i]
        ties = (len(risk) - died) / (len(risk) - 1) if len(risk) > 1 else 1.0
        u, v = u + k * (x[i] - mean), v + k * k * ties * (x[risk] ** 2).mean() - k * k * ties * mean**2
        w[i] += k * (x[i] - mean)
        w[risk] -= k * (x[risk] - mean) / len(risk)
    found = survival.log_rank(frames[0], "x2", km=True, ties=True).first()
    assert np.isclose(found.u, u) and np.isclose(found.v, v)
    got = [r.w for r in survival.influence(frames[0], "x2", km=True).orderBy("iid").collect()]
    assert np.allclose(got, w, atol=1e-9)
    both = survival.dual_log_rank(frames[0], frames[0], "x2", km=True).first()
    assert np.isclose(both.covariance, (w**2).sum())
