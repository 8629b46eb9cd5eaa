"""Variants without variation, without calls or that are other terms; null strata; ungenotyped relatives; odd lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import packed, score, stats, survival, wald
from strataloom.sources import text

KINDS = {0: "plain", 1: "one value", 2: "no call", 3: "constant dosage", 4: "a covariate's line"}


@pytest.fixture(scope="module")
def frames(spark):
    r = np.random.default_rng(8)
    people, cells = [], []
    for i in range(60):
        out = int(r.integers(5, 50))
        x1 = float(r.normal() + i % 3)
        people.append((i, i if i % 3 else 1000 + i // 6, float(1 + i % 4), int(r.integers(0, 4)), out, bool(r.random() < 0.7), x1, float(r.normal()), int(r.random() < 0.5), [None, "a", "b"][i % 3]))
        cells += [(i, 0, float(r.integers(0, 3))), (i, 1, 1.0), (i, 2, None), (i, 3, 0.37), (i, 4, 0.25 + 0.1 * x1)]
    pheno = spark.createDataFrame(people, "iid long, fid long, wt double, entry long, exit long, event boolean, x1 double, y double, yb int, stratum string")
    return pheno.cache(), spark.createDataFrame(cells, "iid long, variant long, g double").cache()


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("model", ["linear", "logistic", "cox"])
def test_wald_fits_of_odd_variants_are_null(frames, model, weighted):
    pheno, gt = frames
    pheno = pheno.withColumn("y", F.col("yb")) if model == "logistic" else pheno
    made = packed.design(pheno, ["x1"], model, weighted, genotyped=gt)
    long = {"linear": wald.linear_wald, "logistic": wald.logistic_wald, "cox": wald.cox_wald}[model]
    for found in (packed.wald_scan(packed.pack(gt, made), made), packed.wald_scan(packed.pack(gt, made, compact=True), made), long(pheno, gt, ["x1"], weighted)):
        rows = {r.variant: r for r in found.collect()}
        assert rows[0].beta is not None and rows[0].status == "ok"
        assert all(rows[v].beta is None and rows[v].status != "ok" for v in (1, 3, 4) if v in rows), model
        assert {0, 1, 3, 4} <= set(rows)
        if 2 in rows:
            assert rows[2].n == 0 and rows[2].beta is None
    assert 2 in {r.variant for r in wald.linear_wald(pheno, gt, ["x1"]).collect()}


def test_score_tests_of_odd_variants_are_null(frames):
    pheno, gt = frames
    counts = stats.variant_stats(gt)
    null = score.fit_null_linear(pheno, ["x1"])
    for found in (score.linear_score(pheno, gt, null, counts), score.linear_score(pheno, gt, null, counts, "optimal")):
        rows = {r.variant: r for r in found.collect()}
        assert set(rows) == set(KINDS) and rows[0].v > 0
        assert all((rows[v].v, rows[v].beta, rows[v].chisq) == (None,) * 3 for v in (1, 2, 3, 4))
    binary = pheno.withColumn("y", F.col("yb").cast("double"))
    rows = {r.variant: r for r in score.logistic_score(binary, gt, score.fit_null_logistic(binary, ["x1"]), counts).collect()}
    assert rows[0].v > 0 and all((rows[v].v, rows[v].beta) == (None, None) for v in (1, 2, 3, 4))
    for model in ("linear", "cox"):
        made = packed.design(pheno, ["x1"], model, genotyped=gt)
        fitted = score.fit_null_cox(pheno, ["x1"]) if model == "cox" else null
        rows = {r.variant: r for r in packed.score_scan(packed.pack(gt, made, compact=True), made, fitted).collect()}
        assert rows[0].v > 0 and all(rows[v].v is None for v in (1, 2, 3))


def test_relatives_without_genotypes_make_no_cluster(frames):
    pheno, gt = frames
    some = gt.where("iid % 2 = 0 AND variant IN (0, 4)")
    linked = pheno.join(some.select("iid").distinct(), "iid", "left_semi")
    counts, null = stats.variant_stats(some), score.fit_null_linear(linked)
    close = lambda a, b: all(np.isclose(x.v, y.v) and np.isclose(x.u, y.u) for x, y in zip(sorted(a.collect()), sorted(b.collect())))
    assert close(score.linear_score(pheno, some, null, counts).select("variant", "u", "v"), score.linear_score(linked, some, null, counts).select("variant", "u", "v"))
    made = packed.design(pheno, genotyped=some)
    assert close(packed.score_scan(packed.pack(some, made), made, null).select("variant", "u", "v"), score.linear_score(pheno, some, null, counts).select("variant", "u", "v"))
    binary = lambda df: df.withColumn("y", F.col("yb").cast("double"))
    fitted = score.fit_null_logistic(binary(linked))
    assert close(score.logistic_score(binary(pheno), some, fitted, counts).select("variant", "u", "v"), score.logistic_score(binary(linked), some, fitted, counts).select("variant", "u", "v"))


def test_genes_leave_variants_without_calls_out(spark, frames):
    pheno, gt = frames
    made = packed.design(pheno, genotyped=gt)
    groups = spark.createDataFrame([("g", v) for v in KINDS], "gene string, variant long")
    found = packed.gene_scan(packed.pack(gt, made, compact=True), groups, made, score.fit_null_linear(pheno), maf_ub=1.0).collect()
    assert {r.i for r in found} == {0, 1, 3, 4}


@pytest.mark.parametrize("tile, rescale", [(1, None), (3, "optimal")])
def test_tiles_of_a_gene_are_the_whole(spark, frames, tile, rescale):
    pheno, _ = frames
    r = np.random.default_rng(4)
    gt = spark.createDataFrame([(i, v, float(r.integers(0, 3))) for i in range(60) for v in range(7)], "iid long, variant long, g double")
    groups = spark.createDataFrame([("a", v) for v in range(7)] + [("b", v) for v in (1, 5)], "gene string, variant long")
    for model in ("linear", "cox"):
        made = packed.design(pheno, ["x1"], model, weighted=rescale is not None, genotyped=gt)
        null = score.fit_null_cox(pheno, ["x1"], rescale is not None) if model == "cox" else score.fit_null_linear(pheno, ["x1"], rescale is not None)
        table = packed.pack(gt, made, compact=True)
        found = {(x.gene, x.i, x.j): (x.u, x.v) for x in packed.gene_scan(table, groups, made, null, 1.0, 0.0, rescale, tile=tile).collect()}
        whole = {(x.gene, x.i, x.j): (x.u, x.v) for x in packed.gene_scan(table, groups, made, null, 1.0, 0.0, rescale, tile=100).collect()}
        assert set(found) == set(whole) and len(found) == 28 + 3
        assert all(np.allclose([np.nan if y is None else y for y in found[k]], [np.nan if y is None else y for y in whole[k]], equal_nan=True) for k in whole)


def test_a_null_stratum_is_a_stratum(frames):
    pheno, _ = frames
    named = pheno.withColumn("stratum", F.coalesce("stratum", F.lit("none")))
    same = lambda f: np.allclose(*[sorted([float(x) for x in r if not isinstance(x, str)] for r in f(d).collect()) for d in (pheno, named)])
    assert pheno.where("stratum IS NULL").count() > 0
    for km in (False, True):
        for ties in (False, True):
            assert same(lambda d: survival.log_rank(d, "x1", km, ties))
            assert km != ties or same(lambda d: survival.cox_regression(d, ["x1"], km=km, ties=ties).drop("term"))
        assert same(lambda d: survival.influence(d, "x1", km=km).select("w"))
        assert same(lambda d: survival.dual_log_rank(d, d.withColumn("event", ~F.col("event")), "x1", km=km))
    assert same(lambda d: survival.risk_sums(d, "x1").drop("stratum"))
    assert same(lambda d: survival.dual_covariance(d, d, ["x1"]).drop("term_a", "term_b"))


def test_a_group_that_does_not_vary_has_no_test(frames):
    pheno, _ = frames
    row = survival.log_rank(pheno.withColumn("x1", F.lit(1.0)), "x1").first()
    assert (row.chisq, row.peto) == (None, None)


def test_odd_lines(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    vcf = put("a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tu\tv\n1\t5\t.\tA\tG\t.\tPASS\tAC=1;DB;AC=2\tGT\t0/1\t1|1\n1\t5\t.\tA\tT\t.\tPASS\tAC=3\tGT\t0/0\t./.\n2\t7\t.\tA\tT\t.\tPASS\t.\n")
    variants, cells = text.read_vcf(spark, vcf)
    assert [r["info"].get("AC") for r in variants.orderBy("ord").collect()] == ["1", "3", None]
    assert {(r.iid, r.pos, r.alt, r.gt) for r in cells.collect()} == {("u", 5, "G", "0/1"), ("v", 5, "G", "1|1"), ("u", 5, "T", "0/0"), ("v", 5, "T", "./.")}
    assert [(r.chrom, r.pos, r.alt) for r in text.first_rows(variants.select("chrom", "pos", "alt", "ord"), ["chrom", "pos"]).orderBy("chrom").collect()] == [("1", 5, "G"), ("2", 7, "T")]
    sam = text.read_sam(spark, put("a.sam", "@HD\n" + "".join(f"q{i}\t0\tx\t{9 - i}\t60\t5M\t*\t0\t0\t*\t*\tNM:i:1\tNM:i:2\n" for i in range(3))))
    assert [(r.qname, r.tags["NM:i"]) for r in sam.orderBy("ord").collect()] == [("q0", "1"), ("q1", "1"), ("q2", "1")]
    assert [tuple(r) for r in text.read_variant_list(spark, put("l", "1:5\nrs7\n2:x\n")).collect()] == [("1", 5), ("rs7", None), ("2:x", None)]
    assert [tuple(r) for r in text.read_groups(spark, put("g", "G\t1:5,bad\nH\nI\t\n")).collect()] == [("G", 0, "1", 5), ("G", 1, "bad", None), ("I", 0, "", None)]
    pheno = text.read_phenotypes(spark, put("p", "iid\ty\na\t1\nb\t2\na\tNA\n"), ord="ord")
    assert sorted(tuple(r) for r in text.last_rows(pheno, "iid").collect()) == [("a", None), ("b", "2")]
