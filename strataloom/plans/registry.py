"""Registered queries of the association library and their SQL twins; doubles are rounded to six digits in both."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions import scalar
from strataloom.operators import blocked, filters, link, model, packed, pedigree, reads, running, scans, score, stats, survival, wald
from strataloom.operators.staging import shuffled
from strataloom.plans import fixtures as fx
from strataloom.plans import twins
from strataloom.plans.fixtures import duck
from strataloom.sources import packed as packed_files
from strataloom.sources import plink, text

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def flagship(spark, sf_dir):
    return queries()["T1_linear_wald"](spark, sf_dir)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


def _linked(spark, d):
    return link.link(fx.pheno(spark, d), fx.geno(spark, d))


# --- filters ---------------------------------------------------------------------------------------------------
@query("F1_complete_cases", duck("pheno geno", "SELECT iid, variant FROM geno JOIN pheno USING (iid) WHERE g IS NOT NULL AND y IS NOT NULL"))
def _(s, d):
    return filters.complete_cases(_linked(s, d), ["g", "y"]).select("iid", "variant")


@query("F2_subset", duck("pheno", "SELECT iid, CASE WHEN stratum = 'BUILDING' AND x1 = 1 THEN 0 ELSE 1 END AS subgroup FROM pheno WHERE (stratum, x1) IN (('BUILDING', 1), ('MACHINERY', 2))"))
def _(s, d):
    return filters.subset(fx.pheno(s, d), ["stratum", "x1"], [("BUILDING", 1.0), ("MACHINERY", 2.0)]).select("iid", "subgroup")


@query("F3_chromosome", duck("variants", "SELECT variant, pos FROM variants WHERE chrom = 1"))
def _(s, d):
    return filters.extract(fx.variants(s, d), 1).select("variant", "pos")


@query("F4_range", duck("variants", "SELECT variant, pos FROM variants WHERE chrom = 1 AND pos BETWEEN 1050 AND 1200"))
def _(s, d):
    return filters.extract(fx.variants(s, d), 1, 1050, 1200).select("variant", "pos")


@query("F5_list", duck("variants", "SELECT variant FROM variants WHERE variant % 3 = 0 QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY variant) = 1"))
def _(s, d):
    v = fx.variants(s, d)
    return filters.extract_list(v, v.where("variant % 3 = 0"), "variant").select("variant")


@query("F6_overlap", duck("variants", "SELECT variant, pos FROM variants WHERE chrom = 1 AND pos + length(ref) - 1 >= 1053 AND pos <= 1200"))
def _(s, d):
    return filters.extract(fx.variants(s, d), 1, 1053, 1200, overlap=True).select("variant", "pos")


@query("F7_biallelic", duck("variants", "SELECT variant FROM variants WHERE alt NOT LIKE '%,%'"))
def _(s, d):
    return filters.biallelic(fx.variants(s, d)).select("variant")


@query("F8_pass", duck("variants", "SELECT variant FROM variants WHERE filter = 'PASS'"))
def _(s, d):
    return filters.pass_only(fx.variants(s, d)).select("variant")


@query("F9_all_phased", duck("pheno geno", "SELECT variant FROM geno GROUP BY 1 HAVING bool_and(iid % 97 <> 1 OR variant % 2 = 0)"))
def _(s, d):
    return filters.all_phased(fx.geno(s, d).withColumn("phased", (F.col("iid") % 97 != 1) | (F.col("variant") % 2 == 0)))


@query("F10_min_alt_count", duck("pheno geno", "SELECT variant, CAST(sum(coalesce(g, 0)) AS BIGINT) AS alt_count FROM geno WHERE iid IN (SELECT iid FROM pheno WHERE wt = 2) GROUP BY 1 HAVING sum(coalesce(g, 0)) >= 50"))
def _(s, d):
    return filters.min_alt_count(fx.geno(s, d), 50, fx.pheno(s, d).where("wt = 2").select("iid"))


@query("F11_min_allele_count", duck("pheno geno", "SELECT variant, least(sum(2 - g), sum(g))::BIGINT AS least FROM geno GROUP BY 1 HAVING least(sum(2 - g), sum(g)) >= 200"))
def _(s, d):
    called = fx.geno(s, d).where("g IS NOT NULL")
    alleles = F.when(F.col("g") == 0, F.array(F.lit(0), F.lit(0))).when(F.col("g") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(1)))
    return filters.min_allele_count(called.select("variant", "iid", alleles.alias("alleles"), F.lit(1).alias("n_alt")), 200)


@query("F12_by_id", duck("variants", "SELECT variant FROM variants WHERE id NOT IN (SELECT id FROM variants WHERE pos > 1300)"))
def _(s, d):
    v = fx.variants(s, d)
    return filters.by_id(v, include=v.where("pos < 1100").select("id"), exclude=v.where("pos > 1300").select("id")).select("variant")


@query("F13_samples", duck("pheno geno", "SELECT iid, variant FROM geno WHERE iid IN (SELECT iid FROM pheno WHERE wt = 2) AND iid NOT IN (SELECT iid FROM pheno WHERE x1 = 3)"))
def _(s, d):
    p = fx.pheno(s, d)
    return filters.subset_samples(fx.geno(s, d), p.where("wt = 2").select("iid"), p.where("x1 = 3").select("iid")).select("iid", "variant")


@query("F14_group_filter", duck("pheno geno", "SELECT variant FROM geno GROUP BY 1 HAVING sum(g) / (2.0 * count(g)) <= 0.15 AND count(g) / count(*) >= 0.9"))
def _(s, d):
    return filters.group_filter(stats.variant_stats(fx.geno(s, d)), 0.15, 0.9).select("variant")


@query("F15_flags", duck("align", "SELECT rname, count(*) AS n FROM align WHERE flag & 1024 = 0 AND flag & 4 = 4 GROUP BY 1"))
def _(s, d):
    return filters.flag_filter(fx.align(s, d), 4, 1024).groupBy("rname").agg(F.count("*").alias("n"))


@query("F16_region_reads", duck("align", "SELECT pos, len, count(*) AS n FROM align WHERE rname = 2 AND pos < 160 AND align_end >= 100 GROUP BY 1, 2"))
def _(s, d):
    return filters.reads_in_region(fx.align(s, d), 2, 100, 160).groupBy("pos", "len").agg(F.count("*").alias("n"))


@query("F17_outcome_errors", duck("pheno surv", "SELECT count(*) AS n, CAST(coalesce(sum(CASE WHEN entry < 0 OR entry > exit THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_bad FROM surv"))
def _(s, d):
    return filters.outcome_errors(fx.surv(s, d).withColumn("status", F.col("event").cast("int")), "cox")


# --- model columns ---------------------------------------------------------------------------------------------
@query("M1_model_matrix", duck("pheno", "SELECT iid, round(y, 6) AS y, x1, round(ln(wt + 1) * x1, 6) AS x2, CASE WHEN x1 >= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS x3 FROM pheno"))
def _(s, d):
    return rounded(model.model_matrix(fx.pheno(s, d), "y = x1 + log(wt + 1) * x1 + I(x1 >= 5)").select("iid", "y", "x1", "x2", "x3"))


@query("M2_nominal", duck("pheno", "SELECT iid, (stratum = 'BUILDING')::DOUBLE AS b, (stratum = 'FURNITURE')::DOUBLE AS f FROM pheno"))
def _(s, d):
    e = model.expand_nominal(fx.pheno(s, d), "stratum", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    return e.select("iid", F.col("`I_(stratum=BUILDING)`").alias("b"), F.col("`I_(stratum=FURNITURE)`").alias("f"))


@query("M3_subgroup", duck("pheno", "SELECT iid, CASE WHEN stratum = 'MACHINERY' THEN 1.0 ELSE 0.0 END::DOUBLE AS second FROM pheno WHERE stratum IN ('BUILDING', 'MACHINERY')"))
def _(s, d):
    sub = filters.subset(fx.pheno(s, d), ["stratum"], [("BUILDING",), ("MACHINERY",)])
    return model.subgroup_indicator(sub, 2).select("iid", F.col("`I_(subgroup=1)`").alias("second"))


@query("M4_standardize", duck("pheno", "SELECT iid, round((y - avg(y) OVER ()) / stddev_samp(y) OVER (), 6) + 0.0 AS y FROM pheno"))
def _(s, d):
    return rounded(model.standardize(fx.pheno(s, d), ["y"]).select("iid", "y"))


@query("M6_collapse", duck("pheno", "SELECT iid, CASE WHEN x1 BETWEEN 0 AND 4 THEN 1.0 WHEN x1 = 7 THEN 2.0 ELSE x1 END::DOUBLE AS x1 FROM pheno"))
def _(s, d):
    return model.collapse(fx.pheno(s, d), "x1", [((0, 4), 1.0), (7.0, 2.0)]).select("iid", "x1")


@query("M7_round_to", duck("pheno", "SELECT iid, round(trunc(y / 0.25 + CASE WHEN y < 0 THEN -0.5 ELSE 0.5 END) * 0.25, 6) + 0.0 AS y FROM pheno"))
def _(s, d):
    return rounded(fx.pheno(s, d).select("iid", scalar.round_to(F.col("y"), 0.25).alias("y")))


@query("M8_bucketize", duck("pheno", "SELECT iid, round(lo + (least(floor((y - lo) / ((hi - lo) / 7)), 6) + 0.5) * ((hi - lo) / 7), 6) AS y FROM pheno, (SELECT min(y) AS lo, max(y) AS hi FROM pheno)"))
def _(s, d):
    return rounded(model.bucketize(fx.pheno(s, d), "y", 7).select("iid", "y"))


@query("M9_bucket_times", duck("pheno surv", "SELECT iid, CAST(trunc(exit / 30 + 0.5) * 30 AS DOUBLE) AS exit FROM surv"))
def _(s, d):
    return model.bucket_times(fx.surv(s, d).withColumn("exit", F.col("exit").cast("double")), "exit", 30).select("iid", "exit")


@query("M10_event_outcome", duck("pheno surv", "SELECT iid, least(exit, 900) AS exit, exit <= 900 AS event FROM surv"))
def _(s, d):
    rows = fx.surv(s, d).select("iid", F.col("exit").alias("t"), F.lit(900).cast("long").alias("c"), F.lit(-1).alias("st"))
    return model.event_outcome(rows, "t", "c", "st").select("iid", "exit", "event")


@query("M11_gt_dosage", duck("pheno geno", "SELECT iid, variant, g FROM geno"))
def _(s, d):
    gt = F.when(F.col("g").isNull(), "0|.").when(F.col("g") == 0, "0/0").when(F.col("g") == 1, "0|1").otherwise("1/1")
    return fx.geno(s, d).select("iid", "variant", scalar.gt_dosage(gt).cast("long").alias("g"))


@query("M12_ds_dosage", duck("pheno geno", "SELECT iid, variant, CAST(g AS DOUBLE) AS ds FROM geno"))
def _(s, d):
    fields = F.create_map(F.lit("DS"), F.coalesce(F.col("g").cast("string"), F.lit(".")))
    return fx.geno(s, d).select("iid", "variant", scalar.ds_dosage(fields).alias("ds"))


@query("M13_interactions", duck("pheno geno", "SELECT iid, variant, g * x1 AS gx FROM geno JOIN pheno USING (iid)"))
def _(s, d):
    return model.add_interactions(_linked(s, d), "g", ["x1"]).select("iid", "variant", F.col("g_x_x1").alias("gx"))


@query("M14_impute", duck("pheno geno", "SELECT iid, variant, round(coalesce(CAST(g AS DOUBLE), sum(g) OVER w / count(g) OVER w), 6) AS g FROM geno WINDOW w AS (PARTITION BY variant)"))
def _(s, d):
    g = fx.geno(s, d)
    return rounded(model.impute_mean(g, stats.variant_stats(g)).select("iid", "variant", "g"))


@query("M16_map_functions", "SELECT l_orderkey, l_linenumber, round((1 - exp(-2 * CAST(l_discount AS DOUBLE))) / 2, 6) AS h, round((exp(4 * CAST(l_discount AS DOUBLE)) - 1) / (exp(4 * CAST(l_discount AS DOUBLE)) + 1) / 2, 6) AS k, round(CAST(l_discount AS DOUBLE), 6) AS back FROM lineitem")
def _(s, d):
    x = F.col("l_discount").cast("double")
    return rounded(fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.haldane(x).alias("h"), scalar.kosambi(x).alias("k"), scalar.kosambi_inv(scalar.kosambi(x)).alias("back")))


@query("M17_chi2_tail", duck("pheno", "SELECT iid, round(exp(-y * y / 2), 6) AS p2, round(exp(-y * y / 2) * (1 + y * y / 2), 6) AS p4 FROM pheno"))
def _(s, d):
    q = F.col("y") * F.col("y")
    return rounded(fx.pheno(s, d).select("iid", scalar.chi2_sf(q, 2).alias("p2"), scalar.chi2_sf(q, 4).alias("p4")))


@query("M18_dichotomize", duck("ped", "SELECT pid, CASE WHEN trait > (SELECT avg(trait) FROM ped WHERE fat IS NOT NULL) THEN 2 ELSE 1 END AS trait_status FROM ped"))
def _(s, d):
    return model.dichotomize(fx.ped(s, d), "trait").select("pid", "trait_status")


# --- joins -----------------------------------------------------------------------------------------------------
@query("J1_link", duck("pheno geno", "SELECT iid, variant, g, round(y, 6) AS y FROM geno JOIN pheno USING (iid)"))
def _(s, d):
    return rounded(_linked(s, d).select("iid", "variant", "g", "y"))


@query("J3_conditions", duck("pheno geno", "SELECT iid, CAST(max(CASE WHEN variant = 3 THEN g END) AS DOUBLE) AS c_3, CAST(max(CASE WHEN variant = 8 THEN g END) AS DOUBLE) AS c_8 FROM geno GROUP BY 1 HAVING c_3 IS NOT NULL AND c_8 IS NOT NULL"))
def _(s, d):
    return link.attach_conditions(fx.pheno(s, d), fx.geno(s, d), [3, 8]).select("iid", "c_3", "c_8")


@query("J4_group_variants", duck("variants groups", "SELECT gene, v.variant FROM groups g JOIN variants v USING (chrom, pos)"))
def _(s, d):
    return link.group_variants(fx.groups(s, d).drop("variant"), fx.variants(s, d)).select("gene", "variant")


for _how, _pick in (("left", "lo"), ("right", "hi"), ("nearest", "CASE WHEN lt IS NULL OR ht IS NULL THEN NULL WHEN ht - t <= t - lt THEN hi ELSE lo END"), ("linear", "CASE WHEN lt IS NULL OR ht IS NULL THEN NULL WHEN ht = lt THEN lo ELSE lo + (hi - lo) * (t - lt) / (ht - lt) END")):
    _both = "CASE WHEN lt IS NOT NULL AND ht IS NOT NULL THEN %s END" % _pick

    @query(f"J6_asof_{_how}", duck("longcov", f"""
, grid AS (SELECT DISTINCT iid, (time // 86400 + 1) * 86400 AS t FROM longcov),
a AS (SELECT g.iid, g.t, l.time AS lt, l.value AS lo FROM grid g ASOF LEFT JOIN longcov l ON g.iid = l.iid AND g.t >= l.time),
b AS (SELECT a.*, h.time AS ht, h.value AS hi FROM a ASOF LEFT JOIN longcov h ON a.iid = h.iid AND a.t <= h.time)
SELECT iid, t AS time, round({_both}, 6) + 0.0 AS value FROM b"""))
    def _(s, d, how=_how):
        obs = fx.long_covariate(s, d)
        grid = obs.select("iid", ((F.floor(F.col("time") / 86400) + 1) * 86400).cast("long").alias("time")).distinct()
        return rounded(link.asof_values(obs, grid, how))


_ISLANDS = """, o AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM regions),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, "end", id) AS isle FROM o),
merged AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM n GROUP BY chrom, isle)
"""


@query("A17_merge_regions", duck("regions", _ISLANDS + "SELECT * FROM merged"))
def _(s, d):
    return link.merge_regions(fx.regions(s, d))


@query("J7_in_regions", duck("regions", _ISLANDS + ", p AS (SELECT p_partkey AS id, p_brand AS chrom, (p_partkey * 13) % 5200 AS pos FROM part) SELECT id, EXISTS (SELECT 1 FROM merged m WHERE m.chrom = p.chrom AND pos >= start AND pos < \"end\") AS inside FROM p"))
def _(s, d):
    points = fx.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("chrom"), ((F.col("p_partkey") * 13) % 5200).cast("long").alias("pos"))
    return link.in_regions(points, link.merge_regions(fx.regions(s, d))).select("id", "inside")


@query("J8_exclude_positions", duck("align", "SELECT rname, pos, count(*) AS depth FROM align WHERE pos % 3 <> 0 GROUP BY 1, 2"))
def _(s, d):
    starts = fx.align(s, d).groupBy("rname", "pos").agg(F.count("*").alias("depth"))
    return link.exclude_positions(starts, starts.where("pos % 3 = 0"))


@query("J9_trios", duck("ped markers", "SELECT c.pid, c.marker, f.a1 AS f1, f.a2 AS f2, m.a1 AS m1, m.a2 AS m2 FROM ped p JOIN markers c USING (fid, pid) JOIN markers f ON f.fid = p.fid AND f.pid = p.fat AND f.marker = c.marker JOIN markers m ON m.fid = p.fid AND m.pid = p.mot AND m.marker = c.marker"))
def _(s, d):
    return link.trios(fx.ped(s, d), fx.markers(s, d)).select("pid", "marker", "f1", "f2", "m1", "m2")


@query("J10_common_rows", duck("pheno", "SELECT iid FROM pheno WHERE wt >= 2 AND x1 < 10"))
def _(s, d):
    p = fx.pheno(s, d)
    return link.common_rows(p.where("wt >= 2"), p.where("x1 < 10")).select("iid")


# --- aggregations ----------------------------------------------------------------------------------------------
@query("A1_variant_stats", duck("pheno geno", """SELECT variant, count(*) AS n_total, count(g) AS n, CAST(sum(g) AS BIGINT) AS alt_ac, round(sum(g) / (2.0 * count(g)), 6) AS alt_af, round(count(g) / count(*), 6) AS call_rate,
 count(*) FILTER (g = 0) AS n_ref, count(*) FILTER (g = 1) AS n_het, count(*) FILTER (g = 2) AS n_alt, count(g) FILTER (yb = 1) AS n_case, round(sum(g) FILTER (yb = 1) / (2.0 * count(g) FILTER (yb = 1)), 6) AS alt_af_case FROM geno JOIN pheno USING (iid) GROUP BY 1"""))
def _(s, d):
    return rounded(stats.variant_stats(_linked(s, d), case="yb"))


@query("A4_moments", duck("pheno geno", "SELECT variant, round(sum(wt * g * g), 6) AS gg, round(sum(wt * g), 6) AS g1, round(sum(wt), 6) AS ones, round(sum(wt * g * y), 6) AS gy, round(sum(wt * y), 6) AS y1 FROM geno JOIN pheno USING (iid) WHERE g IS NOT NULL GROUP BY 1"))
def _(s, d):
    m = stats.moments(_linked(s, d).where("g IS NOT NULL"), [F.col("g"), F.lit(1)], F.col("y"), F.col("wt"), ["variant"])
    return rounded(m.select("variant", F.col("sxx")[0].alias("gg"), F.col("sxx")[1].alias("g1"), F.col("sxx")[3].alias("ones"), F.col("sxy")[0].alias("gy"), F.col("sxy")[1].alias("y1")), 6)


@query("A5_cluster_meat", duck("pheno geno", "SELECT variant, round(sum(s * s), 4) AS meat FROM (SELECT variant, fid, sum(wt * g * y) AS s FROM geno JOIN pheno USING (iid) WHERE g IS NOT NULL GROUP BY 1, 2) GROUP BY 1"))
def _(s, d):
    u = _linked(s, d).where("g IS NOT NULL").withColumn("u", F.col("wt") * F.col("g") * F.col("y"))
    return rounded(stats.cluster_meat(u, ["u"], ["variant"]).select("variant", F.col("meat")[0].alias("meat")), 4)


@query("A8_residual_variance", duck("pheno", "SELECT stratum, round(sum(wt * (y - 4) * (y - 4)) / sum(wt), 6) AS sigma2 FROM pheno GROUP BY 1"))
def _(s, d):
    return rounded(stats.residual_variance(fx.pheno(s, d).select("stratum", F.col("wt").alias("w"), (F.col("y") - 4).alias("r")), ["stratum"]))


@query("A10_read_stats", duck("align", "SELECT rname, count(*) AS total, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 1024 <> 0) AS duplicates, CAST(sum(len) AS BIGINT) AS total_bases FROM align GROUP BY 1"))
def _(s, d):
    return reads.read_stats(fx.align(s, d), ["rname"]).select("rname", "total", "mapped", "duplicates", "total_bases")


@query("A13_running_stats", "SELECT l_suppkey, count(*) AS n, round(avg(CAST(l_extendedprice AS DOUBLE)), 4) AS mean, round(coalesce(stddev_samp(CAST(l_extendedprice AS DOUBLE)), 0), 4) AS sd FROM lineitem GROUP BY 1")
def _(s, d):
    rows = fx.table(s, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast("double").alias("v"))
    return rounded(stats.running_stats(rows, "v", ["l_suppkey"]).select("l_suppkey", "n", "mean", "sd"), 4)


@query("A14_medians", duck("pheno", "SELECT stratum, round(median(y), 6) AS median_y, round(median(x1), 6) AS median_x1 FROM pheno GROUP BY 1"))
def _(s, d):
    return rounded(stats.medians(fx.pheno(s, d), ["y", "x1"], ["stratum"]))


@query("A15_allele_freq", duck("ped markers", "SELECT marker, a AS allele, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY marker), 6) AS freq FROM (SELECT marker, unnest([a1, a2]) AS a FROM markers JOIN ped USING (fid, pid) WHERE fat IS NULL) GROUP BY 1, 2"))
def _(s, d):
    return rounded(pedigree.allele_freq(fx.ped(s, d), fx.markers(s, d), "founders"))


@query("A18_depth", duck("align", ", p AS (SELECT rname, unnest(range(pos, align_end + 1)) AS pos FROM align WHERE flag & 4 = 0) SELECT rname, pos, count(*) AS depth FROM p GROUP BY 1, 2"))
def _(s, d):
    return reads.depth(fx.align(s, d).where("flag & 4 = 0"))


@query("A19_fraction_alive", duck("pheno surv", "SELECT stratum, round(avg(CASE WHEN event THEN 0.0 ELSE 1.0 END), 6) AS fraction_alive, count(*) AS n FROM surv GROUP BY 1"))
def _(s, d):
    return rounded(stats.fraction_alive(fx.surv(s, d), ["stratum"]))


@query("A20_families", duck("ped", "SELECT fid, count(*) AS size, count(*) FILTER (fat IS NULL) AS founders FROM ped GROUP BY 1"))
def _(s, d):
    return pedigree.families(fx.ped(s, d))


@query("A21_kept_counts", duck("pheno geno", "SELECT stratum, CAST(count(g) AS BIGINT) AS kept, CAST(count(*) - count(g) AS BIGINT) AS skipped FROM geno JOIN pheno USING (iid) GROUP BY 1"))
def _(s, d):
    return stats.kept_counts(_linked(s, d), ["g"], ["stratum"])


# --- tests -----------------------------------------------------------------------------------------------------
def _wald_sql(w: str, robust: bool, guard: bool) -> str:
    single = "false" if robust else "size = 1"
    keep = "CASE WHEN meat / (sxx * sxx) < s2 / sxx - 1e-8 THEN s2 / sxx ELSE meat / (sxx * sxx) END" if guard else "meat / (sxx * sxx)"
    return duck("pheno geno", f""", z AS (SELECT fid, count(*) AS size FROM pheno GROUP BY 1),
r AS (SELECT variant, fid, size, CAST(g AS DOUBLE) AS g, y, {w} AS w FROM geno JOIN pheno USING (iid) JOIN z USING (fid) WHERE g IS NOT NULL),
m AS (SELECT variant, count(*) AS n, sum(w * g) / sum(w) AS mg, sum(w * y) / sum(w) AS my, sum(w) AS sw FROM r GROUP BY 1),
c AS (SELECT r.*, g - mg AS gc, y - my AS yc, n, sw FROM r JOIN m USING (variant)),
b AS (SELECT variant, any_value(n) AS n, sum(w * gc * gc) AS sxx, sum(w * gc * yc) / sum(w * gc * gc) AS beta FROM c GROUP BY 1),
e AS (SELECT c.*, sxx, beta, yc - beta * gc AS res FROM c JOIN b USING (variant, n)),
v AS (SELECT variant, sum(w * res * res) / sum(w) AS s2 FROM e GROUP BY 1),
f AS (SELECT variant, fid, any_value(size) AS size, sum(w * gc * res) AS u, sum(w * w * gc * gc) AS q FROM e GROUP BY 1, 2),
t AS (SELECT variant, any_value(s2) AS s2, sum(CASE WHEN {single} THEN s2 * q ELSE u * u END) AS meat FROM f JOIN v USING (variant) GROUP BY 1),
o AS (SELECT variant, n, beta, {keep} AS var FROM b JOIN t USING (variant))
SELECT variant, n, round(beta, 6) + 0.0 AS beta, round(sqrt(var), 6) AS se, round(beta * beta / var, 5) AS chisq FROM o""")


def _slim(df, digits: int = 6):
    return df.select("variant", "n", (F.round("beta", digits) + 0.0).alias("beta"), F.round("se", digits).alias("se"), F.round("chisq", digits - 1).alias("chisq"))


def _score_columns(out):
    return out.select("variant", "n", (F.round("u", 5) + 0.0).alias("u"), F.round("v", 4).alias("v"), (F.round("beta", 6) + 0.0).alias("beta"), F.round("se", 6).alias("se"))


@query("T1_linear_wald", _wald_sql("1.0::DOUBLE", False, True))
def _(s, d):
    return _slim(wald.linear_wald(fx.pheno(s, d), fx.geno(s, d)))


@query("T1_linear_wald_robust_weighted", _wald_sql("wt", True, False))
def _(s, d):
    return _slim(wald.linear_wald(fx.pheno(s, d), fx.geno(s, d), weighted=True, robust=True))


@query("T10_linear_score", duck("pheno geno", """, z AS (SELECT fid, count(*) AS size FROM pheno GROUP BY 1), nul AS (SELECT avg(y) AS my, var_pop(y) AS s2 FROM pheno),
r AS (SELECT variant, fid, size, y - my AS r, s2, coalesce(CAST(g AS DOUBLE), avg(g) OVER (PARTITION BY variant)) AS g FROM geno JOIN pheno USING (iid) JOIN z USING (fid), nul),
c AS (SELECT *, g - avg(g) OVER (PARTITION BY variant) AS e FROM r),
f AS (SELECT variant, fid, any_value(size) AS size, any_value(s2) AS s2, sum(r * e) AS s, sum(e * e) AS q, count(*) AS m FROM c GROUP BY 1, 2),
t AS (SELECT variant, sum(m) AS n, any_value(s2) AS s2, sum(s) / any_value(s2) AS u, sum(CASE WHEN size = 1 THEN q / s2 ELSE s * s / (s2 * s2) END) AS v0, sum(q) / any_value(s2) AS va FROM f GROUP BY 1),
o AS (SELECT *, CASE WHEN 1 / v0 < 1 / va - 1e-8 THEN va ELSE v0 END AS v FROM t)
SELECT variant, CAST(n AS BIGINT) AS n, round(u, 5) + 0.0 AS u, round(v, 4) AS v, round(u / v, 6) + 0.0 AS beta, round(1 / sqrt(v), 6) AS se FROM o"""))
def _(s, d):
    p = fx.pheno(s, d)
    return _score_columns(scans.score_scan(p, fx.geno(s, d), score.fit_null_linear(p)))


@query("N2_T10_logistic_score", duck("pheno geno", """, z AS (SELECT fid, count(*) AS size FROM pheno GROUP BY 1), nul AS (SELECT avg(yb) AS mu FROM pheno),
r AS (SELECT variant, fid, size, yb - mu AS r, mu * (1 - mu) AS dd, coalesce(CAST(g AS DOUBLE), avg(g) OVER (PARTITION BY variant)) AS g FROM geno JOIN pheno USING (iid) JOIN z USING (fid), nul),
c AS (SELECT *, g - avg(g) OVER (PARTITION BY variant) AS e FROM r),
f AS (SELECT variant, fid, any_value(size) AS size, sum(r * e) AS s, sum(dd * e * e) AS q, count(*) AS m FROM c GROUP BY 1, 2),
t AS (SELECT variant, sum(m) AS n, sum(s) AS u, sum(CASE WHEN size = 1 THEN q ELSE s * s END) AS v0, sum(q) AS va FROM f GROUP BY 1),
o AS (SELECT *, CASE WHEN 1 / v0 < 1 / va - 1e-8 THEN va ELSE v0 END AS v FROM t)
SELECT variant, CAST(n AS BIGINT) AS n, round(u, 5) + 0.0 AS u, round(v, 4) AS v, round(u / v, 6) + 0.0 AS beta FROM o"""))
def _(s, d):
    p = fx.pheno(s, d).withColumn("y", F.col("yb").cast("double"))
    out = packed.score_scan(*_scan(s, d, p, "logistic"), score.fit_null_logistic(p))
    return out.select("variant", "n", (F.round("u", 5) + 0.0).alias("u"), F.round("v", 4).alias("v"), (F.round("beta", 6) + 0.0).alias("beta"))


@query("T12_gene_score", duck("pheno geno variants groups", """, nul AS (SELECT var_pop(y) AS s2 FROM pheno),
e AS (SELECT variant, iid, coalesce(CAST(g AS DOUBLE), avg(g) OVER (PARTITION BY variant)) - avg(g) OVER (PARTITION BY variant) AS e FROM geno)
SELECT a.gene, a.variant AS i, b.variant AS j, round(sum(x.e * w.e) / any_value(s2), 4) + 0.0 AS v FROM groups a JOIN groups b ON a.gene = b.gene AND b.variant <= a.variant JOIN e x ON x.variant = a.variant JOIN e w ON w.variant = b.variant AND w.iid = x.iid, nul GROUP BY 1, 2, 3"""))
def _(s, d):
    g = fx.geno(s, d)
    out = score.gene_score(fx.pheno(s, d), g, fx.groups(s, d).select("gene", "variant"), stats.variant_stats(g))
    return out.select("gene", "i", "j", (F.round("v", 4) + 0.0).alias("v"))


@query("T16_linear_regression", duck("pheno", """, r AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, (regr_syy(y, x1) - regr_sxy(y, x1) * regr_sxy(y, x1) / regr_sxx(y, x1)) / (count(*) - 2) AS s2, regr_sxx(y, x1) AS sxx, avg(x1) AS m, count(*) AS n FROM pheno),
o AS (SELECT 'x1' AS term, b AS beta, sqrt(s2 / sxx) AS se FROM r UNION ALL SELECT '(Intercept)', a, sqrt(s2 * (1.0 / n + m * m / sxx)) FROM r) SELECT term, round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 5) AS t FROM o"""))
def _(s, d):
    out = wald.linear_regression(fx.pheno(s, d), "y", ["x1"])
    return out.select("term", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), F.round("t", 5).alias("t"))


@query("T17_logistic_regression", duck("pheno", ", r AS (SELECT 0 AS variant, iid AS fid, true AS single, x1 % 3 AS g, yb AS y FROM pheno)" + twins.logistic("r") + ", o AS (SELECT '(Intercept)' AS term, a AS beta, sqrt(ibb / (iaa * ibb - iab * iab)) AS se FROM lf UNION ALL SELECT 'third', b, sqrt(iaa / (iaa * ibb - iab * iab)) FROM lf) SELECT term, round(beta, 5) AS beta, round(se, 5) AS se, round(beta / se, 4) AS z FROM o"))
def _(s, d):
    out = wald.logistic_regression(fx.pheno(s, d).withColumn("third", F.col("x1") % 3), "yb", ["third"])
    return out.select("term", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"), F.round("z", 4).alias("z"))


# --- survival --------------------------------------------------------------------------------------------------
_RISK = """, ev AS (SELECT stratum, exit AS time, count(*) FILTER (event) AS events FROM surv GROUP BY 1, 2),
k AS (SELECT ev.stratum, ev.time, any_value(events) AS events, count(*) AS at_risk, sum(arm) AS s1 FROM ev JOIN surv s ON s.stratum = ev.stratum AND s.entry <= ev.time AND s.exit >= ev.time GROUP BY 1, 2)
"""


@query("V1_kaplan_meier", duck("pheno surv", _RISK + ", l AS (SELECT *, sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER w AS s, max(CASE WHEN events < at_risk THEN 0 ELSE 1 END) OVER w AS dead FROM k WINDOW w AS (PARTITION BY stratum ORDER BY time)) SELECT stratum, time, at_risk, events, round(CASE WHEN dead = 1 THEN 0 ELSE exp(coalesce(s, 0)) END, 6) AS survival FROM l"))
def _(s, d):
    return rounded(survival.kaplan_meier(fx.surv(s, d)))


@query("V2_risk_sums", duck("pheno surv", _RISK + "SELECT stratum, time, events, CAST(at_risk AS DOUBLE) AS s0, s1 FROM k WHERE events > 0"))
def _(s, d):
    return survival.risk_sums(fx.surv(s, d), "arm").select("stratum", "time", "events", "s0", "s1")


@query("V3_log_rank", duck("pheno surv", _RISK + ", x AS (SELECT stratum, exit AS time, sum(arm) AS ex FROM surv WHERE event GROUP BY 1, 2), t AS (SELECT sum(ex - events * s1 / at_risk) AS u, sum(events * (s1 / at_risk - (s1 / at_risk) * (s1 / at_risk))) AS v FROM k JOIN x USING (stratum, time)) SELECT round(u, 6) AS u, round(v, 6) AS v, round(u * u / v, 6) AS chisq, round(u / v, 6) AS peto FROM t"))
def _(s, d):
    return rounded(survival.log_rank(fx.surv(s, d), "arm"))


@query("V4_ties_constant", duck("pheno surv", _RISK + "SELECT stratum, time, round(CASE WHEN at_risk = 1 THEN 1.0 ELSE (at_risk - events) / (at_risk - 1) END, 6) AS ties FROM k WHERE events > 0"))
def _(s, d):
    return rounded(survival.ties_constant(fx.surv(s, d)))


_INFLUENCE = """, f AS (SELECT iid, stratum, exit, event, arm FROM surv), ev AS (SELECT stratum, exit AS time, count(*) AS dd FROM f WHERE event GROUP BY 1, 2),
k AS (SELECT ev.stratum, ev.time, any_value(dd) AS dd, count(*) AS s0, sum(arm) AS s1 FROM ev JOIN f ON f.stratum = ev.stratum AND f.exit >= ev.time GROUP BY 1, 2)
SELECT iid, round(any_value(CASE WHEN event THEN arm ELSE 0 END) - coalesce(max(CASE WHEN event AND k.time = exit THEN s1 / s0 END), 0) - coalesce(sum(dd * (arm / s0 - s1 / (s0 * s0))), 0), 6) + 0.0 AS w FROM f LEFT JOIN k ON k.stratum = f.stratum AND k.time <= f.exit GROUP BY 1"""


@query("V7_influence", duck("pheno surv", _INFLUENCE))
def _(s, d):
    return rounded(survival.influence(fx.surv(s, d).withColumn("entry", F.lit(-1).cast("long")), "arm"))


# --- windows, quality checks -----------------------------------------------------------------------------------
@query("W7_sort_check", duck("align", ", o AS (SELECT rname, pos, l_orderkey AS k, l_linenumber AS n FROM (SELECT l_suppkey % 5 AS rname, l_partkey AS pos, l_orderkey, l_linenumber FROM lineitem)), p AS (SELECT *, lag(pos) OVER (PARTITION BY rname ORDER BY k, n, pos) AS before FROM o) SELECT rname, count(*) AS n_out_of_order FROM p WHERE pos < before GROUP BY 1"))
def _(s, d):
    rows = fx.table(s, d, "lineitem").select((F.col("l_suppkey") % 5).alias("rname"), F.col("l_partkey").alias("pos"), "l_orderkey", "l_linenumber")
    return reads.out_of_order(rows, ["rname"], ["l_orderkey", "l_linenumber", "pos"]).groupBy("rname").agg(F.count("*").alias("n_out_of_order"))


@query("QA_mendel_errors", duck("ped markers", "SELECT c.pid, c.marker FROM ped p JOIN markers c USING (fid, pid) JOIN markers f ON f.fid = p.fid AND f.pid = p.fat AND f.marker = c.marker JOIN markers m ON m.fid = p.fid AND m.pid = p.mot AND m.marker = c.marker WHERE NOT ((c.a1 IN (f.a1, f.a2) AND c.a2 IN (m.a1, m.a2)) OR (c.a2 IN (f.a1, f.a2) AND c.a1 IN (m.a1, m.a2)))"))
def _(s, d):
    return pedigree.mendel_errors(fx.ped(s, d), fx.markers(s, d)).select("pid", "marker")


@query("QC_twin_check", duck("ped markers", "SELECT fid, marker, count(DISTINCT least(a1, a2) || '/' || greatest(a1, a2)) > 1 AS discordant FROM ped JOIN markers USING (fid, pid) WHERE twin IS NOT NULL GROUP BY 1, 2"))
def _(s, d):
    return pedigree.twin_check(fx.ped(s, d), fx.markers(s, d)).select("fid", "marker", "discordant")


@query("QD_merge_twins", duck("ped", "SELECT fid, string_agg(CAST(pid AS VARCHAR), '$' ORDER BY pid) AS merged, max(affected) AS affected FROM ped WHERE twin IS NOT NULL GROUP BY 1"))
def _(s, d):
    return pedigree.merged_twins(fx.ped(s, d)).select("fid", "merged", "affected")


@query("QE_extract_on_affection", duck("ped", "SELECT pid, round(CASE WHEN affected = 2 THEN trait END, 6) AS trait FROM ped"))
def _(s, d):
    return rounded(pedigree.extract_on_affection(fx.ped(s, d), "affected", ["trait"]).select("pid", "trait"))


# --- strata, features, Cox scores and models -------------------------------------------------------------------
@query("T2_linear_wald_strata")
def _(s, d):
    return _slim(wald.linear_wald_hetero(fx.pheno(s, d), fx.geno(s, d), ["x1"]))


@query("T9_feature_wald", "SELECT 'f' || variant AS feature_id, n, beta, se, chisq FROM (" + _wald_sql("1.0::DOUBLE", False, True) + ")")
def _(s, d):
    features = fx.geno(s, d).select(F.concat(F.lit("f"), F.col("variant").cast("string")).alias("feature_id"), "iid", "g")
    found = wald.feature_wald(fx.pheno(s, d), features)
    return found.select("feature_id", "n", (F.round("beta", 6) + 0.0).alias("beta"), F.round("se", 6).alias("se"), F.round("chisq", 5).alias("chisq"))


@query("T11_log_rank_score", duck("pheno geno surv", """, f AS (SELECT variant, s.iid, s.fid, entry, exit, event, coalesce(CAST(g AS DOUBLE), avg(g) OVER (PARTITION BY variant)) AS g FROM geno JOIN surv s USING (iid)),
z AS (SELECT fid, count(*) AS size FROM surv GROUP BY 1), ev AS (SELECT variant, exit AS time, count(*) AS d FROM f WHERE event GROUP BY 1, 2),
k AS (SELECT ev.variant, ev.time, any_value(d) AS d, count(*) AS s0, sum(g) AS s1, sum(g * g) AS s2 FROM ev JOIN f ON f.variant = ev.variant AND entry <= ev.time AND exit >= ev.time GROUP BY 1, 2),
r AS (SELECT f.variant, f.iid, any_value(fid) AS fid, max(CASE WHEN event AND k.time = exit THEN g - s1 / s0 END) AS own, sum(d * (g / s0 - s1 / (s0 * s0))) AS spent, max(CASE WHEN event AND k.time = exit THEN s2 / s0 - (s1 / s0) * (s1 / s0) END) AS spread
  FROM f LEFT JOIN k ON k.variant = f.variant AND k.time BETWEEN entry AND exit GROUP BY 1, 2),
fam AS (SELECT variant, fid, any_value(size) AS size, sum(coalesce(own, 0) - coalesce(spent, 0)) AS s, sum(coalesce(spread, 0)) AS q, count(*) AS m FROM r JOIN z USING (fid) GROUP BY 1, 2),
a AS (SELECT variant, sum(d * (s2 / s0 - (s1 / s0) * (s1 / s0))) AS va FROM k GROUP BY 1),
t AS (SELECT variant, sum(m) AS n, sum(s) AS u, sum(CASE WHEN size = 1 THEN q ELSE s * s END) AS v0 FROM fam GROUP BY 1)
SELECT variant, CAST(n AS BIGINT) AS n, round(u, 5) + 0.0 AS u, round(CASE WHEN 1 / v0 < 1 / va - 1e-8 THEN va ELSE v0 END, 5) AS v, round(va, 5) AS v_a FROM t JOIN a USING (variant)"""))
def _(s, d):
    out = packed.score_scan(*_scan(s, d, fx.surv(s, d), "cox"), score.fit_null_cox(fx.surv(s, d), []))
    return rounded(out.select("variant", "n", "u", "v", "v_a"), 5)


@query("T20_summaries", duck("pheno", "SELECT iid, round(y * y, 6) AS squared, round(sqrt(wt), 6) AS se, round(y / sqrt(wt), 6) + 0.0 AS z, round(2 * 1.9599639845 * sqrt(wt), 6) AS ci_width FROM pheno"))
def _(s, d):
    rows = fx.pheno(s, d).select("iid", F.col("y").alias("estimate"), F.col("wt").alias("variance"))
    return rounded(survival.summarize(rows).select("iid", "squared", "se", "z", "ci_width"))


@query("A9_gene_moments", duck("pheno geno variants groups", """, nul AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, (regr_syy(y, x1) - regr_sxy(y, x1) * regr_sxy(y, x1) / regr_sxx(y, x1)) / count(*) AS s2 FROM pheno),
f AS (SELECT variant, iid, x1, y, coalesce(CAST(g AS DOUBLE), avg(g) OVER (PARTITION BY variant)) AS g FROM geno JOIN pheno USING (iid)),
h AS (SELECT variant, regr_slope(g, x1) AS hb, regr_intercept(g, x1) AS ha FROM f GROUP BY 1),
e AS (SELECT f.variant, iid, g - ha - hb * x1 AS e, y - a - b * x1 AS r, s2 FROM f JOIN h USING (variant), nul)
SELECT a.gene, a.variant AS i, b.variant AS j, round(CASE WHEN a.variant = b.variant THEN sum(x.r * x.e) / any_value(x.s2) END, 4) + 0.0 AS u, round(sum(x.e * w.e) / any_value(x.s2), 4) + 0.0 AS v
FROM groups a JOIN groups b ON a.gene = b.gene AND b.variant <= a.variant JOIN e x ON x.variant = a.variant JOIN e w ON w.variant = b.variant AND w.iid = x.iid GROUP BY 1, 2, 3"""))
def _(s, d):
    p, g = fx.pheno(s, d), fx.geno(s, d)
    return rounded(score.gene_moments(p, g, fx.groups(s, d), score.fit_null_linear(p, ["x1"]), stats.variant_stats(g)), 4)


# --- alleles, reads ----------------------------------------------------------------------------------------------
@query("A16_lump_alleles", duck("ped markers", """, c AS (SELECT marker, allele, count(*) AS n FROM (SELECT marker, unnest([a1, a2]) AS allele FROM markers) GROUP BY 1, 2),
r AS (SELECT *, n <= floor(sum(n) OVER (PARTITION BY marker) * 0.333) AS rare FROM c)
SELECT marker, allele, CASE WHEN rare THEN 'OTHER' ELSE CAST(row_number() OVER (PARTITION BY marker, rare ORDER BY n DESC, allele) AS VARCHAR) END AS code FROM r"""))
def _(s, d):
    return pedigree.lump_alleles(fx.markers(s, d), 0.333)


@query("QB_x_linked", duck("ped markers", """SELECT c.pid, c.marker FROM ped p JOIN markers c USING (fid, pid) JOIN markers f ON f.fid = p.fid AND f.pid = p.fat AND f.marker = c.marker JOIN markers m ON m.fid = p.fid AND m.pid = p.mot AND m.marker = c.marker
WHERE CASE WHEN sex = 1 THEN c.a1 <> c.a2 OR c.a1 NOT IN (m.a1, m.a2) ELSE NOT ((c.a1 = f.a1 AND c.a2 IN (m.a1, m.a2)) OR (c.a2 = f.a1 AND c.a1 IN (m.a1, m.a2))) END"""))
def _(s, d):
    return pedigree.mendel_errors(fx.ped(s, d), fx.markers(s, d), x=True).select("pid", "marker")


_READS = """r AS (SELECT doc_id AS id, doc_id % 5 AS rname, doc_id AS pos, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq,
  repeat(chr(CAST(40 + doc_id % 20 AS INT)), CAST(length(text) AS INT)) AS qual FROM documents WHERE length(text) > 0),
b AS (SELECT id, rname, pos + unnest(range(length(seq))) AS refpos, unnest(string_split(seq, '')) AS base, unicode(qual) - 33 AS q FROM r)"""


@query("QF_interleaved_pairs", """WITH r AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS k, 'r' || (doc_id // 2 + CASE WHEN doc_id % 14 = 1 THEN 1 ELSE 0 END) || '/' || (doc_id % 2 + 1) AS name FROM documents),
p AS (SELECT pair, max(name) FILTER (k = 0) AS first, max(name) FILTER (k = 1) AS second FROM r GROUP BY 1)
SELECT * FROM p WHERE second IS NULL OR regexp_replace(first, '/1$', '') <> regexp_replace(second, '/2$', '')""")
def _(s, d):
    name = F.expr("concat('@r', cast(floor(doc_id / 2) + CASE WHEN doc_id % 14 = 1 THEN 1 ELSE 0 END as string), '/', cast(doc_id % 2 + 1 as string), ' x')")
    return reads.interleaved_errors(fx.table(s, d, "documents").select((F.col("doc_id") * 4 + 1).alias("line"), name.alias("id_line")))


@query("W6_coordinate_sort", duck("align", "SELECT rname, pos, len, count(*) AS n FROM align GROUP BY 1, 2, 3"))
def _(s, d):
    return reads.coordinate_sorted(fx.align(s, d).groupBy("rname", "pos", "len").agg(F.count("*").alias("n")))


# --- whole texts and all pairs of ids ------------------------------------------------------------------------------
@query("F9_no_missing", duck("pheno geno", "SELECT variant FROM geno GROUP BY 1 HAVING count(*) = count(g)"))
def _(s, d):
    return filters.no_missing_gt(fx.geno(s, d))


for _how, _test in (("overlapping", 'a.start <= b."end" AND b.start <= a."end"'), ("containing", 'a.start <= b.start AND b."end" <= a."end"'), ("contained", 'b.start <= a.start AND a."end" <= b."end"')):

    @query(f"J11_{_how}", duck("regions", f"SELECT a.id AS a_id, b.id AS b_id FROM regions a JOIN regions b ON a.chrom = b.chrom AND {_test} WHERE a.id < b.id"))
    def _(s, d, how=_how):
        r = fx.regions(s, d)
        return link.interval_join(r, r, how).where("a_id < b_id")


@query("A7_design_meat", duck("pheno", """, s AS (SELECT *, CAST(x1 AS BIGINT) % 3 AS study, iid // 12 AS cluster, 1 / wt AS p FROM pheno),
q AS (SELECT a.study, CASE WHEN a.iid = b.iid THEN a.p ELSE least(1, a.p * b.p * (1 + ((a.iid + b.iid) % 3) * 0.05)) END AS pij, a.p AS pi, b.p AS pj, a.wt AS wi, b.wt AS wj, a.fid = b.fid AS same, a.y AS yi, b.y AS yj FROM s a JOIN s b USING (study, cluster))
SELECT round(sum(yi * yj * CASE WHEN same THEN wi * wj ELSE (pij - pi * pj) * wi * wj / pij END), 4) AS meat FROM q"""))
def _(s, d):
    # subjects of different sampling clusters (12 neighbouring ids, whole families) are drawn independently: they add 0
    p = fx.pheno(s, d)
    own = p.select((F.col("x1").cast("long") % 3).alias("study"), F.floor(F.col("iid") / 12).alias("cluster"), F.col("iid").alias("iid_i"), (1 / F.col("wt")).alias("a"))
    other = own.select("study", "cluster", F.col("iid_i").alias("iid_j"), F.col("a").alias("b"))
    joint = F.least(F.lit(1.0), F.col("a") * F.col("b") * (1 + ((F.col("iid_i") + F.col("iid_j")) % 3) * 0.05))
    probs = own.join(other, ["study", "cluster"]).select("study", "iid_i", "iid_j", F.when(F.col("iid_i") == F.col("iid_j"), F.col("a")).otherwise(joint).alias("pi"))
    delta = stats.design_weights(link.link_probs(p, probs), p)
    return rounded(stats.design_meat(p.select("iid", F.col("y").alias("u")), delta, ["u"]).select(F.col("meat")[0].alias("meat")), 4)


_CHARS = "c AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS cycle, unnest(l) AS ch FROM (SELECT doc_id, string_split(text, '') AS l FROM documents WHERE text <> ''))"


@query("A11_base_composition", f"WITH {_CHARS}, e AS (SELECT cycle, regexp_replace(translate(lower(ch), 'aeinorst', 'ACGTACGT'), '[^ACGT]', 'N') AS base FROM c) SELECT cycle, count(*) AS n, round(100.0 * count(*) FILTER (base = 'A') / count(*), 6) AS pct_a, round(100.0 * count(*) FILTER (base = 'N') / count(*), 6) AS pct_n FROM e GROUP BY 1")
def _(s, d):
    seq = F.regexp_replace(F.translate(F.lower("text"), "aeinorst", "ACGTACGT"), "[^ACGT]", "N")
    out = reads.base_composition(fx.table(s, d, "documents").select(seq.alias("seq")))
    return rounded(out.select(F.col("cycle").cast("long").alias("cycle"), "n", "pct_a", "pct_n"))


@query("A12_quality_by_cycle", f"WITH {_CHARS} SELECT cycle, round(avg(unicode(ch) % 40), 6) AS quality FROM c GROUP BY 1")
def _(s, d):
    chars = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.char(33 + F.ascii(c) % 40))
    return rounded(reads.quality_by_cycle(fx.table(s, d, "documents").select(F.array_join(chars, "").alias("qual"))).select(F.col("cycle").cast("long").alias("cycle"), "quality"))


def _reads(spark, d):
    i = F.col("doc_id")
    return fx.table(spark, d, "documents").where("length(text) > 0").select(
        i.alias("id"), (i % 5).alias("rname"), i.alias("pos"), F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "N").alias("seq"), F.expr("repeat(char(cast(40 + doc_id % 20 as int)), length(text))").alias("qual"),
        F.concat(F.length("text").cast("string"), F.lit("M")).alias("cigar"), F.lit(0).alias("flag"),
    )


@query("A18_pileup", "WITH " + _READS + " SELECT rname, refpos, count(*) AS depth, string_agg(base, '' ORDER BY base, q) AS bases, string_agg(chr(CAST(q + 33 AS INT)), '' ORDER BY base, q) AS quals FROM b GROUP BY 1, 2")
def _(s, d):
    return reads.pileup(_reads(s, d))


@query("QG_mismatch_filter", "WITH " + _READS + """, m AS (SELECT id, sum(q) FILTER (base <> substr('ACGT', CAST(refpos % 4 + 1 AS INT), 1)) AS bad FROM b GROUP BY 1)
SELECT id, CASE WHEN bad > 250 THEN 4 ELSE 0 END AS flag FROM m""")
def _(s, d):
    rows = _reads(s, d)
    sites = rows.groupBy("rname").agg(F.min("pos").alias("a"), F.max(F.col("pos") + F.length("seq") - 1).alias("b")).select("rname", F.explode(F.sequence("a", "b")).alias("pos"))
    ref = sites.withColumn("base", F.expr("substring('ACGT', cast(pos % 4 + 1 as int), 1)"))
    return reads.mismatch_filter(rows, ref, 250).select("id", "flag")


@query("QF_fastq_checks", """WITH r AS (SELECT doc_id, 'r' || doc_id % 150 AS name, CASE WHEN doc_id % 7 = 0 THEN text ELSE regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') END AS seq,
  CASE WHEN doc_id % 5 = 0 THEN '+other' ELSE '+' END AS plus, length(text) + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS n_qual FROM documents WHERE length(text) > 0)
SELECT doc_id, concat_ws('; ', CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN 'duplicate id' END, CASE WHEN NOT regexp_full_match(seq, '[ACGTNacgtn.]*') THEN 'invalid base' END, CASE WHEN length(seq) < 10 THEN 'read too short' END,
  CASE WHEN plus <> '+' THEN 'plus line differs' END, CASE WHEN length(seq) <> n_qual THEN 'lengths differ' END) AS errors FROM r""")
def _(s, d):
    rows = fx.table(s, d, "documents").where("length(text) > 0").select(
        "doc_id", (F.col("doc_id") * 4 + 1).alias("line"), F.expr("concat('@r', cast(doc_id % 150 as string), ' x')").alias("id_line"),
        F.expr("CASE WHEN doc_id % 7 = 0 THEN text ELSE regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N') END").alias("seq"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN '+other' ELSE '+' END").alias("plus"), F.expr("repeat('I', length(text) + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END)").alias("qual"),
    )
    return reads.validate_fastq(rows).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query("W5_trim_ends", """WITH r AS (SELECT doc_id, [unicode(c) % 40 FOR c IN string_split(text, '')] AS q FROM documents WHERE length(text) >= 4),
f AS (SELECT doc_id, q, coalesce(list_filter(range(0, len(q) - 3), lambda i: q[i + 1] + q[i + 2] + q[i + 3] + q[i + 4] > 80)[1], len(q)) AS first FROM r)
SELECT doc_id, CAST(coalesce(list_max(list_filter(range(1, first + 1), lambda p: q[p] < 20)), 0) AS INT) AS cut FROM f""")
def _(s, d):
    rows = fx.table(s, d, "documents").where("length(text) >= 4").select("doc_id", F.expr("transform(filter(split(text, ''), c -> c <> ''), c -> ascii(c) % 40)").alias("q"))
    return rows.select("doc_id", reads.trim_index(F.col("q"), 20).alias("cut"))


@query("M15_phred", f"WITH {_CHARS} SELECT doc_id, count(*) AS n, CAST(sum(ascii(ch) - 33) AS BIGINT) AS total, min(ascii(ch) - 33) AS least, max(ascii(ch) - 33) AS most FROM c WHERE ascii(ch) BETWEEN 33 AND 126 GROUP BY 1")
def _(s, d):
    at = fx.table(s, d, "documents").select("doc_id", F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("ch")).where(F.ascii("ch").between(33, 126))
    q = scalar.phred(F.col("ch"))
    return at.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(q).cast("long").alias("total"), F.min(q).alias("least"), F.max(q).alias("most"))


@query("T20_log_rank_summaries", duck("pheno", "SELECT iid, round(sqrt(wt), 8) AS se, round(y / wt, 8) + 0.0 AS peto, round(1 / wt, 8) AS peto_variance, round(1 / sqrt(wt), 8) AS peto_se FROM pheno"))
def _(s, d):
    rows = fx.pheno(s, d).select("iid", F.col("y").alias("u"), F.col("wt").alias("v"))
    return rounded(survival.summarize_log_rank(rows).select("iid", "se", "peto", "peto_variance", "peto_se"), 8)


# --- packed scans, and fits whose twins unroll Newton's steps --------------------------------------------------------
def _scan(s, d, pheno, model="linear", covariates=(), gt=None, **options):
    gt = fx.geno(s, d) if gt is None else gt
    made = packed.design(pheno, list(covariates), model, genotyped=gt, **options)
    return packed.pack(gt, made, compact=True), made


_SIZES = ", z AS (SELECT fid, count(*) = 1 AS single FROM {of} GROUP BY 1)"
_VARIANT_COX = ", rows AS (SELECT variant AS v, 0 AS part, s.iid, s.fid, single, entry, exit, event, CAST(g AS DOUBLE) AS p, x1 AS q FROM geno JOIN surv s USING (iid) JOIN z ON z.fid = s.fid WHERE g IS NOT NULL)"


@query("T3_logistic_wald", duck("pheno geno", _SIZES.format(of="pheno") + ", r AS (SELECT variant, fid, single, g, yb AS y FROM geno JOIN pheno USING (iid) JOIN z USING (fid) WHERE g IS NOT NULL)" + twins.logistic("r") + " SELECT variant, n, round(beta, 4) + 0.0 AS beta, round(sqrt(CASE WHEN var < model - 1e-8 THEN model ELSE var END), 4) AS se, round(beta * beta / CASE WHEN var < model - 1e-8 THEN model ELSE var END, 3) AS chisq FROM lv"))
def _(s, d):
    return _slim(scans.wald_scan(fx.pheno(s, d).withColumn("y", F.col("yb")), fx.geno(s, d), model="logistic"), 4)


@query("T4_cox_wald", duck("pheno geno surv", _SIZES.format(of="surv") + _VARIANT_COX + twins.cox("rows") + twins.cox_sandwich() + ", n AS (SELECT v, count(*) AS n FROM rows GROUP BY 1), o AS (SELECT v, n, a, CASE WHEN v11 < m11 - 1e-8 THEN m11 ELSE v11 END AS var FROM cv JOIN n USING (v)) SELECT v AS variant, n, round(a, 4) + 0.0 AS beta, round(sqrt(var), 4) AS se, round(a * a / var, 3) AS chisq FROM o"))
def _(s, d):
    return _slim(scans.wald_scan(fx.surv(s, d), fx.geno(s, d), ["x1"], "cox"), 4)


@query("N3_T10_cox_score", duck("pheno geno surv", _SIZES.format(of="surv") + ", base AS (SELECT 0 AS v, 0 AS part, iid, fid, false AS single, entry, exit, event, x1 AS p, 0.0::DOUBLE AS q FROM surv)" + twins.cox("base", "n", one=True) + """
, rows AS (SELECT variant AS v, 0 AS part, s.iid, s.fid, single, entry, exit, event, coalesce(CAST(g AS DOUBLE), avg(g) OVER (PARTITION BY variant)) AS p, x1 AS q FROM geno JOIN surv s USING (iid) JOIN z ON z.fid = s.fid),
start AS (SELECT v, 0.0::DOUBLE AS a, b FROM (SELECT DISTINCT v FROM rows), (SELECT a AS b FROM nf))""" + twins.cox("rows", given="start") + """
, s AS (SELECT v, fid, any_value(single) AS single, sum(u1) AS u, sum(u1 - i12 / i22 * u2) AS s, sum(c11 - 2 * i12 / i22 * c12 + (i12 / i22) * (i12 / i22) * c22) AS q, count(*) AS m FROM cr JOIN ci USING (v) GROUP BY 1, 2),
t AS (SELECT v, sum(m) AS n, sum(u) AS u, sum(CASE WHEN single THEN q ELSE s * s END) AS v0, any_value(i11 - i12 * i12 / i22) AS va FROM s JOIN ci USING (v) GROUP BY 1),
o AS (SELECT *, CASE WHEN 1 / v0 < 1 / va - 1e-8 THEN va ELSE v0 END AS vv FROM t)
SELECT v AS variant, CAST(n AS BIGINT) AS n, round(u, 4) + 0.0 AS u, round(vv, 4) AS v, round(va, 4) AS v_a, round(u / vv, 5) + 0.0 AS beta, round(1 / sqrt(vv), 5) AS se FROM o"""))
def _(s, d):
    p = fx.surv(s, d)
    out = scans.score_scan(p, fx.geno(s, d), score.fit_null_cox(p, ["x1"]), "cox")
    return out.select("variant", "n", (F.round("u", 4) + 0.0).alias("u"), F.round("v", 4).alias("v"), F.round("v_a", 4).alias("v_a"), (F.round("beta", 5) + 0.0).alias("beta"), F.round("se", 5).alias("se"))


@query("T7_conditional", duck("pheno geno", """, c AS (SELECT iid, g AS c3 FROM geno WHERE variant = 3 AND g IS NOT NULL), z AS (SELECT fid, count(*) = 1 AS single FROM pheno JOIN c USING (iid) GROUP BY 1),
r AS (SELECT variant, fid, single, g - avg(g) OVER w AS p, c3 - avg(c3) OVER w AS q, y - avg(y) OVER w AS y FROM geno JOIN pheno USING (iid) JOIN c USING (iid) JOIN z USING (fid) WHERE g IS NOT NULL AND variant <> 3 WINDOW w AS (PARTITION BY variant))""" + twins.two_terms("r") + """
SELECT variant, 'g' AS term, round(b1, 6) + 0.0 AS beta, round(sqrt(v11), 6) AS se FROM ov UNION ALL SELECT variant, 'c_3', round(b2, 6) + 0.0, round(sqrt(v22), 6) FROM ov"""))
def _(s, d):
    gt = fx.geno(s, d)
    p = link.attach_conditions(fx.pheno(s, d), gt, [3])
    found = packed.wald_scan(*_scan(s, d, p, "linear", ["c_3"], gt.where("variant <> 3")))
    return rounded(packed.term_rows(found, {"g": 0, "c_3": 2}).drop("pvalue"))


_CROSS = """, r0 AS (SELECT variant, fid, single, CAST(g AS DOUBLE) AS g, g * x1 AS gx, x1, y FROM geno JOIN pheno USING (iid) JOIN z USING (fid) WHERE g IS NOT NULL),
f0 AS (SELECT variant, regr_slope(g, x1) AS bg, regr_intercept(g, x1) AS ag, regr_slope(gx, x1) AS bx, regr_intercept(gx, x1) AS ax, regr_slope(y, x1) AS by_, regr_intercept(y, x1) AS ay FROM r0 GROUP BY 1),
r AS (SELECT variant, fid, single, g - ag - bg * x1 AS p, gx - ax - bx * x1 AS q, y - ay - by_ * x1 AS y FROM r0 JOIN f0 USING (variant))"""


@query("T8_interaction", duck("pheno geno", _SIZES.format(of="pheno") + _CROSS + twins.two_terms("r") + ", t AS (SELECT *, (b1 * b1 * v22 - 2 * b1 * b2 * v12 + b2 * b2 * v11) / (v11 * v22 - v12 * v12) AS both_ FROM ov) SELECT variant, round(b1 * b1 / v11, 5) AS chisq_g, round(b2 * b2 / v22, 5) AS chisq_inter, round(both_, 5) AS chisq_both, round(exp(-both_ / 2), 6) AS p_both FROM t"))
def _(s, d):
    found = wald.interaction_test(scans.wald_scan(fx.pheno(s, d), fx.geno(s, d), ["x1"], envs=["x1"]), 1)
    return found.select("variant", F.round("chisq_g", 5).alias("chisq_g"), F.round("chisq_inter", 5).alias("chisq_inter"), F.round("chisq_both", 5).alias("chisq_both"), F.round("p_both", 6).alias("p_both"))


@query("T8_interaction_detail", duck("pheno geno", _SIZES.format(of="pheno") + _CROSS + twins.two_terms("r") + " SELECT variant, 'g' AS a, 'g' AS b, round(v11, 7) AS cov FROM ov UNION ALL SELECT variant, 'g', 'g_x_x1', round(v12, 7) + 0.0 FROM ov UNION ALL SELECT variant, 'g_x_x1', 'g_x_x1', round(v22, 7) FROM ov"))
def _(s, d):
    found = scans.wald_scan(fx.pheno(s, d), fx.geno(s, d), ["x1"], envs=["x1"])
    return rounded(packed.covariances(found, {"g": 0, "g_x_x1": 2}), 7)


_STRATA = ", rows AS (SELECT 0 AS v, stratum AS part, iid, iid AS fid, false AS single, entry, exit, event, arm AS p, x1 AS q FROM surv)"
_LATE = ", late AS (SELECT 0 AS v, stratum AS part, iid, iid AS fid, false AS single, entry, least(exit, 1500) AS exit, event AND exit < 1500 AS event, arm AS p, x1 AS q FROM surv)"


@query("T18_stratified_cox", duck("pheno surv", _STRATA + twins.cox("rows") + twins.cox_sandwich() + " SELECT 'arm' AS term, round(a, 5) + 0.0 AS beta, round(sqrt(v11), 5) AS se, round(a / sqrt(v11), 5) + 0.0 AS z FROM cv UNION ALL SELECT 'x1', round(b, 5) + 0.0, round(sqrt(v22), 5), round(b / sqrt(v22), 5) + 0.0 FROM cv"))
def _(s, d):
    return rounded(survival.cox_regression(fx.surv(s, d), ["arm", "x1"], robust=True).drop("pvalue"), 5)


@query("T19_dual_covariance", duck("pheno surv", _STRATA + _LATE + twins.cox("rows", "a") + twins.cox("late", "b") + """
, x AS (SELECT sum(a.u1 * b.u1) AS c11, sum(a.u1 * b.u2) AS c12, sum(a.u2 * b.u1) AS c21, sum(a.u2 * b.u2) AS c22 FROM ar a JOIN br b USING (iid)),
i AS (SELECT a.i22 / (a.i11 * a.i22 - a.i12 * a.i12) AS a11, -a.i12 / (a.i11 * a.i22 - a.i12 * a.i12) AS a12, a.i11 / (a.i11 * a.i22 - a.i12 * a.i12) AS a22, b.i22 / (b.i11 * b.i22 - b.i12 * b.i12) AS b11, -b.i12 / (b.i11 * b.i22 - b.i12 * b.i12) AS b12, b.i11 / (b.i11 * b.i22 - b.i12 * b.i12) AS b22 FROM ai a, bi b),
h AS (SELECT a11 * c11 + a12 * c21 AS h11, a11 * c12 + a12 * c22 AS h12, a12 * c11 + a22 * c21 AS h21, a12 * c12 + a22 * c22 AS h22, i.* FROM i, x),
o AS (SELECT 'arm' AS term_a, 'arm' AS term_b, h11 * b11 + h12 * b12 AS c, a11 * b11 AS m FROM h UNION ALL SELECT 'arm', 'x1', h11 * b12 + h12 * b22, a11 * b22 FROM h UNION ALL SELECT 'x1', 'arm', h21 * b11 + h22 * b12, a22 * b11 FROM h UNION ALL SELECT 'x1', 'x1', h21 * b12 + h22 * b22, a22 * b22 FROM h)
SELECT term_a, term_b, round(c, 6) + 0.0 AS covariance, round(c / sqrt(m), 6) + 0.0 AS correlation FROM o"""))
def _(s, d):
    a = fx.surv(s, d)
    b = a.withColumns({"event": F.col("event") & (F.col("exit") < 1500), "exit": F.least(F.col("exit"), F.lit(1500).cast("long"))})
    return rounded(survival.dual_covariance(a, b, ["arm", "x1"]))


@query("V6_dual_log_rank", duck("pheno surv", (_STRATA + _LATE).replace(" entry,", " -1 AS entry,") + ", zero AS (SELECT 0 AS v, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)" + twins.cox("rows", "a", given="zero") + twins.cox("late", "b", given="zero") + """
, x AS (SELECT sum(a.u1 * b.u1) AS c FROM ar a JOIN br b USING (iid)) SELECT round(c, 6) + 0.0 AS covariance, round(c / sqrt(a.i11 * b.i11), 6) + 0.0 AS correlation FROM x, ai a, bi b"""))
def _(s, d):
    a = fx.surv(s, d).withColumn("entry", F.lit(-1).cast("long"))
    b = a.withColumns({"event": F.col("event") & (F.col("exit") < 1500), "exit": F.least(F.col("exit"), F.lit(1500).cast("long"))})
    return rounded(survival.dual_log_rank(a, b, "arm"))


def _study_probs(s, d):
    """Subjects with a study, and joint inclusion probabilities of those that share a sampling cluster of 12 neighbouring ids."""
    p = fx.pheno(s, d).withColumn("study", F.col("x1").cast("long") % 3)
    own = p.select("study", F.floor(F.col("iid") / 12).alias("cluster"), F.col("iid").alias("iid_i"), (1 / F.col("wt")).alias("a"))
    other = own.select("study", "cluster", F.col("iid_i").alias("iid_j"), F.col("a").alias("b"))
    joint = F.least(F.lit(1.0), F.col("a") * F.col("b") * (1 + ((F.col("iid_i") + F.col("iid_j")) % 3) * 0.05))
    return p, own.join(other, ["study", "cluster"]).select("study", "iid_i", "iid_j", F.when(F.col("iid_i") == F.col("iid_j"), F.col("a")).otherwise(joint).alias("pi"))


_DELTA = """, s AS (SELECT *, CAST(x1 AS BIGINT) % 3 AS study, iid // 12 AS cluster, 1 / wt AS pi FROM pheno),
r AS (SELECT variant, iid, s.fid, study, cluster, wt AS w, pi, CAST(g AS DOUBLE) AS g, {y} AS y FROM geno JOIN s USING (iid) WHERE g IS NOT NULL),
q AS (SELECT variant, a.iid AS i, b.iid AS j, a.h * a.e AS x, b.h * b.e AS x2, a.h1 * a.e AS k, b.h1 * b.e AS k2,
 CASE WHEN a.fid = b.fid THEN a.w * b.w ELSE (least(1, a.pi * b.pi * (1 + ((a.iid + b.iid) % 3) * 0.05)) - a.pi * b.pi) * a.w * b.w / least(1, a.pi * b.pi * (1 + ((a.iid + b.iid) % 3) * 0.05)) END AS delta FROM f a JOIN f b USING (variant, study, cluster))"""


@query("T1_inclusion_probabilities", duck("pheno geno", _DELTA.format(y="y").split("\nq AS")[0].rstrip(",") + """,
m AS (SELECT variant, count(*) AS n, sum(w) AS sw, sum(w * g) / sum(w) AS mg, sum(w * y) / sum(w) AS my FROM r GROUP BY 1),
b AS (SELECT variant, sum(w * (g - mg) * (g - mg)) AS sxx, sum(w * (g - mg) * (y - my)) / sum(w * (g - mg) * (g - mg)) AS beta FROM r JOIN m USING (variant) GROUP BY 1),
f AS (SELECT r.*, y - my - beta * (g - mg) AS e, (g - mg) / sxx AS h, 1 / sw - mg * (g - mg) / sxx AS h1 FROM r JOIN m USING (variant) JOIN b USING (variant)),
""" + "q AS" + _DELTA.split("\nq AS")[1] + """,
o AS (SELECT variant, sum(delta * x * x2) AS var, sum(delta * k * k2) AS var1 FROM q GROUP BY 1)
SELECT variant, n, CASE WHEN var > 0 AND var1 > 0 THEN round(beta, 6) + 0.0 END AS beta, CASE WHEN var > 0 AND var1 > 0 THEN round(sqrt(var), 6) END AS se FROM o JOIN m USING (variant) JOIN b USING (variant)"""))
def _(s, d):
    p, probs = _study_probs(s, d)
    out = blocked.wald_scan(*_blocked(s, d, p, probs, robust=True))
    return out.select("variant", "n", (F.round("beta", 6) + 0.0).alias("beta"), F.round("se", 6).alias("se"))


def _blocked(s, d, pheno, probs, model="linear", covariates=(), **options):
    """Packed genotypes, a design of the studies' subjects, and their probabilities, for scans in blocks."""
    return *_scan(s, d, pheno, model, covariates, weighted=True, members=probs, **options), probs


# of the pairs of a study and cluster, with the singletons' own term apart; f has h, h1 (influences), e, d (variances)
_STUDIES = ", s AS (SELECT *, CAST(x1 AS BIGINT) % 3 AS study, iid // 12 AS cluster, 1 / wt AS pi FROM pheno), sz AS (SELECT study, fid, count(*) = 1 AS single FROM {of} GROUP BY 1, 2)"
_PI = "least(1, a.pi * b.pi * (1 + ((a.iid + b.iid) % 3) * 0.05))"
_PAIRS = f""",
qd AS (SELECT a.v, a.x1 AS ax1, a.x2 AS ax2, b.x1 AS bx1, b.x2 AS bx2, a.c11, a.c12, a.c22, a.iid = b.iid AND a.single AS own, CASE WHEN a.fid = b.fid THEN a.w * b.w ELSE ({_PI} - a.pi * b.pi) * a.w * b.w / {_PI} END AS delta FROM f a JOIN f b USING (v, study, cluster)),
qb AS (SELECT v, sum(delta * CASE WHEN own THEN c11 ELSE ax1 * bx1 END) AS b11, sum(delta * CASE WHEN own THEN c12 ELSE (ax1 * bx2 + ax2 * bx1) / 2 END) AS b12, sum(delta * CASE WHEN own THEN c22 ELSE ax2 * bx2 END) AS b22 FROM qd GROUP BY 1)"""


@query("T3_inclusion_probabilities", duck("pheno geno", _STUDIES.format(of="s") + """,
r AS (SELECT variant, iid, fid, study, cluster, wt AS w, pi, single, g, yb AS y FROM geno JOIN s USING (iid) JOIN sz USING (study, fid) WHERE g IS NOT NULL)""" + twins.logistic("r", w="w") + """,
f AS (SELECT r.variant AS v, iid, fid, study, cluster, w, pi, single, h * e AS x1, h1 * e AS x2, h * h * d AS c11, h * h1 * d AS c12, h1 * h1 * d AS c22 FROM
 (SELECT r.*, y - 1 / (1 + exp(-(a + b * g))) AS e, 1 / (1 + exp(-(a + b * g))) * (1 - 1 / (1 + exp(-(a + b * g)))) AS d, (g * iaa - iab) / (iaa * ibb - iab * iab) AS h, (ibb - g * iab) / (iaa * ibb - iab * iab) AS h1 FROM r JOIN lf ON lf.variant = r.variant) r)""" + _PAIRS + """
SELECT variant, n, CASE WHEN b11 > 0 AND b22 > 0 THEN round(b, 6) + 0.0 END AS beta, CASE WHEN b11 > 0 AND b22 > 0 THEN round(sqrt(b11), 6) END AS se, CASE WHEN b11 > 0 AND b22 > 0 THEN round(b * b / b11, 5) END AS chisq FROM qb JOIN lf ON lf.variant = qb.v"""))
def _(s, d):
    p, probs = _study_probs(s, d)
    return _slim(blocked.wald_scan(*_blocked(s, d, p.withColumn("y", F.col("yb")), probs, "logistic")))


@query("T4_inclusion_probabilities", duck("pheno geno surv", _STUDIES.format(of="(SELECT s.* FROM s JOIN surv USING (iid))") + """,
rows AS (SELECT variant AS v, 0 AS part, u.iid, u.fid, single, entry, exit, event, CAST(g AS DOUBLE) AS p, arm AS q, u.wt AS w, s.study, s.cluster, s.pi FROM geno JOIN surv u USING (iid) JOIN s ON s.iid = u.iid JOIN sz ON sz.study = s.study AND sz.fid = u.fid WHERE g IS NOT NULL)""" + twins.cox("rows", w="w") + """,
f AS (SELECT r.v, r.iid, r.fid, study, cluster, w, pi, r.single, (i22 * u1 - i12 * u2) / det AS x1, (i11 * u2 - i12 * u1) / det AS x2, (i22 * i22 * c11 - 2 * i12 * i22 * c12 + i12 * i12 * c22) / (det * det) AS c11, 0 AS c12, (i12 * i12 * c11 - 2 * i11 * i12 * c12 + i11 * i11 * c22) / (det * det) AS c22
 FROM cr r JOIN rows o ON o.v = r.v AND o.iid = r.iid JOIN (SELECT *, i11 * i22 - i12 * i12 AS det FROM ci) i ON i.v = r.v)""" + _PAIRS + """,
nn AS (SELECT v, count(*) AS n FROM rows GROUP BY 1)
SELECT qb.v AS variant, n, CASE WHEN b11 > 0 AND b22 > 0 THEN round(a, 6) + 0.0 END AS beta, CASE WHEN b11 > 0 AND b22 > 0 THEN round(sqrt(b11), 6) END AS se, CASE WHEN b11 > 0 AND b22 > 0 THEN round(a * a / b11, 5) END AS chisq FROM qb JOIN cf USING (v) JOIN nn USING (v)"""))
def _(s, d):
    p, probs = _study_probs(s, d)
    studied = fx.surv(s, d).join(p.select("iid", "study"), "iid")
    return _slim(blocked.wald_scan(*_blocked(s, d, studied, probs, "cox", ["arm"])))


def _weighted_score_sql(scale: str) -> str:
    return duck("pheno geno", f""", z AS (SELECT fid, count(*) = 1 AS single FROM pheno GROUP BY 1), nul AS (SELECT sum(wt * y) / sum(wt) AS my, count(*) AS n, sum(wt) AS sw FROM pheno), nu2 AS (SELECT nul.*, (SELECT sum(wt * (y - my) * (y - my)) / sum(wt) FROM pheno) AS s2 FROM nul),
r AS (SELECT variant, fid, single, wt AS w, y - my AS r, s2, n, sw, coalesce(CAST(g AS DOUBLE), avg(g) OVER (PARTITION BY variant)) AS g FROM geno JOIN pheno USING (iid) JOIN z USING (fid), nu2),
c AS (SELECT *, g - sum(w * g) OVER (PARTITION BY variant) / sum(w) OVER (PARTITION BY variant) AS e FROM r),
f AS (SELECT variant, fid, any_value(single) AS single, any_value(s2) AS s2, any_value(n) AS n, any_value(sw) AS sw, sum(w * r * e) / any_value(s2) AS s, sum(w * w * e * e) / any_value(s2) AS q, sum(w * e * e) / any_value(s2) AS a FROM c GROUP BY 1, 2),
t AS (SELECT variant, any_value(n) / any_value(sw) AS naive, sum(s) AS u, sum(CASE WHEN single THEN q ELSE s * s END) AS v0, sum(a) AS va FROM f GROUP BY 1),
o AS (SELECT *, {scale} AS k FROM t)
SELECT variant, round(u * k, 5) + 0.0 AS u, round(v0 * k * k, 4) AS v, round(u / v0, 6) + 0.0 AS beta, round(1 / sqrt(v0), 6) AS se FROM o""")


for _rescale, _k in (("naive", "naive"), ("optimal", "CASE WHEN v0 > 0 AND va > 0 THEN va / v0 ELSE naive END")):

    @query(f"T15_{_rescale}_rescale", _weighted_score_sql(_k))
    def _(s, d, rescale=_rescale):
        p = fx.pheno(s, d)
        out = scans.score_scan(p, fx.geno(s, d), score.fit_null_linear(p, weighted=True), rescale=rescale)
        return out.select("variant", (F.round("u", 5) + 0.0).alias("u"), F.round("v", 4).alias("v"), (F.round("beta", 6) + 0.0).alias("beta"), F.round("se", 6).alias("se"))


@query("T12_gene_score_families", duck("pheno geno variants groups", """, z AS (SELECT fid, count(*) = 1 AS single FROM pheno GROUP BY 1), nul AS (SELECT avg(y) AS my, var_pop(y) AS s2 FROM pheno),
e AS (SELECT variant, iid, fid, single, y - my AS r, s2, coalesce(CAST(g AS DOUBLE), avg(g) OVER (PARTITION BY variant)) - avg(g) OVER (PARTITION BY variant) AS e FROM geno JOIN pheno USING (iid) JOIN z USING (fid), nul),
h AS (SELECT DISTINCT gene, variant FROM groups), k AS (SELECT DISTINCT a.variant AS i, b.variant AS j FROM h a JOIN h b ON a.gene = b.gene AND b.variant <= a.variant),
m AS (SELECT i, j, sum(x.e * y.e) / any_value(x.s2) AS va, sum(x.e * y.e) FILTER (x.single) / any_value(x.s2) AS one FROM k JOIN e x ON x.variant = i JOIN e y ON y.variant = j AND y.iid = x.iid GROUP BY 1, 2),
fs AS (SELECT variant, fid, sum(r * e) / any_value(s2) AS s FROM e WHERE NOT single GROUP BY 1, 2), us AS (SELECT variant, sum(r * e) / any_value(s2) AS u FROM e GROUP BY 1),
n AS (SELECT i, j, sum(x.s * y.s) AS many FROM k JOIN fs x ON x.variant = i JOIN fs y ON y.variant = j AND y.fid = x.fid GROUP BY 1, 2),
v AS (SELECT i, j, va, coalesce(one, 0) + coalesce(many, 0) AS v0 FROM m LEFT JOIN n USING (i, j)), low AS (SELECT i AS variant, 1 / v0 < 1 / va - 1e-8 AS low FROM v WHERE i = j)
SELECT a.gene, i, j, CASE WHEN i = j THEN round(u, 5) + 0.0 END AS u, round(CASE WHEN li.low OR lj.low THEN va ELSE v0 END, 4) + 0.0 AS v FROM v JOIN h a ON a.variant = i JOIN h b ON b.variant = j AND b.gene = a.gene JOIN us ON us.variant = i JOIN low li ON li.variant = i JOIN low lj ON lj.variant = j"""))
def _(s, d):
    p = fx.pheno(s, d)
    table, made = _scan(s, d, p)
    out = packed.gene_scan(table, fx.groups(s, d), made, score.fit_null_linear(p), maf_ub=1.0)
    return out.select("gene", "i", "j", (F.round("u", 5) + 0.0).alias("u"), (F.round("v", 4) + 0.0).alias("v"))


# --- sources and sinks: derived tables written as files of the format and read again ---------------------------------
@query("S1_S10_phenotypes", duck("pheno", "SELECT CAST(iid AS VARCHAR) AS iid, stratum, CASE WHEN iid % 11 <> 0 THEN round(y, 6) END AS y FROM pheno"))
def _(s, d):
    path = fx.scratch(s, "phenotypes")
    text.write_results(fx.pheno(s, d).select("iid", "stratum", F.when(F.col("iid") % 11 != 0, F.col("y")).alias("y")), path)
    return rounded(text.read_phenotypes(s, path).select("iid", "stratum", F.col("y").cast("double").alias("y")))


def _vcf(s, d) -> str:
    """The derived genotypes as a VCF file, with GT and DS."""
    path, sites = fx.scratch(s, "vcf"), fx.variants(s, d)
    gt = F.when(F.col("g").isNull(), "./.").when(F.col("g") == 0, "0/0").when(F.col("g") == 1, "0|1").otherwise("1/1")
    cells = fx.geno(s, d).join(F.broadcast(sites), "variant").select("chrom", "pos", "ref", "alt", "iid", gt.alias("gt"), F.create_map(F.lit("DS"), F.coalesce(F.col("g").cast("string"), F.lit("."))).alias("fields"))
    samples = [r.iid for r in fx.pheno(s, d).select("iid").orderBy("iid").collect()]  # the header line
    text.write_vcf(sites.withColumn("filter", F.array("filter")), cells, path, samples, ("GT", "DS"))
    return path


@query("S2_S12_vcf", duck("pheno geno variants", "SELECT CAST(chrom AS VARCHAR) AS chrom, pos, CAST(iid AS VARCHAR) AS iid, CASE WHEN g IS NULL THEN './.' WHEN g = 0 THEN '0/0' WHEN g = 1 THEN '0|1' ELSE '1/1' END AS gt, CASE WHEN g IS NULL THEN '.' ELSE CAST(g AS VARCHAR) END AS ds, g IS NOT NULL AND g = 1 AS phased, g FROM geno JOIN variants USING (variant)"))
def _(s, d):
    _, found = text.read_vcf(s, _vcf(s, d))
    return found.select("chrom", F.col("pos").cast("long").alias("pos"), "iid", "gt", F.element_at("fields", "DS").alias("ds"), (F.col("phased") & ~F.col("gt").contains(".")).alias("phased"), scalar.gt_dosage(F.col("gt")).cast("long").alias("g"))


@query("S2_vcf_sites", duck("variants", "SELECT CAST(chrom AS VARCHAR) AS chrom, pos, id, ref, alt, CAST(variant AS VARCHAR) AS qual, filter, CAST(variant % 3 AS VARCHAR) AS ac FROM variants"))
def _(s, d):
    path = fx.scratch(s, "sites")
    v = F.col("variant")
    text.write_vcf(fx.variants(s, d).select("chrom", "pos", "id", "ref", "alt", F.array("filter").alias("filter"), v.alias("qual"), F.create_map(F.lit("AC"), (v % 3).cast("string")).alias("info")), None, path)
    found, _ = text.read_vcf(s, path)
    return found.select("chrom", F.col("pos").cast("long").alias("pos"), "id", "ref", "alt", "qual", F.col("filter")[0].alias("filter"), F.element_at("info", "AC").alias("ac"))


@query("S3_features", duck("pheno geno", "SELECT 'f' || variant AS feature_id, CAST(iid AS VARCHAR) AS iid, CAST(g AS DOUBLE) AS g FROM geno"))
def _(s, d):
    path = fx.scratch(s, "features")
    cells = F.sort_array(F.collect_list(F.struct("iid", F.coalesce(F.col("g").cast("string"), F.lit("NA")).alias("g"))))
    wide = fx.geno(s, d).groupBy("variant").agg(cells.alias("c"))
    head = wide.orderBy("variant").limit(1).select(F.lit(0).alias("o"), F.concat_ws("\t", F.lit("id"), F.array_join(F.transform("c", lambda x: x["iid"].cast("string")), "\t")).alias("value"))
    body = wide.select(F.lit(1).alias("o"), F.concat_ws("\t", F.concat(F.lit("f"), F.col("variant")), F.array_join(F.transform("c", lambda x: x["g"]), "\t")).alias("value"))
    head.union(body).repartition(1).sortWithinPartitions("o").select("value").write.text(path)  # one file of the format
    return text.read_feature_matrix(s, path)


@query("S4_inclusion_probabilities", duck("pheno", ", p AS (SELECT stratum, 1 / wt AS p FROM pheno), a AS (SELECT stratum, min(p) AS p FROM p GROUP BY 1) SELECT 's' AS study, x.stratum AS iid_i, y.stratum AS iid_j, round(x.p * y.p, 6) AS pi FROM a x, a y"))
def _(s, d):
    path = fx.scratch(s, "probabilities")
    least = fx.pheno(s, d).groupBy("stratum").agg((1 / F.max("wt")).alias("p"))
    other = least.select(F.col("stratum").alias("j"), F.col("p").alias("q"))
    rows = least.crossJoin(F.broadcast(other)).groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("j", (F.col("p") * F.col("q")).alias("pi")))).alias("c"))  # a few strata
    head = rows.limit(1).select(F.lit("").alias("o"), F.array_join(F.transform("c", lambda x: x["j"]), "\t").alias("value"))
    body = rows.select(F.col("stratum").alias("o"), F.array_join(F.transform("c", lambda x: x["pi"].cast("string")), "\t").alias("value"))
    head.union(body).repartition(1).sortWithinPartitions("o").select("value").write.text(path)
    return rounded(text.read_inclusion_probs(s, {"s": path}))


@query("S5_groups", duck("variants groups", "SELECT 'G' || gene AS gene, row_number() OVER (PARTITION BY gene ORDER BY chrom, pos) - 1 AS ord, CAST(chrom AS VARCHAR) AS chrom, pos FROM groups"))
def _(s, d):
    path = fx.scratch(s, "groups")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chrom", "pos"))), lambda x: F.concat(x["chrom"].cast("string"), F.lit(":"), x["pos"].cast("string"))), ",")
    fx.groups(s, d).groupBy("gene").agg(ids.alias("ids")).select(F.concat_ws("\t", F.concat(F.lit("G"), F.col("gene")), "ids").alias("value")).write.text(path)
    return text.read_groups(s, path).select("gene", F.col("ord").cast("long").alias("ord"), "chrom", F.col("pos").cast("long").alias("pos"))


@query("S6_variant_list", duck("variants", "SELECT CAST(chrom AS VARCHAR) AS chrom, pos FROM variants"))
def _(s, d):
    path = fx.scratch(s, "list")
    fx.variants(s, d).select(F.concat_ws(":", "chrom", "pos").alias("value")).write.text(path)
    return text.read_variant_list(s, path).select("chrom", F.col("pos").cast("long").alias("pos"))


@query("S8_fastq", "WITH r AS (SELECT doc_id, regexp_replace(text, '[^a-zA-Z]', 'N', 'g') AS seq FROM documents WHERE length(text) > 0) SELECT 'd' || doc_id AS name, seq, length(seq) AS n_qual, CAST(unicode(chr(CAST(40 + doc_id % 20 AS INT))) AS BIGINT) AS first FROM r")
def _(s, d):
    path = fx.scratch(s, "fastq")
    rows = fx.table(s, d, "documents").where("length(text) > 0").select("doc_id", F.regexp_replace("text", "[^a-zA-Z]", "N").alias("seq"), F.expr("repeat(char(cast(40 + doc_id % 20 as int)), length(text))").alias("qual"))
    rows.select(F.concat(F.lit("@d"), F.col("doc_id"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.text(path)
    found = text.read_fastq(s, path)
    return found.select(F.expr("substring(id_line, 2)").alias("name"), "seq", F.length("qual").cast("long").alias("n_qual"), F.ascii("qual").cast("long").alias("first"))


@query("S9_sam", duck("align", "SELECT CAST(rname AS VARCHAR) AS rname, pos, flag, len || 'M' AS cigar, CAST(len AS VARCHAR) AS nm, count(*) AS n FROM align GROUP BY ALL"))
def _(s, d):
    path = fx.scratch(s, "sam")
    a = fx.align(s, d)
    fields = [F.lit("q"), "flag", "rname", "pos", F.lit(60), F.concat(F.col("len").cast("string"), F.lit("M")), F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"), F.concat(F.lit("NM:i:"), F.col("len").cast("string")), F.lit("RG:Z:a:b")]
    s.createDataFrame([("@HD\tVN:1.6",)], "value string").union(a.select(F.concat_ws("\t", *[F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields]).alias("value"))).write.text(path)
    found = text.read_sam(s, path).where(F.element_at("tags", "RG:Z") == "a:b")
    return found.groupBy("rname", F.col("pos").cast("long").alias("pos"), "flag", "cigar", F.element_at("tags", "NM:i").alias("nm")).agg(F.count("*").alias("n"))


@query("S11_gene_summaries", duck("pheno geno variants groups", ", g AS (SELECT DISTINCT gene, variant FROM groups), c AS (SELECT variant, count(g) AS n, CAST(sum(g) AS BIGINT) AS ac FROM geno GROUP BY 1) SELECT 'G' || gene AS gene, id, ac, n, count(*) OVER (PARTITION BY gene) AS width, row_number() OVER (PARTITION BY gene ORDER BY variant) AS filled FROM g JOIN c USING (variant) JOIN variants v USING (variant)"))
def _(s, d):
    path = fx.scratch(s, "mass")
    genes, sites = fx.groups(s, d).select("gene", "variant").distinct(), fx.variants(s, d).select("variant", "id")
    counts = stats.variant_stats(fx.geno(s, d))
    scores = genes.join(counts, "variant").join(sites, "variant").select(F.concat(F.lit("G"), F.col("gene")).alias("gene"), "variant", "id", F.col("alt_af").alias("af"), F.col("alt_ac").alias("ac"), "n", "n_ref", "n_het", "n_alt", F.lit(0.5).alias("u"))
    cov = genes.join(genes.withColumnRenamed("variant", "j"), "gene").where("j <= variant").select(F.concat(F.lit("G"), F.col("gene")).alias("gene"), F.col("variant").alias("i"), "j", F.lit(1.5).alias("v"))
    text.write_mass(scores, cov, fx.pheno(s, d).count(), path)
    c = F.split("value", "\t")
    lines = s.read.text(path).where("value NOT LIKE '#%'").select(c.alias("c"))
    row = F.slice("c", F.lit(10), F.size("c") - 9)
    return lines.select(F.col("c")[0].alias("gene"), F.col("c")[1].alias("id"), F.col("c")[3].cast("long").alias("ac"), F.col("c")[4].cast("long").alias("n"), F.size(row).cast("long").alias("width"), F.size(F.filter(row, lambda x: x == "1.5")).cast("long").alias("filled"))


# --- further forms ---------------------------------------------------------------------------------------------------
@query("M1_gamma", duck("pheno", "SELECT iid, round(gamma(x1 / 5 + 0.5), 6) AS x1, round(sqrt(wt) * 2, 6) AS x2 FROM pheno"))
def _(s, d):
    return rounded(model.model_matrix(fx.pheno(s, d), "y = gamma(x1 / 5 + 0.5) + sqrt(wt) * 4 * phi(x1 - x1)").select("iid", "x1", "x2"))


@query("M2_nominal_interaction", duck("pheno", "SELECT iid, CASE WHEN stratum = 'BUILDING' THEN x1 ELSE 0 END AS x1, CASE WHEN stratum = 'FURNITURE' THEN x1 ELSE 0 END AS x2, wt AS x3 FROM pheno"))
def _(s, d):
    return model.model_matrix(fx.pheno(s, d), "y = stratum * x1 + wt", {"stratum": ["AUTOMOBILE", "BUILDING", "FURNITURE"]}).select("iid", "x1", "x2", "x3")


@query("M5_unstandardize", duck("pheno", "SELECT 'x1' AS term, round(regr_slope(y, x1), 6) AS beta, round(sqrt((regr_syy(y, x1) - regr_sxy(y, x1) * regr_sxy(y, x1) / regr_sxx(y, x1)) / (count(*) - 2) / regr_sxx(y, x1)), 6) AS se FROM pheno"))
def _(s, d):
    p = fx.pheno(s, d)
    fit = wald.linear_regression(model.standardize(p, ["x1"]), "y", ["x1"]).where("term = 'x1'").first()
    sd = p.agg(F.stddev_samp("x1")).first()[0]
    beta, cov = model.unstandardize(np.array([fit.beta]), np.array([[fit.se**2]]), np.array([sd]))
    return rounded(s.createDataFrame([("x1", float(beta[0]), float(np.sqrt(cov[0, 0])))], "term string, beta double, se double"))


@query("J3_absent_conditions", duck("variants", "SELECT DISTINCT chrom, pos + 5 AS pos FROM variants WHERE variant % 2 = 0"))
def _(s, d):
    v = fx.variants(s, d)
    return link.absent_conditions(v.select("chrom", (F.col("pos") + F.when(F.col("variant") % 2 == 0, 5).otherwise(0)).alias("pos")), v)


@query("A12_overall_quality", f"WITH {_CHARS} SELECT cycle, round(avg(unicode(ch) % 40), 6) AS quality, count(*) AS n FROM c GROUP BY ROLLUP (cycle)")
def _(s, d):
    chars = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.char(33 + F.ascii(c) % 40))
    out = reads.quality_by_cycle(fx.table(s, d, "documents").select(F.array_join(chars, "").alias("qual")), overall=True)
    return rounded(out.select(F.col("cycle").cast("long").alias("cycle"), "quality", "n"))


@query("A18_pileup_region", "WITH " + _READS + " SELECT rname, refpos, count(*) AS depth, string_agg(base, '' ORDER BY base, q) AS bases FROM b WHERE rname = 2 AND refpos >= 100 AND refpos < 900 GROUP BY 1, 2")
def _(s, d):
    return reads.pileup(_reads(s, d), region=(2, 100, 900)).drop("quals")


@query("A20_sibships", duck("ped", "SELECT fid, fat, mot, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pid) AS sibs FROM ped WHERE fat IS NOT NULL AND mot IS NOT NULL GROUP BY 1, 2, 3"))
def _(s, d):
    return pedigree.sibships(fx.ped(s, d)).select("fid", "fat", "mot", F.array_join(F.transform("sibs", lambda p: p.cast("string")), ",").alias("sibs"))


@query("QA_sibship_errors", duck("ped markers", """, r AS (SELECT fid, fat, mot, marker, a1, a2, least(a1, a2) || '/' || greatest(a1, a2) AS g FROM ped JOIN markers USING (fid, pid) WHERE fat IS NOT NULL),
s AS (SELECT fid, fat, mot, marker, count(DISTINCT g) AS genotypes, count(DISTINCT a1) FILTER (a1 = a2) AS homozygous FROM r GROUP BY 1, 2, 3, 4),
l AS (SELECT fid, fat, mot, marker, unnest([a1, a2]) AS allele, g FROM r), m AS (SELECT fid, fat, mot, marker, allele, count(DISTINCT g) AS within_ FROM l GROUP BY 1, 2, 3, 4, 5), n AS (SELECT fid, fat, mot, marker, count(*) AS alleles, max(within_) AS most FROM m GROUP BY 1, 2, 3, 4)
SELECT fid, fat, mot, marker FROM s JOIN n USING (fid, fat, mot, marker) WHERE genotypes > 4 OR alleles + homozygous > 4 OR (alleles = 4 AND most > 2)"""))
def _(s, d):
    return pedigree.sibship_errors(fx.ped(s, d), fx.markers(s, d)).select("fid", "fat", "mot", "marker")


@query("QD_merged_families", duck("ped", """, t AS (SELECT fid, string_agg(CAST(pid AS VARCHAR), '$' ORDER BY pid) AS merged, max(affected) AS aff FROM ped WHERE twin IS NOT NULL GROUP BY fid, twin),
k AS (SELECT DISTINCT p.fid, CASE WHEN p.twin IS NOT NULL THEN t.merged ELSE CAST(p.pid AS VARCHAR) END AS pid, CAST(p.fat AS VARCHAR) AS fat, CAST(p.mot AS VARCHAR) AS mot, CASE WHEN p.twin IS NOT NULL THEN t.aff ELSE p.affected END AS affected FROM ped p LEFT JOIN t USING (fid)) SELECT * FROM k"""))
def _(s, d):
    return pedigree.merge_twins(fx.ped(s, d)).select("fid", "pid", "fat", "mot", "affected")


@query("T6_degenerate", duck("pheno geno", "SELECT variant, count(*) AS n, variant % 7 = 0 AS degenerate FROM geno WHERE g IS NOT NULL GROUP BY 1"))
def _(s, d):
    gt = fx.geno(s, d).withColumn("g", F.when((F.col("variant") % 7 == 0) & F.col("g").isNotNull(), 1).otherwise(F.col("g")))
    out = packed.wald_scan(*_scan(s, d, fx.pheno(s, d), gt=gt))
    return out.select("variant", "n", (F.col("beta").isNull() & F.col("se").isNull() & F.col("pvalue").isNull() & (F.col("status") != "ok")).alias("degenerate"))


@query("W6_sorted_order", duck("align", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_before FROM align"))
def _(s, d):
    placed = reads.coordinate_sorted(fx.align(s, d)).select(F.struct("rname", "pos").alias("at"), F.monotonically_increasing_id().alias("place"))
    return running.previous(placed, [], ["place"], "at", "before").agg(F.count("*").alias("n"), F.count(F.when(F.col("before") > F.col("at"), 1)).alias("n_before"))


def _strata_sql(steps: int = 60) -> str:
    out = ", s0 AS (SELECT stratum, count(*) AS n, avg(y) AS m, var_pop(y) AS v, (SELECT var_pop(y) FROM pheno) AS s2 FROM pheno GROUP BY 1)"
    for i in range(1, steps + 1):
        out += f", t{i} AS (SELECT sum(n * m / s2) / sum(n / s2) AS mu FROM s{i - 1}), s{i} AS (SELECT stratum, n, m, v, v + (m - mu) * (m - mu) AS s2 FROM s{i - 1}, t{i})"
    return out + f" SELECT stratum, round(mu, 3) AS mean, round(s2, 3) AS sigma2 FROM s{steps}, t{steps}"


@query("N1_null_strata", duck("pheno", _strata_sql()))
def _(s, d):
    null = score.fit_null_linear(fx.pheno(s, d), stratum="stratum")
    return rounded(s.createDataFrame([(k, float(null["theta"][0]), v) for k, v in null["sigma2s"].items()], "stratum string, mean double, sigma2 double"), 3)


@query("V7_influence_late_entry", duck("pheno surv", _STRATA + ", zero AS (SELECT 0 AS v, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)" + twins.cox("rows", "a", given="zero") + " SELECT iid, round(u1, 6) + 0.0 AS w FROM ar"))
def _(s, d):
    return rounded(survival.influence(fx.surv(s, d), "arm"))


@query("T8_cox_interaction", duck("pheno geno surv", _SIZES.format(of="surv") + _VARIANT_COX.replace("x1 AS q", "CAST(g AS DOUBLE) * arm AS q") + twins.cox("rows") + ", o AS (SELECT v, a * a * (i11 - i12 * i12 / i22) AS cg, b * b * (i22 - i12 * i12 / i11) AS cx, a * a * i11 + 2 * a * b * i12 + b * b * i22 AS cb FROM cf JOIN ci USING (v)) SELECT v AS variant, round(cg, 2) AS chisq_g, round(cx, 2) AS chisq_inter, round(cb, 2) AS chisq_both FROM o"))
def _(s, d):
    # g and g x arm alone, with the model's variance, so that two terms hold the whole fit
    gt, p = fx.geno(s, d), fx.surv(s, d)
    made = packed.design(p, ["arm"], "cox", genotyped=gt)
    found = packed.wald_scan(packed.pack(gt, made), made.without_covariates(), ["arm"], variance="model")
    return wald.interaction_test(found, 1, 1).select("variant", *[F.round(c, 2).alias(c) for c in ("chisq_g", "chisq_inter", "chisq_both")])


def _bed(s, d) -> str:
    """The derived genotypes as a bed file with its map and subjects: a.bed, bim and fam of a folder; one variant a row."""
    folder = fx.scratch(s, "plink")
    sites = fx.variants(s, d).select("variant", "chrom", "pos", "id")
    code = F.when(F.col("g").isNull(), 1).when(F.col("g") == 2, 0).when(F.col("g") == 1, 2).otherwise(3)
    rows = fx.geno(s, d).join(F.broadcast(sites), "variant").groupBy("variant", "chrom", "pos", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("iid", code.alias("c")))), lambda x: x["c"]).alias("codes"))
    plink.write_bed(rows.orderBy("variant").select("codes"), f"{folder}/a.bed")
    rows.orderBy("variant").select(F.concat_ws("\t", "chrom", "id", F.lit(0), "pos", F.lit("A"), F.lit("G")).alias("value")).coalesce(1).write.text(f"{folder}/bim")
    fx.pheno(s, d).orderBy("iid").select(F.concat_ws(" ", "fid", "iid", F.lit("0 0 1 -9")).alias("value")).coalesce(1).write.text(f"{folder}/fam")
    return folder


@query("S7_plink", duck("pheno geno variants", "SELECT CAST(chrom AS VARCHAR) AS chrom, id, pos, CAST(iid AS VARCHAR) AS iid, g FROM geno JOIN variants USING (variant)"))
def _(s, d):
    folder = _bed(s, d)
    found = plink.read_plink(s, f"{folder}/a.bed", f"{folder}/bim", f"{folder}/fam")
    return found.select("chrom", "id", F.col("pos").cast("long").alias("pos"), "iid", "g")


# --- files straight to scans, odd variants, null strata --------------------------------------------------------------
@query("S2_packed_T1", _SQL["T1_linear_wald"])
def _(s, d):
    made = packed.design(fx.pheno(s, d))
    read = packed_files.read_vcf(s, _vcf(s, d), made).select(((F.col("pos") - 1000) / 10).cast("long").alias("variant"), "g")
    return _slim(packed.wald_scan(read, made))


@query("S2_packed_dosages_T10", _SQL["T10_linear_score"])
def _(s, d):
    p = fx.pheno(s, d)
    made = packed.design(p)
    read = packed_files.read_vcf(s, _vcf(s, d), made, "DS").select(((F.col("pos") - 1000) / 10).cast("long").alias("variant"), "g")
    return _score_columns(packed.score_scan(read, made, score.fit_null_linear(p)))


@query("S7_packed_T10", _SQL["T10_linear_score"])
def _(s, d):
    folder, p = _bed(s, d), fx.pheno(s, d)
    made = packed.design(p)
    found = packed.score_scan(packed_files.read_bed(s, f"{folder}/a.bed", f"{folder}/fam", made), made, score.fit_null_linear(p))
    named = packed_files.with_map(found, f"{folder}/bim").withColumn("variant", F.substring("id", 3, 9).cast("long"))
    return _score_columns(named)


def _odd(s, d):
    """The derived genotypes, some variants with one value, a dosage that is constant, or a covariate's line, or no call."""
    v, g = F.col("variant"), F.col("g")
    values = F.when(v % 8 == 1, F.lit(1.0)).when(v % 8 == 3, F.lit(0.37)).when(v % 8 == 5, 0.25 + 0.05 * F.col("x1")).when(v % 8 == 7, F.lit(None)).otherwise(g.cast("double"))
    return fx.geno(s, d).join(shuffled(fx.pheno(s, d).select("iid", "x1")), "iid").select("iid", "variant", F.when(g.isNotNull(), values).alias("g"))


_ODD_SQL = "SELECT variant, CASE WHEN variant % 8 = 7 THEN 0 ELSE count(g) END AS n, variant % 2 = 1 AS degenerate FROM geno {join} GROUP BY 1"
for _model in ("linear", "logistic", "cox"):

    @query(f"T6_odd_variants_{_model}", duck("pheno geno surv", _ODD_SQL.format(join="JOIN surv USING (iid)" if _model == "cox" else "")))
    def _(s, d, model=_model):
        p = fx.surv(s, d) if model == "cox" else fx.pheno(s, d).withColumn("y", F.col("yb" if model == "logistic" else "y"))
        out = scans.wald_scan(p, _odd(s, d), ["x1"], model, weighted=True)
        return out.select("variant", "n", (F.col("beta").isNull() & F.col("se").isNull() & (F.col("status") != "ok")).alias("degenerate"))


@query("T1_odd_variants_long", duck("pheno geno", _ODD_SQL.format(join="")))
def _(s, d):
    out = wald.linear_wald(fx.pheno(s, d), _odd(s, d), ["x1"])
    return out.select("variant", "n", (F.col("beta").isNull() & F.col("se").isNull()).alias("degenerate"))


# missing dosages are imputed by their mean, so a covariate's line (5) keeps some variance here
@query("T10_odd_variants_long", duck("pheno geno", "SELECT variant, variant % 8 IN (1, 3, 7) AS degenerate FROM geno GROUP BY 1"))
def _(s, d):
    p, gt = fx.pheno(s, d), _odd(s, d)
    out = score.linear_score(p, gt, score.fit_null_linear(p, ["x1"]), stats.variant_stats(gt))
    return out.select("variant", (F.col("v").isNull() & F.col("beta").isNull() & F.col("chisq").isNull()).alias("degenerate"))


def _gaps(s, d):
    """The survival rows with no stratum where it is BUILDING."""
    return fx.surv(s, d).withColumn("stratum", F.when(F.col("stratum") != "BUILDING", F.col("stratum")))


_GAPS = ", gaps AS (SELECT * REPLACE (coalesce(nullif(stratum, 'BUILDING'), '-') AS stratum) FROM surv)"


@query("V2_null_strata", duck("pheno surv", _GAPS + _RISK.replace("FROM surv", "FROM gaps").replace("JOIN surv", "JOIN gaps") + "SELECT nullif(stratum, '-') AS stratum, time, events, CAST(at_risk AS DOUBLE) AS s0, s1 FROM k WHERE events > 0"))
def _(s, d):
    return survival.risk_sums(_gaps(s, d), "arm").select("stratum", "time", "events", "s0", "s1")


_LEFT = """, km AS (SELECT stratum, time, events, at_risk, s1, coalesce(exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER w), 1) * coalesce(min(CASE WHEN events < at_risk THEN 1 ELSE 0 END) OVER w, 1) AS km
  FROM k WINDOW w AS (PARTITION BY stratum ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("V3_log_rank_weights_ties", duck("pheno surv", _GAPS + (_RISK + _LEFT).replace("FROM surv", "FROM gaps").replace("JOIN surv", "JOIN gaps") + """
, x AS (SELECT stratum, exit AS time, sum(arm) AS ex FROM gaps WHERE event GROUP BY 1, 2),
t AS (SELECT sum(km * (ex - events * s1 / at_risk)) AS u, sum(km * km * events * (s1 / at_risk - (s1 / at_risk) * (s1 / at_risk)) * CASE WHEN at_risk = 1 THEN 1 ELSE (at_risk - events) / (at_risk - 1) END) AS v FROM km JOIN x USING (stratum, time))
SELECT round(u, 6) AS u, round(v, 6) AS v, round(u * u / v, 6) AS chisq, round(u / v, 6) AS peto FROM t"""))
def _(s, d):
    return rounded(survival.log_rank(_gaps(s, d), "arm", km=True, ties=True))


@query("T18_null_strata", _SQL["T18_stratified_cox"].replace("stratum AS part", "coalesce(nullif(stratum, 'BUILDING'), '-') AS part"))
def _(s, d):
    return rounded(survival.cox_regression(_gaps(s, d), ["arm", "x1"], robust=True).drop("pvalue"), 5)


@query("V6_dual_log_rank_late_entry", _SQL["V6_dual_log_rank"].replace(" -1 AS entry,", " entry,"))
def _(s, d):
    a = fx.surv(s, d)
    b = a.withColumns({"event": F.col("event") & (F.col("exit") < 1500), "exit": F.least(F.col("exit"), F.lit(1500).cast("long"))})
    return rounded(survival.dual_log_rank(a, b, "arm"))


@query("T2_strata_slope", duck("pheno geno", _SIZES.format(of="pheno") + ", r AS (SELECT variant, stratum, fid, single, CAST(g AS DOUBLE) AS g, y FROM geno JOIN pheno USING (iid) JOIN z USING (fid) WHERE g IS NOT NULL)" + twins.strata_slope("r") + " SELECT variant, n, round(beta, 6) + 0.0 AS beta, round(sqrt(CASE WHEN var < model - 1e-8 THEN model ELSE var END), 6) AS se, round(beta * beta / CASE WHEN var < model - 1e-8 THEN model ELSE var END, 5) AS chisq FROM hv"))
def _(s, d):
    return _slim(wald.linear_wald_hetero(fx.pheno(s, d), fx.geno(s, d)))


@query("T12_S11_gene_run", duck("pheno geno variants groups", """, nul AS (SELECT avg(y) AS my, var_pop(y) AS s2 FROM pheno),
e AS (SELECT variant, iid, y - my AS r, s2, coalesce(CAST(g AS DOUBLE), avg(g) OVER (PARTITION BY variant)) - avg(g) OVER (PARTITION BY variant) AS e FROM geno JOIN pheno USING (iid), nul),
h AS (SELECT DISTINCT gene, variant FROM groups), us AS (SELECT variant, sum(r * e) / any_value(s2) AS u FROM e GROUP BY 1),
k AS (SELECT DISTINCT a.variant AS i, b.variant AS j FROM h a JOIN h b ON a.gene = b.gene AND b.variant <= a.variant),
m AS (SELECT i, j, sum(x.e * w.e) / any_value(x.s2) AS v FROM k JOIN e x ON x.variant = i JOIN e w ON w.variant = j AND w.iid = x.iid GROUP BY 1, 2),
c AS (SELECT variant, count(g) AS n, CAST(sum(g) AS BIGINT) AS ac FROM geno GROUP BY 1),
l AS (SELECT a.gene, a.variant, count(*) OVER (PARTITION BY a.gene) AS width FROM h a)
SELECT 'G' || gene AS gene, id, ac, n, round(u, 4) + 0.0 AS u, CAST(width AS BIGINT) AS width, (SELECT round(sum(v), 3) FROM m JOIN h b ON b.variant = m.j AND b.gene = l.gene WHERE m.i = l.variant) AS total FROM l JOIN us USING (variant) JOIN c USING (variant) JOIN variants v USING (variant)"""))
def _(s, d):
    path, p, g = fx.scratch(s, "mass"), fx.pheno(s, d), fx.geno(s, d)
    if scans.large(p):
        found = score.gene_moments(p, g, fx.groups(s, d), score.fit_null_linear(p), stats.variant_stats(g))
    else:
        table, made = _scan(s, d, p, robust=True)
        found = packed.gene_scan(table, fx.groups(s, d), replace(made, model_variance=True), score.fit_null_linear(p), maf_ub=1.0)
    named = found.withColumn("gene", F.concat(F.lit("G"), F.col("gene")))
    counts, sites = stats.variant_stats(g), fx.variants(s, d).select("variant", "id")
    scores = named.where("i = j").select("gene", F.col("i").alias("variant"), "u").join(counts, "variant").join(sites, "variant")
    scores = scores.select("gene", "variant", "id", F.col("alt_af").alias("af"), F.col("alt_ac").alias("ac"), "n", "n_ref", "n_het", "n_alt", "u")
    text.write_mass(scores, named.select("gene", "i", "j", "v"), p.count(), path)
    c = F.split("value", "\t")
    lines = s.read.text(path).where("value NOT LIKE '#%'").select(c.alias("c"))
    row = F.slice("c", F.lit(10), F.size("c") - 9)
    total = F.aggregate(row, F.lit(0.0), lambda a, x: a + x.cast("double"))
    out = lines.select(F.col("c")[0].alias("gene"), F.col("c")[1].alias("id"), F.col("c")[3].cast("long").alias("ac"), F.col("c")[4].cast("long").alias("n"), F.col("c")[8].cast("double").alias("u"), F.size(row).cast("long").alias("width"), total.alias("total"))
    return out.withColumns({"u": F.round("u", 4) + 0.0, "total": F.round("total", 3)})


@query("T3_logistic_wald_long", _SQL["T3_logistic_wald"])
def _(s, d):
    return _slim(wald.logistic_wald(fx.pheno(s, d).withColumn("y", F.col("yb")), fx.geno(s, d)), 4)


@query("T4_cox_wald_long", _SQL["T4_cox_wald"])
def _(s, d):
    return _slim(wald.cox_wald(fx.surv(s, d), fx.geno(s, d), ["x1"]), 4)


@query("T11_log_rank_score_long", _SQL["T11_log_rank_score"])
def _(s, d):
    found = score.cox_score(fx.surv(s, d), fx.geno(s, d), score.fit_null_cox(fx.surv(s, d), []))
    return rounded(found.select("variant", "n", "u", "v", "v_a"), 5)
