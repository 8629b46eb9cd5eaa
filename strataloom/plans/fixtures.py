"""Association tables derived from the given tables, as Spark views and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.staging import scratch as scratch
from strataloom.operators.staging import shuffled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pheno(spark, d) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(
        c.alias("iid"), F.when(c % 3 == 0, c).otherwise(1000000000 + F.floor(c / 6)).cast("long").alias("fid"), (1 + c % 4).cast("double").alias("wt"), F.col("c_mktsegment").alias("stratum"),
        (F.col("c_acctbal") / 1000).cast("double").alias("y"), F.when(F.col("c_acctbal") > 4500, 1).otherwise(0).alias("yb"), F.col("c_nationkey").cast("double").alias("x1"),
    )


def geno(spark, d) -> DataFrame:
    """(iid, variant, g): every subject and variant, g null where missing."""
    kept = table(spark, d, "lineitem").where(F.col("l_quantity") > (F.col("l_partkey") % 5) * 10).select("l_orderkey", (F.col("l_partkey") % 40).alias("variant"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("iid"))
    calls = kept.join(shuffled(orders), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("iid", "variant").agg(F.least(F.count("*"), F.lit(2)).alias("g"))
    cells = pheno(spark, d).select("iid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("variant"))
    missing = (F.col("iid") * 7 + F.col("variant") * 13) % 37 == 0
    return cells.join(shuffled(calls.withColumn("variant", F.col("variant").cast("long"))), ["iid", "variant"], "left").select("iid", "variant", F.when(missing, None).otherwise(F.coalesce("g", F.lit(0))).cast("long").alias("g"))


def variants(spark, d) -> DataFrame:
    v = F.col("variant")
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 40).cast("long").alias("variant")).distinct()
    return rows.select(
        v, (v % 4).alias("chrom"), (1000 + 10 * v).alias("pos"), F.concat(F.lit("rs"), v.cast("string")).alias("id"), F.when(v % 5 == 0, "ACGT").otherwise("A").alias("ref"),
        F.when(v % 19 == 0, "G,T").otherwise("G").alias("alt"), F.when(v % 7 == 0, "q10").otherwise("PASS").alias("filter"),
    )


def surv(spark, d) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("iid")).agg(
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("exit"), (F.max_by("o_orderstatus", "o_orderkey") == "F").alias("event")
    )
    p = pheno(spark, d)
    return o.join(shuffled(p), "iid").select("iid", "fid", "wt", "stratum", F.least(F.col("exit"), (F.col("iid") % 5) * 30).cast("long").alias("entry"), "exit", "event", "x1", (F.col("iid") % 2).cast("double").alias("arm"))


def groups(spark, d) -> DataFrame:
    v = variants(spark, d).select("variant", "chrom", "pos")
    return v.select((F.col("variant") % 6).alias("gene"), "variant", "chrom", "pos").unionByName(v.where("variant % 5 = 4").select(F.lit(6).cast("long").alias("gene"), "variant", "chrom", "pos"))


def long_covariate(spark, d) -> DataFrame:
    """(iid, time, value): one row per user and second, by the largest event id."""
    e = table(spark, d, "events").select(F.col("user_id").alias("iid"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("time"), "value", "event_id")
    return e.groupBy("iid", "time").agg(F.max_by("value", "event_id").cast("double").alias("value"))


def regions(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    start = (F.col("p_partkey") * 7) % 5000
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("chrom"), start.cast("long").alias("start"), (start + F.col("p_size")).cast("long").alias("end"))


def align(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    flag = F.when(F.col("l_returnflag") == "R", 1024).otherwise(0) + F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), 4).otherwise(0)
    return li.select((F.col("l_suppkey") % 5).alias("rname"), F.col("l_partkey").alias("pos"), F.col("l_quantity").cast("int").alias("len"), (F.col("l_partkey") + F.col("l_quantity").cast("int") - 1).alias("align_end"), flag.alias("flag"))


def ped(spark, d) -> DataFrame:
    c = F.col("c_custkey")
    k, fid = c % 5, F.floor(c / 5).cast("long")
    child = k >= 2
    return table(spark, d, "customer").select(
        fid.alias("fid"), c.alias("pid"), F.when(child, c - k).alias("fat"), F.when(child, c - k + 1).alias("mot"), (1 + c % 2).alias("sex"),
        F.when((k >= 3) & (fid % 4 == 0), 1).alias("twin"), (F.col("c_acctbal") / 1000).cast("double").alias("trait"), F.when(F.col("c_acctbal") > 5000, 2).otherwise(1).alias("affected"),
    )


def markers(spark, d) -> DataFrame:
    c = F.col("c_custkey")
    rows = table(spark, d, "customer").select(c, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("marker"))
    m = F.col("marker")
    return rows.select(F.floor(c / 5).cast("long").alias("fid"), c.alias("pid"), m, (1 + (c * (m + 3)) % 3).cast("int").alias("a1"), (1 + (c * (m + 5) + m) % 3).cast("int").alias("a2"))


DUCK = {
    "pheno": """pheno AS (SELECT c_custkey AS iid, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE 1000000000 + c_custkey // 6 END AS fid,
      CAST(1 + c_custkey % 4 AS DOUBLE) AS wt, c_mktsegment AS stratum, CAST(c_acctbal AS DOUBLE) / 1000 AS y, CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END AS yb, CAST(c_nationkey AS DOUBLE) AS x1 FROM customer)""",
    "geno": """geno AS (SELECT p.iid, v.variant, CASE WHEN (p.iid * 7 + v.variant * 13) % 37 = 0 THEN NULL ELSE coalesce(k.g, 0) END AS g
      FROM pheno p CROSS JOIN (SELECT unnest(range(40)) AS variant) v LEFT JOIN (SELECT o_custkey AS iid, l_partkey % 40 AS variant, least(count(*), 2) AS g
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > (l_partkey % 5) * 10 GROUP BY 1, 2) k ON k.iid = p.iid AND k.variant = v.variant)""",
    "variants": """variants AS (SELECT variant, variant % 4 AS chrom, 1000 + 10 * variant AS pos, 'rs' || variant AS id, CASE WHEN variant % 5 = 0 THEN 'ACGT' ELSE 'A' END AS ref,
      CASE WHEN variant % 19 = 0 THEN 'G,T' ELSE 'G' END AS alt, CASE WHEN variant % 7 = 0 THEN 'q10' ELSE 'PASS' END AS filter FROM (SELECT DISTINCT l_partkey % 40 AS variant FROM lineitem))""",
    "surv": """surv AS (SELECT o.iid, fid, wt, stratum, least(exit, (o.iid % 5) * 30) AS entry, exit, event, x1, CAST(o.iid % 2 AS DOUBLE) AS arm FROM
      (SELECT o_custkey AS iid, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS exit, max_by(o_orderstatus, o_orderkey) = 'F' AS event FROM orders GROUP BY 1) o JOIN pheno USING (iid))""",
    "groups": """groups AS (SELECT variant % 6 AS gene, variant, chrom, pos FROM variants UNION ALL SELECT 6, variant, chrom, pos FROM variants WHERE variant % 5 = 4)""",
    "longcov": """longcov AS (SELECT user_id AS iid, CAST(floor(epoch(ts)) AS BIGINT) AS time, CAST(max_by(value, event_id) AS DOUBLE) AS value FROM events GROUP BY 1, 2)""",
    "regions": """regions AS (SELECT p_partkey AS id, p_brand AS chrom, (p_partkey * 7) % 5000 AS start, (p_partkey * 7) % 5000 + p_size AS "end" FROM part)""",
    "align": """align AS (SELECT l_suppkey % 5 AS rname, l_partkey AS pos, CAST(l_quantity AS INT) AS len, l_partkey + CAST(l_quantity AS INT) - 1 AS align_end,
      CASE WHEN l_returnflag = 'R' THEN 1024 ELSE 0 END + CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 4 ELSE 0 END AS flag FROM lineitem)""",
    "ped": """ped AS (SELECT c_custkey // 5 AS fid, c_custkey AS pid, CASE WHEN c_custkey % 5 >= 2 THEN c_custkey - c_custkey % 5 END AS fat, CASE WHEN c_custkey % 5 >= 2 THEN c_custkey - c_custkey % 5 + 1 END AS mot,
      1 + c_custkey % 2 AS sex, CASE WHEN c_custkey % 5 >= 3 AND (c_custkey // 5) % 4 = 0 THEN 1 END AS twin, CAST(c_acctbal AS DOUBLE) / 1000 AS trait, CASE WHEN c_acctbal > 5000 THEN 2 ELSE 1 END AS affected FROM customer)""",
    "markers": """markers AS (SELECT c_custkey // 5 AS fid, c_custkey AS pid, marker, 1 + (c_custkey * (marker + 3)) % 3 AS a1, 1 + (c_custkey * (marker + 5) + marker) % 3 AS a2 FROM customer, (SELECT unnest(range(4)) AS marker))""",
}


def duck(names: str, body: str) -> str:
    """A query over some of the fixtures."""
    ctes = "WITH " + ",\n".join(DUCK[n] for n in names.split())
    return ctes + "\n" + body
