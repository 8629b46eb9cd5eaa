"""Queries over whole inputs against brute force: nothing is lost behind an id or a text length."""

import numpy as np
import pandas as pd
import pytest

from strataloom.plans import registry

DATA = "/root/testdata/sf0.001"


def test_a_later_subject_makes_a_variant_incomplete(spark, tmp_path):
    customers = spark.read.parquet(f"{DATA}/customer.parquet").where("c_custkey IN (2, 31)")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    found = {r.variant for r in registry.queries()["F9_no_missing"](spark, str(tmp_path)).collect()}
    missing = lambda iid: {v for v in range(40) if (iid * 7 + v * 13) % 37 == 0}
    assert missing(31) - missing(2) and found == set(range(40)) - missing(2) - missing(31)


def test_overlaps_of_ids_of_any_parity(spark):
    part = pd.read_parquet(f"{DATA}/part.parquet")
    rows = [(p.p_partkey, p.p_brand, p.p_partkey * 7 % 5000, p.p_partkey * 7 % 5000 + p.p_size) for p in part.itertuples()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    found = [(r.a_id, r.b_id) for r in registry.queries()["J11_overlapping"](spark, DATA).collect()]
    assert len(found) == len(want) and set(found) == want and any((a - b) % 2 == 0 for a, b in want)


def test_every_character_counts(spark):
    texts = [t for t in pd.read_parquet(f"{DATA}/documents.parquet").text if t]
    composition = registry.queries()["A11_base_composition"](spark, DATA).toPandas()
    assert composition.n.sum() == sum(map(len, texts)) and composition.cycle.max() == max(map(len, texts)) - 1
    assert registry.queries()["A18_pileup"](spark, DATA).agg({"depth": "sum"}).first()[0] == sum(map(len, texts))
    assert registry.queries()["M15_phred"](spark, DATA).agg({"n": "sum"}).first()[0] == sum(33 <= ord(c) <= 126 for t in texts for c in t)


def test_long_intervals_meet_short_ones(spark):
    """All three kinds of interval joins against brute force, with lengths from none to the whole range."""
    from strataloom.operators import link

    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(0, 100_000, 250), rng.choice([0, 3, 40, 900, 20_000, 100_000], 250, p=[0.2, 0.4, 0.2, 0.1, 0.05, 0.05])))]
    table = spark.createDataFrame(rows, "id long, chrom string, start long, end long")
    tests = {"overlapping": lambda a, b: a[2] <= b[3] and b[2] <= a[3], "containing": lambda a, b: a[2] <= b[2] and b[3] <= a[3], "contained": lambda a, b: b[2] <= a[2] and a[3] <= b[3]}
    for how, test in tests.items():
        want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and test(a, b))
        for options in ({}, {"width": 16, "fan": 4, "levels": 6}, {"width": 7, "fan": 3, "levels": 2}):
            assert sorted((r.a_id, r.b_id) for r in link.interval_join(table, table, how, **options).collect()) == want


def test_running_sums_against_windows(spark):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from strataloom.operators import running

    rng = np.random.default_rng(4)
    rows = [(i, [None, "a", "b"][int(k)], int(t), float(v)) for i, (k, t, v) in enumerate(zip(rng.choice(3, 800, p=[0.1, 0.8, 0.1]), rng.integers(0, 60, 800), rng.normal(size=800)))]
    table = spark.createDataFrame(rows, "id long, k string, t long, v double")
    for down in (False, True):
        for current in (False, True):
            order = [F.col(c).desc() if down else F.col(c).asc() for c in ("t", "id")]
            w = W.partitionBy("k").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow if current else -1)
            want = {r.id: (r.s, r.m) for r in table.select("id", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m")).collect()}
            got = {r.id: (r.s, r.m) for r in running.running(table, ["k"], ["t", "id"], down, current, {"s": F.col("v")}, {"m": F.col("v")}).collect()}
            assert all((got[i][0] is None) == (want[i][0] is None) and (want[i][0] is None or (abs(got[i][0] - want[i][0]) < 1e-9 and got[i][1] == want[i][1])) for i in want)
    before = W.partitionBy("k").orderBy("t", "id")
    want = {r.id: r.p for r in table.select("id", F.lag("v").over(before).alias("p")).collect()}
    assert {r.id: r.p for r in running.previous(table, ["k"], ["t", "id"], "v", "p").collect()} == want
    assert running.running(table.where("false"), ["k"], ["t"], sums={"s": F.col("v")}).count() == 0


def test_cigars_walk_their_letters(spark):
    from strataloom.operators import reads

    rows = [("x", 1, 10, "2S3M1I2M2D1M", "ACGTACGTA", "abcdefghi", 0), ("y", 1, 5, "4M", "ACGT", "*", 0), ("z", 1, 12, "*", "A", "b", 4)]
    table = spark.createDataFrame(rows, "id string, rname int, pos int, cigar string, seq string, qual string, flag int")
    found = sorted((r.id, r.refpos, r.base, r.qual or "", r.read_index) for r in reads.cigar_positions(table).collect())
    assert found == [("x", 10, "G", "c", 3), ("x", 11, "T", "d", 4), ("x", 12, "A", "e", 5), ("x", 13, "G", "g", 7), ("x", 14, "T", "h", 8), ("x", 15, "-", "", 9), ("x", 16, "-", "", 10), ("x", 17, "A", "i", 9), ("y", 5, "A", "*", 1), ("y", 6, "C", "", 2), ("y", 7, "G", "", 3), ("y", 8, "T", "", 4)]
    deep = {r.refpos: (r.depth, r.bases, r.quals) for r in reads.pileup(table, del_as_base=True, region=(1, 8, 13)).collect()}
    assert deep == {8: (1, "T", " "), 10: (1, "G", "c"), 11: (1, "T", "d"), 12: (1, "A", "e")}


def test_tails_of_the_distributions(spark):
    import math

    from pyspark.sql import functions as F

    from strataloom.functions import scalar

    x = np.r_[0, np.logspace(-6, 3, 400)]
    assert np.allclose(scalar.erfc(x), [math.erfc(v) for v in x], rtol=1e-11, atol=0)
    rows = spark.createDataFrame([(float(v),) for v in (-3, -0.5, 0, 1, 2.5, 30)] + [(None,)], "v double")
    for r in rows.select("v", scalar.normal_cdf(F.col("v")).alias("p"), scalar.gamma(F.col("v")).alias("g"), scalar.chi2_sf(F.col("v")).alias("t")).collect():
        if r.v is None:
            assert r.p is None or math.isnan(r.p)
            continue
        assert r.p == pytest.approx(0.5 * math.erfc(-r.v / math.sqrt(2)), abs=1e-14)
        assert (r.g is None or math.isnan(r.g)) if r.v in (-3, 0) else r.g == pytest.approx(math.gamma(r.v))
        assert (r.t is None or math.isnan(r.t)) if r.v < 0 else r.t == pytest.approx(math.erfc(math.sqrt(r.v / 2)), rel=1e-9)
