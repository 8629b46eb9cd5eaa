"""Running sums over cuts, positions in regions, mismatches by chunk and repeated read ids, against plain Python."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.operators import link, reads, running, survival


@pytest.mark.parametrize("cuts", [[], [5.0], [3.0, 20.0, 21.0, 59.0]])
def test_running_sums_in_ranges(spark, cuts):
    rng = np.random.default_rng(4)
    rows = [(i, [None, "a", "b"][int(k)], None if t == 7 else int(t), float(v)) for i, (k, t, v) in enumerate(zip(rng.choice(3, 600, p=[0.1, 0.8, 0.1]), rng.integers(0, 60, 600), rng.normal(size=600)))]
    table = spark.createDataFrame(rows, "id long, k string, t long, v double").where("t IS NOT NULL")
    for down in (False, True):
        for current in (False, True):
            w = W.partitionBy("k").orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c in ("t", "id")]).rowsBetween(W.unboundedPreceding, W.currentRow if current else -1)
            want = {r.id: (r.s, r.m) for r in table.select("id", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m")).collect()}
            got = {r.id: (r.s, r.m) for r in running.running(table, ["k"], ["t", "id"], down, current, {"s": F.col("v")}, {"m": F.col("v")}, cuts).collect()}
            assert all(got[i] == (None, None) if want[i][0] is None else got[i] == pytest.approx(want[i]) for i in want)
    want = {r.id: r.p for r in table.select("id", F.lag("v").over(W.partitionBy("k").orderBy("t", "id")).alias("p")).collect()}
    assert {r.id: r.p for r in running.previous(table, ["k"], ["t", "id"], "v", "p", cuts).collect()} == want


def test_cuts_follow_the_rows(spark):
    table = spark.range(10_000).select(F.sqrt("id").alias("t"))
    assert running.cut_points(table, "t", 10_000) == [] and running.cut_points(table.where("false"), "t") == []
    for rows in (5000, 1000, 30):  # the last makes more ranges than the first pass has quantiles
        cuts = running.cut_points(table, "t", rows)
        sizes = [r.n for r in running.with_range(table, "t", cuts).groupBy("_range").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == -(-10_000 // rows) and max(sizes) <= 2 * rows
    odd = spark.createDataFrame([(None,), (-5,), (3,), (9,), (900,)], "t long")
    assert [r._range for r in running.with_range(odd, "t", [3.0, 9.5]).collect()] == [-1, 0, 1, 1, 2]


def test_survival_is_the_same_over_cuts(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], int(rng.integers(0, 5)), int(rng.integers(5, 60)), bool(rng.random() < 0.5)) for i in range(300)]
    table = spark.createDataFrame(rows, "stratum string, entry long, exit long, event boolean")
    for side in ("left", "right"):
        whole, parts = (sorted(tuple(r) for r in survival.kaplan_meier(table, side, c).collect()) for c in ([], [10.0, 30.0, 31.0]))
        assert [r[:4] for r in whole] == [r[:4] for r in parts] and np.allclose([r[4] for r in whole], [r[4] for r in parts])


def test_positions_in_regions(spark):
    rng = random.Random(1)
    raw = [(rng.choice("xy"), a := rng.randint(0, 400), a + rng.choice([0, 1, 5, 40, 10**9])) for _ in range(25)]
    merged = link.merge_regions(spark.createDataFrame(raw, "chrom string, start long, end long"))
    points = [(i, rng.choice(["x", "y", "z", None]), rng.choice([None, *range(450)])) for i in range(400)]
    found = {r.id: r.inside for r in link.in_regions(spark.createDataFrame(points, "id int, chrom string, pos int"), merged).collect()}
    assert found == {i: p is not None and any(c == k and a <= p < b for k, a, b in raw) for i, c, p in points}
    exact = spark.createDataFrame([("x", 13, 15), ("x", 14, 20), ("x", 25, 26)], "chrom string, start long, end long")
    asked = spark.createDataFrame([(p, "x") for p in (12, 13, 19, 20, 24, 25, 26)], "pos long, chrom string")
    assert {r.pos: r.inside for r in link.in_regions(asked, link.merge_regions(exact)).collect()} == {12: False, 13: True, 19: True, 20: False, 24: False, 25: True, 26: False}


@pytest.mark.parametrize("width", [3, 8, 4096])
def test_mismatches_by_chunk(spark, width):
    rng = random.Random(2)
    ref = {(r, p): rng.choice("ACGT") for r in (1, 2) for p in range(80) if (r, p) != (1, 30)}
    rows, want = [], {}
    for i in range(60):
        cigar, pos, rname = "".join(f"{rng.randint(1, 9)}{rng.choice('MMMIDS=X')}" for _ in range(rng.randint(1, 6))) if i else "*", rng.randint(0, 60), rng.choice([1, 2, 3])
        ops = [(int(n), op) for n, op in __import__("re").findall(r"(\d+)([MIDNSHP=X])", cigar)]
        n = sum(k for k, op in ops if op in "MIS=X")
        seq = "".join(rng.choice("ACGT") for _ in range(max(0, n - rng.choice([0, 0, 2]))))
        qual = "".join(chr(33 + rng.randint(0, 40)) for _ in seq) if rng.random() < 0.7 else ""
        rows.append((i, rname, pos, cigar, seq, qual, 0))
        r, q, bad = pos, 0, 0
        for k, op in ops:
            if op in "M=X":
                for j in range(k):
                    if q + j < len(seq) and (rname, r + j) in ref and seq[q + j] != ref[rname, r + j]:
                        bad += ord(qual[q + j]) - 33 if q + j < len(qual) else 20
            r, q = r + k * (op in "M=XDN"), q + k * (op in "M=XIS")
        want[i] = 4 if bad > 60 else 0
    table = spark.createDataFrame(rows, "id int, rname int, pos int, cigar string, seq string, qual string, flag int")
    sites = spark.createDataFrame([(r, p, b) for (r, p), b in ref.items()], "rname int, pos int, base string")
    assert {r.id: r.flag for r in reads.mismatch_filter(table, sites, 60, width=width).collect()} == want
    assert {r.id: r.flag for r in reads.mismatch_filter(table, reads.reference_chunks(sites, width), 60, width=width).collect()} == want
    assert 0 < sum(want.values()) < 4 * len(want)


def test_chunks_and_long_reads_are_made_in_one_pass(spark):
    rng = random.Random(3)
    gaps = [p for p in range(200_000) if p % 1000 and not 50_000 < p < 60_000]
    sites = spark.createDataFrame([(1, p, "ACGT"[p % 4]) for p in gaps] + [(2, 70_000, "A"), (2, 65_536, None)], "rname int, pos long, base string")
    began = time.monotonic()
    chunks = {(r.rname, r.bin): r.bases for r in reads.reference_chunks(sites, 65_536).collect()}
    assert all(len(c) == 65_536 for c in chunks.values()) and {1, 0} == {c.count("A") for k, c in chunks.items() if k[0] == 2} | {0}
    assert [p for (r, b), c in sorted(chunks.items()) if r == 1 for p, x in enumerate(c, b * 65_536) if x] == gaps
    seq = "".join(rng.choice("ACGTé") for _ in range(150_000))  # letters of two bytes as well
    table = spark.createDataFrame([(7, 1, 20_000, "150000M", seq, "+" * 140_000 + "é", 0), (8, 2, 69_999, "3M", "CCC", None, 0)], "id int, rname int, pos int, cigar string, seq string, qual string, flag int")
    known = set(gaps)
    bad = [i for i, x in enumerate(seq) if i + 20_000 in known and x != "ACGT"[i % 4]]
    worth = sum(10 if i < 140_000 else ord("é") - 33 if i == 140_000 else 20 for i in bad)
    for threshold, want in ((worth - 1, 4), (worth, 0)):
        assert {r.id: r.flag for r in reads.mismatch_filter(table, sites, threshold, width=64).collect()} == {7: want, 8: 0}
    assert {r.id: r.flag for r in reads.mismatch_filter(table, sites, 19).collect()} == {7: 4, 8: 4}
    assert time.monotonic() - began < 60  # a map's entries looked up one by one, or whole reads sent to each chunk, take far longer
    with pytest.raises(Exception, match="a position twice"):
        reads.reference_chunks(sites.union(sites.where("pos = 70000"))).collect()


def test_repeated_ids_name_the_first_line(spark):
    rows = [(4 * i + 1, f"@r{i % 7 if i < 14 else i} x", "ACGTACGTACGT", "+", "IIIIIIIIIIII") for i in range(30)]
    df = spark.createDataFrame(rows, "line long, id_line string, seq string, plus string, qual string")
    found = {r.line: (r.errors, r.duplicate_of) for r in reads.validate_fastq(df).collect()}
    assert all(found[4 * i + 1] == ((["duplicate id"], 4 * (i % 7) + 1) if i < 14 else ([], None)) for i in range(30))
    plan = reads.validate_fastq(df).select("line", "errors")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and reads.validate_fastq(df).where("false").count() == 0


def test_residuals_look_sums_up_at_distinct_times(spark):
    """Score residuals with null strata, shared times and late entry against plain Python; no window runs over the subjects."""
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "a", "b"]), a := rng.randint(0, 6), a + rng.randint(0, 6), rng.random() < 0.6, rng.choice([0.0, 1.0, 2.0])) for i in range(120)]
    df = spark.createDataFrame(rows, "iid int, stratum string, entry int, exit int, event boolean, x double")
    found = survival.influence(df, "x")
    weights = {r.iid: r.w for r in found.collect()}
    assert not [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in line]
    for iid, s, entry, exit_, event, x in rows:
        risk = lambda t: [r[5] for r in rows if r[1] == s and r[2] <= t <= r[3]]
        hit = [r[3] for r in rows if r[1] == s and r[4]]
        mean = lambda t: sum(risk(t)) / len(risk(t))
        want = (x - mean(exit_) if event else 0.0) - sum((x - mean(t)) / len(risk(t)) for t in hit if entry <= t <= exit_)
        assert weights[iid] == pytest.approx(want, abs=1e-9)
