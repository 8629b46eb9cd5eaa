"""Dosages as bytes, and VCF and bed files read straight into packed rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataloom.functions import scalar
from strataloom.operators import dosage, packed
from strataloom.sources import packed as files


def test_bytes_hold_dosages():
    r = np.random.default_rng(1)
    for n in (1, 3, 4, 5, 64):
        calls = np.where(r.random(n) < 0.2, np.nan, r.integers(0, 3, n)).astype(float)
        doses = np.where(r.random(n) < 0.2, np.nan, r.random(n) * 2).astype(np.float32).astype(float)
        three = np.full(n, 3.0)
        column = pa.array([dosage.encode(calls), None, dosage.encode(doses), dosage.encode(three)], pa.binary())
        assert np.array_equal(dosage.decode(column, n), np.stack([calls, np.full(n, np.nan), doses, three]), equal_nan=True)
        assert len(dosage.encode(calls)) == 1 + -(-n // 4)
        lists = pa.array([[None if np.isnan(x) else x for x in calls], None], pa.list_(pa.float64()))
        assert np.array_equal(dosage.decode(lists, n), np.stack([calls, np.full(n, np.nan)]), equal_nan=True)


def test_cells_are_read_as_the_long_reader_does(spark):
    rng = random.Random(2)
    kinds = ["0/0", "0|1", "1/1", "./.", "0|.", ".", "1", "0", "1/2", "10/2", "0/1/1", "2|2"]
    for field, at in (("GT", 0), ("GT", 1)):
        cells = [rng.choice(kinds) for _ in range(200)]
        whole = [(f"{c}:7" if rng.random() < 0.5 else c) if at == 0 else f"7:{c}" for c in cells]
        want = [r.g for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(scalar.gt_dosage(F.col("c")).alias("g")).collect()]
        got = files.parse_cells("\t".join(whole).encode(), field, at)
        assert [None if np.isnan(x) else int(x) for x in got] == want
    assert np.array_equal(files.parse_cells(b"0/1:0.5\t./.:.\t1\t0/0:1.25:3", "DS", 1), [0.5, np.nan, np.nan, 1.25], equal_nan=True)


@pytest.fixture
def design(spark):
    rows = [("s3", "f3", 1.0, 0.5, "a"), ("s1", "f1", 1.0, 1.5, "a"), ("absent", "f4", 1.0, 2.0, "b"), ("s2", "f2", 1.0, -1.0, "b")]
    return packed.design(spark.createDataFrame(rows, "iid string, fid string, wt double, y double, study string"))


def test_vcf_lines_in_the_designs_order(spark, tmp_path, design):
    path = tmp_path / "a.vcf"
    path.write_text("##fileformat\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\tother\ts2\ts3\n1\t9\tr\tA\tG\t.\tPASS\t.\tGT:DS\t0/1:0.9\t1/1:2\t./.:.\t1|1:1.7\n1\t3\tq\tA\tG\t.\tq10\t.\tDS\t1\t2\t0\t0.5\n1\t4\tz\tA\tG\t.\tPASS\t.\n")
    order = [str(i) for i in design.ids]
    for field, want in (("GT", {"r": (1, np.nan, 2), "q": (np.nan,) * 3, "z": (np.nan,) * 3}), ("DS", {"r": (0.9, np.nan, 1.7), "q": (1, 0, 0.5), "z": (np.nan,) * 3})):
        read = files.read_vcf(spark, str(path), design, field)
        assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
        rows = read.orderBy("ord").collect()
        assert [r.id for r in rows] == ["r", "q", "z"] and [r.filter for r in rows] == ["PASS", "q10", "PASS"]
        for r in rows:
            g = dict(zip(order, dosage.decode(pa.array([bytes(r.g)]), len(order))[0]))
            assert np.allclose([g["s1"], g["s2"], g["s3"]], want[r.id], equal_nan=True) and np.isnan(g["absent"])
    scan = packed.wald_scan(files.read_vcf(spark, str(path), design).withColumnRenamed("id", "variant"), design)
    assert "Exchange" not in scan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n_variants", [1, 3])
def test_bed_blocks_in_the_designs_order(spark, tmp_path, design, n_variants):
    # subjects s1, other, s2, s3, x: two bits each from the lowest on; 0 two copies, 1 missing, 2 one, 3 none
    codes = [[2, 0, 1, 0, 3], [3, 3, 2, 1, 0], [0, 0, 0, 0, 0]][:n_variants]
    body = b"".join(bytes(sum(c << 2 * k for k, c in enumerate(row[i : i + 4])) for i in range(0, 5, 4)) for row in codes)
    (tmp_path / "a.bed").write_bytes(b"\x6c\x1b\x01" + body)
    (tmp_path / "fam").write_text("".join(f"f {s} 0 0 1 -9\n" for s in ("s1", "other", "s2", "s3", "x")))
    (tmp_path / "bim").write_text("".join(f"1 v{k} 0 {10 * k} A G\n" for k in range(n_variants)))
    read = files.read_bed(spark, str(tmp_path / "a.bed"), str(tmp_path / "fam"), design)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    copies = {0: 2.0, 1: np.nan, 2: 1.0, 3: 0.0}
    for r in files.with_map(read, str(tmp_path / "bim")).collect():
        g = dict(zip(map(str, design.ids), dosage.decode(pa.array([bytes(r.g)]), 4)[0]))
        row = codes[r.variant]
        assert np.array_equal([g["s1"], g["s2"], g["s3"], g["absent"]], [copies[row[0]], copies[row[2]], copies[row[3]], np.nan], equal_nan=True)
        assert (r.id, r.pos) == (f"v{r.variant}", 10 * r.variant)
    (tmp_path / "a.bed").write_bytes(b"\x6c\x1b\x01" + body + b"\x00")
    with pytest.raises(ValueError):
        files.read_bed(spark, str(tmp_path / "a.bed"), str(tmp_path / "fam"), design)
