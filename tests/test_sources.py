"""Text sources and sinks on small files."""

import pytest
from pyspark.sql import functions as F

from strataloom.sources import text


def put(path, content):
    path.write_text(content)
    return str(path)


def test_phenotypes_and_features(spark, tmp_path):
    rows = text.read_phenotypes(spark, put(tmp_path / "p", "IID\ty\na\t1\nb\tNA\nc\t-9\n"), na=("NA", "-9")).collect()
    assert [(r.IID, r.y) for r in rows] == [("a", "1"), ("b", None), ("c", None)]
    long = text.read_feature_matrix(spark, put(tmp_path / "f", "id\ta\tb\nx\t0.5\tNA\n"))
    assert sorted((r.feature_id, r.iid, r.g) for r in long.collect()) == [("x", "a", 0.5), ("x", "b", None)]


def test_vcf_round_trip(spark, tmp_path):
    vcf = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t10\trs1\tA\tG\t9\tPASS\tAC=1;DB\tGT:DS\t0|1:1\t./.\n"
    variants, genotypes = text.read_vcf(spark, put(tmp_path / "v", vcf))
    v = variants.first()
    assert (v.chrom, v.pos, v.filter, v.info) == ("1", 10, ["PASS"], {"AC": "1", "DB": None})
    assert sorted((r.iid, r.gt, r.phased) for r in genotypes.collect()) == [("s1", "0|1", True), ("s2", "./.", False)]
    text.write_vcf(variants, genotypes, str(tmp_path / "out"), ["s2", "s1"])
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert "1\t10\trs1\tA\tG\t9\tPASS\tAC=1;DB\tGT\t./.\t0|1" in lines
    text.write_vcf(variants.drop("qual", "info"), genotypes, str(tmp_path / "two"), ["s1", "s3", "s2"], ("GT", "DS"))
    assert "1\t10\trs1\tA\tG\t.\tPASS\t.\tGT:DS\t0|1:1\t./.:.\t./.:." in [r.value for r in spark.read.text(str(tmp_path / "two")).collect()]


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    for k in range(3):
        put(tmp_path / f"f{k}", "".join(f"{k}-{i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = text.numbered_lines(spark, str(tmp_path)).orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.n, r.value) for r in found] == [(500 * k + i, f"{k}-{i}") for k in range(3) for i in range(500)]


def test_probabilities_groups_lists(spark, tmp_path):
    good = text.read_inclusion_probs(spark, {"s": put(tmp_path / "q", "a\tb\n0.5\t0.2\n0.2\t1\n")})
    assert sorted((r.iid_i, r.iid_j, r.pi) for r in good.collect()) == [("a", "a", 0.5), ("a", "b", 0.2), ("b", "a", 0.2), ("b", "b", 1.0)]
    with pytest.raises(ValueError):
        text.read_inclusion_probs(spark, {"s": put(tmp_path / "r", "a\tb\n0.5\t0\n0.2\t1\n")})
    groups = text.read_groups(spark, put(tmp_path / "g", "G1\t1:5,2:7\n"))
    assert [(r.gene, r.ord, r.chrom, r.pos) for r in groups.orderBy("ord").collect()] == [("G1", 0, "1", 5), ("G1", 1, "2", 7)]
    assert text.read_variant_list(spark, put(tmp_path / "l", "1:5\n\n")).first().pos == 5


def test_reads_and_results(spark, tmp_path):
    fastq = text.read_fastq(spark, put(tmp_path / "fq", "@a\nAC\n+\nII\n@b\nGT\n+\nJJ\n")).orderBy("line").collect()
    assert [(r.line, r.id_line, r.seq, r.qual) for r in fastq] == [(1, "@a", "AC", "II"), (5, "@b", "GT", "JJ")]
    sam = text.read_sam(spark, put(tmp_path / "s", "@HD\tVN:1.0\nq\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\tNM:i:2\n")).first()
    assert sam.flag == 4 and sam.seq == "AC" and sam.tags == {"NM:i": "2"}
    text.write_results(spark.range(1).coalesce(1).select("id", F.lit(None).cast("double").alias("p")), str(tmp_path / "res"))
    assert [r.value for r in spark.read.text(str(tmp_path / "res")).collect()] == ["id\tp", "0\tNA"]
