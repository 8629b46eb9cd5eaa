"""Sequencing reads: statistics, composition, quality, pile-up, trimming, order and FASTQ checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.operators.running import previous


def read_stats(reads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Flag counts per group; rates in percent."""
    def bit(b):
        return F.col("flag").bitwiseAND(F.lit(b)) != 0

    def n(c):
        return F.count(F.when(c, 1))

    mapped = ~bit(4)
    return reads.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), n(mapped).alias("mapped"), n(bit(1)).alias("paired"), n(bit(1) & bit(2)).alias("proper"), n(bit(1024)).alias("duplicates"), n(bit(512)).alias("qc_fail"),
        F.sum("len").cast("long").alias("total_bases"), F.coalesce(F.sum(F.when(mapped, F.col("len"))), F.lit(0)).cast("long").alias("mapped_bases"), (100.0 * n(mapped) / F.count("*")).alias("mapping_rate"),
    )


def base_composition(reads: DataFrame) -> DataFrame:
    """Percent of A, C, G, T, N per read position (0-based)."""
    at = reads.where(F.length("seq") > 0).select(F.posexplode(F.split("seq", "")).alias("cycle", "base")).where("base <> ''")
    pct = [(100.0 * F.count(F.when(F.col("base") == b, 1)) / F.count("*")).alias(f"pct_{b.lower()}") for b in "ACGTN"]
    return at.groupBy("cycle").agg(F.count("*").alias("n"), *pct)


def quality_by_cycle(reads: DataFrame, overall: bool = False) -> DataFrame:
    """Average Phred quality per read position (0-based); `overall` adds the average of all bases, cycle null."""
    at = reads.select(F.posexplode(F.split("qual", "")).alias("cycle", "q")).where("q <> ''")
    grouped = at.rollup("cycle") if overall else at.groupBy("cycle")
    return grouped.agg(F.avg(F.ascii("q") - 33).alias("quality"), F.count("*").alias("n"))


def depth(reads: DataFrame, width: int = 4096) -> DataFrame:
    """Covering reads per position, from +1/-1 events in bins of `width` positions, each a window of its own.

    A read that reaches into a later bin opens there anew at the bin's start, so no carried offset is needed.
    """
    bins = F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor(F.col("align_end") / width))).alias("bin")
    parts = reads.select("rname", bins, F.col("pos"), F.col("align_end"))
    parts = parts.select("rname", "bin", F.greatest("pos", F.col("bin") * width).alias("a"), F.least("align_end", F.col("bin") * width + width - 1).alias("b"))
    events = parts.select("rname", "bin", F.explode(F.array(F.struct(F.col("a").alias("pos"), F.lit(1).alias("n")), F.struct((F.col("b") + 1).alias("pos"), F.lit(-1).alias("n")))).alias("e"))
    steps = events.groupBy("rname", "bin", F.col("e.pos").alias("pos")).agg(F.sum("e.n").alias("n"))
    w = W.partitionBy("rname", "bin").orderBy("pos")
    runs = steps.select("rname", "pos", F.sum("n").over(w).alias("depth"), F.lead("pos").over(w).alias("stop")).where("depth > 0")
    return runs.select("rname", F.explode(F.sequence(F.col("pos"), F.col("stop") - 1)).alias("pos"), "depth")


def _walked(reads: DataFrame) -> DataFrame:
    """`reads` with _walk: for each piece of the cigar its first reference position r, place q in the read, length and kind."""
    ops = F.regexp_extract_all("cigar", F.lit(r"([0-9]+[MIDNSHP=X])"), 1)
    rows = reads.withColumn("_ops", F.transform(ops, lambda o: F.struct(F.expr("0").alias("z"), F.regexp_extract(o, r"^[0-9]+", 0).cast("int").alias("n"), F.substring(o, -1, 1).alias("op"))))
    start = F.struct(F.col("pos").cast("long").alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<r:bigint,q:int,n:int,op:string>>").alias("out"))

    def step(s, o):
        ref, own = o["op"].isin("M", "=", "X", "D", "N"), o["op"].isin("M", "=", "X", "I", "S")
        piece = F.struct(s["r"].alias("r"), s["q"].alias("q"), o["n"].alias("n"), o["op"].alias("op"))
        return F.struct((s["r"] + F.when(ref, o["n"]).otherwise(0)).alias("r"), (s["q"] + F.when(own, o["n"]).otherwise(0)).alias("q"), F.concat(s["out"], F.array(piece)).alias("out"))

    return rows.withColumn("_walk", F.aggregate("_ops", start, step)["out"])


def cigar_positions(reads: DataFrame) -> DataFrame:
    """(…, refpos, base, qual): one row per aligned base; deletions give base '-'. Columns pos, cigar, seq, qual."""
    walked = _walked(reads).withColumn("_p", F.explode("_walk")).where(F.col("_p.op").isin("M", "=", "X", "D"))
    # a piece's letters are cut out once; the whole sequence doesn't travel with each base
    gap, kept = F.col("_p.op") == "D", [c for c in reads.columns if c not in ("seq", "qual", "cigar")]
    cut = lambda c: F.slice(F.split(F.expr(f"substring({c}, _p.q + 1, _p.n)"), ""), F.lit(1), F.col("_p.n"))
    letters = F.when(gap, F.array_repeat(F.lit("-"), F.col("_p.n"))).otherwise(cut("seq"))
    pieces = walked.select(*kept, F.col("_p.r").alias("_r"), F.col("_p.q").alias("_q"), F.arrays_zip(letters.alias("base"), F.when(~gap, cut("qual")).otherwise(F.array_repeat(F.lit(None).cast("string"), F.col("_p.n"))).alias("qual")).alias("_z"))
    at = pieces.select(*kept, "_r", "_q", F.posexplode("_z").alias("_k", "_at"))
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    out = at.select(*kept, (F.col("_r") + F.col("_k")).alias("refpos"), empty("_at.base").alias("base"), empty("_at.qual").alias("qual"), (F.col("_q") + F.col("_k") + 1).alias("read_index"))
    return out.where("base IS NOT NULL")


def pileup(reads: DataFrame, del_as_base: bool = False, region: tuple | None = None) -> DataFrame:
    """(rname, refpos, depth, bases, quals): what covers each position, sorted by base and quality.

    `region` (rname, start, end) is end-exclusive; only reads that reach it are walked. Equal pairs of base and quality
    are counted first, so a deep position is a few rows; a deletion's quality is a space.
    """
    if region is not None:
        name, start, end = region
        reads = reads.where((F.col("rname") == name) & (F.col("pos") < end))
    at = cigar_positions(reads)
    at = at if del_as_base else at.where("base <> '-'")
    if region is not None:
        at = at.where((F.col("refpos") >= start) & (F.col("refpos") < end))
    pairs = at.groupBy("rname", "refpos", "base", F.coalesce("qual", F.lit(" ")).alias("qual")).agg(F.count("*").cast("int").alias("n"))
    held = pairs.groupBy("rname", "refpos").agg(F.sum("n").cast("long").alias("depth"), F.array_sort(F.collect_list(F.struct("base", "qual", "n"))).alias("held"))
    text = lambda c: F.array_join(F.transform("held", lambda x: F.repeat(x[c], x["n"])), "")
    return held.select("rname", "refpos", "depth", text("base").alias("bases"), text("qual").alias("quals"))


def reference_chunks(ref: DataFrame, width: int = 4096) -> DataFrame:
    """(rname, bin, bases): the reference (rname, pos, base) in arrays of `width` positions, null where there is none.

    A chunk's bases are sorted and put behind one another, with nulls for what lies between two of them.
    """
    at = F.pmod("pos", F.lit(width)).cast("int").alias("at")
    held = ref.groupBy("rname", F.floor(F.col("pos") / width).alias("bin")).agg(F.sort_array(F.collect_list(F.struct(at, "base"))).alias("_m"))
    none = F.lit(None).cast(ref.schema["base"].dataType)

    def after_gap(x, i):
        gap = x["at"] - F.when(i > 0, F.get("_m", i - 1)["at"]).otherwise(-1) - 1
        return F.when(gap < 0, F.raise_error(F.lit("the reference has a position twice"))).otherwise(F.concat(F.array_repeat(none, gap), F.array(x["base"])))

    tail = F.array_repeat(none, width - 1 - F.element_at("_m", -1)["at"])
    return held.select("rname", "bin", F.concat(F.flatten(F.transform("_m", after_gap)), tail).alias("bases"))


#: Letters of a chunk's text where the reference has no base, and where it has none of one letter, which all bases differ from.
NO_BASE, OTHER = "\x00", "\x01"
#: Parts of reads that are compared at a time.
PARTS = 256


def _letters(column: pa.Array) -> np.ndarray:
    """The code points of all strings of a column, one after another."""
    column = column.cast(pa.string())
    ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data if not len(data) or data.max() < 128 else np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), "<u4")


def mismatch_filter(reads: DataFrame, ref: DataFrame, threshold: int, default_q: int = 20, width: int = 4096) -> DataFrame:
    """`reads` (with id) marked unmapped where the qualities of mismatching bases sum to over the threshold.

    `ref`: rows (rname, pos, base), or the chunks of them. A read is cut at the chunks' bounds, so that each chunk meets only
    the letters that lie on it; letters, qualities and the reference's stretch are compared as arrays. No base is a row.
    """
    chunks = ref if "bases" in ref.columns else reference_chunks(ref, width)
    letter = lambda b: F.when(b.isNull(), NO_BASE).when(F.length(b) == 1, b).otherwise(OTHER)
    chunks = chunks.select("rname", "bin", F.array_join(F.transform("bases", letter), "").alias("_line"))
    walked = _walked(reads.select("id", "rname", "pos", "cigar", "seq", "qual"))

    def cut(p):
        bins = F.sequence(F.floor(p["r"] / width), F.floor((p["r"] + p["n"] - 1) / width))
        low, high = lambda b: F.greatest(p["r"], b * width), lambda b: F.least(p["r"] + p["n"], (b + 1) * width)
        return F.transform(bins, lambda b: F.struct(b.alias("bin"), (low(b) - b * width + 1).cast("int").alias("at"), (low(b) - p["r"] + p["q"] + 1).cast("int").alias("first"), (high(b) - low(b)).cast("int").alias("n")))

    on = F.filter("_walk", lambda p: p["op"].isin("M", "=", "X") & (p["n"] > 0))
    parts = walked.select("id", "rname", "seq", "qual", F.explode(F.flatten(F.transform(on, cut))).alias("_p"))
    letters = lambda c: F.expr(f"substring(coalesce({c}, ''), _p.first, _p.n)")
    met = parts.select("id", "rname", "_p.bin", "_p.at", letters("seq").alias("_s"), letters("qual").alias("_q")).join(chunks, ["rname", "bin"])
    met = met.select("id", "_s", F.rpad("_q", F.length("_s"), NO_BASE).alias("_q"), F.expr("substring(_line, at, length(_s))").alias("_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PARTS) for whole in batches for at in range(0, whole.num_rows, PARTS)):
            own, quality, other = (_letters(batch.column(i)) for i in (1, 2, 3))
            worth = np.where(quality == 0, default_q, quality.astype(np.int64) - 33)
            run = np.concatenate([[0], np.cumsum(np.where((other != ord(NO_BASE)) & (own != other), worth, 0))])
            ends = np.cumsum(np.concatenate([[0], pc.utf8_length(batch.column(1)).to_numpy()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(run[ends]), pa.int64())], names=["id", "n"])

    sums = met.mapInArrow(compare, f"id {reads.schema['id'].dataType.simpleString()}, n long").groupBy("id").agg(F.sum("n").alias("bad"))
    marked = reads.join(sums, "id", "left")
    return marked.withColumn("flag", F.when(F.col("bad") > threshold, F.col("flag").bitwiseOR(F.lit(4))).otherwise(F.col("flag"))).drop("bad")


def trim_index(quals: Column, mean: int, from_left: bool = True, window: int = 4) -> Column:
    """How many values remain cut at one end: the first place whose window sums to over window * mean, less values
    of at least the mean before it; arrays shorter than the window are not trimmed."""
    values = quals if from_left else F.reverse(quals)
    size = F.size(values)
    starts = F.sequence(F.lit(0), size - window)
    good = F.filter(starts, lambda i: F.aggregate(F.slice(values, i + 1, window), F.lit(0), lambda a, b: a + b) > window * mean)
    first = F.coalesce(F.get(good, 0), size)
    back = F.aggregate(F.reverse(F.slice(values, 1, F.greatest(first, F.lit(0)))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, v: F.struct((s["n"] + F.when(s["go"] & (v >= mean), 1).otherwise(0)).alias("n"), (s["go"] & (v >= mean)).alias("go")), lambda s: s["n"])
    return F.when(size < window, F.lit(0)).otherwise(first - back)


def out_of_order(rows: DataFrame, by: list[str], file_order: list[str]) -> DataFrame:
    """Records whose position lies before the one that precedes them in file order."""
    return previous(rows, by, file_order, "pos", "before").where("pos < before")


def coordinate_sorted(reads: DataFrame) -> DataFrame:
    return reads.orderBy("rname", "pos")


def validate_fastq(reads: DataFrame, min_length: int = 10) -> DataFrame:
    """`reads` (line, id_line, seq, plus, qual) with errors array<string>, and duplicate_of: the line that first has the id.

    What a read tells by itself is checked where it lies. For repeated ids only 64-bit hashes are shuffled, then the ids of
    hits, then lines with ids and errors: sequences and qualities move only if the result keeps them.
    """
    name = F.split(F.expr("substring(id_line, 2)"), r"\s")[0]
    found = lambda checks: F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in checks.items()]))
    first = found({"id line does not start with @": ~F.col("id_line").startswith("@"), "empty id": F.length(name) == 0})
    rest = found({
        "invalid base": ~F.col("seq").rlike(r"^[ACGTNacgtn.]*$"),
        "read too short": F.length("seq") < min_length,
        "plus line differs": ~F.col("plus").startswith("+") | ((F.length("plus") > 1) & (F.expr("substring(plus, 2)") != F.expr("substring(id_line, 2)"))),
        "invalid quality": F.col("qual").rlike(r"[\x00-\x20]"),
        "lengths differ": F.length("seq") != F.length("qual"),
    })
    rows = reads.withColumns({"_name": name, "_hash": F.xxhash64(name), "_first": first, "_rest": rest})
    hits = rows.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash")
    twice = rows.select("_hash", "_name", "line").join(hits, "_hash", "left_semi").groupBy("_name").agg(F.count("*").alias("_n"), F.min("line").alias("duplicate_of")).where("_n > 1").drop("_n")
    both = rows.join(twice, "_name", "left")
    again = F.when(F.col("duplicate_of").isNotNull(), F.array(F.lit("duplicate id"))).otherwise(F.array().cast("array<string>"))
    return both.select(*reads.columns, F.concat("_first", again, "_rest").alias("errors"), "duplicate_of")


def interleaved_errors(reads: DataFrame) -> DataFrame:
    """(pair, first, second): neighbouring records of an interleaved file (line = 1, 5, 9, ...) whose ids differ in more
    than a final /1 and /2; second is null where the last record stands alone."""
    name = F.split(F.expr("substring(id_line, 2)"), r"\s")[0]
    index = F.floor((F.col("line") - 1) / 4)
    side = lambda k, c: F.max(F.when(F.col("k") == k, F.col("name"))).alias(c)
    pairs = reads.select(F.floor(index / 2).alias("pair"), (index % 2).alias("k"), name.alias("name")).groupBy("pair").agg(side(0, "first"), side(1, "second"))
    stem = lambda c, end: F.regexp_replace(c, f"/{end}$", "")
    return pairs.where(F.col("second").isNull() | (stem("first", 1) != stem("second", 2)))
