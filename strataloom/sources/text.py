"""Text sources and sinks: phenotypes, VCF, features, probabilities, groups, lists, FASTQ, SAM, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Where a row stands: file, block of the file, place in it. Rows compare in the order of files and lines; no pass is needed.
ORDER = "named_struct('file', _metadata.file_path, 'block', _metadata.file_block_start, 'at', monotonically_increasing_id())"


def read_phenotypes(spark: SparkSession, path: str, sep: str = "\t", na: tuple[str, ...] = ("NA",), comment: str = "#", ord: str | None = None) -> DataFrame:
    """All columns as strings, missing tokens as null; cast by role afterwards. `ord` names a column for the file order."""
    df = spark.read.csv(path, sep=sep, header=True, nullValue=na[0], comment=comment)
    order = [F.expr(ORDER).alias(ord)] if ord else []
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*na), F.col(f"`{c}`")).alias(c) for c in df.columns], *order)


def last_rows(df: DataFrame, key: str, ord: str = "ord") -> DataFrame:
    """Of the rows of each key the last one in file order, without that column."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (key, ord)]), ord).alias("_row"))
    return last.select(key, "_row.*")


def first_rows(df: DataFrame, by: list[str], ord: str = "ord") -> DataFrame:
    """Of the rows of each key (such as a position) the first one in file order, without that column."""
    first = df.groupBy(*by).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (*by, ord)]), ord).alias("_row"))
    return first.select(*by, "_row.*")


def _first_entries(entries: Column) -> Column:
    """A map of (k, v) entries, the first of each key."""
    keys = F.transform(entries, lambda x: x["k"])
    return F.map_from_entries(F.filter(entries, lambda x, i: F.array_position(keys, x["k"]) == i + 1))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of text files, numbered from 0 in the order of file names and places in them.

    Lines are counted per block of a file, so no task reads a file whole and no row passes through Python.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    ahead = W.partitionBy(F.lit(0)).orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)  # a row per block
    blocks = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    return lines.join(blocks, ["_file", "_block"]).select((F.col("_ahead") + F.col("_id") - F.col("_first")).alias("n"), "value")


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(variants, genotypes): one row per record; one per record and sample with its FORMAT fields as a map.

    `ord` holds a record's place in the files. Of an INFO key that is repeated the first value counts. The sample names
    are one row, joined to the records; `sources.packed` reads genotypes for scans without a row a cell.
    """
    lines = spark.read.text(path).withColumn("ord", F.expr(ORDER))
    cols = F.split("value", "\t")
    body = lines.where("value NOT LIKE '#%' AND length(value) > 0").select("ord", cols.alias("c"))  # a line is a record
    info = F.transform(F.split(F.col("c")[7], ";"), lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.get(F.split(x, "=", 2), 1).alias("v")))
    site = [F.col("c")[0].alias("chrom"), F.col("c")[1].cast("int").alias("pos"), F.col("c")[2].alias("id"), F.col("c")[3].alias("ref"), F.col("c")[4].alias("alt")]
    variants = body.select(*site, F.col("c")[5].alias("qual"), F.split(F.col("c")[6], ";").alias("filter"), _first_entries(info).alias("info"), "ord")
    head = lines.where("value LIKE '#CHROM%'").orderBy("ord").limit(1).select(F.slice(cols, F.lit(10), F.greatest(F.size(cols) - 9, F.lit(0))).alias("names"))
    cells = body.crossJoin(F.broadcast(head)).select("ord", *site, "names", F.split(F.get("c", F.lit(8)), ":").alias("format"), F.posexplode(F.slice("c", F.lit(10), F.greatest(F.size("c") - 9, F.lit(0)))).alias("at", "cell"))  # one header row
    values = F.split("cell", ":")
    fields = F.map_from_arrays(F.slice("format", 1, F.least(F.size("format"), F.size(values))), F.slice(values, 1, F.least(F.size("format"), F.size(values))))
    genotypes = cells.select("chrom", "pos", "ref", "alt", F.get("names", F.col("at")).alias("iid"), "at", fields.alias("fields"), "ord")
    gt = F.element_at("fields", "GT")
    return variants, genotypes.withColumns({"gt": gt, "phased": F.instr(gt, "/") == 0})


def read_feature_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, iid, g): a tab table of features by subjects in long form, NA as null."""
    lines = numbered_lines(spark, path)
    head = lines.where("n = 0").select(F.split("value", "\t").alias("names"))
    cells = lines.where("n > 0 AND length(value) > 0").select(F.split("value", "\t").alias("c"))
    rows = cells.crossJoin(F.broadcast(head)).select(F.col("c")[0].alias("feature_id"), "names", F.posexplode("c").alias("at", "g")).where("at > 0")  # one header row
    return rows.select("feature_id", F.get("names", F.col("at")).alias("iid"), F.when(F.col("g") != "NA", F.col("g")).cast("double").alias("g"))


def read_inclusion_probs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(study, iid_i, iid_j, pi) of square matrices with a header of ids, one path per study; checks 0 < pi <= 1."""
    parts = []
    for study, path in paths.items():
        lines = numbered_lines(spark, path)
        head = lines.where("n = 0").select(F.split("value", "\t").alias("names"))
        rows = lines.where("n > 0 AND length(value) > 0").select((F.col("n") - 1).cast("int").alias("i"), F.split("value", "\t").alias("c"))
        cells = rows.crossJoin(F.broadcast(head)).select("names", "i", F.posexplode("c").alias("j", "p"))  # one header row
        parts.append(cells.select(F.lit(study).alias("study"), F.get("names", F.col("i")).alias("iid_i"), F.get("names", F.col("j")).alias("iid_j"), F.col("p").cast("double").alias("pi")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    bad = out.where("iid_i IS NULL OR iid_j IS NULL OR pi IS NULL OR pi <= 0 OR pi > 1").limit(1).count()
    if bad:
        raise ValueError("a matrix is not square, or has a missing probability or one outside (0, 1]")
    return out


def _position(id: str) -> list[Column]:
    """chrom and pos of a chrom:pos."""
    found = F.col(id).rlike(r"^[^:]+:[0-9]+$")
    return [F.when(found, F.split(id, ":")[0]).otherwise(F.col(id)).alias("chrom"), F.when(found, F.try_element_at(F.split(id, ":"), F.lit(2)).try_cast("int")).alias("pos")]


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(gene, ord, chrom, pos) from lines of gene, tab, chrom:pos, chrom:pos ...

    An entry that is no chrom:pos has a null pos and keeps its text as chrom; a line without entries gives no row.
    """
    halves = F.split("value", "\t")
    rows = spark.read.text(path).where("length(value) > 0").select(halves[0].alias("gene"), F.posexplode(F.split(F.get(halves, F.lit(1)), ",")).alias("ord", "id"))
    return rows.select("gene", "ord", *_position("id"))


def read_variant_list(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos) from one chrom:pos per line; a line that is none has a null pos and keeps its text as chrom."""
    return spark.read.text(path).where("length(trim(value)) > 0").select(F.trim("value").alias("id")).select(*_position("id"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """One row per four-line record: line (1-based, of the id line), id_line, seq, plus, qual."""
    numbered = numbered_lines(spark, path)
    part = lambda k, name: F.max(F.when(F.col("n") % 4 == k, F.col("value"))).alias(name)
    records = numbered.groupBy(F.floor(F.col("n") / 4).alias("r")).agg(part(0, "id_line"), part(1, "seq"), part(2, "plus"), part(3, "qual"))
    return records.select((F.col("r") * 4 + 1).alias("line"), "id_line", "seq", "plus", "qual")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fixed fields, tags (map of TAG:TYPE to value, the first of each) and `ord`, the record's place in the files;
    header lines are left out."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).withColumn("ord", F.expr(ORDER)).where("value NOT LIKE '@%' AND length(value) > 0").select(c.alias("c"), "ord")
    names = {"qname": "string", "flag": "int", "rname": "string", "pos": "int", "mapq": "int", "cigar": "string", "rnext": "string", "pnext": "int", "tlen": "int", "seq": "string", "qual": "string"}
    tags = F.transform(F.slice("c", F.lit(12), F.greatest(F.size("c") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 4).alias("k"), F.regexp_replace(t, "^.{5}", "").alias("v")))
    return rows.select(*[F.col("c")[i].cast(kind).alias(n) for i, (n, kind) in enumerate(names.items())], _first_entries(tags).alias("tags"), "ord")


def write_results(df: DataFrame, path: str, gz: bool = False) -> None:
    """Tab-separated results with a header, NA for missing."""
    df.write.csv(path, sep="\t", header=True, nullValue="NA", compression="gzip" if gz else "none")


def write_vcf(variants: DataFrame, genotypes: DataFrame | None, path: str, samples: list[str] = (), fields: tuple[str, ...] = ("GT",)) -> None:
    """Records with the chosen FORMAT `fields` of the named samples, or sites only; the header lines are a part of their own.

    variants: chrom, pos, id, ref, alt, filter, and qual and info (a map) where there are. genotypes: chrom, pos, ref, alt,
    iid, and gt or a map `fields`. A sample that a record has no cell of gets missing values.
    """
    spark, key = variants.sparkSession, ["chrom", "pos", "ref", "alt"]
    entry = lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))
    info = F.array_join(F.transform(F.map_entries("info"), entry), ";") if "info" in variants.columns else F.lit(None)
    qual = F.col("qual").cast("string") if "qual" in variants.columns else F.lit(None)
    dot = lambda c: F.coalesce(F.when(c != "", c), F.lit("."))
    fixed = [F.col("chrom").cast("string"), F.col("pos").cast("string"), dot(F.col("id")), "ref", "alt", dot(qual.cast("string")), dot(F.array_join("filter", ";")), dot(info.cast("string"))]
    titles = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
    rows = variants
    if genotypes is not None:
        missing = ":".join("./." if f == "GT" else "." for f in fields)
        value = lambda f: F.col("gt") if f == "GT" and "gt" in genotypes.columns else F.element_at("fields", f)
        cell = F.concat_ws(":", *[F.coalesce(value(f), F.lit("./." if f == "GT" else ".")) for f in fields])
        places = spark.createDataFrame([(str(s), i) for i, s in enumerate(samples)], "_iid string, _at int")
        cells = genotypes.join(F.broadcast(places), F.col("iid").cast("string") == F.col("_iid"))  # as long as the header line
        held = cells.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_at", cell.alias("cell")))).alias("_held"))
        n = len(samples)
        by_place = F.map_from_entries("_held")
        full = F.when(F.size("_held") == n, F.transform("_held", lambda x: x["cell"])).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(by_place, i), F.lit(missing))))
        rows = variants.join(held, key, "left")
        fixed += [F.lit(":".join(fields)), F.array_join(F.coalesce(full, F.array_repeat(F.lit(missing), n)), "\t")]
        titles += ["FORMAT", *map(str, samples)]
    head = spark.createDataFrame([(0, "##fileformat=VCFv4.2"), (1, "\t".join(titles))], "o long, value string").coalesce(1)
    body = rows.orderBy("chrom", "pos").select(F.concat_ws("\t", *fixed).alias("value"))
    head.orderBy("o").select("value").unionByName(body).write.text(path)


def write_mass(scores: DataFrame, cov: DataFrame, n_total: int, path: str) -> None:
    """Gene summaries: a line "#Samples = n", then one line per gene and variant.

    scores: gene, variant, id, af, ac, n, n_ref, n_het, n_alt, u; cov: gene, i, j, v with j <= i in variant order. A
    line ends with its row of the lower triangle, zeros after it.
    """
    row = cov.groupBy("gene", F.col("i").alias("variant")).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda x: x["v"].cast("string")).alias("row"))
    size = scores.groupBy("gene").agg(F.count("*").cast("int").alias("size"))
    cells = F.concat("row", F.array_repeat(F.lit("0"), F.greatest(F.col("size") - F.size("row"), F.lit(0))))
    fields = [F.col(c).cast("string") for c in ("gene", "id", "af", "ac", "n", "n_ref", "n_het", "n_alt", "u")]
    body = scores.join(row, ["gene", "variant"]).join(size, "gene").orderBy("gene", "variant").select(F.concat_ws("\t", *fields, cells).alias("value"))
    head = scores.sparkSession.createDataFrame([(f"#Samples = {n_total}",)], "value string").coalesce(1)
    head.unionByName(body).write.text(path)
