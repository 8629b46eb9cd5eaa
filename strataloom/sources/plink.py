"""PLINK bed/bim/fam triples as long genotypes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.staging import shuffled
from strataloom.sources.text import numbered_lines

# fixed values: the three leading bytes of a SNP-major file; copies of the first allele by two-bit code, -1 missing
HEADER, COPIES = b"\x6c\x1b\x01", np.array([2, -1, 1, 0], np.int8)
CELLS = 1 << 20
#: Cells that are handed on at a time, and what a variant's cells have of it.
ROWS, SITE = 1 << 17, ["chrom", "id", "pos", "a1", "a2"]


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def _numbered(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The lines of a text file, numbered from 0, split at blanks."""
    cells = F.split(F.trim("value"), r"\s+")
    return numbered_lines(spark, path).where("length(trim(value)) > 0").select(F.col("n").cast("int").alias("at"), *[cells[i].alias(n) for i, n in enumerate(names)])


def read_plink(spark: SparkSession, bed: str, bim: str, fam: str) -> DataFrame:
    """(chrom, id, pos, a1, a2, fid, iid, g): g counts allele a1, null where missing.

    Each task reads the byte ranges of blocks of variants, about a million cells a block, so a bed file may have any size.
    Only SNP-major files are read; another header or a length that does not fit raises. Trailing bits of a variant's last
    byte are ignored.
    """
    variants = _numbered(spark, bim, ["chrom", "id", "cm", "pos", "a1", "a2"]).withColumn("pos", F.col("pos").cast("int")).drop("cm")
    people = _numbered(spark, fam, ["fid", "iid"])
    n, m = people.count(), variants.count()
    width, step = (n + 3) // 4, max(CELLS // max(n, 1), 1)
    blocks = -(-m // step)
    uri = _uri(bed)

    # a block's row has its variants: cells are not joined with them, which would shuffle all cells or, as Spark takes them to be as
    # few as the blocks, gather them on the driver
    held = variants.groupBy(F.floor(F.col("at") / step).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", *SITE))).alias("sites"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = fs.FileSystem.from_uri(uri)
        with store.open_input_file(name) as file:
            if file.read(3) != HEADER or file.size() != 3 + m * width:
                raise ValueError("not a SNP-major bed file of these variants and subjects")
            for batch in batches:
                for block, sites in zip(batch.column(0).to_pylist(), batch.column(1)):
                    sites = pa.RecordBatch.from_struct_array(sites.values)
                    start, stop = block * step, min((block + 1) * step, m)
                    at = sites.column(0).to_numpy(zero_copy_only=False) - start
                    sites = sites.select(SITE).filter(pa.array(at < stop - start))
                    file.seek(3 + start * width)
                    codes = np.frombuffer(file.read((stop - start) * width), np.uint8).reshape(stop - start, width)[at[at < stop - start]]
                    bits = ((codes[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(len(codes), 4 * width)[:, :n]
                    g = COPIES[bits].ravel()
                    for low in range(0, len(g), ROWS):
                        cell = np.arange(low, min(low + ROWS, len(g)))
                        known = g[cell].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([*sites.take(pa.array(cell // n)).columns, pa.array((cell % n).astype(np.int32)), pa.array(known, mask=known < 0)], names=[*SITE, "s", "g"])

    cells = held.repartition(max(blocks, 1), "block").mapInArrow(unpack, "chrom string, id string, pos int, a1 string, a2 string, s int, g long")
    out = cells.join(shuffled(people.withColumnRenamed("at", "s")), "s")
    return out.select("chrom", "id", "pos", "a1", "a2", "fid", "iid", "g")


def write_bed(rows: DataFrame, bed: str) -> None:
    """Write two-bit codes (codes array<int>, a row per variant in file order) as one SNP-major file.

    One task writes the file, variant after variant, so it holds one variant at a time.
    """
    uri = _uri(bed)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, name = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(name), recursive=True)
        part, n = f"{name}.{uuid.uuid4().hex}", 0  # renamed when whole, so that a retried task leaves one file
        with store.open_output_stream(part) as out:
            out.write(HEADER)
            for batch in batches:
                for codes in batch["codes"]:
                    codes = np.asarray(codes, np.uint8)
                    codes = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).reshape(-1, 4)
                    out.write((codes << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes())
                    n += 1
        store.move(part, name)
        yield pd.DataFrame({"n": [n]})

    rows.coalesce(1).mapInPandas(put, "n long").collect()  # the number of variants
