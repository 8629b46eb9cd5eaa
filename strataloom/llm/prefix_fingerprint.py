"""Document fingerprints from prefix polynomial hashes.

For two prime moduli below 2**31, H[i] = sum of (c_j + 1) * B**j over the first i code points. Any span's hash is
(H[j] - H[i]) * B**(top - i): spans compare in constant time, and the longest common extension of two positions is
a binary search. A fingerprint holds the length, the whole text's hash and a bottom sketch: the `keep` least mixed
hashes of the 16-character spans that start at every position. Two fingerprints' likeness is the share of the least
`keep` of both sketches' union that both have, an estimate of the span sets' Jaccard similarity.

Contract. Null text counts as empty; the likeness of two empty texts is 1. Equal texts have equal fingerprints. The
next document follows by ascending doc_id, null ids last, ties by text; after the last comes the first. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import splitmix, table

PRIMES = (np.uint64(2**31 - 1), np.uint64(2**31 - 19))
BASES = (np.uint64(911_382_323), np.uint64(972_663_749))
SPAN, KEEP = 16, 48
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(which: int, n: int) -> np.ndarray:
    """B**0 ... B**(n-1) modulo the prime, grown by doubling."""
    have = _POWERS[which]
    while len(have) < n:
        step = have[-1] * BASES[which] % PRIMES[which]
        have = np.concatenate([have, have * step % PRIMES[which]])
    _POWERS[which] = have
    return have[:n]


class Prefixes:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for k in (0, 1):
            # terms stay below 2**31, so a plain running sum of 2**32 of them fits in 64 bits
            terms = codes * powers(k, self.n) % PRIMES[k]
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64) % PRIMES[k]]))

    def spans(self, starts: np.ndarray, width: int, top: int) -> np.ndarray:
        """One 62-bit hash for each span; comparable between texts that use the same `top` (at least their lengths)."""
        halves = []
        for k in (0, 1):
            span = (self.sums[k][starts + width] + PRIMES[k] - self.sums[k][starts]) % PRIMES[k]
            halves.append(span * powers(k, top + 1)[top - starts] % PRIMES[k])
        return (halves[0] << np.uint64(31)) | halves[1]

    def whole(self) -> int:
        return (int(self.sums[0][-1]) << 31) | int(self.sums[1][-1])


def longest_common_extension(a: Prefixes, b: Prefixes, i: int = 0, j: int = 0) -> int:
    """Number of equal code points from position i of a and j of b on, by binary search on span hashes."""
    top, low, high = max(a.n, b.n), 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        equal = a.spans(np.array([i]), middle, top)[0] == b.spans(np.array([j]), middle, top)[0]
        low, high = (middle, high) if equal else (low, middle - 1)
    return low


TOP = 1 << 18


def sketch(p: Prefixes, keep: int = KEEP) -> np.ndarray:
    """The least mixed 32-bit hashes of the text's 16-character spans (a shorter text: of the whole)."""
    if not p.n:
        return np.zeros(0, np.uint32)
    width = min(SPAN, p.n)
    top = max(TOP, p.n)
    if top > TOP:  # very long text: normalise in blocks against the common top by the inverse exponent
        return _long_sketch(p, width, keep)
    mixed = (splitmix(p.spans(np.arange(p.n - width + 1), width, TOP)) >> np.uint64(32)).astype(np.uint32)
    if len(mixed) > 4 * keep:
        least = np.unique(np.partition(mixed, 2 * keep)[: 2 * keep])
        if len(least) >= keep:
            return least[:keep]
    return np.unique(mixed)[:keep]


def _long_sketch(p: Prefixes, width: int, keep: int) -> np.ndarray:
    """As sketch(), with exponents top - start taken modulo the group order, for texts longer than TOP."""
    parts = []
    for low in range(0, p.n - width + 1, TOP):
        starts = np.arange(low, min(low + TOP, p.n - width + 1))
        halves = []
        for k in (0, 1):
            span = (p.sums[k][starts + width] + PRIMES[k] - p.sums[k][starts]) % PRIMES[k]
            shift = np.uint64(pow(int(BASES[k]), -low, int(PRIMES[k])))
            halves.append(span * powers(k, TOP + 1)[TOP - (starts - low)] % PRIMES[k] * shift % PRIMES[k])
        mixed = splitmix((halves[0] << np.uint64(31)) | halves[1]) >> np.uint64(32)
        parts.append(np.unique(mixed.astype(np.uint32))[:keep])
    return np.unique(np.concatenate(parts))[:keep]


def fingerprint(p: Prefixes, least: np.ndarray) -> str:
    return f"{p.n:x}.{p.whole():016x}." + np.sort(least).astype(">u4").tobytes().hex()


def likeness(a: str, b: str, keep: int = KEEP) -> float:
    """Estimated Jaccard similarity of two fingerprints' span sets; 1 for equal texts."""
    if a == b:
        return 1.0
    x, y = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (a.rpartition(".")[2], b.rpartition(".")[2]))
    least = sorted(x | y)[:keep]
    return sum(h in x and h in y for h in least) / len(least) if least else 0.0


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, head, doc_id, text): documents in at most `parts` ranges of doc_id, each range a partition of its own in
    order; a range also gets, with head set, the rows of the next range's first id, so that each task finds its last
    document's follower. The bounds are one number a partition, looked up by binary search; texts move once."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(2**63 - 1))
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)
    held = docs.sparkSession.sparkContext.broadcast(cuts)  # fewer than `parts` numbers

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, keys.to_numpy(), side="right").astype(np.int32))

    # a range starts at its bound or behind it; of an empty one the follower is the next one's, so first ids are taken from the ids
    firsts = sorted(docs.select(key.alias("key")).groupBy(part_of("key").alias("part")).agg(F.min("key").alias("key")).collect())  # at most `parts` rows
    ids, before = np.array([f.key for f in firsts], np.int64), np.array([firsts[i - 1].part for i in range(len(firsts))], np.int32)
    order = np.argsort(ids)
    starts = docs.sparkSession.sparkContext.broadcast((ids[order], before[order]))

    @F.pandas_udf("int")
    def heads(keys: pd.Series) -> pd.Series:  # the part that a range's first rows are also sent to
        ids, before = starts.value
        if not len(ids):
            return pd.Series([None] * len(keys), dtype="Int32")
        at = np.minimum(np.searchsorted(ids, keys.to_numpy()), len(ids) - 1)
        return pd.Series(np.where(ids[at] == keys.to_numpy(), before[at], -1).astype(np.int32))

    ranged = docs.withColumn("key", key).select("doc_id", "text", "key", part_of("key").alias("own"), heads("key").alias("also"))
    to = F.filter(F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("head")), F.struct(F.col("also").alias("part"), F.lit(True).alias("head"))), lambda x: x["part"] >= 0)
    sent = ranged.select(F.explode(to).alias("to"), "key", "doc_id", "text").select("to.part", "to.head", "key", "doc_id", "text")
    return sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "head", "key", "text").select("part", "head", "doc_id", "text")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document with its own and its edited text's fingerprint and their likenesses."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def digest(row: tuple, after: tuple) -> tuple:
        doc_id, text, prefixes, own = row
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        changed = Prefixes(edited)
        other = fingerprint(changed, sketch(changed))
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), sha, own, other, likeness(own, other), likeness(own, after[3]), longest_common_extension(prefixes, after[2])

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_start"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, closed = None, None  # the row that awaits its follower; the part whose follower has been met
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, out = whole.slice(at, 500), []
                for part, head, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "head", "doc_id", "text"))):
                    if head and closed == part:
                        continue
                    prefixes = Prefixes(text)
                    row = (doc_id, text, prefixes, fingerprint(prefixes, sketch(prefixes)))
                    if pending is not None:
                        out.append(digest(pending, row))
                    pending, closed = (None, part) if head else (row, closed)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names=names)

    return with_next(docs, parts).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start long")


def op6_prefix_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
