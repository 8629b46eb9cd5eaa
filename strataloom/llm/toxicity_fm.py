"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j) over the distinct lower-cased letter runs and
five-letter word starts of a text. Every term of at least MIN_DOCS training rows has an x_i > 0: 1/2 where its counts
differ between the labels by MIN_Z standard deviations, or those of a pair that it is in do so by far (`paired_terms`);
else its inverse document frequency, scaled so that the squares of a mean row's other terms sum to REST (and none is over
1/2), since chance terms would be learnt by heart at full weight. The factors let a pair such as insult and group mention weigh more than both alone, also where neither tells
anything by itself. Each epoch, every partition of the training rows runs Adagrad from the common parameters and the results are
averaged, weighted by rows. `fit` uses a bounded sample of about `sample_rows` labelled rows, chosen by key hash.

Contract. Null or termless texts score sigmoid(w0). Labels, language, source and ids are no inputs. Rows whose label
is null are not learnt from. Without training rows every score is 0. Extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.common import fold_bucket, splitmix, staged, table

BITS, FACTORS, EPOCHS, SAMPLE_ROWS, MIN_DOCS, MIN_Z, REST = 16, 4, 8, 16000, 3, 3.5, 0.5
RATE, SHRINK = 0.3, 1e-4
#: The screen of pairs: rows of the sample that it reads, terms and pairs of so many rows (terms: and such a share of all), so many buckets, standard deviations, and pairs at most.
PAIR_ROWS, PAIR_DOCS, PAIR_SHARE, PAIR_BITS, PAIR_Z, MOST_PAIRS = 4000, 20, 0.02, 18, 10.0, 2000
TERM = re.compile(r"[^\W\d_]+")
_CACHE: dict[str, int] = {}


def terms(text: str | None) -> np.ndarray:
    """Distinct hashed terms and word starts of a text, ascending."""
    found = set(TERM.findall((text or "").lower()))
    found |= {"^" + t[:5] for t in found if len(t) > 5}
    if len(_CACHE) > 400_000:
        _CACHE.clear()
    for term in found.difference(_CACHE):
        _CACHE[term] = xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) >> (64 - BITS)
    return np.unique(np.fromiter(map(_CACHE.__getitem__, found), np.int32, len(found)))


def _raw(model: dict, at: np.ndarray) -> tuple[float, np.ndarray, float]:
    x = model["x"][at]
    v = model["v"][at] * x[:, None]
    total = v.sum(0)
    return float(model["w0"][0] + model["w"][at] @ x + 0.5 * ((total**2).sum() - (v**2).sum())), total, x


def score_terms(model: dict, at: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(_raw(model, at[model["x"][at] > 0])[0], -30, 30))))


def _epoch(model: dict, rows: list[tuple[np.ndarray, int]], rate: float, shrink: float, positive: float) -> dict:
    m = {k: a.copy() for k, a in model.items()}
    for at, label in rows:
        raw, total, x = _raw(m, at)
        slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label) * (positive if label else 1.0)
        own = m["v"][at]
        dw, dv = slope * x + shrink * m["w"][at], slope * x[:, None] * (total - own * x[:, None]) + shrink * own
        m["g0"] += slope**2
        m["gw"][at] += dw**2
        m["gv"][at] += dv**2
        m["w0"] -= rate * slope / np.sqrt(m["g0"])
        m["w"][at] -= rate * dw / np.sqrt(m["gw"][at])
        m["v"][at] -= rate * dv / np.sqrt(m["gv"][at])
    return m


def _weights(found: list, rows: int) -> np.ndarray:
    """x of every hashed term, from (term, n, telling) of those that are kept and the number of rows."""
    x = np.zeros(1 << BITS, np.float32)
    x[[r[0] for r in found if r[2]]] = 0.5
    rest = [(r[0], r[1], np.log((1 + rows) / r[1])) for r in found if not r[2]]
    if rest:
        mass, most = sum(n * idf**2 for _, n, idf in rest) / rows, max(idf for _, _, idf in rest)
        scale = min(0.5 / most, np.sqrt(REST / mass))
        x[[t for t, _, _ in rest]] = [scale * idf for _, _, idf in rest]
    return x


def _pairs(at: np.ndarray, often: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Every pair of a row's frequent terms as one number, about `most` at a time."""
    own = at[often[at]].astype(np.int64)
    step = max(1, most // max(len(own), 1))
    for low in range(0, len(own), step):
        some = own[low : low + step]
        ahead = np.arange(len(own))[None, :] > np.arange(low, low + len(some))[:, None]
        yield (some[:, None] << BITS | own[None, :])[ahead]


def _slots(pairs: np.ndarray) -> np.ndarray:
    return (splitmix(pairs.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _telling(n: np.ndarray, pos: np.ndarray, share: float) -> np.ndarray:
    """By how many standard deviations counts differ between the labels."""
    return np.abs(pos - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))


def paired_terms(rows: DataFrame, counts: list, share: float, total: int) -> set[int]:
    """Neutral terms that tell something in pairs: counts of all pairs of frequent neutral terms in hashed buckets, then exact
    ones of the pairs in buckets that differ between the labels by PAIR_Z standard deviations. Frequent are terms of
    PAIR_DOCS rows and a PAIR_SHARE of all rows."""
    often, least = np.zeros(1 << BITS, bool), max(PAIR_DOCS, PAIR_SHARE * total)
    for r in counts:
        often[r.term] = r.n >= least and r.z < MIN_Z
    shared = rows.sparkSession.sparkContext.broadcast(often)
    rows = rows.where(F.pmod(F.xxhash64("terms", F.lit(7)), F.lit(1_000_000)) < int(min(1.0, PAIR_ROWS / total) * 1_000_000))

    def screened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 1 << PAIR_BITS
        n, held = np.zeros((2, size), np.int32), ([], [])

        def count(y: int) -> None:
            n[y] += np.bincount(np.concatenate([np.zeros(0, np.int64), *held[y]]), minlength=size).astype(np.int32)
            held[y].clear()

        for batch in batches:
            for at, y in zip(batch["terms"], batch["label"]):
                for pairs in _pairs(np.asarray(at), shared.value):
                    held[int(y)].append(_slots(pairs))
                    if sum(map(len, held[int(y)])) > size:
                        count(int(y))
        count(0)
        count(1)
        yield pd.DataFrame({"n": [n.tobytes()]})

    some = rows.select("terms", "label").coalesce(4).mapInPandas(screened, "n binary").collect()  # fixed size
    both = sum((np.frombuffer(bytes(r.n), np.int32).reshape(2, -1).astype(np.int64) for r in some), np.zeros((2, 1 << PAIR_BITS), np.int64))
    flagged = _telling(both.sum(0), both[1], share) >= PAIR_Z
    if not flagged.any():
        return set()
    marks = rows.sparkSession.sparkContext.broadcast(np.packbits(flagged))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(marks.value).astype(bool)
        for batch in batches:
            found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, y in zip(batch["terms"], batch["label"]):
                found[int(y)].extend(pairs[bits[_slots(pairs)]] for pairs in _pairs(np.asarray(at), shared.value))
            for y in (0, 1):
                pair, n = np.unique(np.concatenate(found[y]), return_counts=True)
                yield pd.DataFrame({"pair": pair, "n": n, "pos": n * y})

    summed = rows.select("terms", "label").mapInPandas(exact, "pair long, n long, pos long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    z = F.abs(F.col("pos") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    best = summed.where((F.col("n") >= PAIR_DOCS) & (z >= PAIR_Z)).orderBy(z.desc(), "pair").limit(MOST_PAIRS).select("pair").collect()
    return {t for r in best for t in (r.pair >> BITS, r.pair & (1 << BITS) - 1)}


def fit(labelled: DataFrame, label: str = "toxic", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, shards: int = 4) -> dict | None:
    """Parameters learnt from (key, text, label) rows; None without rows."""
    known = labelled.where(F.col(label).isNotNull()).select(key, "text", F.col(label).cast("int").alias("label"))
    rate = min(1.0, sample_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(1_000_000)) < int(rate * 1_000_000))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"shard": batch["shard"], "terms": [terms(t) for t in batch["text"]], "label": batch["label"]})

    shard = F.pmod(F.xxhash64(key, F.lit(6)), F.lit(shards)).cast("int").alias("shard")
    rows = staged(sample.select(shard, "text", "label").mapInPandas(hashed, "shard int, terms array<int>, label int"), "terms")
    counted = rows.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    if not counted.n:
        return None
    by_term = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    share = (counted.pos or 0) / counted.n
    z = (F.col("pos") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    counts = by_term.where(F.col("n") >= MIN_DOCS).select("term", "n", F.abs(z).alias("z")).collect()  # at most 2**BITS
    paired = paired_terms(rows, counts, share, counted.n) if 0 < share < 1 else set()
    x = _weights([(r.term, r.n, r.z >= MIN_Z or r.term in paired) for r in counts], counted.n)
    size = 1 << BITS
    positive = float(min(4.0, max(1.0, 0.5 * (counted.n - (counted.pos or 0)) / max(counted.pos or 0, 1))))
    noise = np.random.default_rng(5).normal(0, 0.1, (size, FACTORS)).astype(np.float32)
    model = {"w0": np.zeros(1, np.float32), "w": np.zeros(size, np.float32), "v": noise, "g0": np.full(1, 1.0, np.float32), "gw": np.full(size, 1e-2, np.float32), "gv": np.full((size, FACTORS), 1e-2, np.float32)}
    spark = labelled.sparkSession
    for _ in range(epochs):
        shared = spark.sparkContext.broadcast(model | {"x": x})  # fixed size: 3 MB

        def learn(group: pd.DataFrame) -> pd.DataFrame:
            active = (np.asarray(t)[x[np.asarray(t)] > 0] for t in group["terms"])
            examples = sorted(zip(active, group["label"]), key=lambda e: (int(e[0].sum()) * 2654435761 % 2**32, len(e[0]), e[1]))
            learnt = _epoch(shared.value, examples, RATE, SHRINK, positive)
            return pd.DataFrame({"n": [len(examples)], **{k: [a.astype(np.float32).tobytes()] for k, a in learnt.items() if k != "x"}})

        learnt = rows.groupBy("shard").applyInPandas(learn, "n long, w0 binary, w binary, v binary, g0 binary, gw binary, gv binary").collect()
        total = sum(r.n for r in learnt)
        model = {k: sum(np.frombuffer(bytes(r[k]), np.float32).reshape(a.shape) * np.float32(r.n / total) for r in sorted(learnt, key=lambda r: (r.n, bytes(r.w0)))) for k, a in model.items()}
    return {k: model[k] for k in ("w0", "w", "v")} | {"x": x}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """`docs` with score and predicted (score >= 0.5) added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")  # columns of these names give way
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("score double, predicted int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                scores = np.array([score_terms(m, terms(t)) if m else 0.0 for t in batch.column("text").to_pylist()], float)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*columns, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold_bucket(F.col("doc_id"), 5) != 0).where("toxic IS NOT NULL").select("doc_id", "toxic")
    rate = min(1.0, SAMPLE_ROWS / max(1, labels.count()))
    labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(rate * 1_000_000))
    model = fit(docs.join(F.broadcast(labels), "doc_id"))  # at most about SAMPLE_ROWS label rows
    rows = docs.select("doc_id", (fold_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return score(rows, model).drop("text")
