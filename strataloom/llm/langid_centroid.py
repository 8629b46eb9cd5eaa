"""Language identification: nearest of several clustered TF-IDF n-gram centroids per language, by cosine.

A text becomes a vector of hashed character 1- to 3-grams of its case-folded letters: 1 + log(count), times the
n-gram's inverse document frequency over all training rows, length normalised. `fit` takes about `label_rows` rows of
each language, chosen by key hash, or all where it has fewer; each language's own task clusters three quarters of
them by spherical k-means. Rejection is by distance: a text is accepted if its best cosine reaches its centroid's
`floor`, half of the least cosine that a row of the last quarter has with it. A centroid nearest to fewer than SUPPORT
such rows takes its language's floor, and a language with fewer the least floor of all languages with enough.

Contract. Null text or text without a letter: `und`, score 0, not accepted. An empty training set leaves every row
`und`. Ties go to the first language in code point order. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.common import fold_bucket, table

DIMENSIONS = 4096
CLUSTERS = 4
LABEL_ROWS, SUPPORT = 1000, 20
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _letters() -> np.ndarray:
    """For each code point: its lower-case form if it is a letter, else a space."""
    points = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000)]
    return np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in points], np.uint32)


_TABLE: list[np.ndarray] = []


def vector(text: str | None) -> np.ndarray | None:
    """Hashed n-gram weights 1 + log(count), or None without a letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    codes = _TABLE[0][np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes != 32
    if not keep.any():
        return None
    keep[1:] |= keep[:-1]
    codes = np.concatenate([[np.uint32(32)], codes[keep], [np.uint32(32)]]).astype(np.uint32)
    a = codes * _FACTORS[0]
    b = a[:-1] ^ (codes[1:] * _FACTORS[1])
    c = b[:-1] ^ (codes[2:] * _FACTORS[2])
    grams = np.concatenate([a, b * _FACTORS[2], c * _FACTORS[0]])
    counts = np.bincount(grams >> np.uint32(20), minlength=DIMENSIONS)
    return np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def fit(labelled: DataFrame, label: str = "lang", key: str = "doc_id", label_rows: int = LABEL_ROWS, clusters: int = CLUSTERS) -> dict:
    """Centroids learnt from (key, text, label) rows: arrays `langs`, `centroids`, `floors` and `idf`."""
    known = labelled.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(key, "text", label)
    sizes = known.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    dealt = F.pmod(F.xxhash64(F.col(key), F.lit(9)), F.lit(1_000_000)) < F.least(F.lit(1.0), label_rows / F.col("_n")) * 1_000_000
    sample = known.join(F.broadcast(sizes), F.col(label) == F.col("_label")).where(dealt).select(key, "text", label)

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        present, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for v in filter(lambda v: v is not None, map(vector, batch["text"])):
                present += v > 0
                rows += 1
        yield pd.DataFrame({"gram": np.arange(DIMENSIONS + 1), "n": np.append(present, rows)})

    counts = known.select("text").mapInPandas(seen, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    present = np.zeros(DIMENSIONS + 1)
    for r in counts:  # DIMENSIONS n-grams and the number of rows
        present[r.gram] = r.n
    present, rows = present[:-1], present[-1]
    idf = np.log((1 + rows) / (1 + present)).astype(np.float32) + np.float32(0.1)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([key, "text"])
        rows = [v * idf for v in map(vector, group["text"]) if v is not None]
        if not rows:
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        rows = _unit(np.stack(rows))
        held = np.arange(len(rows)) % 4 == 3
        x, apart = rows[~held], rows[held]
        centres = x[np.linspace(0, len(x) - 1, min(clusters, len(x))).astype(int)]
        for _ in range(12):
            near = (x @ centres.T).argmax(1)
            centres = _unit(np.stack([x[near == j].sum(0) if (near == j).any() else centres[j] for j in range(len(centres))]))
        cosine = apart @ centres.T
        near, best = cosine.argmax(1), cosine.max(1)
        least = lambda c: 0.5 * float(c.min()) if len(c) >= SUPPORT else None
        floors = [f if (f := least(best[near == j])) is not None else least(best) for j in range(len(centres))]
        return pd.DataFrame({"lang": group[label].iloc[0], "centroid": [c.tolist() for c in centres], "floor": pd.Series(floors, dtype=float)})

    found = sample.groupBy(label).applyInPandas(cluster, "lang string, centroid array<float>, floor double").orderBy("lang", "floor", "centroid").collect()
    other = min((f.floor for f in found if f.floor is not None), default=0.0)  # without any evidence all are near enough
    centroids = np.array([f.centroid for f in found], np.float32).reshape(-1, DIMENSIONS)
    return {"langs": [f.lang for f in found], "centroids": centroids, "floors": np.array([other if f.floor is None else f.floor for f in found]), "idf": idf}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` with lang_pred, score (best cosine) and accepted (near enough to its centroid) added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # clusters * languages rows of DIMENSIONS floats
    docs = docs.drop("lang_pred", "score", "accepted")  # columns of these names give way
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("lang_pred string, score double, accepted boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weighted = (m["centroids"] * m["idf"]).T
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                names, scores, accepted = [], [], []
                for text in batch.column("text").to_pylist():
                    v = vector(text) if m["langs"] else None
                    if v is None:
                        names.append("und"), scores.append(0.0), accepted.append(False)
                        continue
                    cosine = v @ weighted / max(float(np.linalg.norm(v * m["idf"])), 1e-12)
                    j = int(cosine.argmax())
                    names.append(m["langs"][j]), scores.append(min(max(float(cosine[j]), 0.0), 1.0)), accepted.append(bool(cosine[j] >= m["floors"][j]))
                added = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, "lang_pred", "score", "accepted"])

    return docs.mapInArrow(run, schema)


def train_rows(docs: DataFrame) -> DataFrame:
    """The documents whose label may be learnt from: crc32(doc_id as text) mod 4 is not 2."""
    return docs.where(fold_bucket(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three quarters of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = fit(train_rows(docs))
    rows = docs.select("doc_id", (fold_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "accepted")
