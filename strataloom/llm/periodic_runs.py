"""Periodic runs of words, found by seeds on diagonals.

A run is a maximal stretch of words with smallest period q that is at least max(`least`, `times` * q) words long. At lag
q (a diagonal of the text against itself) it is a stretch of equal words, at least max(least - q, (times - 1) * q) of
them. For the lags from 2**j to 2**(j + 1) - 1 the shortest such overlap gives the seed width k, which is no less than
the lag; within a run, a k-gram then occurs next exactly one period later, so neighbouring occurrences of a k-gram in
one document are all the pairs that are needed, and none has a lag that is a multiple of the smallest period. Pairs
whose lag is not of the class are left to the class that it is of. A per-lag table of how far equal words are covered drops
the seeds within a stretch that is already known; what is left is extended word by word in growing steps.

Windows are compared by 64-bit mixed names that double in width; seeds are extended, and so confirmed, on the words. A
document leaves once no k-gram repeats in it where later classes' are no shorter, as no longer one can.

Contract. Null text has no words, no runs and the hash of the empty text. Every row gives one row, repeated or not; a
null doc_id leaves its words as they are. A text is handled whole within its task. Columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from strataloom.llm.common import slices, splitmix, table

LEAST, TIMES = 6, 4


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of windows put side by side."""
    return splitmix(splitmix(a) ^ b)


def _ahead(names: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(names)
    out[: max(0, len(names) - by)] = names[by:]
    return out


def extend(words: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The widest [start, end) in [low, high) round `at` in which words `lag` apart are the same."""
    start, step = at, 16
    while start > low:
        n = min(step, start - low)
        differs = np.flatnonzero(words[start - n : start] != words[start - n + lag : start + lag])
        if len(differs):
            start -= n - 1 - differs[-1]
            break
        start, step = start - n, 4 * step
    end, step = at, 16
    while end + lag < high:
        n = min(step, high - lag - end)
        differs = np.flatnonzero(words[end : end + n] != words[end + lag : end + lag + n])
        if len(differs):
            end += differs[0]
            break
        end, step = end + n, 4 * step
    return int(start), int(end) + lag


def find_runs(words: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's runs, by start and period; document d has the words from ends[d - 1] (or
    0) up to ends[d], as 64-bit codes that are equal for equal words only."""
    if times < 3 or least < 3:
        raise ValueError("seeds need runs of three periods and three words at least")
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    docs, j = np.flatnonzero(ends - starts >= least), 0
    while len(docs):
        lags = 1 << j, (2 << j) - 1
        k = min(max(least - q, (times - 1) * q) for q in range(lags[0], max(lags[0], min(lags[1], least)) + 1))
        docs = docs[(ends - starts)[docs] >= max(least, times * lags[0])]
        sizes = (ends - starts)[docs]
        if not len(docs):
            break
        firsts = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum())
        own = np.repeat(np.arange(len(docs)), sizes)
        place += np.repeat(starts[docs] - firsts, sizes)  # where each kept word lies among `words`
        names, width, rest = words[place], 1, None
        parts, left, done = [], k, 0  # the binary digits of k, from the widest window down
        doubled = [names]
        while 2 * width <= k:
            doubled.append(_join(doubled[-1], _ahead(doubled[-1], width)))
            width *= 2
        for names in reversed(doubled):
            if left >= width:
                parts.append(_ahead(names, done))
                left, done = left - width, done + width
            width //= 2
        rest = parts[0]
        for part in parts[1:]:
            rest = _join(rest, part)
        inside = np.flatnonzero(place + k <= ends[docs][own])
        keys = _join(rest[inside], own[inside].astype(np.uint64))
        order = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        one, two = inside[order[same]], inside[order[same + 1]]
        lag = two - one
        repeats = np.unique(own[one])
        seeds = np.flatnonzero((lag >= lags[0]) & (lag <= lags[1]))
        seeds = seeds[np.lexsort((one[seeds], lag[seeds], own[one[seeds]]))]
        at, lag, doc = place[one[seeds]], lag[seeds], docs[own[one[seeds]]]
        if len(at):  # a seed right behind another of its document and lag lies in the same stretch
            fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1]) | (doc[1:] != doc[:-1])])
            covered: dict[tuple[int, int], int] = {}
            for i, q, d in zip(at[fresh].tolist(), lag[fresh].tolist(), doc[fresh].tolist()):
                if i < covered.get((d, q), -1):
                    continue
                start, end = extend(words, i, q, int(starts[d]), int(ends[d]))
                covered[d, q] = end - q
                if end - start >= max(least, times * q):
                    found[d].append((start - int(starts[d]), end - start, q))
        docs, j = docs[repeats] if k <= (times - 1) * (2 << j) else docs, j + 1
    return [sorted(set(runs), key=lambda r: (r[0], r[2])) for runs in found]


def repeated(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(start, period) from and with which a document's words are to repeat, for a tenth of all ids."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    start = g % n
    return start, 1 + (n - start) // (3 + g % 8)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; ties: smallest start, then period."""
    best = None
    for run in runs:  # in order of start and period, so only a greater one takes the place
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def periodic_runs(docs: DataFrame, texts: bool = False, planted: bool = False, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row a document: n_runs, its strongest run, hashes of the list of runs and of the text with every run cut to its
    first period. `texts` adds these two as columns `runs` and `collapsed`; `planted` first makes a tenth of the documents
    periodic (see `repeated`)."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    fields = [*[(n, pa.int64()) for n in names[:6]], *[(n, pa.string()) for n in names[6:]]]
    kinds = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if texts:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        fields += [("runs", pa.list_(run)), ("collapsed", pa.string())]
        kinds += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def rows(ids: list[int | None], lists: list[list[bytes]], codes: list[np.ndarray]) -> pa.RecordBatch:
        out = []
        ends = np.cumsum([len(c) for c in codes]).astype(np.int64)
        for doc_id, words, runs in zip(ids, lists, find_runs(np.concatenate([*codes, np.zeros(0, np.uint64)]), ends, least, times)):
            best, kept = strongest(runs), b" ".join(collapse(words, runs))
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
            numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            row = (doc_id, len(runs), *numbers, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
            out.append(row + (([dict(zip(("start", "length", "period"), r)) for r in runs], kept.decode("utf-8", "surrogatepass")) if texts else ()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out) if out else [[]] * len(fields), fields)], names=[n for n, _ in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            ids, texts_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in slices([t or "" for t in texts_], 2_000_000):
                lists, codes = [], []
                for doc_id, text in zip(ids[low:high], texts_[low:high]):
                    words = text.encode("utf-8", "surrogatepass").split() if text else []
                    if len(cache) > 400_000:
                        cache.clear()
                    for word in set(words).difference(cache):
                        cache[word] = xxhash.xxh3_64_intdigest(word)
                    code = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                    change = repeated(doc_id, len(words)) if planted else None
                    if change:
                        start, period = change
                        source = np.arange(len(words))
                        source[start:] = start + (source[start:] - start) % period
                        words, code = [words[i] for i in source], code[source]
                    lists.append(words)
                    codes.append(code)
                yield rows(ids[low:high], lists, codes)

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(work, kinds)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of them made periodic first."""
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True)
