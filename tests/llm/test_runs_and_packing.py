"""Periodic runs against brute force; packed sequences against the tokenizer's own ids and the bound of their sizes."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strataloom.llm import best_fit_packing, periodic_runs

DATA = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, length long, sequence_id string, n_runs string, piece string"


def brute_runs(w, least=6, times=4):
    found, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            inside = w[start : start + length]
            if i > start and length >= max(least, times * q) and not any(inside[p:] == inside[:-p] for p in range(1, q)):
                found.append((start, length, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(6, 4), (3, 3), (10, 5)])
def test_runs_are_those_of_brute_force(least, times):
    rng, total = random.Random(least), 0
    codes = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, kinds = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 20])
            words = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.6:
                start, period = rng.randrange(n), rng.randint(1, 1 + n // 4)
                for i in range(start, min(n, start + rng.randint(1, n))):
                    words[i] = words[start + (i - start) % period]
            docs.append(words)
        flat = np.array([x for d in docs for x in d], int)
        want = [brute_runs(d, least, times) for d in docs]
        total += sum(map(len, want))
        assert periodic_runs.find_runs(codes[flat], np.cumsum([len(d) for d in docs]), least, times) == want
    assert total > 300


def test_runs_query_is_the_same_as_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 9000")
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(docs, planted=True).collect()}
    ran = 0
    for row in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        n, h = len(words), zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        got = found[row.doc_id]
        assert got.n_runs == len(runs)
        assert (got.start, got.length, got.period, got.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert got.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
        ran += bool(runs)
    assert ran > 30


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 100_000), (5, "a b a b a b a b c"), (5, "a b a b a b a b c"), (None, "é é é é é é x"), (7, "a a a a a")]
    docs = spark.createDataFrame([(i, t, None, None, 1, "x", "y", "z") for i, t in rows], SCHEMA)
    found = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs, texts=True).collect()), key=str)
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 100_000, 1)], "a"), (5, [(0, 8, 2)], "a b c"), (5, [(0, 8, 2)], "a b c"), (None, [(0, 6, 1)], "é x"), (7, [], "a a a a a")]
    assert found == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0


def check_packing(rows, capacity=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packed_pieces_hold_the_tokenizers_ids(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = best_fit_packing.op13_best_fit_packing(spark, DATA).collect()
    tokenizer, want, total = Tokenizer.from_file(PATH), set(), 0
    for row in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want |= {(row.doc_id, k, 2048 * k, len(p), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 2048)) for p in [ids[2048 * k : 2048 * k + 2048]]}
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert check_packing(rows) <= -(-total // 2048) + 1


def test_chunks_are_read_as_whole_texts_are():
    rng, tokenizer, chunks = random.Random(3), Tokenizer.from_file(PATH), best_fit_packing.Chunks(PATH, most=200)
    parts = ["don't", "It's", "WE'LL", "'S", "a,b", "(x)", "e.g.", "x!?", "3.14", "ÄÖ", "Ñandú,", "H̱", "é", "́a", "Σς", "İ", "日本語。", "a\x1cb", "\x00", "\x7f!", "x\xa0y", "a b", "<|endoftext|>", "z<|startoftext|>", "😀", "ﬁ", "_", "a_b", "٣", "²"]
    texts = ["", "  "] + ["".join(rng.choice(parts) + rng.choice([" ", "\n", "\t ", "\x0b", "\r\n", ""]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    ids, stops = chunks.encode(texts)
    for text, low, high in zip(texts, [0, *stops[:-1]], stops):
        assert ids[low:high].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], text


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(5)
    for _ in range(300):
        room, left = rng.randint(0, 60), {k: rng.randint(1, 4) for k in sorted(rng.sample(range(1, 40), rng.randint(0, 6)), reverse=True)}
        uses = best_fit_packing.fullest(left, room)
        sums = {0}
        for k, n in left.items():
            sums = {s + k * c for s in sums for c in range(n + 1)}
        assert all(n <= left[k] for k, n in uses.items())
        assert sum(k * n for k, n in uses.items()) == max(s for s in sums if s <= room)


def test_packing_of_odd_rows(spark):
    long = "word " * 5000
    rows = [(1, None), (2, ""), (2, ""), (3, long), (3, long), (None, "a b"), (None, "a b"), (4, "x" * 20_000), *[(i, "one two three") for i in range(5, 2000)]]
    docs = spark.createDataFrame([(i, t, None, None, 1, "x", "y", "z") for i, t in rows], SCHEMA)
    packed = best_fit_packing.pack(best_fit_packing.pieces(docs, with_ids=True))
    found = packed.collect()
    total = sum(r.length for r in found)
    assert check_packing(found) == -(-total // 2048)
    assert sorted(r.length for r in found if r.doc_id == 3) == [905, 905, 2048, 2048, 2048, 2048]
    whole = {r.sequence_id: r.ids for r in best_fit_packing.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == total
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in found)
    assert best_fit_packing.pack(best_fit_packing.pieces(docs.where("false"))).count() == 0
