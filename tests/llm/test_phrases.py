"""Collocations against counts of all phrases in plain Python, over many small ranges; automata against the paths they hold."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from strataloom.llm import phrase_automata as pa_

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, phrase string, n long, score string, part int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {key for key, a in f.items() if a >= least and len(key[1]) > 1}
    inside = {(lang, p[i:j]) for lang, p in candidates for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f[lang, p] >= f[lang, p[i:j]]}
    out = {}
    for lang, p in candidates - inside:
        a = f[lang, p]
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


def corpus(seed, n, kinds):
    rng = random.Random(seed)
    words = ["a", "B", "b", "of", "the", "The", "é", "zu\x01", "日本", "x", "of-", " y", "q"][:kinds]
    rows = [(None, "a b"), ("und", "a b"), ("en", None), ("en", ""), ("de", " \t ,.\n")]
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\x0b", "?!"]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "en", "de", None]), text))
    return rows


@pytest.mark.parametrize("seed,kinds,least,shard", [(1, 13, 3, {"tokens": 500, "chunk": 60, "every": 3}), (2, 4, 5, {"tokens": 300, "chunk": 50, "every": 1}), (3, 2, 9, {"tokens": 10**6, "every": 2}), (4, 13, 2, {})])
def test_collocations_are_those_of_brute_force(spark, seed, kinds, least, shard):
    rows = corpus(seed, 300, kinds)
    docs = spark.createDataFrame([(i, t, lang, "x", 1, "y", 2) for i, (lang, t) in enumerate(rows)], SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        found = pa_.collocations(docs, least=least, top=400, **shard).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(tuple(r) for r in found) == brute(rows, least, 5, 400)
    assert len(found) > 5


def test_collocations_of_nothing_and_of_one_long_text(spark):
    docs = spark.createDataFrame([(1, None, "en", "x", 1, "y", 2), (2, "one two. " * 60_000, None, "x", 1, "y", 2)], SCHEMA)
    assert pa_.collocations(docs.where("false")).count() == pa_.collocations(docs.where("doc_id = 1")).count() == 0
    assert [tuple(r) for r in pa_.collocations(docs).collect()] == [("und", 1, "one two", 60_000, 60_000, 60_000, 120_000, 2000)]


def test_query_is_the_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(pa_.OP11_SQL).fetchall()
    assert sorted(tuple(r) for r in pa_.op11_phrase_automata(spark, DATA).collect()) == sorted(want)


def test_automata_hold_their_paths():
    rng = random.Random(7)
    words = sorted(b"w%d" % i for i in range(6))
    for _ in range(200):
        rows = np.array([(row := [rng.randrange(6) for _ in range(rng.randint(1, 4))]) + [-1] * (4 - len(row)) for _ in range(rng.randint(1, 40))])
        paths, counts = pa_.aggregate(rows, np.ones(len(rows), np.int64))
        one = pa_.Automaton.load(pa_.Automaton.build(words, paths, counts).dump())
        again, n = one.paths()
        have = {pa_.key_of(words, p): c for p, c in zip(paths, counts)}
        assert {pa_.key_of(one.words, p): c for p, c in zip(again, n)} == have
        asked = np.array([[rng.randrange(len(one.words) + 1) for _ in range(3)] for _ in range(30)])
        weights, whole = one.weights(asked)
        for row, weight, own in zip(asked, weights, whole):
            key = tuple([*one.words, b"none"][i] for i in row)
            assert weight == sum(c for p, c in have.items() if p[:3] == key)
            assert own == have.get(key, 0)
    tails = np.array([[i, 4, 5] for i in range(4)])
    assert [len(level[0]) for level in pa_.Automaton.build(words, tails, np.ones(4, np.int64)).levels] == [1, 1, 1]
