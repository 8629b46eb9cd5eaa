"""Pairs of terms that say nothing by themselves, in texts of many words."""

import numpy as np
import pytest

from strataloom.llm import toxicity_fm


@pytest.mark.parametrize("words", [100, 300])
def test_a_neutral_pair_is_learnt_in_long_texts(spark, words):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    rows = []
    for i in range(5000):  # toxic with both or neither
        a, b = rng.random(2) < 0.5
        text = [vocabulary[k] for k in np.minimum(rng.zipf(1.3, words) - 1, 2999)]
        for there, word in ((a, "qqa"), (b, "zzb")):
            if there:
                text.insert(rng.integers(len(text)), word)
        rows.append((i, " ".join(text), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity_fm.fit(docs.where("doc_id < 4000"))
    assert (model["x"][toxicity_fm.terms("qqa zzb")] == 0.5).all() and (model["x"] == 0.5).sum() < 40
    found = toxicity_fm.score(docs.where("doc_id >= 4000"), model)
    assert found.where("predicted = toxic").count() >= 900


def test_pairs_come_in_pieces():
    often = np.ones(1 << toxicity_fm.BITS, bool)
    often[5] = False
    at = np.array([1, 3, 5, 7, 9])
    want = {(i << toxicity_fm.BITS) | j for i in (1, 3, 7, 9) for j in (1, 3, 7, 9) if i < j}
    for most in (1, 5, 100):
        assert sorted(np.concatenate(list(toxicity_fm._pairs(at, often, most))).tolist()) == sorted(want)
    assert list(toxicity_fm._pairs(at[:0], often)) == []
