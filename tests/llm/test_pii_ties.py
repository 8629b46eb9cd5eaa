"""What the skip-chain field adds: repeats far from a base span, in forms that no base pattern takes."""

import random

from strataloom.llm import pii_crf

FILLER = "the meeting was moved to the next week and nobody minded it at all since the room was small "


def luhn_card(rng):
    digits = [4, *[rng.randrange(10) for _ in range(14)]]
    check = next(c for c in range(10) if pii_crf._luhn("".join(map(str, [*digits, c]))))
    return "".join(map(str, [*digits, check]))


def planted(rng, i):
    """(text, spans of the repeats that no base pattern takes): a datum, and far behind it other forms of it."""
    area, mid, end = rng.randint(200, 989), rng.randint(200, 999), rng.randint(1000, 9999)
    card, name = luhn_card(rng), f"{rng.choice(['ann', 'bob', 'eve'])}.{rng.choice(['smith', 'jones'])}{i}"
    kind = i % 3
    first, again = [
        (f"+1 ({area}) {mid}-{end}", [f"{area}-{mid}-{end}", f"{area} {mid} {end}", f"1.{area}.{mid}.{end}"]),
        (" ".join(card[k : k + 4] for k in range(0, 16, 4)), [".".join(card[k : k + 4] for k in range(0, 16, 4)), "/".join(card[k : k + 4] for k in range(0, 16, 4))]),
        (f"{name}@mail.example.com", [f"{name}@localhost", f"{name}@mail,example,com"]),
    ][kind]
    text, spans = f"Reach us: {first} for details. ", []
    for form in again:
        text += FILLER * rng.randint(1, 20) + f"order {rng.randint(100, 99999)} of {rng.randint(1990, 2024)}, see "
        spans.append((len(text), len(text) + len(form)))
        text += form + " there. "
    return text, spans


def clean(rng, i):
    """Numbers that repeat and are no personal data."""
    order = rng.randint(10**7, 10**8 - 1)
    return f"Order {order} in {rng.randint(1990, 2024)}. " + FILLER * 5 + f"The order {order} left on {rng.randint(1, 28)}.{rng.randint(1, 12)}.2020, build 1.2.{i}, size {rng.randint(10, 99)}x{rng.randint(10, 99)}. " * 3


def test_repeats_are_found_far_away(spark):
    rng = random.Random(6)
    rows, want, quiet = [], {}, set()
    for i in range(240):
        text, spans = planted(rng, i)
        want[i] = spans
        rows.append((i, text))
    for i in range(240, 480):
        rows.append((i, clean(rng, i)))
        quiet.add(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii_crf.fit(docs)
    found, caught, added = {r.doc_id: r.spans for r in pii_crf.find(docs, model).collect()}, 0, 0
    texts = dict(rows)
    for i, spans in found.items():
        base = {(a, b) for a, b, _ in pii_crf.base_spans(texts[i])}
        own = {(int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",") if s)} - base
        added += len(own)
        caught += len(own & set(want.get(i, [])))
    total = sum(map(len, want.values()))
    print("recall", caught / total, "precision", caught / max(added, 1))
    assert caught >= 0.9 * total and caught >= 0.95 * added
    assert not any(found[i] for i in quiet)


def test_forms_tie_spaced_numbers_and_names():
    text = "+44 20 7946 0958 or 020 7946 0958 or 44-20-7946-0958, bob.smith@example.com, bob.smith@localhost, 4111 1111 1111 1111 and 4111.1111.1111.1111"
    tokens = pii_crf._tokens(text)
    groups = [{text[slice(*tokens[i])] for i in g} for g in pii_crf._groups(text, tokens)]
    assert {"44", "20", "7946", "0958", "020", "44-20-7946-0958"} <= groups[0] | {"44"}
    assert {"bob.smith@example.com", "bob.smith@localhost"} in groups and {"4111", "1111", "4111.1111.1111.1111"} in groups


def test_a_lone_number_is_no_address():
    flat = {"index": {}, "unary": pii_crf.np.zeros((2, pii_crf.LABELS)), "chain": pii_crf.np.zeros((pii_crf.LABELS,) * 2), "skip": pii_crf.np.array([6.0])}
    flat["unary"][0, 2] = 9.0  # a field that takes all for addresses
    assert pii_crf.all_spans(flat, "Phone: 555-123-4567")[1] == []
    assert pii_crf.all_spans(flat, "at 555.123.45.67")[1] == []  # refused: a part is over 255


def test_the_field_is_learnt_from_every_document(spark):
    """Eight of 12,000 documents hold a form of their own: its features have weights, as in a field learnt from all rows at hand."""
    rows = [(i, f"zyx 10.0.{i // 1500}.77 end" if i % 1500 == 7 else f"page {i % 50}") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii_crf.fit(docs)
    seen = {r.doc_id for r in docs.where("pmod(xxhash64(doc_id, 11), 4) != 0").select("doc_id").collect()}
    counts = pii_crf.defaultdict(int)
    for i, text in rows:
        for example in pii_crf._examples(text) if i in seen else ():
            counts[example] += 1
            counts[pii_crf._bare(example)] += bool(example[1] and any(example[4][1:]))
    whole = pii_crf.learn([(*e, n) for e, n in counts.items() if n])
    assert "b:zyx" in whole["index"] and all(f in model["index"] for f in whole["index"])
    for f, k in whole["index"].items():
        assert abs(model["unary"][model["index"][f]] - whole["unary"][k]).max() < 1e-3, f
    assert abs(model["chain"] - whole["chain"]).max() < 1e-3 and abs(model["skip"] - whole["skip"]).max() < 1e-3
    assert pii_crf.all_spans(model, "zyx 10.0.300.77 end")[0] == []


def test_a_phone_match_that_ran_on_says_nothing():
    """The pattern refuses a phone number with an address behind it: its tokens are no examples of what is none."""
    text = "see page 7, call +1 (826) 555-4081 190.137.223.204 now"
    assert [e[1] for e in pii_crf._examples(text)] == [0, 2]


def test_counts_of_tied_labels_are_whole():
    examples = list(pii_crf._examples("robert.m@mail.example.com says " * 5_000))
    assert {e[4] for e in examples} == {(0, 4_999, 0, 0, 0, 0)}
    model = pii_crf.learn([(*examples[0], 5_000), (*pii_crf._bare(examples[0]), 5_000), (("s:99",), 0, -1, -1, (0,) * 6, 50)])
    assert all(pii_crf.np.isfinite(model[k]).all() for k in ("unary", "chain", "skip")) and model["skip"][0] > 0
