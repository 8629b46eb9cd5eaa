"""Personal data by exact patterns and a skip-chain conditional random field.

Base spans come from four patterns with their checks. The field labels the tokens that carry a digit or an @, all
others being clear of the labels, as none, one of the four kinds, or `secret` (a key or token). Its potentials are
learnt: unary ones over token shape and neighbouring words, a transition matrix between adjacent such tokens, and a
skip strength, which rewards equal labels but for none. Candidates are neighbouring groups of digits or single tokens; the tokens of all candidates of one
document with a form in common (a mail's local part, the digits without a phone number's lead, else the text) are tied to
one group node, however far apart they are. Damped loopy belief propagation passes messages until they converge, so a
card number or mail name that is met again in a form no pattern takes gets its label from its occurrence elsewhere.
Every document with such a token is labelled, with base spans or without. Tokens outside the base spans become a span
when one label's belief reaches `threshold` and they can be of its kind; those of one candidate become one span. A number
that failed a base pattern's check is observed to be none, unless it is tied to a datum.

Training is distant supervision: base spans and key assignments (token = "...") label the tokens of every document; a token
that is tied to such a datum and takes no pattern has no label, nor has what a phone match with too many digits holds. In
three quarters of the documents, Spark counts each token's features (hashed to BUCKETS), label and labelled neighbours, and
tied data once more by their ties alone; unary weights, transitions and skip strength then maximise the pseudo-likelihood
(each label given its neighbours') less a quadratic penalty, each step a sum over all counted examples. In the last quarter
the labels are hidden from the field, and the least threshold is taken at which PRECISION of the tokens it names have the
hidden label.

Contract. Null text counts as empty. The four counts and base_sha256 cover base spans; `spans` holds them and the
field's own, `n_spans` is their number. Offsets are code points, end exclusive. Of repeated rows each is a document of
its own. Extra columns pass through, columns with an output's name give way.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from strataloom.llm.common import staged, table

#: Base kinds, and after them the kind that only the field has. Labels are 0 for none, then the kinds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
LABELS = 1 + len(ALL_KINDS)
#: A key or token in an assignment: its value is observed as a secret.
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_=-]{16,})")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Tried at the start of a run only, so that long runs take linear time; elsewhere in a run it could not match either.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
#: What has a base pattern's whole form but failed its check is observed to be no personal data.
REFUSED = re.compile(r"[0-9]{12,}|[0-9]+(?:\.[0-9]+){3}")
#: A token that may be part of a spaced number, and the most digits that such a number has.
NUMBER, MOST = re.compile(r"[+(]?[0-9][0-9().+/-]*"), 19
EDGE = "\"'()[]{}<>,;:!?.*#$%&|"
#: Messages are passed until none moves by TOLERANCE; ROUNDS only ends those that never settle.
ROUNDS, TOLERANCE = 500, 1e-4
#: The threshold where fewer than SUPPORT hidden tokens are named; else the least of LEVELS with PRECISION, or the last.
THRESHOLD, LEVELS, PRECISION, SUPPORT = 0.9, tuple(i / 100 for i in range(50, 96, 5)), 0.95, 20
#: Learning: steps of Adam, their size, and the penalty on each squared weight.
STEPS, STEP, PENALTY = 150, 0.1, 0.05
#: Buckets of features, how often one must be met to have weights, features of a token, and examples in a block of numbers.
BUCKETS, MET, FEATURES, BLOCK = 2**18, 3, 6, 100_000


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping mail addresses: around each @, the whole local run since the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS; matches that fail their check are dropped."""
    found = [(start, end, 0) for start, end in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2], s[1]))]


def _tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the whitespace tokens with a digit or @, trimmed of edge punctuation."""
    out = []
    for m in TOKEN.finditer(text):
        core = m[0].strip(EDGE)
        if core:
            start = m.start() + m[0].index(core)
            out.append((start, start + len(core)))
    return out


def _features(text: str, start: int, end: int) -> list[str]:
    token = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1\1", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "9", token)))[:12]
    before = text[max(0, start - 24) : start].split()
    return [f"s:{shape}", f"l:{min(len(token), 24)}", f"d:{min(sum(map(str.isdigit, token)), 20)}", f"b:{re.sub(r'[0-9]', '9', before[-1].lower()) if before else ''}", f"+:{'+' in text[max(0, start - 7) : start]}", f"@:{'@' in token}"]


def _observed(text: str, tokens: list[tuple[int, int]], base: list) -> list[int]:
    """Each token's label by the base spans and key assignments, -1 where they say nothing."""
    known = [*((a, b, 1 + KINDS.index(k)) for a, b, k in base), *((*m.span(1), LABELS - 1) for m in SECRET.finditer(text))]
    fixed = [-1] * len(tokens)
    at = 0
    for a, b, label in sorted(known):
        while at < len(tokens) and tokens[at][1] <= a:
            at += 1
        i = at
        while i < len(tokens) and tokens[i][0] < b:
            fixed[i] = label if fixed[i] < 0 else fixed[i]
            i += 1
    return fixed


def _candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of tokens that may be one datum: neighbouring groups of digits with MOST digits at most, else single tokens."""
    out, at = [], 0
    while at < len(tokens):
        stop = at + 1
        if NUMBER.fullmatch(text, *tokens[at]):
            while stop < len(tokens) and _chained(tokens, stop - 1) and NUMBER.fullmatch(text, *tokens[stop]):
                stop += 1
        if stop > at + 1 and sum(map(str.isdigit, text[tokens[at][0] : min(tokens[stop - 1][1], tokens[at][0] + 4 * MOST)])) <= MOST and tokens[stop - 1][1] - tokens[at][0] <= 4 * MOST:
            out.append((at, stop))
        else:
            out += [(i, i + 1) for i in range(at, stop)]
        at = stop
    return out


def _form(text: str) -> str:
    """What repeats of one datum have in common: a mail's local part; digits, without what may lead a phone number (of 9 to
    15 digits the last nine count); else the text in lower case."""
    if "@" in text:
        return "@" + text.partition("@")[0].lower()
    digits = DIGITS.sub("", text)
    if len(digits) >= 7:
        return "#" + (digits[-9:] if 9 <= len(digits) <= 15 else digits)
    return "=" + text.lower()


def _groups(text: str, tokens: list[tuple[int, int]]) -> list[list[int]]:
    """The tokens of candidates with a form of five characters or more in common: of several, or of one with several tokens."""
    alike: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for low, high in _candidates(text, tokens):
        alike[_form(text[tokens[low][0] : tokens[high - 1][1]])].append((low, high))
    groups = [[i for low, high in g for i in range(low, high)] for form, g in alike.items() if len(form) > 5]
    return [g for g in groups if len(g) > 1]


def _chained(tokens: list[tuple[int, int]], i: int) -> bool:
    """Whether tokens i and i + 1 are neighbours."""
    return 0 <= i < len(tokens) - 1 and tokens[i + 1][0] - tokens[i][1] <= 2


def _silver(text: str, tokens: list[tuple[int, int]], groups: list[list[int]]) -> list[int]:
    """Labels for learning: what is observed, none, or -1 for a token that nothing is observed of but a datum it is tied to, or
    a phone pattern's match with too many digits, which ran on into what follows."""
    labels = _observed(text, tokens, base_spans(text))
    unsure = {i for g in groups if any(labels[i] > 0 for i in g) for i in g}
    long = [m.span() for m in PHONE.finditer(text) if len(DIGITS.sub("", m[0])) > 15] if "+" in text else []
    if long:
        starts = [a for a, _ in tokens]
        unsure.update(i for a, b in long for i in range(max(0, bisect_right(starts, a) - 1), bisect_left(starts, b)) if tokens[i][1] > a)
    return [label if label > 0 else -1 if i in unsure else 0 for i, label in enumerate(labels)]


def _examples(text: str) -> Iterator[tuple]:
    """(features, label, left label, right label, labels of the others in the token's group) of each token with a label."""
    tokens = _tokens(text)
    groups = _groups(text, tokens)
    labels = _silver(text, tokens, groups)
    others = {}
    for group in groups:
        counts = np.bincount([labels[i] for i in group if labels[i] >= 0], minlength=LABELS).tolist()
        for i in group:
            others[i] = tuple(c - (labels[i] == l) for l, c in enumerate(counts))
    for i, token in enumerate(tokens):
        if labels[i] < 0:
            continue
        left, right = labels[i - 1] if _chained(tokens, i - 1) else -1, labels[i + 1] if _chained(tokens, i) else -1
        yield tuple(_features(text, *token)), labels[i], left, right, others.get(i, (0,) * LABELS)


def _bare(example: tuple) -> tuple:
    """A tied token's example without features and neighbours."""
    return (), example[1], -1, -1, example[4]


def _ties(skip: np.ndarray) -> np.ndarray:
    """What a token gains by each label that its group has: `skip` holds the gain of all labels, or of data and of none (which
    learning leaves at 0: that a form is no datum elsewhere says nothing against a datum here)."""
    return np.r_[skip[-1], np.repeat(skip[0], LABELS - 1)]


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


class Buckets:
    """The unary weights' row of each feature, by its bucket; as a dict of those that have one."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows

    def __contains__(self, feature: str) -> bool:
        return self.rows[_bucket(feature)] > 0

    def __getitem__(self, feature: str) -> int:
        return int(self.rows[_bucket(feature)])


def _slopes(state: dict, block: np.ndarray) -> np.ndarray:
    """The log pseudo-likelihood's slopes by `state`, end to end, summed over a block of examples: columns label, left, right,
    others, n, and the features' rows."""
    label, left, right = block[:, :3].T
    others, n = block[:, 3 : 3 + LABELS].astype(float), block[:, 3 + LABELS].astype(float)
    at = np.concatenate([np.zeros((len(block), 1), np.int64), block[:, 4 + LABELS :]], 1)  # 0: the bias
    tied = others.sum(1) > 0
    score = state["unary"][at].sum(1)
    score[left >= 0] += state["chain"][left[left >= 0]]
    score[right >= 0] += state["chain"].T[right[right >= 0]]
    # the group node is summed out: for each own label y, over the node's label z
    met = np.eye(LABELS) + others[tied][:, None, :]
    node = _ties(state["skip"]) * met
    most = node.max(2, keepdims=True)
    weight = np.exp(node - most)
    score[tied] += most[..., 0] + np.log(weight.sum(2))
    p = np.exp(score - score.max(1, keepdims=True))
    error = n[:, None] * (np.eye(LABELS)[label] - p / p.sum(1, keepdims=True))
    agree = error[tied][:, :, None] * weight / weight.sum(2, keepdims=True) * met
    unary, chain = np.zeros_like(state["unary"]), np.zeros((LABELS, LABELS))
    for k in range(at.shape[1]):
        for l in range(LABELS):
            unary[:, l] += np.bincount(at[:, k], error[:, l], len(unary))
    np.add.at(chain, left[left >= 0], error[left >= 0])
    np.add.at(chain.T, right[right >= 0], error[right >= 0])
    return np.concatenate([unary.ravel(), chain.ravel(), [agree[..., 1:].sum(), 0.0]])


def _ascend(rows: int, slopes: Callable[[dict], np.ndarray] | None) -> dict:
    """Potentials with `rows` rows of unary weights by Adam on the slopes of all examples (None: there are no examples)."""
    state = {"unary": np.zeros((rows, LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.array([1.0, 0.0])}
    if slopes is None:
        state["unary"][0, 0] = 1.0
        return state
    first, second = ({k: np.zeros_like(v) for k, v in state.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        parts = np.split(slopes(state), np.cumsum([v.size for v in state.values()])[:-1])
        for k, up in zip(state, parts):
            slope = up.reshape(state[k].shape) - (PENALTY / 20 if k == "skip" else PENALTY) * state[k]  # one strength has far more rows than a feature
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope**2
            state[k] = state[k] + STEP * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        state["unary"][-1] = 0.0  # of features without weights
    return {k: v.round(6) for k, v in state.items()}  # whatever the order of the sums


def learn(rows: list[tuple]) -> dict:
    """Potentials from (features, label, left, right, others, n) rows by maximum penalised pseudo-likelihood; for rows at hand,
    `fit` takes the same steps on Spark."""
    seen: dict[str, int] = defaultdict(int)
    for features, *_, n in rows:
        for f in features:
            seen[f] += n
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= MET), 1)}
    most = max((len(r[0]) for r in rows), default=0)
    blank = len(index) + 1
    block = np.array([[*r[1:4], *r[4], r[5], *(index.get(f, blank) for f in r[0]), *[blank] * (most - len(r[0]))] for r in rows], np.int64)
    return {"index": index, **_ascend(blank + 1, (lambda state: _slopes(state, block)) if rows else None)}


def fit(docs: DataFrame, key: str = "doc_id") -> dict:
    """Potentials of the field from three quarters of the documents, dealt by key hash, and its threshold from the others."""
    context = docs.sparkSession.sparkContext
    hidden = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(4)) == 0
    names = ["features", "label", "left", "right", "others"]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple, int] = defaultdict(int)
            for text in batch["text"]:
                for example in _examples(text or ""):
                    found[example] += 1
                    if example[1] and any(example[4][1:]):  # once more, so that the tie is learnt for forms that were never met
                        found[_bare(example)] += 1
            yield pd.DataFrame([([_bucket(x) for x in f], l, a, b, list(o), n) for (f, l, a, b, o), n in found.items()], columns=[*names, "n"])

    counts = docs.where(~hidden).select("text").mapInPandas(counted, "features array<int>, label int, left int, right int, others array<int>, n long")
    counts = staged(counts.groupBy(names).agg(F.sum("n").alias("n")), "examples")
    met = counts.select(F.explode("features").alias("bucket"), "n").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= MET)
    rows = np.zeros(BUCKETS, np.int32)
    met = sorted(r.bucket for r in met.select("bucket").collect())  # BUCKETS at most
    rows[met] = np.arange(1, len(met) + 1)
    blank = len(met) + 1
    shared = context.broadcast(rows)

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(features=[[int(r) or blank for r in shared.value[np.asarray(f, int)]] or [blank] * FEATURES for f in batch["features"]])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            flat = [batch.column(c).flatten().to_numpy().reshape(-1, k) for c, k in (("others", LABELS), ("features", FEATURES))]
            held.append(np.column_stack([*(batch.column(c).to_numpy() for c in names[1:4]), flat[0], batch.column("n").to_numpy(), flat[1]]).astype(np.int64))
            if sum(map(len, held)) >= BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["block"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["block"])

    alike = counts.mapInPandas(known, counts.schema).groupBy(names).agg(F.sum("n").alias("n"))  # rare features told rows apart
    alike = staged(alike, "examples")
    parts = -(-alike.count() // BLOCK)
    blocks = alike.coalesce(max(1, parts)).sortWithinPartitions(names).mapInArrow(numbers, "block binary").rdd.map(lambda r: bytes(r.block)).persist(StorageLevel.MEMORY_AND_DISK)

    def slopes(state: dict) -> np.ndarray:
        now = context.broadcast(state)
        summed = blocks.treeAggregate(0.0, lambda up, block: up + _slopes(now.value, np.frombuffer(block, np.int64).reshape(-1, 4 + LABELS + FEATURES)), lambda x, y: x + y)
        now.destroy()
        return summed

    model = {"index": Buckets(rows), **_ascend(blank + 1, slopes if parts else None)}
    blocks.unpersist()
    learnt = context.broadcast(model)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            levels: dict[tuple[int, bool], int] = defaultdict(int)
            for text in batch["text"]:
                for belief, right in _hidden(learnt.value, text or ""):
                    levels[sum(belief >= level for level in LEVELS), right] += 1
            yield pd.DataFrame([(k, r, n) for (k, r), n in levels.items()], columns=["level", "right", "n"])

    found = docs.where(hidden).select("text").mapInPandas(named, "level int, right boolean, n long")
    return model | {"threshold": _threshold(found.groupBy("level", "right").agg(F.sum("n").alias("n")).collect())}  # at most two rows a level


def _refused(text: str, tokens: list[tuple[int, int]], fixed: list[int]) -> list[int]:
    """`fixed` with refused tokens observed as none, but for those that are tied to an observed datum."""
    tied = {i for group in _groups(text, tokens) if any(fixed[i] > 0 for i in group) for i in group}
    return [0 if label < 0 and i not in tied and REFUSED.fullmatch(text, *token) else label for i, (label, token) in enumerate(zip(fixed, tokens))]


def _fits(kind: str, text: str) -> bool:
    """Whether a text can be of the kind, however it is written."""
    digits = sum(map(str.isdigit, text))
    return {"email": "@" in text, "ip": text.count(".") >= 3 and 4 <= digits <= 12, "card": 12 <= digits <= 19, "phone": 7 <= digits <= 15}.get(kind, True)


def _named(model: dict, text: str, tokens: list[tuple[int, int]], fixed: list[int], least: float) -> Iterator[tuple[int, int, int, float]]:
    """(first token, end, label, belief) of candidates' unobserved tokens that the field gives a label with the belief `least`
    or more."""
    belief = beliefs(model, text, tokens, fixed)
    for low, high in _candidates(text, tokens):
        free = [i for i in range(low, high) if fixed[i] < 0]
        if free:  # one candidate has one label: its tokens' beliefs are multiplied
            odds = np.log(belief[free] + 1e-30).sum(0)
            odds = np.exp(odds - odds.max())
            odds, label = odds / odds.sum(), int(odds.argmax())
            if label and odds[label] >= least and len(free) == free[-1] - free[0] + 1 and _fits(ALL_KINDS[label - 1], text[tokens[free[0]][0] : tokens[free[-1]][1]]):
                yield free[0], free[-1] + 1, label, float(odds[label])


def _hidden(model: dict, text: str) -> Iterator[tuple[float, bool]]:
    """For each token that the field gives a label to without seeing any base span: its belief, and if the base spans agree."""
    tokens = _tokens(text)
    fixed = _refused(text, tokens, [-1] * len(tokens))
    if -1 in fixed:
        silver = _silver(text, tokens, _groups(text, tokens))
        for low, high, label, belief in _named(model, text, tokens, fixed, 0.0):
            yield from ((belief, silver[i] == label) for i in range(low, high) if silver[i] >= 0)


def _threshold(rows: list) -> float:
    """The least level at which PRECISION of the tokens named are right; rows are (levels reached, right, n)."""
    for k, level in enumerate(LEVELS, 1):
        n = sum(r[2] for r in rows if r[0] >= k)
        if n < SUPPORT:
            return THRESHOLD if k == 1 else level
        if sum(r[2] for r in rows if r[0] >= k and r[1]) >= PRECISION * n:
            return level
    return LEVELS[-1]


def beliefs(model: dict, text: str, tokens: list[tuple[int, int]], fixed: list[int]) -> np.ndarray:
    """Label beliefs of the tokens after loopy messages have converged; fixed labels (not -1) are observed."""
    index, weights = model["index"], model["unary"]
    unary = np.array([weights[[0, *(index[f] for f in _features(text, *t) if f in index)]].sum(0) for t in tokens])
    for i, label in enumerate(fixed):
        if label >= 0:
            unary[i] = -30.0
            unary[i, label] = 0.0
    chain = [i for i in range(len(tokens) - 1) if _chained(tokens, i)]
    groups = _groups(text, tokens)
    star = [(i, len(tokens) + k) for k, g in enumerate(groups) for i in g]  # any two of a group are two steps apart
    unary = np.concatenate([unary, np.zeros((len(groups), LABELS))])
    if chain or star:
        a, b = np.array([*((i, i + 1) for i in chain), *star]).T
        source, target, back = np.r_[a, b], np.r_[b, a], np.r_[len(a) : 2 * len(a), 0 : len(a)]
        tie = np.diag(_ties(model["skip"]))
        gain = np.exp(np.stack([model["chain"], model["chain"].T, tie]))  # from the label of the source to the target's
        kind = np.r_[[0] * len(chain), [2] * len(star), [1] * len(chain), [2] * len(star)].astype(int)
        messages = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            inbox = unary.copy()
            np.add.at(inbox, target, messages)
            out = inbox[source] - messages[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.empty_like(messages)
            for k in range(3):
                new[kind == k] = np.log(out[kind == k] @ gain[k])
            step = 0.5 * (new - new.max(1, keepdims=True) - messages)
            messages = messages + step
            if np.abs(step).max() < TOLERANCE:
                break
        unary = unary.copy()
        np.add.at(unary, target, messages)
    unary = unary[: len(tokens)]
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def all_spans(model: dict, text: str, threshold: float | None = None) -> tuple[list, list]:
    """The base spans, and those with the field's own added, in the same order; the threshold is the model's if not given."""
    threshold = model.get("threshold", THRESHOLD) if threshold is None else threshold
    base = base_spans(text)
    tokens = _tokens(text)
    own = []
    if tokens:
        fixed = _observed(text, tokens, base)
        own = [(*m.span(1), "secret") for m in SECRET.finditer(text)]
        fixed = _refused(text, tokens, fixed)
        if -1 in fixed:
            own += [(tokens[low][0], tokens[high - 1][1], ALL_KINDS[label - 1]) for low, high, label, _ in _named(model, text, tokens, fixed, threshold)]
    return base, sorted(base + own, key=lambda s: (s[0], ALL_KINDS.index(s[2]), s[1]))


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list) -> str:
    """The text with each (merged) span replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find(docs: DataFrame, model: dict, redact: bool = False) -> DataFrame:
    """`docs` with n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans added; with `redact`, text is cleaned instead."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs if redact else docs.drop("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")  # these give way
    columns = docs.columns
    schema = docs.schema if redact else T.StructType([*docs.schema.fields, *T.StructType.fromDDL("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column("text").to_pylist()
                found = [all_spans(shared.value, t or "") for t in texts]
                if redact:
                    clean = pa.array([t if t is None else redacted(t, spans) for t, (_, spans) in zip(texts, found)], pa.string())
                    yield pa.RecordBatch.from_arrays([clean if c == "text" else batch.column(c) for c in columns], names=columns)
                    continue
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
                spans = pa.array([joined(s) for _, s in found], pa.string())
                total = pa.array([len(s) for _, s in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, *counts, digests, spans, total], names=[*columns, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.mapInArrow(run, schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, fit(docs)).drop("text")
