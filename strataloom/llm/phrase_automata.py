"""Collocations from weighted acyclic automata.

A count transducer is an acyclic automaton over words whose arcs carry how often the phrase that ends with them occurs.
It is built from a shard's sorted phrases, level by level from the deepest, each state being registered under its arcs, so
that like states are one. An arc's weight is the sum of those behind it and of the phrases that end with it; one path of
`longest` words per position therefore counts all phrases that begin there.

Two rounds. The first counts words and pairs; a bit table of fixed size remembers which of them occur `least` times or
more. The second follows a position only through words and pairs that the table holds (every part of a frequent phrase is
frequent, so nothing is lost; what the table wrongly holds is pruned by the exact counts). Each round cuts its shards'
transducers at the same bounds into ranges of prefixes; a range's parts are united, weights summed, and pruned. A phrase
that is a prefix of a bound is counted in several ranges; these few sums are added up apart, and the last range owns it.

A phrase's first words lie on its own path. Its other parts are gathered per range into an acceptor, one for each range
that they lie in, which is composed with that range's transducer; the weights come back the same way. A part that many
phrases have is asked for once a range, so no hot word gathers rows.

Contract. Null text has no words, null lang is `und`. Rows that repeat count again. Counts and scores are exact integers.
No documents make no rows. Columns other than lang and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.llm.common import slices, splitmix, staged, table

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words that a shard holds before it is sorted; phrases in one stored transducer; phrases per probe for the bounds.
TOKENS, CHUNK, EVERY = 2_000_000, 1 << 18, 1 << 12
#: Slots of the bit table (2**27 bits are 16 MB, at any size of the input).
SLOTS = 27
#: No UTF-8 text holds this byte: it stands for the end of a piece, and sorts behind every word.
GAP = b"\xff"
_MARKS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes(0xFF if i in _MARKS else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))

Key = tuple[bytes, ...]


def sums(parent: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of `values` for each of n parents, exact; `parent` ascends."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    at = np.searchsorted(parent, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def aggregate(paths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of `paths` (-1: no word) and their counts' sums."""
    if not len(paths):
        return paths, counts.astype(np.int64)
    wide = np.concatenate([paths + 1, np.zeros((len(paths), paths.shape[1] % 2), paths.dtype)], axis=1).astype(np.uint64)
    keys = [(wide[:, j] << np.uint64(32)) | wide[:, j + 1] for j in range(0, wide.shape[1], 2)]
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    first = np.zeros(len(paths), bool)
    first[0] = True
    for key in keys:
        sorted_ = key[order]
        first[1:] |= sorted_[1:] != sorted_[:-1]
    starts = np.flatnonzero(first)
    return paths[order[starts]], np.add.reduceat(counts[order].astype(np.int64), starts)


class Automaton:
    """`words` in byte order; a level has its states' numbers of arcs, and the arcs' labels, weights and target states."""

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, ...]]):
        self.words, self.levels = words, levels

    @classmethod
    def build(cls, words: list[bytes], paths: np.ndarray, counts: np.ndarray) -> Automaton:
        """From sorted distinct paths, whose labels are places in `words`."""
        used = np.unique(paths[paths >= 0])
        paths = np.where(paths >= 0, np.searchsorted(used, paths), -1)
        arcs, parent, fresh = [], np.zeros(len(paths), np.int64), np.zeros(len(paths), bool)
        fresh[:1] = True
        for labels in paths.T:
            fresh[1:] |= labels[1:] != labels[:-1]
            there = np.flatnonzero(labels >= 0)
            if not len(there):
                break
            begins = fresh[there]
            starts = np.flatnonzero(begins)
            arcs.append((parent[there[starts]], labels[there[starts]], np.add.reduceat(counts[there].astype(np.int64), starts)))
            parent = parent.copy()
            parent[there] = np.cumsum(begins) - 1
        levels, target = [], np.zeros(len(arcs[-1][0]) if arcs else 0, np.int64)
        for d in range(len(arcs) - 1, -1, -1):
            of, labels, weights = arcs[d]
            n = len(arcs[d - 1][0]) if d else 1
            sizes = np.diff(np.searchsorted(of, np.arange(n + 1)))
            level, target = cls._register(sizes, labels, weights, target)
            levels.insert(0, level)
        return cls([words[i] for i in used], levels)

    @staticmethod
    def _register(sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, targets: np.ndarray) -> tuple:
        """The level with each state once, and which of them each state is."""
        begins = np.cumsum(sizes) - sizes
        signs = splitmix(splitmix(splitmix(labels.astype(np.uint64)) ^ weights.astype(np.uint64)) ^ targets.astype(np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(signs, dtype=np.uint64)])
        _, kept, state = np.unique(total[begins + sizes] - total[begins], return_index=True, return_inverse=True)
        here = np.arange(len(labels)) - np.repeat(begins, sizes)
        of = np.repeat(np.arange(len(sizes)), sizes)
        same = np.array_equal(sizes, sizes[kept[state]])
        if same:
            twin = begins[kept[state]][of] + here
            same = all(np.array_equal(x, x[twin]) for x in (labels, weights, targets))
        if not same:  # two signatures met by chance: no state is shared at this level
            kept = state = np.arange(len(sizes))
        arc = np.repeat(begins[kept], sizes[kept]) + np.arange(sizes[kept].sum()) - np.repeat(np.cumsum(sizes[kept]) - sizes[kept], sizes[kept])
        return (sizes[kept], labels[arc], weights[arc], targets[arc]), state

    def nodes(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All phrases by length, in order: (place of the phrase without its last word, last word, weight)."""
        out, state = [], np.zeros(1, np.int64)
        for sizes, labels, weights, targets in self.levels:
            n = sizes[state]
            arc = np.repeat((np.cumsum(sizes) - sizes)[state] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((np.repeat(np.arange(len(state)), n), labels[arc], weights[arc]))
            state = targets[arc]
        return out

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted paths that it was built from, and their counts."""
        nodes, deep = self.nodes(), len(self.levels)
        rows, counts, above = [np.zeros((0, max(deep, 1)), np.int64)], [np.zeros(0, np.int64)], np.full((1, deep), -1)
        for d, (parent, label, weight) in enumerate(nodes):
            above = above[parent]
            above[:, d] = label
            own = weight - sums(nodes[d + 1][0], nodes[d + 1][2], len(weight)) if d + 1 < deep else weight
            rows.append(above[own > 0])
            counts.append(own[own > 0])
        return aggregate(np.concatenate(rows), np.concatenate(counts))

    def compose(self, other: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The paths of `other` with their own counts there and their phrases' weights here (0: not here)."""
        rows, counts = other.paths()
        place = {w: i for i, w in enumerate(self.words)}
        labels = np.array([place.get(w, len(self.words)) for w in other.words] + [-1], np.int64)[rows]
        return rows, counts, self.weights(labels)[0]

    def weights(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of labels (-1: ended; len(words): unknown) their weights, and how often they occur as whole paths."""
        state, weight, alive = np.zeros(len(labels), np.int64), np.zeros(len(labels), np.int64), np.ones(len(labels), bool)
        depth, width = (labels >= 0).sum(axis=1), len(self.words) + 1
        whole = np.zeros(len(labels), np.int64)
        for d in range(labels.shape[1]):
            on = np.flatnonzero(alive & (depth > d))
            if not len(on):
                break
            if d >= len(self.levels):
                weight[on] = whole[on] = 0
                break
            sizes, arcs, values, targets = self.levels[d]
            keys = np.repeat(np.arange(len(sizes)), sizes) * width + arcs
            asked = state[on] * width + labels[on, d]
            at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
            hit = keys[at] == asked if len(keys) else np.zeros(len(on), bool)
            alive[on[~hit]] = False
            weight[on] = np.where(hit, values[at] if len(keys) else 0, 0)
            state[on] = np.where(hit, targets[at] if len(keys) else 0, 0)
            behind = np.zeros(len(on), np.int64)
            if d + 1 < len(self.levels):
                after = self.levels[d + 1]
                behind = sums(np.repeat(np.arange(len(after[0])), after[0]), after[2], len(after[0]))[state[on]]
            whole[on] = np.where(hit, weight[on] - behind, 0)
        return weight, whole

    def dump(self) -> bytes:
        parts = [GAP.join(self.words)]
        for level in self.levels:
            for values in level:
                top = int(values.max()) if len(values) else 0
                parts.append(values.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * int(t[2]))).tobytes())
        heads = [struct.pack("<II", len(self.words), len(self.levels)), *[struct.pack("<I", len(v)) for level in self.levels for v in level]]
        return zstandard.ZstdCompressor(level=1).compress(b"".join([*heads, *[struct.pack("<Q", len(p)) for p in parts], *parts]))

    @classmethod
    def load(cls, blob: bytes) -> Automaton:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n_words, deep = struct.unpack_from("<II", data)
        counts = struct.unpack_from(f"<{4 * deep}I", data, 8)
        at = 8 + 16 * deep
        sizes = struct.unpack_from(f"<{4 * deep + 1}Q", data, at)
        at += 8 * len(sizes)
        words = data[at : at + sizes[0]].split(GAP) if n_words else []
        at, arrays = at + sizes[0], []
        for n, size in zip(counts, sizes[1:]):
            arrays.append(np.frombuffer(data, f"<u{size // n if n else 1}", n, at).astype(np.int64))
            at += size
        return cls(words, [tuple(arrays[i : i + 4]) for i in range(0, len(arrays), 4)])


def united(parts: list[tuple[list[bytes], np.ndarray, np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, sorted paths and summed counts of all parts."""
    words = sorted(set().union(*[p[0] for p in parts]))
    place = {w: i for i, w in enumerate(words)}
    deep = max(p[1].shape[1] for p in parts)
    rows = []
    for own, paths, _ in parts:
        moved = np.array([place[w] for w in own] + [-1], np.int64)[paths]
        rows.append(np.concatenate([moved, np.full((len(moved), deep - moved.shape[1]), -1)], axis=1))
    return words, *aggregate(np.concatenate(rows), np.concatenate([p[2] for p in parts]))


def key_of(words: list[bytes], row: np.ndarray) -> Key:
    return tuple(words[i] for i in row if i >= 0)


def place_in(words: list[bytes], paths: np.ndarray, key: Key) -> int:
    """How many of the sorted paths lie before `key`."""
    return bisect_left(range(len(paths)), key, key=lambda i: key_of(words, paths[i]))


def slots(lang: str, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Two places in the bit table, one row each, for words (or pairs of them) given by their hashes."""
    mixed = splitmix(first ^ np.uint64(xxhash.xxh3_64_intdigest(lang)))
    mixed = mixed if second is None else splitmix(splitmix(mixed) ^ second)
    return np.stack([mixed & np.uint64((1 << SLOTS) - 1), mixed >> np.uint64(64 - SLOTS)]).astype(np.int64)


def held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(lang: str, words: list[bytes], codes: np.ndarray, longest: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paths of up to `longest` words from every position, and their counts; code -1 is a gap."""
    codes = np.concatenate([codes, np.full(longest, -1, codes.dtype)])
    go_on = np.ones(len(codes) - 1, bool)
    if bits is not None:
        named = hashes(words)
        codes = np.where((codes >= 0) & np.append(held(bits, slots(lang, named)), False)[codes], codes, -1)
        both = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
        go_on[both] = held(bits, slots(lang, named[codes[both]], named[codes[both + 1]]))
    at = np.flatnonzero(codes >= 0)
    columns = [codes[at]]
    for j in range(1, longest):
        columns.append(np.where((columns[-1] >= 0) & go_on[np.minimum(at + j - 1, len(go_on) - 1)], codes[np.minimum(at + j, len(codes) - 1)], -1))
    paths = np.stack(columns, axis=1)
    alone = paths[:, 1] < 0 if longest > 1 else np.ones(len(paths), bool)  # most, in the second round
    single = np.bincount(paths[alone, 0], minlength=len(words))
    some = np.flatnonzero(single)
    ones = np.full((len(some), longest), -1, paths.dtype)
    ones[:, 0] = some
    rest = paths[~alone]
    return aggregate(np.concatenate([ones, rest]), np.concatenate([single[some], np.ones(len(rest), np.int64)]))


def shards(docs: DataFrame, longest: int, bits=None, tokens: int = TOKENS, chunk: int = CHUNK, every: int = EVERY) -> DataFrame:
    """(lang, n, probes, blob): count transducers of the documents' phrases, each of a bounded part of a task's words; n
    words begin their paths, `probes` are evenly spaced ones of these."""

    def flush(lang: str, place: dict[bytes, int], arrays: list[np.ndarray]) -> Iterator[tuple]:
        words = sorted(w for w in place if w != GAP)
        rank = np.full(len(place), -1, np.int64)
        rank[np.fromiter((place[w] for w in words), np.int64, len(words))] = np.arange(len(words))
        paths, counts = windows(lang, words, rank[np.concatenate(arrays)], longest, None if bits is None else bits.value)
        for low in range(0, len(paths), chunk):
            some, n = paths[low : low + chunk], counts[low : low + chunk]
            blob = Automaton.build(words, some, n).dump()
            probes = [GAP.join(key_of(words, some[i])) for i in range(zlib.crc32(blob) % every, len(some), every)]
            yield lang, int(n.sum()), probes, blob

    kinds = [pa.string(), pa.int64(), pa.list_(pa.binary()), pa.binary()]

    def batch_of(row: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["lang", "n", "probes", "blob"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        waiting = 0
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for low, high in slices(own, 1_000_000):
                    joined = "\n".join(own[low:high]).encode("utf-8", "surrogatepass").translate(_LOWER)
                    place, arrays = open_.setdefault(lang, ({GAP: 0}, []))
                    split = joined.replace(GAP, b" \xff ").split(b" ")
                    for word in set(split).difference(place):
                        if word:
                            place[word] = len(place)
                    split = [t for t in split if t]
                    arrays.append(np.fromiter(map(place.__getitem__, split), np.int32, len(split)))
                    arrays.append(np.zeros(1, np.int32))
                    waiting += len(split)
                    if waiting >= tokens:
                        for name, (names, lists) in open_.items():
                            yield from map(batch_of, flush(name, names, lists))
                        open_, waiting = {}, 0
        for name, (names, lists) in open_.items():
            yield from map(batch_of, flush(name, names, lists))

    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    return read.mapInArrow(work, "lang string, n long, probes array<binary>, blob binary")


class Bounds:
    """Bounds of the ranges of prefixes: keys (language, words) in order."""

    def __init__(self, keys: list[Key]):
        self.keys = keys

    @classmethod
    def of(cls, made: DataFrame, parts: int) -> Bounds:
        """About `parts` ranges of even size, from the shards' probes; the driver gets some 20 probes a range."""
        probes = made.select("lang", F.explode("probes").alias("key"))
        every = max(1, probes.count() // (20 * parts))
        some = probes.where(F.pmod(F.xxhash64("lang", "key"), F.lit(every)) == 0).collect()
        keys = sorted((r.lang.encode(), *bytes(r.key).split(GAP)) for r in some)
        return cls(sorted({keys[len(keys) * i // parts] for i in range(1, parts)} if keys else set()))

    def part(self, key: Key) -> int:
        """The range that owns a phrase: the last one that paths beginning with it lie in."""
        return bisect_left(self.keys, (*key, GAP))

    def edges(self, part: int, lang: bytes) -> set[Key]:
        """The phrases of a language whose paths also lie in a neighbouring range."""
        near = self.keys[max(part - 1, 0) : part + 1]
        return {key[1:k] for key in near if key[0] == lang for k in range(2, len(key))}

    def cut(self, lang: bytes, words: list[bytes], paths: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(part, low, high): which of the sorted paths lie in which range."""
        low, part = 0, bisect_left(self.keys, (lang,))
        while low < len(paths):
            here = part < len(self.keys) and self.keys[part][0] == lang
            high = place_in(words, paths, self.keys[part][1:]) if here else len(paths)
            if high > low:
                yield part, low, high
            low, part = high, part + 1


def union(made: DataFrame, bounds: Bounds, parts: int, least: int) -> DataFrame:
    """(part, lang, blob, edges): the pruned transducer of each range and language, and the range's share in the phrases
    that neighbouring ranges count too."""
    shared = made.sparkSession.sparkContext.broadcast(bounds)  # some `parts` keys

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole, out = Automaton.load(blob), []
                paths, counts = whole.paths()
                for part, low, high in shared.value.cut(lang.encode(), whole.words, paths):
                    out.append((part, lang, Automaton.build(whole.words, paths[low:high], counts[low:high]).dump()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.string(), pa.binary()])], names=["part", "lang", "blob"])

    def prune(part: int, lang: str, words: list[bytes], paths: np.ndarray, counts: np.ndarray) -> tuple:
        depth, parent, fresh = np.zeros(len(paths), np.int64), None, np.zeros(len(paths), bool)
        fresh[:1] = True
        for d, labels in enumerate(paths.T):
            fresh[1:] |= labels[1:] != labels[:-1]
            parent = np.cumsum(fresh) - 1
            weight = sums(parent, counts, int(parent[-1]) + 1)[parent]
            depth = np.where((labels >= 0) & (weight >= least), d + 1, depth)
        edges = []
        for key in sorted(shared.value.edges(part, lang.encode())):
            low, high = place_in(words, paths, key), place_in(words, paths, (*key, GAP))
            if high > low:
                edges.append({"phrase": GAP.join(key), "f": int(counts[low:high].sum())})
                depth[low:high] = np.maximum(depth[low:high], len(key))
        kept = depth > 0
        short = np.where(np.arange(paths.shape[1]) < depth[kept, None], paths[kept], -1)
        return part, lang, Automaton.build(words, *aggregate(short, counts[kept])).dump(), edges

    kinds = [pa.int32(), pa.string(), pa.binary(), pa.list_(pa.struct([("phrase", pa.binary()), ("f", pa.int64())]))]

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sofar: dict[tuple[int, str], list] = {}
        for batch in batches:
            for part, lang, blob in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                one = Automaton.load(blob)
                waiting = sofar.setdefault((part, lang), [])
                waiting.append((one.words, *one.paths()))
                if sum(len(p[1]) for p in waiting[1:]) > len(waiting[0][1]) + CHUNK:
                    waiting[:] = [united(waiting)]
        for (part, lang), waiting in sofar.items():
            row = prune(part, lang, *united(waiting))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["part", "lang", "blob", "edges"])

    cut = made.select("lang", "blob").mapInArrow(split, "part int, lang string, blob binary")
    return cut.repartitionById(parts, F.col("part")).mapInArrow(unite, "part int, lang string, blob binary, edges array<struct<phrase: binary, f: long>>")


def frequent_bits(first: DataFrame, least: int) -> np.ndarray:
    """The bit table of the words and pairs that occur `least` times or more (and of some that don't)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob, edges in zip(*(batch.column(c).to_pylist() for c in ("lang", "blob", "edges"))):
                one = Automaton.load(blob)
                named, nodes = hashes(one.words), one.nodes()
                sure = {tuple(bytes(e["phrase"]).split(GAP)) for e in edges}
                found = [np.zeros(0, np.int64)]
                for d, (parent, label, weight) in enumerate(nodes[:2]):
                    often = weight >= least
                    if not d:
                        often |= np.array([(one.words[i],) in sure for i in label], bool)
                    found += [*slots(lang, named[label[often]])] if not d else [*slots(lang, named[nodes[0][1][parent[often]]], named[label[often]])]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)) + 1)], names=["slot"])

    marked = first.select("lang", "blob", "edges").mapInArrow(work, "slot long")
    rows = marked.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = np.zeros(1 << (SLOTS - 3), np.uint8)
    for row in rows.collect():  # 2**SLOTS bits in all, whatever the input
        bits[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return bits


class Phrases:
    """The phrases of one range and language with their weights, in full for those that other ranges count too."""

    def __init__(self, part: int, lang: str, blob: bytes, bounds: Bounds, totals: dict[Key, int]):
        self.automaton, self.part, self.lang, self.bounds = Automaton.load(blob), part, lang.encode(), bounds
        self.words, self.levels = self.automaton.words, []
        above = np.zeros((1, 0), np.int64)
        for parent, label, weight in self.automaton.nodes():
            above = np.concatenate([above[parent], label[:, None]], axis=1)
            self.levels.append((above, parent, weight.copy()))
        self.foreign: set[Key] = set()
        self.totals = {}
        for key in bounds.edges(part, self.lang):
            if len(key) <= len(self.levels):
                at = place_in(self.words, self.levels[len(key) - 1][0], key)
                paths = self.levels[len(key) - 1][0]
                if at < len(paths) and key_of(self.words, paths[at]) == key:
                    self.levels[len(key) - 1][2][at] = self.totals[key] = totals[key]
                    if bounds.part((self.lang, *key)) != part:
                        self.foreign.add(key)

    def candidates(self, least: int) -> Iterator[tuple[Key, list[int], bool]]:
        """(phrase, weights of its first 1, 2 ... words, it contains no word more on the right with as many) for each phrase
        of two words or more that occurs `least` times."""
        for d in range(1, len(self.levels)):
            paths, _, weights = self.levels[d]
            open_ = np.ones(len(weights), bool)
            if d + 1 < len(self.levels):
                _, parent, after = self.levels[d + 1]
                open_[parent[after >= weights[parent]]] = False
            for at in np.flatnonzero(weights >= least):
                key, chain, up = key_of(self.words, paths[at]), [], at
                for level in range(d, -1, -1):
                    chain.append(int(self.levels[level][2][up]))
                    up = self.levels[level][1][up]
                if key not in self.foreign:
                    yield key, chain[::-1], bool(open_[at])

    def weigh(self, asked: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The paths of `asked`, their counts there and their weights here."""
        rows, counts, weights = self.automaton.compose(asked)
        for key, total in self.totals.items():
            at = place_in(asked.words, rows, key)
            if at < len(rows) and key_of(asked.words, rows[at]) == key:
                weights[at] = total
        return rows, counts, weights


def pack_keys(values: dict[Key, int]) -> bytes:
    """An automaton whose whole paths are the keys, with the (positive) values as counts."""
    words = sorted(set().union(*values)) if values else []
    place, deep = {w: i for i, w in enumerate(words)}, max(map(len, values), default=1)
    paths = np.array([[place[w] for w in key] + [-1] * (deep - len(key)) for key in values], np.int64).reshape(-1, deep)
    return Automaton.build(words, *aggregate(paths, np.array(list(values.values()), np.int64))).dump()


def unpack_keys(blob: bytes) -> dict[Key, int]:
    one = Automaton.load(blob)
    rows, counts = one.paths()
    return {key_of(one.words, row): int(n) for row, n in zip(rows, counts)}


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, **shard: int) -> DataFrame:
    """Each language's `top` phrases of two to `longest` words: (lang, rank, phrase, a, l, r, n, score). `shard` holds sizes
    of the shards; they don't change the result."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = staged(shards(docs, 2, **shard), "words")
    sizes = staged(first.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    bits = spark.sparkContext.broadcast(frequent_bits(staged(union(first, Bounds.of(first, parts), parts, least), "pairs"), least))
    second = staged(shards(docs, longest, bits, **shard), "phrases")
    bounds = Bounds.of(second, parts)
    ranges = staged(union(second, bounds, parts, least), "ranges")
    totals: dict[str, dict[Key, int]] = {}
    shares = ranges.select("lang", F.explode("edges").alias("e")).groupBy("lang", "e.phrase").agg(F.sum("e.f").alias("f"))
    for row in shares.collect():  # less than 2 * longest a bound
        totals.setdefault(row.lang, {})[tuple(bytes(row.phrase).split(GAP))] = row.f
    shared = spark.sparkContext.broadcast((bounds, totals))

    def phrases(part: int, lang: str, blob: bytes) -> Phrases:
        bounds, totals = shared.value
        return Phrases(part, lang, blob, bounds, totals.get(lang, {}))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lang, blob in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                own, asked = phrases(part, lang, blob), {}
                for key, chain, _ in own.candidates(least):
                    for k in range(1, len(key)):
                        # a part's count is 1, or 1 more than the greatest weight of a phrase with one word more
                        to = asked.setdefault(own.bounds.part((own.lang, *key[k:])), {})
                        to[key[k:]] = max(to.get(key[k:], 1), 1 + chain[-1] if k == 1 else 1)
                    if key[:-1] in own.foreign:
                        to = asked.setdefault(own.bounds.part((own.lang, *key[:-1])), {})
                        to[key[:-1]] = max(to.get(key[:-1], 1), 1 + chain[-1])
                out = [(to, part, lang, pack_keys(keys)) for to, keys in asked.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.int32(), pa.string(), pa.binary()])], names=["part", "asker", "lang", "blob"])

    def answer(held_: pa.Table, asked: pa.Table) -> pa.Table:
        own = {r["lang"]: phrases(r["part"], r["lang"], r["blob"]) for r in held_.to_pylist()}
        out, within = [], {}
        for row in asked.to_pylist():
            acceptor = Automaton.load(row["blob"])
            rows, counts, weights = own[row["lang"]].weigh(acceptor)
            out.append((row["asker"], row["lang"], False, Automaton.build(acceptor.words, rows, weights).dump()))
            gone = within.setdefault((row["part"], row["lang"]), {})
            gone |= {key_of(acceptor.words, r): 1 for r in rows[(counts - 1 >= weights) & (rows[:, min(1, rows.shape[1] - 1)] >= 0)]}
        out += [(part, lang, True, pack_keys(keys)) for (part, lang), keys in within.items() if keys]
        kinds = [pa.int32(), pa.string(), pa.bool_(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)], names=["part", "lang", "within", "blob"])

    def score(held_: pa.Table, answers: pa.Table) -> pa.Table:
        weight: dict[str, dict[Key, int]] = {}
        gone: dict[str, set[Key]] = {}
        for row in answers.to_pylist():
            if row["within"]:
                gone.setdefault(row["lang"], set()).update(unpack_keys(row["blob"]))
            else:
                weight.setdefault(row["lang"], {}).update(unpack_keys(row["blob"]))
        out = []
        for row in held_.to_pylist():
            lang, n, best = row["lang"], row["n"], []
            for key, chain, alone in phrases(row["part"], lang, row["blob"]).candidates(least):
                if alone and key not in gone.get(lang, ()):
                    a = chain[-1]
                    cuts = [(1000 * a * n // (chain[k - 1] * weight[lang][key[k:]]), k) for k in range(1, len(key))]
                    least_, k = min(cuts)
                    best.append((-least_, -a, b" ".join(key), chain[k - 1], weight[lang][key[k:]]))
            out += [(lang, p.decode("utf-8", "surrogatepass"), -a, left, right, n, -s) for s, a, p, left, right in sorted(best)[:top]]
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 5]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=["lang", "phrase", "a", "l", "r", "n", "score"])

    held_ = ranges.select("part", "lang", "blob")
    asked = held_.mapInArrow(ask, "part int, asker int, lang string, blob binary")
    answers = staged(held_.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(answer, "part int, lang string, within boolean, blob binary"), "answers")
    counted = held_.join(sizes, "lang")
    scored = counted.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(score, "lang string, phrase string, a long, l long, r long, n long, score long")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest collocations of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, w FROM (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
      FROM documents WHERE text IS NOT NULL
    )
  ) WHERE len(w) > 0
), t AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), n AS (
  SELECT lang, count(*) AS n FROM t GROUP BY lang
), f AS (
  SELECT lang, k, w[i : i + k - 1] AS p, count(*) AS f FROM t, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)
  GROUP BY 1, 2, 3 HAVING count(*) >= 100
), c AS (
  SELECT * FROM f WHERE k >= 2
), inside AS (
  SELECT DISTINCT c.lang, c.p FROM (
    SELECT lang, f, unnest([p[1 : k - 1], p[2 : k]]) AS p FROM c WHERE k >= 3
  ) longer JOIN c ON c.lang = longer.lang AND c.p = longer.p AND longer.f >= c.f
), cuts AS (
  SELECT lang, k, p, f AS a, unnest(range(1, k)) AS j FROM c WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = c.lang AND inside.p = c.p)
), s AS (
  SELECT cuts.lang, cuts.p, j, a, x.f AS l, y.f AS r, n,
         CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN n USING (lang)
  JOIN f x ON x.lang = cuts.lang AND x.p = cuts.p[1 : j] JOIN f y ON y.lang = cuts.lang AND y.p = cuts.p[j + 1 : cuts.k]
), b AS (
  SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang, p ORDER BY score, j) AS least FROM s
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE least = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""
