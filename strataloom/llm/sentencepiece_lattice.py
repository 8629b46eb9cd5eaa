"""Sampled SentencePiece segmentation: forward filtering, backward sampling over the piece lattice.

Contract. `encode` adds `piece_ids array<int>`, `decode` turns such a column back into text; decode(encode(t)) is t
for every text. Null text gives null ids and null text; empty text gives the ids of the dummy prefix alone. A row's
draws depend only on its seed column and the positions in its own text: reruns, other partitionings and repeated rows
with one key agree. Other columns pass through unchanged; the added column's name is a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.common import slices, splitmix, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: No piece crosses from a non-space to a space or touches a newline, so the lattice falls apart into these chunks.
CHUNK = re.compile(r" *[^ \n]+| +|\n")


class Vocabulary:
    """Pieces as text (the space mark as a plain space), their log-weights, byte pieces, and a trie in arrays.

    A unigram model's scores are log-probabilities. A BPE model has merge ranks instead; Zipf's law turns rank r
    into log-weight -log(r + 1). `alpha` sharpens (over 1) or flattens the sampling.
    """

    def __init__(self, model_path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(sp.get_piece_size())
        self.bytes_of = [b""] * len(ids)
        self.byte_ids = np.zeros(256, np.int32)
        scores = np.array([sp.get_score(i) for i in ids])
        ranked = scores.min() < -1000
        normal: dict[str, int] = {}
        weights = np.zeros(len(ids))
        for i in ids:
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace("▁", " ")
                self.bytes_of[i] = text.encode()
                if "\n" not in text and " " not in text.lstrip(" "):
                    normal[text] = i
        rank = np.empty(len(ids))
        rank[np.argsort(-scores, kind="stable")] = np.arange(len(ids))
        for i in normal.values():
            weights[i] = alpha * (-np.log(rank[i] + 1) if ranked else scores[i])
        self.weights = weights
        self.unknown = float(weights.min() - 10 * alpha)
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for text, i in normal.items():
            at = 0
            for char in text:
                if (key := (at, ord(char))) not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                at = nodes[key]
            ends[at] = i
        # the trie's edges as an open hash table, at most an eighth full: mostly one look per step
        keys = [(a << 21) | c for a, c in nodes]
        self.bits = max(10, (8 * len(keys)).bit_length())
        self.keys, self.children = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        for key, child, at in zip(keys, nodes.values(), self._slots(np.array(keys, np.int64)).tolist()):
            while self.keys[at] >= 0:
                at = (at + 1) & (len(self.keys) - 1)
            self.keys[at], self.children[at] = key, child
        self.ends = np.array(ends, np.int64)
        self.roots = np.full(0x110000, -1, np.int32)
        for (at, char), child in nodes.items():
            if at == 0:
                self.roots[char] = child

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Child nodes, -1 where there is none."""
        key = (node << 21) | char
        at = self._slots(key)
        held = self.keys[at]
        child = np.where(held == key, self.children[at], -1)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):  # what met another key looks on
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            hit = held == key[open_]
            child[open_[hit]] = self.children[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return child.astype(np.int64)


class Lattice:
    """All segmentations of some chunks, forward filtered: for each node, the cumulative weights of its incoming edges."""

    def __init__(self, vocabulary: Vocabulary, chunks: list[str]):
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        # positions fit in 32 bits: a lattice holds about a slice of characters, or one text of at most 2**31
        stop = np.repeat(np.cumsum(lengths).astype(np.int32), lengths)  # each character's chunk end
        of = np.repeat(np.arange(len(chunks), dtype=np.int32), lengths)
        at, node, depth = np.arange(len(chars), dtype=np.int32), np.zeros(len(chars), np.int64), 0
        starts, ends, pieces = [], [], []
        while len(at):
            node = vocabulary.step(node, chars[at + depth]) if depth else vocabulary.roots[chars].astype(np.int64)
            live = node >= 0
            at, node = at[live], node[live]
            depth += 1
            whole = vocabulary.ends[node]
            hit = whole >= 0
            starts.append(at[hit])
            ends.append(at[hit] + depth)
            pieces.append(whole[hit])
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        covered = np.zeros(len(chars), bool)
        covered[starts[0]] = True
        bare = np.flatnonzero(~covered).astype(np.int32)  # no piece for this character: its bytes
        start = np.concatenate([*starts, bare])
        end = np.concatenate([*ends, bare + 1])
        piece = np.concatenate([*pieces, -1 - chars[bare]])
        weight = np.where(piece >= 0, vocabulary.weights[np.maximum(piece, 0)], vocabulary.unknown)
        chunk = of[start]
        source, target = start + chunk, end + chunk  # a chunk of n characters has n + 1 nodes
        order = np.argsort(target, kind="stable")
        self.source, self.piece = source[order], piece[order]
        target, weight = target[order], weight[order]
        self.last = np.cumsum(lengths) + np.arange(len(chunks))
        self.first = self.last - lengths
        position = target - self.first.astype(np.int32)[chunk[order]]
        if not len(position) or position.max() < 1 << 16:
            position = position.astype(np.uint16)  # sorted by digits, not by comparison
        self.keys = np.empty(len(target))
        filtered = np.zeros(len(chars) + len(chunks))
        by_step = np.argsort(position, kind="stable")
        bounds = np.r_[0, np.cumsum(np.bincount(position, minlength=int(lengths.max(initial=0)) + 1))][1:]
        for low, high in zip(bounds[:-1], bounds[1:]):
            edges = by_step[low:high]
            to = target[edges]
            value = filtered[self.source[edges]] + weight[edges]
            heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            sizes = np.diff(np.r_[heads, len(to)])
            most = np.maximum.reduceat(value, heads)
            share = np.exp(value - np.repeat(most, sizes))
            total = np.add.reduceat(share, heads)
            filtered[to[heads]] = most + np.log(total)
            run = np.cumsum(share)
            base = np.repeat(run[heads] - share[heads], sizes)
            reached = np.minimum((run - base) / np.repeat(total, sizes), 1)
            reached[heads + sizes - 1] = 1
            self.keys[edges] = to + reached

    def sample(self, chunk: np.ndarray, seed: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a segmentation for each occurrence of a chunk; pieces in text order and how many each has."""
        at, live, rounds = self.last[chunk], np.arange(len(chunk)), []
        counts = np.zeros(len(chunk), np.int64)
        step = 0
        while len(live):
            draw = splitmix(seed[live] ^ splitmix((counter[live] << np.uint64(20)) + np.uint64(step)))
            u = (draw >> np.uint64(11)).astype(np.float64) / 2**53
            edge = np.searchsorted(self.keys, at[live] + u, side="right")
            edge = np.minimum(edge, len(self.keys) - 1)
            rounds.append((live, self.piece[edge]))
            counts[live] += 1
            at[live] = self.source[edge]
            live = live[at[live] != self.first[chunk[live]]]
            step += 1
        stop = np.cumsum(counts)
        pieces = np.empty(int(stop[-1]) if len(stop) else 0, np.int64)
        for step, (who, piece) in enumerate(rounds):
            pieces[stop[who] - 1 - step] = piece
        return pieces, counts


def sample_pieces(vocabulary: Vocabulary, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after another, and the offsets of each text's ids."""
    ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for low, high in slices(texts, 400_000):
        chunks = [CHUNK.findall(" " + t) for t in texts[low:high]]
        per_text = np.fromiter(map(len, chunks), np.int64, len(chunks))
        flat = list(chain.from_iterable(chunks))
        distinct = list(dict.fromkeys(flat))
        codes = np.fromiter(map(dict(zip(distinct, range(len(distinct)))).__getitem__, flat), np.int64, len(flat))
        lattice = Lattice(vocabulary, distinct)
        seed = np.repeat(seeds[low:high].astype(np.uint64), per_text)
        first = np.repeat(np.cumsum(per_text) - per_text, per_text)
        pieces, counts = lattice.sample(codes, seed, (np.arange(len(codes)) - first).astype(np.uint64))
        widths = np.ones(len(pieces), np.int64)
        bare = np.flatnonzero(pieces < 0)
        spelled = {int(c): vocabulary.byte_ids[list(chr(-1 - c).encode("utf-8", "surrogatepass"))] for c in np.unique(pieces[bare])}
        if len(bare):
            widths[bare] = [len(spelled[int(c)]) for c in pieces[bare]]
        out = np.repeat(pieces, widths).astype(np.int32)
        stop = np.cumsum(widths)
        for code, own in spelled.items():
            where = bare[pieces[bare] == code]
            for k, byte in enumerate(own):
                out[stop[where] - len(own) + k] = byte
        occurrence = np.repeat(np.arange(len(counts)), counts)
        of_text = np.repeat(np.arange(len(per_text)), per_text)[occurrence]
        ids.append(out)
        sizes.append(np.bincount(of_text, widths, len(per_text)).astype(np.int64))
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def spell(bytes_of: list[bytes], ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of consecutive runs of piece ids, without the dummy prefix; bytes that are not UTF-8 become U+FFFD."""
    parts = list(map(bytes_of.__getitem__, ids.tolist()))
    return [b"".join(parts[a:b])[1:].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "piece_ids", model_path: str = MODEL, alpha: float = 1.0, seed: int = 0, verified: str | None = None) -> DataFrame:
    """Add sampled piece ids of `text`, drawn from a generator seeded by `key` and `seed`.

    With `verified`, a boolean column of that name tells whether the ids decode to the very text; the text is dropped.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(model_path, alpha))  # one model: about 7 MB
    docs = docs.drop(out, *([verified] if verified else []))  # columns of these names give way
    columns = [c for c in docs.columns if not verified or c != text]
    keyed = docs.withColumn("_seed", F.xxhash64(F.col(key), F.lit(seed)))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    schema = schema.add(verified, "boolean") if verified else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 200):
                batch = whole.slice(low, 200)
                texts = batch.column(text).to_pylist()
                known = [i for i, t in enumerate(texts) if t is not None]
                seeds = batch.column("_seed").to_numpy(zero_copy_only=False)[known].view(np.uint64)
                ids, offsets = sample_pieces(vocabulary.value, [texts[i] for i in known], seeds)
                lengths = np.zeros(len(texts), np.int64)
                lengths[known] = np.diff(offsets)
                ends = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
                mask = pa.array(np.array([t is None for t in texts], bool))
                lists = pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()), mask=mask)
                added = {out: lists}
                if verified:
                    spelled = spell(vocabulary.value.bytes_of, ids, offsets)
                    same = [True] * len(texts)
                    for i, back in zip(known, spelled):
                        same[i] = back == texts[i]
                    added[verified] = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *added.values()], names=[*columns, *added])

    return keyed.mapInArrow(run, schema)


def decode(frame: DataFrame, ids: str = "piece_ids", out: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """Add the text that a column of piece ids stands for; bytes that are not UTF-8 become U+FFFD."""
    table_of = frame.sparkSession.sparkContext.broadcast(Vocabulary(model_path).bytes_of)

    @F.pandas_udf("string")
    def text_of(column):
        return column.map(lambda x: None if x is None else spell(table_of.value, x, np.array([0, len(x)]))[0])

    return frame.withColumn(out, text_of(F.col(ids)))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document, and whether they decode to its very text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, verified="lossless")
    return coded.select("doc_id", "piece_ids", F.size("piece_ids").alias("n_pieces"), "lossless")
