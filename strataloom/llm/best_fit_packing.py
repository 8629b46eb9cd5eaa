"""Packing documents into sequences by minimum bin slack.

Documents become token ids with an end id; longer ones are cut into pieces of the capacity. Only the lengths matter to a
plan, so it is made on their histogram, which has no more rows than the capacity. Per bin: the longest piece left goes
in, then a subset-sum over the lengths left (a bitset; a length as often as pieces of it are left) finds the fullest
feasible filling, longer pieces first. The same filling is taken as often as its lengths last, and is removed; each
filling uses up a length, or lowers how often it can be used, so there are fewer fillings than
sum(capacity // length), some 16,000 at 2048, for any number of documents. Pieces are numbered within their length in
Spark, and a piece's number tells its sequence and offset.

Contract. Null text counts as empty: the end id alone. Rows that repeat are pieces of their own. No documents make no
rows. Token ids are those of the whole text: a text is cut at ASCII white space, which the tokenizer drops, and a
worker looks each distinct chunk up once. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.llm.common import slices, staged, table

CAPACITY, END = 2048, 0
#: A chunk of letters, then marks: the pre-tokenizer cuts between the two, and nowhere else.
MARKS = b'.,;:!?()#&*%$|<>"'
PLAIN = re.compile(rb"([A-Za-z]*)([" + re.escape(MARKS) + rb"]*)")
_KNOWN: dict[str, Chunks] = {}


class _Rows(dict):
    """Chunks' numbers; one that is asked for the first time gets the next number and is noted as new."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self.new.append(chunk)
        self[chunk] = row = len(self)
        return row


class Chunks:
    """Token ids of chunks of text, kept while there are at most `most` of them."""

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        model = json.loads(self.tokenizer.to_str())["model"]
        self.closing = np.zeros(max(model["vocab"].values()) + 1, bool)  # the tokens that end a piece of the pre-tokenizer
        self.closing[[i for token, i in model["vocab"].items() if token.endswith(model["end_of_word_suffix"])]] = True
        self.clear()

    @classmethod
    def of(cls, path: str) -> Chunks:
        """One for each worker and file, so that a worker's tasks share it."""
        if path not in _KNOWN:
            _KNOWN[path] = cls(path)
        return _KNOWN[path]

    def clear(self) -> None:
        self.rows = _Rows()
        self.ids, self.starts, self.sizes = array("I"), array("q"), array("q")

    def piece(self, letters: bytes) -> list[int]:
        """The ids of ASCII letters or marks, which stand for themselves, in lower case."""
        row = self.rows.get(letters)
        if row is not None and row < len(self.starts):
            return self.ids[self.starts[row] : self.starts[row] + self.sizes[row]].tolist()
        return [t.id for t in self.tokenizer.model.tokenize(letters.decode())]

    def learn(self) -> None:
        """Look up the chunks that are new in `rows`."""
        new, letters, hard = self.rows.new, [], []
        found: list = [None] * len(new)
        for i, chunk in enumerate(new):
            plain = PLAIN.fullmatch(chunk)
            if plain:
                found[i] = [*(self.piece(plain[1].lower()) if plain[1] else ()), *(self.piece(plain[2]) if plain[2] else ())]
            else:
                (letters if chunk.rstrip(MARKS).decode("utf-8", "replace").isalpha() else hard).append(i)
        for low in range(0, len(letters), 5000):  # letters alone are a piece each, so a joined text falls apart again
            some = letters[low : low + 5000]
            ids = np.array(self.tokenizer.encode(b" ".join(new[i].rstrip(MARKS) for i in some).decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.closing[ids]) + 1 if len(ids) else ids
            if len(stops) == len(some):
                for i, low_, high in zip(some, [0, *stops.tolist()], stops.tolist()):
                    tail = new[i][len(new[i].rstrip(MARKS)) :]
                    found[i] = [*ids[low_:high].tolist(), *(self.piece(tail) if tail else ())]
            else:  # a letter that is none in lower case
                hard += some
        coded = self.tokenizer.encode_batch_fast([new[i].decode("utf-8", "replace") for i in hard], add_special_tokens=False)
        for i, c in zip(hard, coded):
            found[i] = c.ids
        for ids in found:
            self.starts.append(len(self.ids))
            self.sizes.append(len(ids))
            self.ids.extend(ids)
        self.rows.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, END behind each text, and where each text's ids stop."""
        if len(self.rows) > self.most:
            self.clear()
        lists = [text.encode("utf-8", "replace").split() for text in texts]
        n = np.array([len(x) for x in lists])
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(lists)), np.int64, n.sum())
        self.learn()
        sizes, starts = np.frombuffer(self.sizes, np.int64)[rows] if len(rows) else rows, np.frombuffer(self.starts, np.int64)[rows] if len(rows) else rows
        total = np.concatenate([[0], np.cumsum(sizes)])
        stops = total[np.cumsum(n)] + np.arange(1, len(texts) + 1)
        flat = np.full(stops[-1] if len(stops) else 0, END, np.uint32)
        inner = np.ones(len(flat), bool)
        inner[stops - 1] = False
        flat[inner] = np.frombuffer(self.ids, np.uint32)[np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])] if len(rows) else 0
        return flat, stops


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, ids: one row for each piece of each document."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks.of(path)
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            nulls, doc_ids = batch.column(0).is_null().to_numpy(zero_copy_only=False), batch.column(0).fill_null(0).to_numpy()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for low, high in slices(texts, 1_000_000):
                ids, stops = chunks.encode(texts[low:high])
                lengths = np.diff(stops, prepend=0)
                n = -(-lengths // capacity)
                of = np.repeat(np.arange(high - low), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                size = np.minimum(capacity, lengths[of] - start)
                begin = (stops - lengths)[of] + start
                parts = [ids[a : a + b] for a, b in zip(begin.tolist(), size.tolist())]
                crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
                cells = [pa.array(doc_ids[low:high][of], pa.int64(), mask=nulls[low:high][of]), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cells.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cells, names=[*[f for f, _ in fields], *["ids"] * with_ids])

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(work, kinds)


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length (keys in descending order) to fill `room` as far as can be; longer ones first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, n in left.items():
        copies, part = min(n, room // length), 1
        while copies > 0:  # parts of 1, 2, 4 ... copies make every number of them
            part = min(part, copies)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            copies, part = copies - part, 2 * part
        if reach >> room & 1:
            break
    best, uses = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> best & 1:
            best -= length * part
            uses[length] = uses.get(length, 0) + part
    return uses


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first, uses, sequence, offset): of the pieces of a length, that numbered first + t goes into the
    sequence numbered sequence + t // uses, at offset + (t % uses) * length, until the next row's first."""
    left = {length: histogram[length] for length in sorted(histogram, reverse=True)}
    taken, sequence, rows = dict.fromkeys(left, 0), 0, []
    while left:
        longest = next(iter(left))
        uses = fullest({k: n - (k == longest) for k, n in left.items()}, capacity - longest)
        uses[longest] = uses.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in uses.items()), 0
        for length in sorted(uses, reverse=True):
            rows.append((length, taken[length], uses[length], sequence, offset))
            offset += length * uses[length]
            taken[length] += times * uses[length]
            left[length] -= times * uses[length]
            if not left[length]:
                del left[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `cut` (with a `length` each) with sequence_id and offset. `cut` is staged, so that its rows keep numbers."""
    spark = cut.sparkSession
    rows = staged(cut.drop("sequence_id", "offset", "_row", "_deal").withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # pieces of one length are dealt out, so that no length is one task; a count for each deal tells where its numbers begin
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64("_row"), F.lit(deals)))
    counts = staged(dealt.groupBy("length", "_deal").agg(F.count("*").alias("n")), "lengths")  # at most capacity * deals rows
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table_ = plan(histogram, capacity)
    held = spark.sparkContext.broadcast((table_, table_[:, 0] * 2**40 + table_[:, 1]))  # see the bound above
    before = W.partitionBy("length").orderBy("_deal").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("length", "_deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy("length", "_deal").orderBy("_row")) - 1
    numbered = dealt.withColumn("_at", number).join(firsts, ["length", "_deal"]).withColumn("_at", F.col("_before") + F.col("_at"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, at: pd.Series) -> pd.DataFrame:
        entries, keys = held.value
        found = entries[np.searchsorted(keys, length.to_numpy() * 2**40 + at.to_numpy(), side="right") - 1] if len(length) else entries[:0]
        t = at.to_numpy() - found[:, 1]
        return pd.DataFrame({"sequence_id": found[:, 3] + t // found[:, 2], "offset": found[:, 4] + t % found[:, 2] * found[:, 0]})

    placed = numbered.withColumn("_place", place("length", "_at"))
    return placed.select(*[c for c in rows.columns if c != "_row"], "_place.sequence_id", "_place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed pieces' ids in order; a sequence has at most `capacity` of them."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 2048 tokens."""
    return pack(pieces(table(spark, sf_dir, "documents")))
