"""Near-duplicate groups by min-max hashing.

Each permutation gives a row's signature two components, the least and the greatest hash of its shingle set; both
agree between two sets with a probability equal to their Jaccard similarity, so half the hash evaluations give the
same number of components. Bands of six components name candidates (a pair at similarity 0.8 is missed by all 40
bands with probability 5e-6); every candidate link is confirmed on the full shingle sets.

Contract. Equal sets are one class, so thousands of copies cost one member. Within a bucket each class is compared
with the bucket's chosen representatives; what is still in different components afterwards is compared in blocks of
bounded size inside tasks. A block yields only links that join two components, fewer than it has documents, so no
candidate link between components is lost and no list of all pairs is ever written. Null or wordless text has an
empty set and links with nothing. A row with a null id is compared with nothing: component null, kept. Rows that
share an id form one node. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.llm.common import lookup, splitmix, staged, table

PERMUTATIONS, ROWS = 120, 6
BANDS = 2 * PERMUTATIONS // ROWS
#: About how many documents and shingles a chunk holds; a block compares two chunks, or a hub with one.
BLOCK, WEIGHT = 256, 1 << 20
#: So many of a hub's blocks are handed on as one row.
PART = 512
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CACHE: dict[bytes, int] = {}


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles (fewer words: of the whole sequence)."""
    out = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        if len(_CACHE) > 200_000:
            _CACHE.clear()
        for word in set(words).difference(_CACHE):
            _CACHE[word] = xxhash.xxh3_64_intdigest(word)
        codes = np.fromiter(map(_CACHE.__getitem__, words), np.uint64, len(words))
        width = min(k, len(codes))
        mixed = np.full(len(codes) - width + 1 if width else 0, width, np.uint64)
        for j in range(width):
            mixed = splitmix(mixed ^ codes[j : len(codes) - width + 1 + j])
        out.append(np.unique(mixed))
    return out


def _signatures(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """Band hashes of non-empty sets, one row a set."""
    coefficients = splitmix(np.arange(2 * PERMUTATIONS, dtype=np.uint64) + np.uint64(seed << 32))
    factors, shifts = coefficients[::2] | np.uint64(1), coefficients[1::2]
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    low = np.empty((PERMUTATIONS, len(sets)), np.uint64)
    high = np.empty_like(low)
    for i in range(PERMUTATIONS):
        permuted = joined * factors[i] + shifts[i]
        low[i] = np.minimum.reduceat(permuted, starts)
        high[i] = np.maximum.reduceat(permuted, starts)
    rows = np.concatenate([low.reshape(-1, ROWS, len(sets)), high.reshape(-1, ROWS, len(sets))])
    bands = splitmix(np.arange(BANDS, dtype=np.uint64))[:, None] + np.zeros(len(sets), np.uint64)
    for r in range(ROWS):
        bands = splitmix(bands ^ rows[:, r])
    return np.ascontiguousarray(bands.T)


def signatures(docs: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """doc_id, n_shingles, set_key (identity of the whole set, null if empty), bands array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                sets = shingle_sets(batch.column("text").to_pylist(), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands = np.zeros((len(sets), BANDS), np.uint64)
                if full:
                    bands[full] = _signatures([sets[i] for i in full], seed)
                keys = [f"{len(s):x}-{int(s.sum(dtype=np.uint64)):x}-{int(splitmix(s).sum(dtype=np.uint64)):x}" if len(s) else None for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.string()), lists], names=["doc_id", "n_shingles", "set_key", "bands"])
        _CACHE.clear()  # the worker lives on in later stages

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key string, bands array<long>")


def _links(left: np.ndarray, right: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Index pairs (i, j), i of `left` and j of `right`, with 100 * |common| >= percent * |union| that join two labels.

    Labels that a link joins are one from then on, so a block yields fewer links than it has labels, and documents that
    it has already joined aren't compared again.
    """
    labels = labels.copy()
    sizes = np.array([len(s) for s in sets], np.int64)
    universe, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    codes = [codes[e - n : e] for e, n in zip(ends, sizes)]
    present = np.zeros(len(universe), bool)
    for i in left:
        bound = 100 * np.minimum(sizes[i], sizes[right]) >= percent * np.maximum(sizes[i], sizes[right])
        partners = right[bound & (labels[right] != labels[i]) & (sizes[right] > 0)]
        if not len(partners):
            continue
        present[codes[i]] = True
        starts = np.cumsum([0, *sizes[partners[:-1]]])
        common = np.add.reduceat(present[np.concatenate([codes[j] for j in partners])], starts, dtype=np.int64)
        present[codes[i]] = False
        found = partners[100 * common >= percent * (sizes[i] + sizes[partners] - common)]
        if len(found):
            joined, first = np.unique(labels[found], return_index=True)
            yield from ((i, j) for j in found[first])
            labels[np.isin(labels, joined)] = labels[i]


def compare(tasks: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) found within blocks, on the full sets.

    `tasks` has a row (p, q, side, label, doc_id, part) per document of the block (p, q); a document on side 1 or 3 is
    compared with each one on side 2 or 3 whose label differs. Only links leave a task. A document's text travels once
    for each `part` of its blocks (a hub has one for every PART blocks); its set travels once a block.
    """
    wanted = tasks.groupBy(F.col("doc_id").alias("_id"), "part").agg(F.collect_list(F.struct("p", "q", "side", "label")).alias("tasks")).drop("part")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 250):
                batch = whole_batch.slice(at, 250)
                sets = shingle_sets(batch.column("text").to_pylist(), k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tasks"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "tasks", "members"])
        _CACHE.clear()

    kind = "array<struct<p:long,q:long,side:int,label:long>>"
    sets = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "tasks").mapInArrow(whole, f"doc_id long, tasks {kind}, members binary")
    blocks = sets.select("doc_id", "members", F.explode("tasks").alias("t")).select("t.p", "t.q", "t.side", "t.label", "doc_id", "members")

    def one(rows: pa.Table) -> list[tuple[int, int]]:
        side, label, ids = (rows.column(c).to_numpy() for c in ("side", "label", "doc_id"))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("members")]
        found = _links(np.flatnonzero(side & 1), np.flatnonzero(side & 2), label, sets, percent)
        return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in found]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []  # the rows of the block that a later batch may continue

        def close(tables: list[pa.Table]) -> pa.RecordBatch:
            links = one(pa.concat_tables(tables))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        last = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            p, q = part.column("p").to_numpy(), part.column("q").to_numpy()
            cuts = [0, *(np.flatnonzero((p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1), len(p)] if len(p) else []
            for start, end in zip(cuts, cuts[1:]):
                if rest and (p[start], q[start]) != last:
                    yield close(rest)
                    rest = []
                last = (p[start], q[start])
                rest.append(part.slice(start, end - start))
        if rest:
            yield close(rest)

    return blocks.repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(linked, "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id on an edge (a, b). Labels spread and jump each round.

    Ids with many arcs and components with many ids are looked up as heavy keys, so no task gets all of their rows.
    """
    arcs = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("id")).union(edges.select("b", "a")).distinct(), "arcs")
    labels = arcs.groupBy(F.col("u").alias("id")).agg(F.least(F.first("u"), F.min("id")).alias("component"), F.count("*").alias("n_key"))
    labels = staged(labels, "labels")
    n_arcs, n_ids = arcs.count(), labels.count()
    while True:
        near = lookup(arcs, labels, "id", F.col("u"), total=n_arcs).groupBy("u").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels.id == near.u).select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"), "n_key")
        spread = staged(spread, "spread")
        # each label's own label, with the number of ids that look it up
        named = spread.groupBy("component").agg(F.count("*").alias("n_key"))
        own = named.join(spread.select("id", F.col("component").alias("further")), named.component == F.col("id")).select(named.component, "further", named.n_key)
        after = lookup(spread.withColumnRenamed("n_key", "degree"), own, "component", F.col("id"), total=n_ids)
        after = staged(after.select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component"), F.col("degree").alias("n_key")), "labels")
        changed = after.where("old <> component").limit(1).count()
        labels = after.drop("old")
        if not changed:
            return labels.drop("n_key")


def _star_tasks(stars: DataFrame) -> DataFrame:
    """Blocks of a hub (side 1) with up to about BLOCK of its documents (side 2)."""
    sizes = staged(stars.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"), F.count("*").alias("n_key")), "hubs")
    spokes = lookup(stars.select("doc_id", "hub"), sizes, "hub", F.col("doc_id"), join="merge").select(F.col("hub").alias("p"), F.pmod(F.xxhash64("doc_id"), "blocks").alias("q"), F.lit(2).alias("side"), "doc_id", F.lit(0).cast("long").alias("part"))
    hubs = sizes.select(F.col("hub").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("q"), F.lit(1).alias("side"), F.col("hub").alias("doc_id"))
    hubs = hubs.withColumn("part", F.floor(F.col("q") / PART))
    return spokes.union(hubs).select("p", "q", "side", F.col("doc_id").alias("label"), "doc_id", "part")


def _with_count(df: DataFrame, key: str, spread: str, **measures) -> DataFrame:
    """`df` with the `measures` of its `key` group added, heavy groups dealt out by `spread`."""
    sums = df.groupBy(key).agg(F.count("*").alias("n_key"), *[m.alias(n) for n, m in measures.items()])
    return lookup(df, staged(sums, "sums"), key, F.col(spread), join="merge")


def _block_tasks(slim: DataFrame, candidates: DataFrame, grouped: DataFrame) -> DataFrame:
    """Blocks that hold every pair of documents which share a bucket and are in different components so far.

    Documents are dealt to chunks of about BLOCK members and WEIGHT shingles, alike ones together; two chunks meet
    if some bucket holds documents of both in different components.
    """
    labelled = candidates.select("bucket", "doc_id").join(grouped.hint("merge"), candidates.doc_id == grouped.id, "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n_key")).where("x <> y").select("bucket", "n_key", F.col("n_key").alias("size"))
    apart = staged(lookup(labelled, staged(mixed, "mixed"), "bucket", F.col("doc_id"), join="merge").where("size IS NOT NULL").select("bucket", "doc_id", "component", "size"), "apart")
    # a document goes with its largest bucket, so that families of whatever likeness gather; large components keep to themselves
    members = apart.groupBy("doc_id", "component").agg(F.max(F.struct("size", "bucket"))["bucket"].alias("largest")).join(slim.select("doc_id", "n_shingles").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")).hint("merge"), "doc_id")
    members = _with_count(staged(members, "members"), "component", "doc_id", large=F.count("*") >= BLOCK // 4)
    roots = staged(members.select("doc_id", "component", "n_shingles", F.when(F.col("large"), F.col("component")).otherwise(F.col("largest")).alias("root"), "large"), "roots")
    # then with the largest family that it shares a bucket with, with which it must be compared anyway
    sized = _with_count(roots.where("NOT large").select(F.col("doc_id").alias("member"), "root"), "root", "member", n=F.count("*")).select("member", F.struct("n", "root").alias("family"))
    beside = apart.join(sized.hint("merge"), F.col("doc_id") == F.col("member"), "left").select("bucket", "doc_id", "family")
    moved = _with_count(staged(beside, "beside"), "bucket", "doc_id", widest=F.max("family")).groupBy("doc_id").agg(F.max("widest")["root"].alias("moved"))
    members = roots.join(moved.hint("merge"), "doc_id").select("doc_id", "component", "n_shingles", F.xxhash64(F.when(F.col("large"), F.col("root")).otherwise(F.col("moved")), "large").alias("root"))
    sized = _with_count(staged(members, "members"), "root", "doc_id", chunks=F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / WEIGHT)))
    chunks = staged(sized.select("doc_id", "component", F.xxhash64("root", F.pmod(F.xxhash64("doc_id"), "chunks")).alias("chunk")), "chunks")
    met = apart.select("bucket", "doc_id").join(chunks.hint("merge"), "doc_id").groupBy("bucket", "chunk").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    # chunks wholly of the component that fills most chunks of the bucket needn't meet each other
    alike = F.when(F.col("x") == F.col("y"), F.count("*").over(W.partitionBy("bucket", "x", "y")))
    most = F.max(F.struct(F.col("alike"), F.col("x"))).over(W.partitionBy("bucket"))["x"]
    met = met.repartition("bucket").withColumn("alike", alike).withColumn("filled", F.coalesce((F.col("x") == F.col("y")) & (F.col("x") == most), F.lit(False)))
    met = staged(met.select("bucket", "chunk", "x", "y", "filled"), "met")
    odd, plain = met.where("NOT filled"), met.where("filled")
    other = lambda side: side.select("bucket", F.col("chunk").alias("q"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    apart_ = "NOT (x = y AND x2 = y2 AND x = x2)"
    pairs = odd.join(other(odd), "bucket").where(f"chunk <= q AND {apart_}").select(F.col("chunk").alias("p"), "q")
    pairs = pairs.union(odd.join(other(plain), "bucket").where(apart_).select(F.least("chunk", "q"), F.greatest("chunk", "q"))).distinct()
    pairs = staged(pairs, "pairs")
    sides = pairs.where("p = q").select("p", "q", F.lit(3).alias("side"), F.col("p").alias("chunk"))
    for side, key in ((1, "p"), (2, "q")):
        sides = sides.union(pairs.where("p <> q").select("p", "q", F.lit(side).alias("side"), F.col(key).alias("chunk")))
    return sides.join(chunks, "chunk").select("p", "q", "side", F.col("component").alias("label"), "doc_id", F.lit(0).cast("long").alias("part"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id), one row per row of `docs`."""
    slim = staged(signatures(docs, k), "signatures")
    classes = slim.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_key"))
    classes = staged(classes.where("n_key > 1"), "classes")
    rows = staged(lookup(slim.select("doc_id", "n_shingles", "set_key"), classes, "set_key", F.col("doc_id")).select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")), "rows")
    copies = rows.where("doc_id <> class_id").select("doc_id")
    reps = slim.where("set_key IS NOT NULL AND doc_id IS NOT NULL").join(copies, "doc_id", "left_anti")
    members = reps.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    # a bucket's hub is the member least under one of eight reorderings of the ids, so hubs differ between bands
    mask = F.element_at(F.array(*[F.lit(int(m) >> 24) for m in splitmix(np.arange(8, dtype=np.uint64))]), (F.col("band") % 8 + 1).cast("int"))
    ordered = members.select("bucket", F.col("doc_id").bitwiseXOR(mask).alias("place"), mask.alias("mask"))
    buckets = ordered.groupBy("bucket").agg(F.count("*").alias("n_key"), F.min("place").bitwiseXOR(F.first("mask")).alias("hub")).where("n_key > 1")
    candidates = staged(lookup(members.select("bucket", "doc_id"), staged(buckets, "buckets"), "bucket", F.col("doc_id"), join="merge").where("hub IS NOT NULL"), "candidates")
    # each document first meets the two hubs with which it shares most buckets
    shared = candidates.where("hub <> doc_id").groupBy("doc_id", "hub").agg(F.count("*").alias("n"))
    best = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "hub"))
    stars = staged(shared.withColumn("rank", best).where("rank <= 2").select("doc_id", "hub"), "stars")
    same_id = rows.where("doc_id <> class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    first = staged(compare(_star_tasks(stars), docs, k, percent), "links")
    second = staged(compare(staged(_block_tasks(slim, candidates, components(first)), "tasks"), docs, k, percent), "links")
    tied = components(first.union(second).union(same_id))
    return rows.join(tied, rows.doc_id == tied.id, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component").isNull() | (F.col("doc_id") == F.col("component")), F.lit(True)).alias("kept")
    )


def op7_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on distinct two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
