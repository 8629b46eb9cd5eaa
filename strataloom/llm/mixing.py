"""Mixing sources to target weights by entropy balancing.

The rates r that stay closest to one copy per document in relative entropy, subject to each source's token target and
at most `cap` copies, are exponential tilts min(cap, exp(t * size / mean size)) with one multiplier t per source: the
convex dual, solved by Newton steps kept inside a bracket. The sums of each step run as one grouped aggregation over
the exact histogram (source, size, documents), which is all the dual depends on.

Rates become copies within chunks of a source, largest documents first: each gets the floor or ceiling of its rate,
whichever keeps the chunk's words nearest to what its rates have promised so far, so the smallest documents settle the
remainder. A hot source has many chunks, so no task holds it whole.

Contract. Sources are ordered by code point, null last, and weigh `weights` in turn. Null text has size 0; a document
of size 0 keeps one copy. Null or repeated ids are ordinary rows. Reruns agree. Extra columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.llm.common import n_words, staged, table

CHUNK_ROWS = 5000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """(source, source_size, n_docs, target): the weighted shares of all words, stopped at `cap` times the source.

    Sharing the excess anew until none is above its stop ends at min(stop, level * weight) with one common level; it
    is found by running sums over the sources, one row each, in the order in which they stop.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    stop = F.col("source_size") * float(cap)
    order = W.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    table_ = by_source.withColumn("weight", weight).withColumn("stop", stop)
    table_ = table_.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
    table_ = table_.withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    level = F.max(F.col("left") / F.col("open")).over(whole)  # each stop below the level raises the next, each above lowers it
    return table_.select("source", "source_size", "n_docs", F.least(F.col("stop"), level * F.col("weight")).alias("target"))


def tilts(sizes: DataFrame, goals: DataFrame, cap: float = 3, rounds: int = 60) -> DataFrame:
    """(source, tilt) with sum(size * min(cap, exp(tilt * size / mean))) = target, to a relative 1e-9."""
    goals = goals.where("source_size > 0").withColumn("mean", F.col("source_size") / F.col("n_docs"))
    cells = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    cells = cells.join(goals.select(F.col("source").alias("s"), "mean"), cells.source.eqNullSafe(F.col("s"))).drop("s")
    cells = staged(cells, "histogram")
    state = staged(goals.select("source", "target", "source_size", F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done")), "tilts")
    for _ in range(rounds):
        now = cells.join(state.where("NOT done").select(F.col("source").alias("s"), "tilt"), cells.source.eqNullSafe(F.col("s"))).drop("s")
        x = F.col("size") / F.col("mean")
        capped = F.col("tilt") * x >= float(np.log(cap))
        rate = F.when(capped, F.lit(float(cap))).otherwise(F.exp(F.least(F.col("tilt") * x, F.lit(float(np.log(cap))))))
        sums = now.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("n") * F.col("size") * x * rate)).alias("slope"),
        )
        step = state.join(sums.withColumnRenamed("source", "s"), state.source.eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap <= 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - gap / F.col("slope"))
        widened = F.when(F.col("high") == 1e6, F.greatest(F.col("tilt") * 4, F.lit(1.0))).when(F.col("low") == -1e6, F.least(F.col("tilt") * 4, F.lit(-1.0))).otherwise((F.col("low") + F.col("high")) / 2)
        moved = step.withColumns({"low": F.when(F.col("done"), F.col("low")).otherwise(low), "high": F.when(F.col("done"), F.col("high")).otherwise(high)})
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        done = F.col("done") | (F.abs(gap) <= 1e-9 * F.col("target")) | (F.col("high") - F.col("low") < 1e-13)
        moved = moved.withColumn("done", done).withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(inside, newton).otherwise(widened))
        state = staged(moved.select(*state.columns), "tilts")
        if not state.where("NOT done").limit(1).count():
            break
    return state.select("source", "tilt")


def _settle(sizes: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Copies of documents given largest first: floor or ceiling of the rate, by the words still owed."""
    copies, owed = np.empty(len(sizes), np.int64), 0.0
    for i, (size, rate) in enumerate(zip(sizes.tolist(), rates.tolist())):
        base = int(rate + 1e-9)
        wanted = size * (rate - base) + owed
        more = size > 0 and rate - base > 1e-9 and 2 * wanted >= size
        copies[i] = base + more
        owed = wanted - size * more
    return copies


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """doc_id, row_key, source, size, source_size, target, rate, copies, taken: one row per document."""
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("row_key"))
    slim = staged(slim, "sizes")
    goals = staged(targets(slim, weights, cap), "targets")
    known = goals.join(tilts(slim, goals, cap).withColumnRenamed("source", "s"), goals.source.eqNullSafe(F.col("s")), "left").drop("s")
    known = staged(known, "solved").withColumnRenamed("source", "s")
    rows = slim.join(known, slim.source.eqNullSafe(F.col("s")), "left").drop("s")
    exponent = F.col("tilt") * F.col("size") * F.col("n_docs") / F.col("source_size")
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.exp(F.least(exponent, F.lit(float(np.log(cap))))))
    rows = rows.withColumn("rate", F.least(rate, F.lit(float(cap))))
    chunk = F.pmod(F.xxhash64("row_key", F.lit(3)), F.ceil(F.col("n_docs") / CHUNK_ROWS))
    rows = rows.select("doc_id", "row_key", "source", "size", "source_size", "target", "rate", F.xxhash64("source", chunk).alias("chunk"))

    def settle(chunk_rows: pd.DataFrame) -> pd.DataFrame:
        chunk_rows = chunk_rows.sort_values(["size", "row_key"], ascending=[False, True], kind="stable")
        return chunk_rows.assign(copies=_settle(chunk_rows["size"].to_numpy(), chunk_rows["rate"].to_numpy()))

    settled = rows.groupBy("chunk").applyInPandas(settle, "doc_id long, row_key long, source string, size long, source_size long, target double, rate double, chunk long, copies long")
    return settled.drop("chunk").withColumn("taken", F.col("copies") * F.col("size"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, by weights 5, 2, 1 in turn and at most 3 copies."""
    mixed = mix(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
