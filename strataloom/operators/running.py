"""Running sums and maxima over long orders, in ranges of the order instead of one window per group.

A window over a whole group is one task, whatever the group's size. So one pass counts the rows and takes quantiles of the
first order column; where there are more than ROWS, rows are dealt to ranges of about so many, each range's total is
taken, the totals are run through a window, and each range runs its own window on top of what came before it. Several
running sums of one order share the cuts, and so their partitioning. Fewer rows need no ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range; a range of a group is a task's share at most.
ROWS = 1 << 18


def cut_points(df: DataFrame, order: str, rows: int = ROWS) -> list[float]:
    """Cuts of the order column into ranges of about `rows` rows each; none where there are no more than that."""
    key, first = F.col(order).cast("double"), 256
    n, cuts = df.agg(F.count(order), F.percentile_approx(key, [i / first for i in range(1, first)], 10_000)).first()
    if n <= rows:
        return []
    ranges = -(-n // rows)
    if ranges > first:
        cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))).first()[0]
    return sorted({cuts[len(cuts) * i // ranges] for i in range(1, ranges)} if ranges <= first else set(cuts))


def with_range(df: DataFrame, order: str, cuts: list[float]) -> DataFrame:
    """`df` with _range, the number of the range between cuts that `order` lies in, found by binary search; -1 for null."""
    if not cuts:
        return df.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(0))
    from pyspark.ml.feature import Bucketizer

    named = df.withColumn("_key", F.col(order).cast("double"))
    placed = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_key", outputCol="_range", handleInvalid="keep").transform(named)
    return placed.withColumn("_range", F.when(F.col("_key").isNull(), -1).otherwise(F.col("_range").cast("int"))).drop("_key")


def running(df: DataFrame, by: list[str], order: list[str], down: bool = False, current: bool = True, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, cuts: list[float] | None = None) -> DataFrame:
    """`df` with running sums and maxima of expressions added, per group `by`, in (falling, if `down`) order.

    `current`: with the row itself, else only what comes before it (null where nothing does). Give all order columns that
    make the order of rows definite; the first one, a number, sets the ranges. `cuts` of it, if they are known, save a pass.
    """
    wanted = {**{n: (F.sum, c) for n, c in (sums or {}).items()}, **{n: (F.max, c) for n, c in (maxima or {}).items()}}
    step = (lambda c: F.col(c).desc()) if down else (lambda c: F.col(c).asc())
    cuts = cut_points(df, order[0]) if cuts is None else cuts
    if not cuts:
        whole = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(*[step(c) for c in order]).rowsBetween(W.unboundedPreceding, W.currentRow if current else -1)
        return df.withColumns({n: f(c).over(whole) for n, (f, c) in wanted.items()})  # ROWS at most
    rows = with_range(df.withColumns({f"_v_{n}": c for n, (_, c) in wanted.items()}), order[0], cuts)
    totals = rows.groupBy(*by, "_range").agg(*[f(f"_v_{n}").alias(f"_t_{n}") for n, (f, _) in wanted.items()])
    whole = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(step("_range")).rowsBetween(W.unboundedPreceding, -1)  # a row per range
    before = totals.select(*by, "_range", *[f(f"_t_{n}").over(whole).alias(f"_b_{n}") for n, (f, _) in wanted.items()])
    null_safe = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_range")]
    both = rows.alias("l").join(before.alias("r"), null_safe).select("l.*", *[f"r._b_{n}" for n in wanted])
    own = W.partitionBy(*by, "_range").orderBy(*[step(c) for c in order]).rowsBetween(W.unboundedPreceding, W.currentRow if current else -1)
    out = {}
    for n, (f, _) in wanted.items():
        here, ahead = f(f"_v_{n}").over(own), F.col(f"_b_{n}")
        out[n] = F.greatest(here, ahead) if f is F.max else F.when(here.isNull(), ahead).otherwise(here + F.coalesce(ahead, F.lit(0)))
    return both.withColumns(out).drop("_range", *[f"_v_{n}" for n in wanted], *[f"_b_{n}" for n in wanted])


def previous(df: DataFrame, by: list[str], order: list[str], value: str, out: str, cuts: list[float] | None = None) -> DataFrame:
    """`df` with the `value` of the row before, per group `by` in the given order; null for a group's first row."""
    cuts = cut_points(df, order[0]) if cuts is None else cuts
    if not cuts:
        whole = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(*order)
        return df.withColumn(out, F.lag(value).over(whole))  # ROWS at most
    rows = with_range(df, order[0], cuts)
    last = F.max(F.struct(*order, F.col(value).alias("_last")))["_last"]
    ends = rows.groupBy(*by, "_range").agg(last.alias("_end"))
    whole = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_range")  # a row per range
    ends = ends.select(*by, "_range", F.lag("_end").over(whole).alias("_carried"))
    null_safe = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_range")]
    both = rows.alias("l").join(ends.alias("r"), null_safe).select("l.*", "r._carried")
    own = W.partitionBy(*by, "_range").orderBy(*order)
    return both.withColumn(out, F.when(F.row_number().over(own) == 1, F.col("_carried")).otherwise(F.lag(value).over(own))).drop("_range", "_carried")
