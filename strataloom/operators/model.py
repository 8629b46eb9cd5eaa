"""Model-matrix projections: terms, nominal columns, scaling, buckets, outcomes, interactions."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.scalar import GAMMA, PHI, round_to

ALLOWED = {"log": "ln", "ln": "ln", "exp": "exp", "sqrt": "sqrt", "pow": "pow", "abs": "abs", "sin": "sin", "cos": "cos", "tan": "tan", "factorial": "factorial", "i": "I", "gamma": "strataloom_gamma", "phi": "strataloom_phi"}


def _term(text: str) -> str:
    """A formula term as a Spark expression; only whitelisted functions pass."""
    if bad := re.findall(r"[^\w\s.+\-*/(),<>=^]", text):
        raise ValueError(f"not allowed in a formula: {bad}")

    def name(m: re.Match) -> str:
        if (key := m[1].lower()) not in ALLOWED:
            raise ValueError(f"unknown function {m[1]}")
        return "CAST(" if key == "i" else ALLOWED[key] + "("

    out = re.sub(r"(\w+)\s*\(", name, text)
    return re.sub(r"CAST\(([^()]*)\)", r"CAST((\1) AS DOUBLE)", out)


def _split_terms(text: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "+" and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]]]


def _expanded(term: str, nominal: dict[str, list]) -> list[str]:
    """A term for each combination of the levels, but the first, of the nominal columns that it names."""
    out = [term]
    for col, levels in nominal.items():
        if re.search(rf"\b{re.escape(col)}\b", term):
            quoted = [str(v).replace("\\", "\\\\").replace("'", "\\'") for v in levels[1:]]
            out = [re.sub(rf"\b{re.escape(col)}\b", lambda m, v=v: f"CAST(({col} = '{v}') AS DOUBLE)", t) for t in out for v in quoted]  # noqa: B023
    return out


def model_matrix(df: DataFrame, formula: str, nominal: dict[str, list] | None = None) -> DataFrame:
    """`df` with `y` and one column x1, x2, ... per top-level term of "outcome = term + term".

    A term that names a `nominal` column (with its levels), alone or in a product, stands for one term per level but the first.
    """
    left, _, right = formula.partition("=")
    if re.search(r"\b(gamma|phi)\s*\(", formula, re.IGNORECASE):  # functions that SQL lacks
        df.sparkSession.udf.register("strataloom_gamma", GAMMA)
        df.sparkSession.udf.register("strataloom_phi", PHI)
    whole = [x for t in _split_terms(right) for x in _expanded(_term(t), nominal or {})]
    terms = {f"x{i}": F.expr(t).cast("double") for i, t in enumerate(whole, 1)}
    return df.select(*[c for c in df.columns if c not in {"y", *terms}], F.expr(_term(left.strip())).cast("double").alias("y"), *[c.alias(n) for n, c in terms.items()])


def levels_of(df: DataFrame, col: str) -> list:
    """The sorted levels of a nominal column (few by its nature)."""
    return sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())


def expand_nominal(df: DataFrame, col: str, levels: list | None = None) -> DataFrame:
    """k - 1 indicators I_(col=level); the first sorted level is the reference, null stays null."""
    levels = levels_of(df, col) if levels is None else levels
    return df.withColumns({f"I_({col}={v})": (F.col(col) == v).cast("double") for v in levels[1:]})


def subgroup_indicator(df: DataFrame, n: int) -> DataFrame:
    """n - 1 indicators of the column `subgroup`."""
    return df.withColumns({f"I_(subgroup={i})": (F.col("subgroup") == i).cast("double") for i in range(1, n)})


def standardize(df: DataFrame, cols: list[str], mode: str = "sample", non_binary_only: bool = False) -> DataFrame:
    """(x - mean) / SD, population or sample; SD 0 leaves the column alone, as does 0/1 data where asked."""
    spread = F.stddev_samp if mode == "sample" else F.stddev_pop
    stats = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), spread(c).alias(f"s_{c}"), F.bool_and(F.col(c).isin(0, 1)).alias(f"b_{c}"))]).first()
    out = {}
    for c in cols:
        if stats[f"s_{c}"] and not (non_binary_only and stats[f"b_{c}"]):
            out[c] = (F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]
    return df.withColumns(out) if out else df


def unstandardize(beta: np.ndarray, cov: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance on the original scale."""
    sd = np.where(np.asarray(sd) == 0, 1.0, sd)
    return beta / sd, cov / np.outer(sd, sd)


def collapse(df: DataFrame, col: str, rules: list[tuple]) -> DataFrame:
    """Rules (value, constant) or ((low, high), constant) with a closed range; the first that matches wins."""
    hit = None
    for what, constant in rules:
        test = F.col(col).cast("double").between(*what) if isinstance(what, tuple) else F.col(col) == what
        hit = F.when(test, F.lit(constant)) if hit is None else hit.when(test, F.lit(constant))
    return df.withColumn(col, hit.otherwise(F.col(col)) if hit is not None else F.col(col))


def bucketize(df: DataFrame, col: str, n: int, out: str | None = None) -> DataFrame:
    """Midpoints of n equal-width buckets; the right end lies in the last one, equal ends give that value."""
    ends = df.agg(F.min(col).cast("double").alias("low"), F.max(col).cast("double").alias("high")).first()
    if ends.low is None or ends.low == ends.high:
        return df.withColumn(out or col, F.col(col).cast("double"))
    if float("inf") in (abs(ends.low), abs(ends.high)):
        raise ValueError(f"{col} has infinite values")
    width = (ends.high - ends.low) / n
    at = F.least(F.floor((F.col(col) - ends.low) / width), F.lit(n - 1))
    return df.withColumn(out or col, F.lit(ends.low) + (at + 0.5) * width)


def bucket_times(df: DataFrame, col: str, step: float) -> DataFrame:
    """Times rounded to a step; null and infinity pass through."""
    return df.withColumn(col, round_to(F.col(col), step))


def event_outcome(df: DataFrame, survival: str, censoring: str, status: str) -> DataFrame:
    """(exit, event): with status -1 the earlier of both times, an event where survival is not later."""
    s, c, d = F.col(survival), F.col(censoring), F.col(status)
    return df.withColumns({
        "exit": F.when(d == -1, F.least(s, c)).when(d == 1, s).otherwise(c),
        "event": F.when(d == -1, s <= c).otherwise(d == 1),
    })


def add_interactions(df: DataFrame, g: str, envs: list[str]) -> DataFrame:
    return df.withColumns({f"{g}_x_{e}": F.col(g) * F.col(e) for e in envs})


def impute_mean(gt: DataFrame, stats: DataFrame, key: str = "variant") -> DataFrame:
    """Missing genotypes become 2 * ALT_AF of their variant."""
    return gt.join(stats.select(key, "alt_af"), key).withColumn("g", F.coalesce(F.col("g").cast("double"), 2 * F.col("alt_af"))).drop("alt_af")


def dichotomize(ped: DataFrame, trait: str, mean: float | None = None) -> DataFrame:
    """2 above the mean of phenotyped non-founders (or the given mean), else 1; 0 for null."""
    if mean is None:
        mean = ped.agg(F.avg(F.when(F.col("fat").isNotNull(), F.col(trait)))).first()[0]
    return ped.withColumn(f"{trait}_status", F.when(F.col(trait).isNull(), 0).when(F.col(trait) > mean, 2).otherwise(1))
