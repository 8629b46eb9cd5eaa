"""Scans under pairwise inclusion probabilities whose pairs no task and no driver could hold: B = U' D U in blocks.

Subjects are dealt to buckets of SIZE places in the design's order. D, the design weights, becomes blocks (i-bucket,
j-bucket); only blocks with pairs exist. A task fits a variant and sends each bucket of its subjects' scores U to the
blocks that need it; a block adds U_i' D_ij U_j for every variant of a batch, and these p x p parts are summed. The fit
itself travels along, so that each variant is fitted once. A group holds one block and two buckets of a batch's scores.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import packed as forms
from strataloom.operators import stats
from strataloom.operators.packed import Design
from strataloom.operators.wald import RESULT, regular, result_row

SIZE = 512


def weight_blocks(probs: DataFrame, made: Design, size: int = SIZE) -> tuple[DataFrame, np.ndarray]:
    """((a, b, i, j, delta), alone): the design weights in blocks of the buckets a and b, as lists of places and weights,
    and the weights of the diagonal of single families, which take the model's variance (0 where `robust`)."""
    spark, n = probs.sparkSession, len(made.ids)
    people = pd.DataFrame({"study": made.study, "iid": made.ids, "fid": made.fid, "wt": made.w, "slot": np.arange(n), "one": made.single})
    named = spark.createDataFrame(people).withColumns({c: F.col(c).cast(probs.schema[k].dataType) for c, k in (("study", "study"), ("iid", "iid_i"))})
    pairs = stats.design_weights(probs, named.select("study", "iid", "fid", "wt"))
    side = lambda k: F.broadcast(named.select("study", F.col("iid").alias(f"iid_{k}"), F.col("slot").alias(k), F.col("one").alias(f"one_{k}")))  # noqa: E731  as long as the design, which is checked
    placed = pairs.join(side("i"), ["study", "iid_i"]).join(side("j"), ["study", "iid_j"])
    alone = np.zeros(n)
    if not made.robust:
        own = (F.col("i") == F.col("j")) & F.col("one_i")
        for r in placed.where(own).select("i", "delta").collect():  # a row a subject at most
            alone[r.i] = r.delta
        placed = placed.where(~own)
    cells = placed.select(F.floor(F.col("i") / size).cast("int").alias("a"), F.floor(F.col("j") / size).cast("int").alias("b"), (F.col("i") % size).cast("int").alias("i"), (F.col("j") % size).cast("int").alias("j"), "delta")
    held = cells.groupBy("a", "b").agg(F.collect_list(F.struct("i", "j", "delta")).alias("c"))  # size * size at most
    return held.select("a", "b", F.col("c.i").alias("i"), F.col("c.j").alias("j"), F.col("c.delta").alias("delta")), alone


def _scores(d: Design, name, u: np.ndarray, n: int, fit: list[float], status: str, size: int):
    """The rows that a variant sends: its fit (bucket -1), and the buckets of its scores that are not all zero."""
    yield {"variant": name, "bucket": -1, "width": u.shape[1], "u": None, "n": n, "fit": fit, "status": status}
    for k in range(0, len(u), size):
        part = u[k : k + size]
        if part.any():
            yield {"variant": name, "bucket": k // size, "width": u.shape[1], "u": np.ascontiguousarray(part).tobytes(), "n": None, "fit": None, "status": None}


ROW = "variant {kind}, bucket int, width int, u binary, n long, fit array<double>, status string"


def _products(scored: DataFrame, blocks: DataFrame, kind: str, size: int, batches: int) -> DataFrame:
    """(variant, n, fit, status, part): a variant's fit in one row, and its parts of U' D U, a row a block."""
    spark = scored.sparkSession
    pairs = blocks.select("a", "b").unionByName(spark.createDataFrame([(-1, -1)], "a int, b int"))
    to = pairs.select(F.col("a").alias("to_a"), F.col("b").alias("to_b"), F.explode(F.array_distinct(F.array("a", "b"))).alias("bucket"))
    dealt = F.pmod(F.xxhash64("variant"), F.lit(batches)).cast("int")
    sent = scored.join(to, "bucket").withColumn("to_batch", dealt)
    held = blocks.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    schema = f"variant {kind}, n long, fit array<double>, status string, part array<double>"

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        out = [(r["variant"], r["n"], r["fit"], r["status"], None) for r in rows if r["bucket"] < 0]
        if right.num_rows and rows:
            block = right.to_pylist()[0]
            weights = np.zeros((size, size))
            np.add.at(weights, (np.array(block["i"], int), np.array(block["j"], int)), np.array(block["delta"], float))
            sides: tuple[dict, dict] = ({}, {})
            for r in rows:
                u = np.frombuffer(r["u"]).reshape(-1, r["width"])
                for k in (0, 1):
                    if r["bucket"] == (block["a"], block["b"])[k]:
                        sides[k][r["variant"]] = u
            for name, u in sides[0].items():
                if name in sides[1]:
                    v = sides[1][name]
                    out.append((name, None, None, None, (u.T @ weights[: len(u), : len(v)] @ v).ravel().tolist()))
        kinds = [left.schema.field("variant").type, pa.int64(), pa.list_(pa.float64()), pa.string(), pa.list_(pa.float64())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["variant", "n", "fit", "status", "part"])

    return sent.groupBy("to_a", "to_b", "to_batch").cogroup(held.groupBy("a", "b", "batch")).applyInArrow(multiply, schema)


def wald_scan(packed: DataFrame, made: Design, probs: DataFrame, key: str = "variant", size: int = SIZE, batches: int = 1) -> DataFrame:
    """`packed.wald_scan` with pairwise inclusion probabilities (study, iid_i, iid_j, pi) of any number. `made` is a weighted
    design without pairs; `batches`: more of them make smaller groups, each block being sent to every batch."""
    blocks, alone = weight_blocks(probs, made, size)
    kind = packed.schema[key].dataType.simpleString()
    shared = packed.sparkSession.sparkContext.broadcast((replace(made, sink=[]), alone))

    def run(rows):
        d, single = shared.value
        risk = forms.Risk(d) if d.model == "cox" else None
        ahead = 0 if risk else 1
        for name, g in forms.variants(rows, len(d.ids), lambda k, g: list(zip(k.to_pylist(), g))):
            m = np.isfinite(g).astype(float)
            g = np.where(m > 0, g, 0.0)
            x = np.column_stack([g, *([np.ones(len(g))] if ahead else []), d.x[:, ahead:]]) * m[:, None]
            d.sink.clear()
            try:
                terms = x if ahead else np.column_stack([m, x])
                if not regular((terms * d.w[:, None]).T @ terms):
                    raise np.linalg.LinAlgError
                theta, inverse, status = forms._cox(d, x, m, risk) if risk else (forms._logistic if d.model == "logistic" else forms._linear)(d, x, m)
            except np.linalg.LinAlgError:
                inverse, status = None, "singular"
            if inverse is None:
                yield from _scores(d, name, np.zeros((0, 1)), int(m.sum()), [], status, size)
                continue
            u, own = d.sink[-1]
            fit = [*theta, *inverse.ravel(), *(np.zeros(inverse.size) if d.robust else own(single).ravel())]
            yield from _scores(d, name, u, int(m.sum()), [float(v) for v in fit], status, size)

    scored = forms._rows(packed.select(key, "g"), run, ROW.format(kind=kind))
    parts = _products(scored, blocks, kind, size, batches)

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        fit = group[group["status"].notna()].iloc[0]
        values = np.asarray(fit["fit"], float)
        if not len(values):
            return pd.DataFrame([result_row(fit["variant"], int(fit["n"]), None, None, fit["status"])])
        p = next(k for k in range(1, len(values)) if k + 2 * k * k == len(values))
        theta, inverse, own = values[:p], values[p : p + p * p].reshape(p, p), values[p + p * p :].reshape(p, p)
        b = own + sum((np.asarray(v, float).reshape(p, p) for v in group["part"] if v is not None), np.zeros((p, p)))
        return pd.DataFrame([result_row(fit["variant"], int(fit["n"]), theta, inverse @ b @ inverse, fit["status"])])

    return parts.groupBy("variant").applyInPandas(finish, RESULT.replace("variant long", f"variant {kind}"))


def score_scan(packed: DataFrame, made: Design, probs: DataFrame, null: dict, key: str = "variant", size: int = SIZE, batches: int = 1) -> DataFrame:
    """`packed.score_scan` with pairwise inclusion probabilities of any number, for linear and logistic null models."""
    if made.model == "cox":
        raise ValueError("score tests in blocks are for linear and logistic models")
    blocks, alone = weight_blocks(probs, made, size)
    kind = packed.schema[key].dataType.simpleString()
    shared = packed.sparkSession.sparkContext.broadcast((made, null, alone))

    def run(rows):
        d, held, single = shared.value
        r, dd = forms._null_parts(d, held)

        def batch(keys, g):
            g, n = forms._imputed(g)
            g = np.nan_to_num(g)
            e = forms._adjust(d, held, r, dd, g)
            u, v_a, own = g @ (d.w * r), (e * e) @ (d.w * dd), 0.0 if d.robust else (e * e) @ (single * dd)
            varied = (n > 0) & (v_a > 1e-12 * ((g * g) @ (d.w * dd)))
            for k, name in enumerate(keys.to_pylist()):
                fit = [float(u[k]), float(v_a[k]), float(own[k] if np.ndim(own) else own)] if varied[k] else []
                yield from _scores(d, name, (e[k] * r)[:, None] if varied[k] else np.zeros((0, 1)), int(n[k]), fit, "ok", size)

        return forms.variants(rows, len(d.ids), batch)

    scored = forms._rows(packed.select(key, "g"), run, ROW.format(kind=kind))
    total = F.coalesce(F.sum(F.get("part", F.lit(0))), F.lit(0.0))
    sums = _products(scored, blocks, kind, size, batches).groupBy("variant").agg(F.max("n").alias("n_informative"), F.max("fit").alias("fit"), total.alias("meat"))
    v = F.col("meat") + F.get("fit", F.lit(2))
    out = sums.select("variant", F.lit(len(made.ids)).cast("long").alias("n"), "n_informative", F.get("fit", F.lit(0)).alias("u"), F.when(v > 0, v).alias("v"), F.get("fit", F.lit(1)).alias("v_a"))
    return out.withColumns({"u": F.when(F.col("v").isNotNull(), F.col("u")), "beta": F.try_divide("u", "v"), "se": F.try_divide(F.lit(1.0), F.sqrt("v")), "chisq": F.try_divide(F.col("u") * F.col("u"), "v")})
