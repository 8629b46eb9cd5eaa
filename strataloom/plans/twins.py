"""SQL twins of iterated fits: Newton steps unrolled as common table expressions, risk sums as running sums."""

from __future__ import annotations


def logistic(rows: str, steps: int = 9, w: str = "1") -> str:
    """(variant, n, a, b) and the sandwich of logistic regression of y on [1, g], g in 0, 1, 2.

    rows: a table (variant, fid, single, g, y). Defines lf (the fit, weighted by w), lv (variant, n, beta, var; unweighted).
    """
    out = f""", cells AS (SELECT variant, count(*) AS n, {', '.join(f"CAST(coalesce(sum({w}) FILTER (g = {k}), 0) AS DOUBLE) AS n{k}, CAST(coalesce(sum({w} * y) FILTER (g = {k}), 0) AS DOUBLE) AS s{k}" for k in range(3))} FROM {rows} GROUP BY 1),
l0 AS (SELECT *, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM cells)"""
    mu = lambda k: f"(1 / (1 + exp(-(a + {k} * b))))"
    var = lambda k: f"(n{k} * {mu(k)} * (1 - {mu(k)}))"
    for i in range(1, steps + 1):
        out += f""",
m{i} AS (SELECT *, {' + '.join(f"(s{k} - n{k} * {mu(k)})" for k in range(3))} AS ua, {' + '.join(f"{k} * (s{k} - n{k} * {mu(k)})" for k in (1, 2))} AS ub,
 {' + '.join(var(k) for k in range(3))} AS iaa, {' + '.join(f"{k} * {var(k)}" for k in (1, 2))} AS iab, {' + '.join(f"{k * k} * {var(k)}" for k in (1, 2))} AS ibb FROM l{i - 1}),
l{i} AS (SELECT variant, n, n0, s0, n1, s1, n2, s2, a + (ibb * ua - iab * ub) / (iaa * ibb - iab * iab) AS a, b + (iaa * ub - iab * ua) / (iaa * ibb - iab * iab) AS b FROM m{i})"""
    return out + f""",
lf AS (SELECT *, {' + '.join(var(k) for k in range(3))} AS iaa, {' + '.join(f"{k} * {var(k)}" for k in (1, 2))} AS iab, {' + '.join(f"{k * k} * {var(k)}" for k in (1, 2))} AS ibb FROM l{steps}),
lr AS (SELECT r.variant, fid, single, r.g, y - 1 / (1 + exp(-(a + b * g))) AS e, 1 / (1 + exp(-(a + b * g))) * (1 - 1 / (1 + exp(-(a + b * g)))) AS d, (g * iaa - iab) / (iaa * ibb - iab * iab) AS h FROM {rows} r JOIN lf ON lf.variant = r.variant),
lm AS (SELECT variant, fid, any_value(single) AS single, sum(h * e) AS u, sum(h * h * d) AS q FROM lr GROUP BY 1, 2),
lv AS (SELECT lf.variant, n, b AS beta, iaa / (iaa * ibb - iab * iab) AS model, (SELECT sum(CASE WHEN single THEN q ELSE u * u END) FROM lm WHERE lm.variant = lf.variant) AS var FROM lf)"""


def two_terms(rows: str) -> str:
    """Least squares of y on [p, q] with residuals' family sandwich. rows: (variant, fid, single, p, q, y), free of the
    other terms. Defines ov (variant, n, b1, b2, v11, v12, v22, a11, a22), the a being the model's variances."""
    return f""", o1 AS (SELECT variant, count(*) AS n, sum(p * p) AS spp, sum(p * q) AS spq, sum(q * q) AS sqq, sum(p * y) AS spy, sum(q * y) AS sqy FROM {rows} GROUP BY 1),
o2 AS (SELECT *, spp * sqq - spq * spq AS det, (sqq * spy - spq * sqy) / (spp * sqq - spq * spq) AS b1, (spp * sqy - spq * spy) / (spp * sqq - spq * spq) AS b2 FROM o1),
o3 AS (SELECT r.variant, fid, single, y - b1 * p - b2 * q AS e, (sqq * p - spq * q) / det AS h1, (spp * q - spq * p) / det AS h2 FROM {rows} r JOIN o2 USING (variant)),
o4 AS (SELECT variant, sum(e * e) / count(*) AS s2 FROM o3 GROUP BY 1),
o5 AS (SELECT variant, fid, any_value(single) AS single, sum(h1 * e) AS u1, sum(h2 * e) AS u2, sum(h1 * h1) AS q11, sum(h1 * h2) AS q12, sum(h2 * h2) AS q22 FROM o3 GROUP BY 1, 2),
o6 AS (SELECT variant, any_value(s2) AS s2, sum(CASE WHEN single THEN s2 * q11 ELSE u1 * u1 END) AS w11, sum(CASE WHEN single THEN s2 * q12 ELSE u1 * u2 END) AS w12, sum(CASE WHEN single THEN s2 * q22 ELSE u2 * u2 END) AS w22 FROM o5 JOIN o4 USING (variant) GROUP BY 1),
ov AS (SELECT variant, n, b1, b2, s2 * sqq / det AS a11, -s2 * spq / det AS a12, s2 * spp / det AS a22, w11, w12, w22,
 CASE WHEN w11 < s2 * sqq / det - 1e-8 THEN s2 * sqq / det ELSE w11 END AS v11, CASE WHEN w11 < s2 * sqq / det - 1e-8 THEN -s2 * spq / det ELSE w12 END AS v12, CASE WHEN w11 < s2 * sqq / det - 1e-8 THEN s2 * spp / det ELSE w22 END AS v22 FROM o2 JOIN o6 USING (variant))"""


def _sums(x: str, theta: str, rows: str, w: str) -> str:
    """Risk sums at every event time for (v, a, b) of `theta`; defines {x}e, {x}k."""
    sums = ("e", "e * p", "e * q", "e * p * p", "e * p * q", "e * q * q")
    names = ("s0", "s1", "s2", "s11", "s12", "s22")
    return f""",
{x}e AS (SELECT r.*, exp(a * p + b * q) AS e1, {w} * exp(a * p + b * q) AS e FROM {rows} r JOIN {theta} USING (v)),
{x}p AS (SELECT v, part, entry AS t, 0 AS kind, {', '.join(f'{s} AS {n}' for s, n in zip(sums, names))} FROM {x}e UNION ALL SELECT v, part, exit, 2, {', '.join(f'-({s})' for s in sums)} FROM {x}e UNION ALL SELECT v, part, t, 1, 0, 0, 0, 0, 0, 0 FROM {rows}_ev),
{x}w AS (SELECT v, part, t, kind, {', '.join(f'sum({n}) OVER w AS {n}' for n in names)} FROM {x}p WINDOW w AS (PARTITION BY v, part ORDER BY t, kind ROWS UNBOUNDED PRECEDING)),
{x}k AS (SELECT v, part, t, d, sp, sq, s0, s1 / s0 AS m1, s2 / s0 AS m2, s11 / s0 - (s1 / s0) * (s1 / s0) AS c11, s12 / s0 - s1 * s2 / (s0 * s0) AS c12, s22 / s0 - (s2 / s0) * (s2 / s0) AS c22 FROM {x}w JOIN {rows}_ev USING (v, part, t) WHERE kind = 1)"""


def cox(rows: str, x: str = "c", steps: int = 8, given: str | None = None, one: bool = False, w: str = "1") -> str:
    """Cox fit, weighted by w, on [p, q] (or [p] alone) with risk sets by `part` and theta by `v`. rows: (v, part, iid, fid, single, entry, exit, event, p, q).

    Defines {x}f (v, a, b: the fit, or the table `given`), {x}i (v, information, n), {x}r (per subject: scores u1 and u2, and for
    events the spread c11, c12, c22 at their time).
    """
    out = f""",
{rows}_ev AS (SELECT v, part, exit AS t, CAST(sum({w}) AS DOUBLE) AS d, sum({w} * p) AS sp, sum({w} * q) AS sq FROM {rows} WHERE event GROUP BY 1, 2, 3)"""
    if given is None:
        out += f""",
{x}_0 AS (SELECT DISTINCT v, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {rows})"""
        for i in range(1, steps + 1):
            out += _sums(f"{x}{i}_", f"{x}_{i - 1}", rows, w) + f""",
{x}{i}_n AS (SELECT v, sum(sp - d * m1) AS u1, sum(sq - d * m2) AS u2, sum(d * c11) AS i11, sum(d * c12) AS i12, sum(d * c22) AS i22 FROM {x}{i}_k GROUP BY 1),
{x}_{i} AS (SELECT v, {'a + u1 / i11 AS a, b' if one else 'a + (i22 * u1 - i12 * u2) / (i11 * i22 - i12 * i12) AS a, b + (i11 * u2 - i12 * u1) / (i11 * i22 - i12 * i12) AS b'} FROM {x}_{i - 1} JOIN {x}{i}_n USING (v))"""
        given = f"{x}_{steps}"
    out += f""",
{x}f AS (SELECT v, a, b FROM {given})""" + _sums(x, f"{x}f", rows, w)
    return out + f""",
{x}i AS (SELECT v, sum(d * c11) AS i11, sum(d * c12) AS i12, sum(d * c22) AS i22 FROM {x}k GROUP BY 1),
{x}h AS (SELECT v, part, t, sum(d / s0) OVER w AS h0, sum(d * m1 / s0) OVER w AS h1, sum(d * m2 / s0) OVER w AS h2 FROM {x}k WINDOW w AS (PARTITION BY v, part ORDER BY t ROWS UNBOUNDED PRECEDING)),
{x}x AS (SELECT e.*, coalesce(h.h0, 0) AS x0, coalesce(h.h1, 0) AS x1, coalesce(h.h2, 0) AS x2 FROM {x}e e ASOF LEFT JOIN {x}h h ON e.v = h.v AND e.part = h.part AND e.exit >= h.t),
{x}xx AS (SELECT x.*, coalesce(h.h0, 0) AS y0, coalesce(h.h1, 0) AS y1, coalesce(h.h2, 0) AS y2 FROM {x}x x ASOF LEFT JOIN {x}h h ON x.v = h.v AND x.part = h.part AND x.entry > h.t),
{x}r AS (SELECT y.v, iid, fid, single, CASE WHEN event THEN p - m1 ELSE 0 END - e1 * (p * (x0 - y0) - (x1 - y1)) AS u1, CASE WHEN event THEN q - m2 ELSE 0 END - e1 * (q * (x0 - y0) - (x2 - y2)) AS u2,
 CASE WHEN event THEN c11 ELSE 0 END AS c11, CASE WHEN event THEN c12 ELSE 0 END AS c12, CASE WHEN event THEN c22 ELSE 0 END AS c22 FROM {x}xx y LEFT JOIN {x}k k ON y.event AND k.v = y.v AND k.part = y.part AND k.t = y.exit)"""


def cox_sandwich(x: str = "c") -> str:
    """Family sandwich of a fit by cox(): defines {x}v (v, a, b, m11 ... the model's variances, v11, v12, v22)."""
    return f""",
{x}s AS (SELECT v, fid, any_value(single) AS single, sum(u1) AS u1, sum(u2) AS u2, sum(c11) AS c11, sum(c12) AS c12, sum(c22) AS c22 FROM {x}r GROUP BY 1, 2),
{x}b AS (SELECT v, sum(CASE WHEN single THEN c11 ELSE u1 * u1 END) AS b11, sum(CASE WHEN single THEN c12 ELSE u1 * u2 END) AS b12, sum(CASE WHEN single THEN c22 ELSE u2 * u2 END) AS b22 FROM {x}s GROUP BY 1),
{x}j AS (SELECT v, i22 / (i11 * i22 - i12 * i12) AS m11, -i12 / (i11 * i22 - i12 * i12) AS m12, i11 / (i11 * i22 - i12 * i12) AS m22 FROM {x}i),
{x}v AS (SELECT v, a, b, m11, m12, m22, m11 * m11 * b11 + 2 * m11 * m12 * b12 + m12 * m12 * b22 AS v11, m12 * m12 * b11 + 2 * m12 * m22 * b12 + m22 * m22 * b22 AS v22 FROM {x}f JOIN {x}j USING (v) JOIN {x}b USING (v))"""


def strata_slope(rows: str, steps: int = 40, tolerance: float = 1e-4) -> str:
    """Least squares of y on [g, 1] with a residual variance per stratum, refitted in turn until both settle.

    rows: (variant, stratum, fid, single, g, y). Defines hv (variant, n, beta, model, var).
    """
    settle = f"sum(abs(new - s2)) + any_value(abs(b1 - b0) + abs(a1 - a0)) < {tolerance}"
    out = f""",
h AS (SELECT variant, stratum, CAST(count(*) AS DOUBLE) AS m, sum(g) AS sg, sum(g * g) AS sgg, sum(y) AS sy, sum(g * y) AS sgy, sum(y * y) AS syy FROM {rows} GROUP BY 1, 2),
h00 AS (SELECT variant, regr_slope(y, g) AS b0, regr_intercept(y, g) AS a0, (regr_syy(y, g) - regr_sxy(y, g) * regr_sxy(y, g) / regr_sxx(y, g)) / count(*) AS s2 FROM {rows} GROUP BY 1),
h0 AS (SELECT h.*, b0, a0, s2, false AS settled FROM h JOIN h00 USING (variant))"""
    for i in range(1, steps + 1):
        out += f""",
ht{i} AS (SELECT variant, (sum(m / s2) * sum(sgy / s2) - sum(sg / s2) * sum(sy / s2)) / (sum(m / s2) * sum(sgg / s2) - sum(sg / s2) * sum(sg / s2)) AS b1,
 (sum(sgg / s2) * sum(sy / s2) - sum(sg / s2) * sum(sgy / s2)) / (sum(m / s2) * sum(sgg / s2) - sum(sg / s2) * sum(sg / s2)) AS a1 FROM h{i - 1} GROUP BY 1),
hn{i} AS (SELECT *, (syy - 2 * b1 * sgy - 2 * a1 * sy + b1 * b1 * sgg + 2 * a1 * b1 * sg + a1 * a1 * m) / m AS new FROM h{i - 1} JOIN ht{i} USING (variant)),
hs{i} AS (SELECT variant, {settle} AS now FROM hn{i} GROUP BY 1),
h{i} AS (SELECT variant, stratum, m, sg, sgg, sy, sgy, syy, CASE WHEN settled THEN b0 ELSE b1 END AS b0, CASE WHEN settled THEN a0 ELSE a1 END AS a0, CASE WHEN settled THEN s2 ELSE new END AS s2, settled OR now AS settled FROM hn{i} JOIN hs{i} USING (variant))"""
    return out + f""",
hi AS (SELECT variant, sum(m / s2) AS imm, sum(sg / s2) AS ig, sum(sgg / s2) AS igg FROM h{steps} GROUP BY 1),
hr AS (SELECT r.variant, fid, single, (g * imm - ig) / (igg * imm - ig * ig) AS k, y - a0 - b0 * g AS e, s2 FROM {rows} r JOIN h{steps} USING (variant, stratum) JOIN hi USING (variant)),
hf AS (SELECT variant, fid, any_value(single) AS single, sum(k * e / s2) AS u, sum(k * k / s2) AS q, count(*) AS n FROM hr GROUP BY 1, 2),
hv AS (SELECT variant, CAST(sum(n) AS BIGINT) AS n, (SELECT any_value(b0) FROM h{steps} x WHERE x.variant = hf.variant) AS beta, (SELECT imm / (igg * imm - ig * ig) FROM hi x WHERE x.variant = hf.variant) AS model, sum(CASE WHEN single THEN q ELSE u * u END) AS var FROM hf GROUP BY 1)"""
