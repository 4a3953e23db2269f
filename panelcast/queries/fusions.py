"""Fusion of member forecasts with weights from validation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, metrics as M
from ..plans.datasets import H, stored_forecasts, stored_fused
from .registry import query, tidy
from .sql import r, sql

MEMBERS = ["Scaled", "OLS2"]
_ID = ["protocol", "fold", "series_id", "ts"]


def _variant(name: str, key: str) -> None:
    @query(key, sql(f"SELECT protocol, fold, series_id, ts, {r(name, 4)} AS yhat FROM fused_h"))
    def run(spark, sf):
        return tidy(stored_fused(spark, sf, H).select(*_ID, F.col(name).alias("yhat")), 4)


for _name, _key in (
    ("Mean", "e01_mean"),
    ("InvRMSE", "e02_inverse_rmse"),
    ("RidgeStack", "e03_ridge_stack"),
    ("NNLSStack", "e04_nnls_stack"),
    ("BestSingleByVal", "e05_best_by_validation"),
    ("NNLSRenormalised", "e06_nnls_sum_to_one"),
    ("NNLSConvex", "e07_simplex"),
):
    _variant(_name, _key)


_HOUR = """SELECT series_id, protocol, fold, hour(ts) AS h, count(*) AS n, sum(Scaled*Scaled) AS g11, sum(Scaled*OLS2) AS g12, sum(OLS2*OLS2) AS g22,
    sum(Scaled*y) AS h1, sum(OLS2*y) AS h2, (h1*g22 - h2*g12)/nullif(g11*g22 - g12*g12, 0) AS u1, (h2*g11 - h1*g12)/nullif(g11*g22 - g12*g12, 0) AS u2,
    CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN -h1*h1/g11 <= -h2*h2/g22 THEN h1/g11 ELSE 0 END AS n1,
    CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN -h1*h1/g11 <= -h2*h2/g22 THEN 0 ELSE h2/g22 END AS n2
    FROM fc_h WHERE role = 'val' AND active AND NOT is_missing GROUP BY ALL"""


@query(
    "e08_per_hour_stack",
    sql(
        f"""SELECT t.protocol, t.fold, t.series_id, t.ts, {r('greatest(CASE WHEN n >= 6 THEN (n1*Scaled + n2*OLS2)/(n1 + n2) ELSE (Scaled + OLS2)/2 END, 0)', 3)} AS yhat
        FROM test_h t LEFT JOIN ({_HOUR}) w ON w.series_id = t.series_id AND w.protocol = t.protocol AND w.fold = t.fold AND w.h = hour(t.ts)"""
    ),
)
def e08_per_hour_stack(spark, sf):
    out = fusion.per_hour_stack(stored_forecasts(spark, sf, H), MEMBERS, min_rows=6)
    return tidy(out.select(*_ID, F.col("PerHourStack").alias("yhat")), 3)


@query(
    "e09_weight_shares",
    sql(
        f"""SELECT series_id, protocol, member, {r('avg(w / total)', 5)} AS share_mean, {r('stddev_samp(w / total)', 5)} AS share_sd, {r('avg(total)', 5)} AS sum_mean, count(*) AS n_folds
        FROM (SELECT series_id, protocol, n1 + n2 AS total, unnest(['Scaled', 'OLS2']) AS member, unnest([n1, n2]) AS w FROM weights_h) GROUP BY ALL"""
    ),
)
def e09_weight_shares(spark, sf):
    weights = fusion.fit(stored_forecasts(spark, sf, H), MEMBERS)
    return tidy(fusion.weight_shares(weights, MEMBERS), 5)


_VARIANTS = ["NNLSStack", "NNLSRenormalised", "NNLSConvex", "Mean"]


@query(
    "e10_constraint_comparison",
    sql(
        f"""SELECT series_id, protocol, model, count(*) AS n, {r('sqrt(avg((y - yhat)**2))', 4)} AS rmse FROM (SELECT series_id, protocol, y,
        unnest([{', '.join(f"'{v}'" for v in _VARIANTS)}]) AS model, unnest([{', '.join(_VARIANTS)}]) AS yhat FROM fused_h WHERE active AND NOT is_missing) GROUP BY ALL"""
    ),
)
def e10_constraint_comparison(spark, sf):
    rows = M.to_long(stored_fused(spark, sf, H).where("active"), _VARIANTS)
    return tidy(M.score(rows, ["series_id", "protocol", "model"]).select("series_id", "protocol", "model", "n", "rmse"), 4)


_LOFO = """SELECT series_id, protocol, fold, n, yy, h1, h2, g11, g12, g22, sum(h1) OVER w - h1 AS oh1, sum(h2) OVER w - h2 AS oh2,
    sum(g11) OVER w - g11 AS o11, sum(g12) OVER w - g12 AS o12, sum(g22) OVER w - g22 AS o22,
    (oh1*o22 - oh2*o12)/(o11*o22 - o12*o12) AS u1, (oh2*o11 - oh1*o12)/(o11*o22 - o12*o12) AS u2,
    CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1/(u1 + u2) WHEN oh1*oh1/o11 >= oh2*oh2/o22 THEN 1.0 ELSE 0.0 END AS w1
    FROM (SELECT series_id, protocol, fold, count(*) AS n, sum(y*y) AS yy, sum(Scaled*y) AS h1, sum(OLS2*y) AS h2, sum(Scaled*Scaled) AS g11, sum(Scaled*OLS2) AS g12, sum(OLS2*OLS2) AS g22
    FROM test_h WHERE active AND NOT is_missing GROUP BY ALL) WINDOW w AS (PARTITION BY series_id, protocol)"""


@query(
    "e11_leave_member_out",
    sql(
        f"""SELECT series_id, protocol, model, {r('rmse', 4)} AS rmse_without, {r("100 * (rmse - max(rmse) FILTER (WHERE model = 'ALL') OVER w) / max(rmse) FILTER (WHERE model = 'ALL') OVER w", 4)} AS rmse_increase_pct
        FROM (SELECT series_id, protocol, unnest(['ALL', 'Scaled', 'OLS2']) AS model, unnest([
        sqrt(sum(yy - 2*(w1*h1 + (1-w1)*h2) + w1*w1*g11 + 2*w1*(1-w1)*g12 + (1-w1)*(1-w1)*g22)/sum(n)), sqrt(sum(yy - 2*h2 + g22)/sum(n)), sqrt(sum(yy - 2*h1 + g11)/sum(n))]) AS rmse
        FROM ({_LOFO}) GROUP BY series_id, protocol) WINDOW w AS (PARTITION BY series_id, protocol)"""
    ),
)
def e11_leave_member_out(spark, sf):
    return tidy(fusion.leave_member_out(stored_forecasts(spark, sf, H), MEMBERS), 4)


@query("e10_three_member_fusion")
def e10_three_member_fusion(spark, sf):
    """All variants over three members, ridge included."""
    fused = stored_fused(spark, sf, H, ("Scaled", "OLS2", "Ridge"))
    rows = M.with_subsets(M.to_long(fused, list(fusion.VARIANTS)))
    return tidy(M.score(rows, ["series_id", "protocol", "model", "subset"], F.col("capacity")))


# Three members: every active set of a non-negative fit, and every face of the simplex, in closed form.
_THREE = ["Scaled", "OLS2", "SmartPersistence"]
_IDX = (1, 2, 3)
_g = lambda p, i, j: f"{p}{min(i, j)}{max(i, j)}"


def _det(m) -> str:
    if len(m) == 1:
        return f"({m[0][0]})"
    signed = (f"{'+' if c % 2 == 0 else '-'} ({m[0][c]})*{_det([row[:c] + row[c + 1:] for row in m[1:]])}" for c in range(len(m)))
    return f"({' '.join(signed)})"


def _solve(matrix, right) -> list[str]:
    """Cramer's rule."""
    n, whole = len(right), _det(matrix)
    return [f"{_det([row[:c] + [right[i]] + row[c + 1:] for i, row in enumerate(matrix)])} / nullif({whole}, 0)" for c in range(n)]


def _faces() -> list[tuple[int, ...]]:
    return [tuple(i for k, i in enumerate(_IDX) if bits >> k & 1) for bits in range(1, 8)]


def _best(candidates: list[tuple[list[str], str]]) -> str:
    """The weights of the candidate without a negative one that has the largest score."""
    listed = ", ".join(f"{{'s': {score}, 'w': [{', '.join(w)}]}}" for w, score in candidates)
    return f"list_max(list_filter([{listed}], lambda x: x.s IS NOT NULL AND list_min(x.w) >= 0)).w"


def _nnls() -> str:
    out = []
    for face in _faces():
        w = dict(zip(face, _solve([[_g("g", i, j) for j in face] for i in face], [f"h{i}" for i in face])))
        full = [w.get(i, "0.0") for i in _IDX]
        out.append((full, " + ".join(f"h{i}*({w[i]})" for i in face)))
    return _best(out)


def _convex() -> str:
    out = []
    for face in _faces():
        *free, last = face
        if free:  # the last weight is one less the others
            a = [[f"{_g('g', i, j)} - {_g('g', i, last)} - {_g('g', j, last)} + {_g('g', last, last)}" for j in free] for i in free]
            w = dict(zip(free, _solve(a, [f"h{i} - h{last} - {_g('g', i, last)} + {_g('g', last, last)}" for i in free])))
        else:
            w = {}
        w[last] = f"1 - ({' + '.join(f'({w[i]})' for i in free) or 0})"
        full = [w.get(i, "0.0") for i in _IDX]
        square = " + ".join(f"({w[i]})*({w[j]})*{_g('g', i, j)}" for i in face for j in face)
        out.append((full, " + ".join(f"2*h{i}*({w[i]})" for i in face) + f" - ({square})"))
    return _best(out)


def _three_sql() -> str:
    pairs = [(i, j) for i in _IDX for j in _IDX if i <= j]
    name = dict(zip(_IDX, _THREE))
    sums = [f"sum({name[i]}*{name[j]}) AS g{i}{j}" for i, j in pairs] + [f"sum({name[i]}*y) AS h{i}, sum({name[i]}) AS s{i}, sqrt(avg((y - {name[i]})**2)) AS e{i}" for i in _IDX]
    ridge = _solve([[f"{_g('g', i, j)} - s{i}*s{j}/n" + (" + 1" if i == j else "") for j in _IDX] for i in _IDX], [f"h{i} - s{i}*sy/n" for i in _IDX])
    dot = lambda w: " + ".join(f"{w}[{i}]*{name[i]}" for i in _IDX)
    inverse = " + ".join(f"1/e{i}" for i in _IDX)
    return f"""SELECT t.protocol, t.fold, t.series_id, t.ts, {r(f"({' + '.join(_THREE)})/3", 4)} AS Mean, {r(f"({' + '.join(f'{name[i]}/e{i}' for i in _IDX)}) / ({inverse})", 4)} AS InvRMSE,
        {r(f"greatest((sy - {' - '.join(f'r[{i}]*s{i}' for i in _IDX)})/n + {dot('r')}, 0)", 4)} AS RidgeStack, {r(f'greatest({dot("w")}, 0)', 4)} AS NNLSStack,
        {r(f'greatest(({dot("w")})/list_sum(w), 0)', 4)} AS NNLSRenormalised, {r(f'greatest({dot("c")}, 0)', 4)} AS NNLSConvex,
        {r('CASE WHEN e1 <= e2 AND e1 <= e3 THEN Scaled WHEN e2 <= e3 THEN OLS2 ELSE SmartPersistence END', 4)} AS BestSingleByVal
        FROM test_h t JOIN (SELECT *, {_nnls()} AS w, {_convex()} AS c, [{', '.join(ridge)}] AS r FROM (SELECT series_id, protocol, fold, count(*) AS n, sum(y) AS sy, {', '.join(sums)}
        FROM fc_h WHERE role = 'val' AND active AND NOT is_missing GROUP BY ALL)) w ON w.series_id = t.series_id AND w.protocol = t.protocol AND w.fold = t.fold"""


@query("e07_three_member_variants", sql(_three_sql()))
def e07_three_member_variants(spark, sf):
    """Every fusion of three members, row by row."""
    fused = stored_fused(spark, sf, H, tuple(_THREE))
    return tidy(fused.select(*_ID, *fusion.VARIANTS, "NNLSRenormalised", "NNLSConvex"), 4)
