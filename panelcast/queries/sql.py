"""Named SQL fragments for the checking queries. ``sql(body)`` prepends the
fragments the body uses, in order of definition."""

from __future__ import annotations

import re

from .registry import NUDGE

_PARTS: dict[str, str] = {}


def part(name: str, body: str) -> None:
    _PARTS[name] = body


def sql(body: str) -> str:
    need: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in _PARTS:
            if name in words and name not in need:
                need.add(name)
                todo.append(_PARTS[name])
    ctes = ",\n".join(f"{n} AS ({b})" for n, b in _PARTS.items() if n in need)
    return f"WITH {ctes}\n{body}" if ctes else body


def r(expr: str, digits: int = 6) -> str:
    """Rounded as :func:`panelcast.queries.registry.rnd` does."""
    return f"(round(({expr}) + CAST({NUDGE * 10.0**-digits!r} AS DOUBLE), {digits}) + 0.0)"


def metric_sql(y: str = "y", yhat: str = "yhat", cap: str | None = None, digits: int = 6) -> str:
    """The metric set as select items."""
    e = f"({y} - {yhat})"
    both = f"FILTER (WHERE {y} IS NOT NULL AND {yhat} IS NOT NULL)"
    var = f"var_pop({y}) {both}"
    ok = f"count(*) {both} >= 5 AND {var} >= 1e-9"
    case = lambda x: r(f"CASE WHEN {ok} THEN {x} END", digits)
    mae, rmse = f"avg(abs{e}) {both}", f"sqrt(avg({e}*{e}) {both})"
    items = [
        f"count(*) {both} AS n",
        f"{case(f'1 - sum({e}*{e}) {both} / (({var}) * count(*) {both})')} AS r2",
        f"{case(mae)} AS mae",
        f"{case(rmse)} AS rmse",
    ]
    if cap:
        items += [f"{case(f'{mae} / max({cap}) * 100')} AS nmae_pct", f"{case(f'{rmse} / max({cap}) * 100')} AS nrmse_pct"]
    return ", ".join(items)


# ---- canonical panels -------------------------------------------------------

HOUR = "CAST(floor(epoch(ts) / 3600) AS BIGINT)"


def _panel(x: str, step: int) -> None:
    part(f"read_{x}", f"SELECT series_id, slot, CAST(sum(v) AS DOUBLE) AS y FROM raw_{x} GROUP BY ALL")
    part(f"span_{x}", f"SELECT series_id, min(slot) AS lo, max(slot) AS hi FROM raw_{x} GROUP BY ALL")
    part(
        f"panel_{x}",
        f"""SELECT g.series_id, g.slot, make_timestamp(g.slot * {step}000000) AS ts, r.y,
        coalesce(greatest(r.y, 0), 0) AS y_filled, r.y IS NULL AS is_missing
        FROM (SELECT series_id, unnest(generate_series(lo, hi)) AS slot FROM span_{x}) g
        LEFT JOIN read_{x} r ON r.series_id = g.series_id AND r.slot = g.slot""",
    )


part("raw_h", f"SELECT event_type AS series_id, {HOUR} AS slot, CAST(value AS DECIMAL(18,2)) AS v FROM events")
_panel("h", 3600)
part("raw_u", f"SELECT CAST(user_id AS VARCHAR) AS series_id, {HOUR} AS slot, CAST(value AS DECIMAL(18,2)) AS v FROM events")
_panel("u", 3600)
part(
    "raw_d",
    """SELECT l_returnflag AS series_id, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS slot,
    CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS v
    FROM lineitem""",
)
_panel("d", 86400)
part(
    "exog_h",
    f"""SELECT {HOUR} AS slot, CAST(count(*) AS DOUBLE) AS n_events,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_value,
    CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS DOUBLE) / count(CAST(props->>'$.k' AS BIGINT)) AS mean_k
    FROM events GROUP BY 1""",
)
part(
    "exog_d",
    """SELECT CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS slot, CAST(count(*) AS DOUBLE) AS n_orders,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_price
    FROM orders GROUP BY 1""",
)


def fill(col: str) -> str:
    w = "PARTITION BY series_id ORDER BY slot ROWS BETWEEN"
    return (
        f"coalesce(last_value({col} IGNORE NULLS) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({col} IGNORE NULLS) OVER ({w} CURRENT ROW AND UNBOUNDED FOLLOWING))"
    )


def sun_items(lat: str, lon: str) -> str:
    """Solar position as select items over ``ts`` (later items use earlier aliases)."""
    return f"""
    CAST(epoch(ts) AS BIGINT) % 86400 AS sec_,
    2*pi()/365.0 * (dayofyear(ts) - 1 + (sec_/3600.0 - 12.0)/24.0) AS gam_,
    0.006918 - 0.399912*cos(gam_) + 0.070257*sin(gam_) - 0.006758*cos(2*gam_) + 0.000907*sin(2*gam_)
      - 0.002697*cos(3*gam_) + 0.00148*sin(3*gam_) AS dec_,
    229.18*(0.000075 + 0.001868*cos(gam_) - 0.032077*sin(gam_) - 0.014615*cos(2*gam_) - 0.04089*sin(2*gam_)) AS eot_,
    radians((sec_/60.0 + eot_ + 4.0*({lon}))/4.0 - 180.0) AS ha_,
    greatest(-1.0, least(1.0, sin(radians({lat}))*sin(dec_) + cos(radians({lat}))*cos(dec_)*cos(ha_))) AS cos_zenith,
    degrees(acos(cos_zenith)) AS sun_zenith, 90.0 - sun_zenith AS sun_elev,
    degrees(atan2(sin(ha_), cos(ha_)*sin(radians({lat})) - tan(dec_)*cos(radians({lat})))) + 180.0 AS sun_az"""


# ---- backtest frames --------------------------------------------------------

for _x in "hd":
    part(f"cap_{_x}", f"SELECT series_id, quantile_cont(y_filled, 0.999) AS capacity FROM panel_{_x} GROUP BY 1")
_over_p = "PARTITION BY p.series_id ORDER BY p.slot"


def filled(col: str) -> str:
    return fill(col).replace("PARTITION BY series_id ORDER BY slot", _over_p)


part("sun_h", f"SELECT slot, ts, {sun_items('50.91', '-1.40')} FROM (SELECT DISTINCT slot, ts FROM panel_h)")


def hourly_frame(panel: str, exog: str, sun: str = "sun_h", prefix: str = "") -> str:
    return f"""SELECT '{prefix}' || p.series_id AS series_id, p.slot, p.ts, y, y_filled, is_missing, {filled('n_events')} AS n_events,
    {filled('mean_value')} AS mean_value, {filled('mean_k')} AS mean_k, s.sun_elev > 5.0 AS active,
    {filled('mean_value')} * 10.0 AS driver, capacity
    FROM {panel} p LEFT JOIN {exog} e ON e.slot = p.slot JOIN cap_h c ON c.series_id = p.series_id
    JOIN {sun} s ON s.slot = p.slot"""


part("frame_h", hourly_frame("panel_h", "exog_h"))
part(
    "lab_d",
    """SELECT series_id, month(ts) AS m, slot % 7 AS s, median(y_filled) AS med FROM panel_d GROUP BY ALL""",
)
part(
    "frame_d",
    f"""SELECT p.series_id, p.slot, p.ts, y, y_filled, is_missing, {filled('n_orders')} AS n_orders,
    {filled('mean_price')} AS mean_price, l.med > 0.4 * capacity AS active, {filled('mean_price')} * 0.002 AS driver, capacity
    FROM panel_d p LEFT JOIN exog_d e ON e.slot = p.slot JOIN cap_d c ON c.series_id = p.series_id
    JOIN lab_d l ON l.series_id = p.series_id AND l.m = month(p.ts) AND l.s = p.slot % 7""",
)


def _backtest(x: str, season: int, per_day: int, first: int, folds: int, k: int, min_rows: int, x1: str, x2: str, seed: str = "0") -> None:
    w = f"(PARTITION BY series_id, slot % {season} ORDER BY slot // {season} RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)"
    part(
        f"back_{x}",
        f"""SELECT *, last_value(y IGNORE NULLS) OVER {w} AS prev_y,
        last_value(CASE WHEN driver IS NOT NULL THEN y END IGNORE NULLS) OVER {w} AS pair_y,
        last_value(CASE WHEN y IS NOT NULL THEN driver END IGNORE NULLS) OVER {w} AS pair_g,
        last_value(y) OVER {w.replace("7 PRECEDING", "1 PRECEDING")} IS NOT NULL AS lag_seen FROM frame_{x}""",
    )
    part(
        f"whole_{x}",
        f"""SELECT *, CAST(ts AS DATE) AS day FROM back_{x}
        QUALIFY count(*) OVER (PARTITION BY series_id, CAST(ts AS DATE)) = {per_day}""",
    )
    part(f"days_{x}", f"SELECT series_id, day, count(*) FILTER (WHERE NOT is_missing) AS n_obs FROM whole_{x} GROUP BY ALL")
    part(
        f"roll_{x}",
        f"""SELECT * FROM (SELECT *, sum(n_obs) FILTER (WHERE cand) OVER (PARTITION BY series_id, f) AS train_rows FROM (
        SELECT *, pos < {first} + f * len AND n_obs > 0 AS cand,
        pos >= {first} + f * len AND (f = {folds - 1} OR pos < {first} + (f + 1) * len) AS test
        FROM (SELECT *, (n - {first}) // {folds} AS len FROM (SELECT *,
        row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM days_{x}),
        (SELECT unnest(range(0, {folds})) AS f)) WHERE len >= 1) WHERE cand OR test) WHERE train_rows >= {min_rows}""",
    )
    part(
        f"rand_{x}",
        f"""SELECT *, NOT test AND n_obs > 0 AS cand FROM (SELECT *, f = least(pos // greatest(n // {k}, 1), {k - 1}) AS test FROM (SELECT *,
        row_number() OVER (PARTITION BY series_id ORDER BY md5({seed} || '|' || CAST(day AS VARCHAR)), day) - 1 AS pos,
        count(*) OVER (PARTITION BY series_id) AS n FROM days_{x}), (SELECT unnest(range(0, {k})) AS f))
        WHERE test OR n_obs > 0""",
    )
    part(
        f"splits_{x}",
        f"""SELECT series_id, 'rolling_origin' AS protocol, 'T' || (f + 1) AS fold, day,
        CASE WHEN test THEN 'test' WHEN rk <= least(greatest(7, CAST(ceil(nc * 0.15) AS INT)), greatest(nc - 1, 1)) THEN 'val' ELSE 'train' END AS role
        FROM (SELECT *, count(*) OVER (PARTITION BY series_id, f, cand) AS nc,
        row_number() OVER (PARTITION BY series_id, f, cand ORDER BY day DESC) AS rk FROM roll_{x})
        UNION ALL SELECT series_id, 'random_day', 'K' || (f + 1), day,
        CASE WHEN test THEN 'test' WHEN rk <= greatest(7, CAST(floor(nc * 0.1) AS INT)) THEN 'val' ELSE 'train' END
        FROM (SELECT *, count(*) OVER (PARTITION BY series_id, f, cand) AS nc,
        row_number() OVER (PARTITION BY series_id, f, cand ORDER BY md5(({seed} + f) || '|' || CAST(day AS VARCHAR)), day) AS rk FROM rand_{x})""",
    )
    part(
        f"train_{x}",
        f"""SELECT w.*, s.protocol, s.fold FROM whole_{x} w JOIN splits_{x} s ON s.series_id = w.series_id AND s.day = w.day
        WHERE s.role = 'train' AND NOT is_missing""",
    )
    fold = "series_id, protocol, fold"
    part(
        f"fcap_{x}",
        f"""SELECT {fold}, count(*) AS n_train, CASE WHEN count(*) > 50 THEN quantile_cont(y_filled, 0.999) ELSE max(capacity) END AS capacity_fold
        FROM train_{x} GROUP BY ALL""",
    )
    part(f"clim_cell_{x}", f"SELECT {fold}, month(ts) AS m, slot % {season} AS s, avg(y) AS v FROM train_{x} GROUP BY ALL")
    part(f"clim_slot_{x}", f"SELECT {fold}, slot % {season} AS s, avg(y) AS v FROM train_{x} GROUP BY ALL")
    part(f"clim_all_{x}", f"SELECT {fold}, avg(y) AS v FROM train_{x} GROUP BY ALL")
    part(
        f"ratio_{x}",
        f"""SELECT {fold}, slot % {season} AS s,
        least(greatest(y / greatest(capacity_fold * driver / 1000.0, 1.0), 0.0), 1.5) AS v
        FROM train_{x} JOIN fcap_{x} USING ({fold})""",
    )
    part(f"ratio_slot_{x}", f"SELECT {fold}, s, avg(v) AS v FROM ratio_{x} GROUP BY ALL")
    part(f"ratio_all_{x}", f"SELECT {fold}, avg(v) AS v FROM ratio_{x} GROUP BY ALL")
    part(
        f"fit_{x}",
        f"""SELECT {fold}, sum({x1}*y)/nullif(sum({x1}*{x1}),0) AS slope, covar_pop({x1}, {x1})*covar_pop({x2}, {x2}) - covar_pop({x1}, {x2})**2 AS det,
        CASE WHEN det > 1e-9*var_pop({x1})*var_pop({x2}) THEN (covar_pop({x1}, y)*var_pop({x2}) - covar_pop({x2}, y)*covar_pop({x1}, {x2}))/det END AS b1,
        CASE WHEN det > 1e-9*var_pop({x1})*var_pop({x2}) THEN (covar_pop({x2}, y)*var_pop({x1}) - covar_pop({x1}, y)*covar_pop({x1}, {x2}))/det END AS b2,
        avg(y) - b1*avg({x1}) - b2*avg({x2}) AS b0 FROM train_{x} WHERE {x1} IS NOT NULL AND {x2} IS NOT NULL GROUP BY ALL""",
    )
    part(
        f"fc_{x}",
        f"""SELECT {fold}, role, slot, ts, day, y, active, is_missing, driver, capacity, capacity_fold,
        lag_seen, prev_y IS NOT NULL AS back_seen, cell_seen, slot_seen, greatest(coalesce(prev_y, clim, 0), 0) AS Persistence, clim AS Climatology,
        greatest(coalesce(CASE WHEN pair_y IS NOT NULL THEN least(greatest(pair_y / greatest(capacity_fold*pair_g/1000.0, 1.0), 0.0), 1.5) END, rs, ra, 0)
          * greatest(capacity_fold*coalesce(driver, 0)/1000.0, 0), 0) AS SmartPersistence, scaled AS Scaled, coalesce(ols, scaled) AS OLS2 FROM (
        SELECT w.*, sp.protocol, sp.fold, sp.role, fc.capacity_fold, cc.v IS NOT NULL AS cell_seen, cs.v IS NOT NULL AS slot_seen, greatest(coalesce(cc.v, cs.v, ca.v), 0) AS clim, rs.v AS rs, ra.v AS ra,
        coalesce(greatest(ft.slope*w.{x1}, CASE WHEN ft.slope IS NULL THEN NULL ELSE 0 END), 0) AS scaled,
        CASE WHEN ft.b0 IS NOT NULL THEN greatest(ft.b0 + ft.b1*w.{x1} + ft.b2*w.{x2}, 0) END AS ols
        FROM whole_{x} w JOIN splits_{x} sp ON sp.series_id = w.series_id AND sp.day = w.day AND sp.role <> 'train'
        JOIN fcap_{x} fc ON fc.series_id = w.series_id AND fc.protocol = sp.protocol AND fc.fold = sp.fold
        LEFT JOIN clim_cell_{x} cc ON cc.series_id = w.series_id AND cc.protocol = sp.protocol AND cc.fold = sp.fold AND cc.m = month(w.ts) AND cc.s = w.slot % {season}
        LEFT JOIN clim_slot_{x} cs ON cs.series_id = w.series_id AND cs.protocol = sp.protocol AND cs.fold = sp.fold AND cs.s = w.slot % {season}
        LEFT JOIN clim_all_{x} ca ON ca.series_id = w.series_id AND ca.protocol = sp.protocol AND ca.fold = sp.fold
        LEFT JOIN ratio_slot_{x} rs ON rs.series_id = w.series_id AND rs.protocol = sp.protocol AND rs.fold = sp.fold AND rs.s = w.slot % {season}
        LEFT JOIN ratio_all_{x} ra ON ra.series_id = w.series_id AND ra.protocol = sp.protocol AND ra.fold = sp.fold
        LEFT JOIN fit_{x} ft ON ft.series_id = w.series_id AND ft.protocol = sp.protocol AND ft.fold = sp.fold)""",
    )
    models = ["Persistence", "Climatology", "SmartPersistence", "Scaled", "OLS2"]
    names, values = ", ".join(f"'{m}'" for m in models), ", ".join(models)
    part(f"test_{x}", f"SELECT * FROM fc_{x} WHERE role = 'test'")
    part(f"pred_{x}", f"SELECT * EXCLUDE ({values}), unnest([{names}]) AS model, unnest([{values}]) AS yhat FROM test_{x}")
    part(f"obs_{x}", f"SELECT * FROM pred_{x} WHERE NOT is_missing")
    part(f"sub_{x}", f"SELECT *, unnest(CASE WHEN active THEN ['ALL', 'active'] ELSE ['ALL'] END) AS subset FROM obs_{x}")
    part(
        f"gram_{x}",
        f"""SELECT series_id, protocol, fold, count(*) AS n, sum(y) AS sy, sum(Scaled) AS s1, sum(OLS2) AS s2, sum(Scaled*Scaled) AS g11,
        sum(Scaled*OLS2) AS g12, sum(OLS2*OLS2) AS g22, sum(Scaled*y) AS h1, sum(OLS2*y) AS h2,
        sqrt(avg((y-Scaled)**2)) AS e1, sqrt(avg((y-OLS2)**2)) AS e2 FROM fc_{x} WHERE role = 'val' AND active AND NOT is_missing GROUP BY ALL""",
    )
    part(
        f"weights_{x}",
        f"""SELECT *, (h1*g22 - h2*g12)/(g11*g22 - g12*g12) AS u1, (h2*g11 - h1*g12)/(g11*g22 - g12*g12) AS u2,
        CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN -h1*h1/g11 <= -h2*h2/g22 THEN h1/g11 ELSE 0 END AS n1,
        CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN -h1*h1/g11 <= -h2*h2/g22 THEN 0 ELSE h2/g22 END AS n2,
        least(greatest((h1 - h2 - g12 + g22)/(g11 - 2*g12 + g22), 0), 1) AS c1,
        (1/e1)/(1/e1 + 1/e2) AS v1, g11 - s1*s1/n + 1 AS r11, g12 - s1*s2/n AS r12, g22 - s2*s2/n + 1 AS r22, h1 - s1*sy/n AS q1, h2 - s2*sy/n AS q2,
        (q1*r22 - q2*r12)/(r11*r22 - r12*r12) AS k1, (q2*r11 - q1*r12)/(r11*r22 - r12*r12) AS k2, (sy - k1*s1 - k2*s2)/n AS k0 FROM gram_{x}""",
    )
    part(
        f"fused_{x}",
        f"""SELECT t.*, (Scaled + OLS2)/2 AS Mean, v1*Scaled + (1-v1)*OLS2 AS InvRMSE, greatest(k0 + k1*Scaled + k2*OLS2, 0) AS RidgeStack,
        greatest(n1*Scaled + n2*OLS2, 0) AS NNLSStack, greatest((n1*Scaled + n2*OLS2)/(n1+n2), 0) AS NNLSRenormalised,
        greatest(c1*Scaled + (1-c1)*OLS2, 0) AS NNLSConvex, CASE WHEN e1 <= e2 THEN Scaled ELSE OLS2 END AS BestSingleByVal
        FROM test_{x} t JOIN weights_{x} w ON w.series_id = t.series_id AND w.protocol = t.protocol AND w.fold = t.fold""",
    )
    part(f"pair_{x}", f"SELECT *, unnest(CASE WHEN active THEN ['ALL', 'active'] ELSE ['ALL'] END) AS subset FROM test_{x} WHERE NOT is_missing")


_backtest("h", 24, 24, 12, 3, 5, 50, "n_events", "mean_value")
_backtest("d", 7, 1, 730, 4, 5, 200, "n_orders", "mean_price")
# the daily panel with a short head, so that early folds meet unseen months
part("frame_e", "SELECT * FROM frame_d")
_backtest("e", 7, 1, 150, 6, 5, 100, "n_orders", "mean_price")

# experiment grids: settings are prefixes of the series id
part("late_h", "SELECT slot + 24 AS slot, n_events, mean_value, mean_k FROM exog_h")
part("other_h", "SELECT slot + 1 AS slot, n_events, mean_value, mean_k FROM exog_h")
part("frame_p", " UNION ALL ".join(hourly_frame("panel_h", f"{e}_h", prefix=f"{p}/") for p, e in (("now", "exog"), ("late", "late"), ("other", "other"))))
_products = ", ".join(f"{filled(f'{p}.{v}')} AS {v}_{p}" for p in ("late", "other") for v in ("n_events", "mean_k"))
part("prod_h", f"SELECT p.series_id, p.slot, {_products} FROM panel_h p LEFT JOIN late_h late ON late.slot = p.slot LEFT JOIN other_h other ON other.slot = p.slot")
part("train_q", "SELECT * FROM train_h JOIN prod_h USING (series_id, slot)")
part("test_q", "SELECT w.*, s.protocol, s.fold FROM whole_h w JOIN splits_h s ON s.series_id = w.series_id AND s.day = w.day AND s.role = 'test'")
_backtest("p", 24, 24, 12, 3, 5, 50, "n_events", "mean_value")
for _k in (-1, -2):
    part(f"moved{-_k}", f"SELECT series_id, slot - {-_k} AS slot, ts - INTERVAL {-_k} HOUR AS ts, y, y_filled, is_missing FROM panel_h")
part("sun_w", f"SELECT slot, ts, {sun_items('50.91', '-1.40')} FROM (SELECT DISTINCT slot, ts FROM panel_h UNION SELECT slot, ts FROM moved1 UNION SELECT slot, ts FROM moved2)")
part(
    "frame_w",
    " UNION ALL ".join(
        hourly_frame(p, "exog_h", "sun_w", f"{k}/") for p, k in (("panel_h", 0), ("moved1", -1), ("moved2", -2))
    ),
)
_backtest("w", 24, 24, 12, 3, 5, 50, "n_events", "mean_value")
part("ctx_w", "SELECT series_id, slot, avg(n_events) OVER (PARTITION BY series_id ORDER BY slot ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS roll3 FROM frame_w")
part("frame_r", "SELECT k || '/' || series_id AS series_id, slot, ts, y, y_filled, is_missing, n_events, mean_value, mean_k, active, driver, capacity FROM frame_h, (SELECT unnest([0, 1, 2, 3, 4]) AS k)")
_backtest("r", 24, 24, 12, 3, 5, 50, "n_events", "mean_value", "CAST(split_part(series_id, '/', 1) AS INT)")


def ridge1(src: str, x: str, keys: str, alpha: float = 1.0) -> str:
    """One-feature ridge on the standardised feature, in closed form."""
    return f"""SELECT {keys}, count(*) AS n_train, count(*) * covar_pop({x}, y) / stddev_pop({x}) / (count(*) + {alpha}) / stddev_pop({x}) AS w1,
    avg(y) - w1*avg({x}) AS w0 FROM {src} GROUP BY {keys}"""


def ridge2(src: str, x1: str, x2: str, keys: str, alpha: float = 1.0) -> str:
    """Two-feature ridge on standardised features, in closed form."""
    return f"""SELECT {keys}, count(*) AS n_train, stddev_pop({x1}) AS sd1, stddev_pop({x2}) AS sd2, n_train * corr({x1}, {x2}) AS g_, n_train + {alpha} AS d_,
    n_train * covar_pop({x1}, y) / sd1 AS q1_, n_train * covar_pop({x2}, y) / sd2 AS q2_,
    (q1_*d_ - q2_*g_)/(d_*d_ - g_*g_)/sd1 AS w1, (q2_*d_ - q1_*g_)/(d_*d_ - g_*g_)/sd2 AS w2, avg(y) - w1*avg({x1}) - w2*avg({x2}) AS w0
    FROM {src} GROUP BY {keys}"""
