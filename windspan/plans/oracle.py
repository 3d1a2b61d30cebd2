"""The same queries in plain SQL, for checking. Each string is one statement over the tables."""

from __future__ import annotations

import numpy as np

from windspan.plans.linear_sql import fits, predicted

_VIEWS = {
    "sites": """
    select * from (values
      ('gyeongju', '경주풍력', 'gyeongju', 35.7149e0, 129.3693e0, 56.5e0, 1.04e0),
      ('yangyang', '양양풍력', 'yangyang', 37.9330943e0, 128.6943946e0, 67.85e0, 1.05e0),
      ('yeongdeok', '영덕풍력', 'yeongduk', 36.4198685e0, 129.3960048e0, 75.5e0, 1.05e0)
    ) t(site, plant_name, target_tag, lat, lon, turbine_rad, capacity_factor)""",
    "grid": """
    select date_trunc('hour', ts) as time,
      35.0e0 + (user_id % 15) * 0.2e0 as latitude,
      128.5e0 + (user_id % 7) * 0.2e0 as longitude,
      268.15e0 + value % 40 as ta_1p5m,
      20e0 + event_id % 80 as rh_1p5m,
      990e0 + event_id % 50 as pmsl,
      (event_id % 31) - 14.5e0 as uws_10m,
      (event_id % 23) - 10.75e0 as vws_10m,
      value / 100 as fvmin_50m,
      value / 100 + event_id % 7 as fvmax_50m
    from events where event_type <> 'purchase'""",
    "target": """
    select case user_id % 3 when 0 then 'gyeongju' when 1 then 'yangyang' else 'yeongduk' end
        as filename,
      date_trunc('hour', ts) as end_datetime, max(value) * 100 as energy_kwh
    from events where event_type = 'purchase' group by 1, 2""",
    "site_target": """
    select s.site, s.plant_name, s.capacity_factor, t.end_datetime, t.energy_kwh
    from target t join sites s on t.filename = s.target_tag""",
    "cells": """
    select s.site, g.* from grid g join sites s
      on g.latitude between s.lat - 0.5e0 and s.lat + 0.5e0
      and g.longitude between s.lon - 0.7e0 and s.lon + 0.7e0""",
    "series": """
    select site, time,
      cast(max(cast(latitude as float)) as double) as latitude,
      cast(max(cast(longitude as float)) as double) as longitude,
      cast(max(cast(ta_1p5m as float)) as double) as ta_1p5m,
      cast(max(cast(rh_1p5m as float)) as double) as rh_1p5m,
      cast(max(cast(pmsl as float)) as double) as pmsl,
      cast(max(cast(uws_10m as float)) as double) as uws_10m,
      cast(max(cast(vws_10m as float)) as double) as vws_10m,
      cast(max(cast(fvmin_50m as float)) as double) as fvmin_50m,
      cast(max(cast(fvmax_50m as float)) as double) as fvmax_50m
    from cells group by site, time""",
    "daily": """
    select o_orderpriority as site, o_orderdate as time, max(o_totalprice) as energy_kwh,
      count(*) as n_orders
    from orders group by 1, 2""",
    "daily_all": """
    select 'all' as site, o_orderdate as time, max(o_totalprice) as energy_kwh,
      count(*) as n_orders
    from orders group by 2""",
    "scored": """
    select *, energy_kwh * 0.9e0 + 1000 * n_orders as prediction,
      max(energy_kwh) over (partition by site) * 1.05e0 as capacity
    from daily""",
    "regimes": """
    select site, time, energy_kwh,
      case when energy_kwh >= 0.5e0 * capacity then 'high'
        when energy_kwh < 0.5e0 * capacity then 'low' end as regime
    from scored""",
    "physics": """
    select *, speed * speed * speed as speed_cubed,
      (degrees(atan2(vws_10m, uws_10m)) + 360) % 360 as bearing,
      (degrees(atan2(fvmin_50m, fvmax_50m)) + 360) % 360 as storm_bearing,
      pmsl * 100 / (287.05e0 * ta_1p5m) as density,
      pi() * turbine_rad * turbine_rad as area
    from (
      select r.*, s.turbine_rad, sqrt(uws_10m * uws_10m + vws_10m * vws_10m) as speed
      from series r join sites s using (site))""",
    "paths": """
    select event_id,
      case when event_id % 17 = 0 then 'broken'
        else strftime(ts, '%Y-%m-%d_%H_%M_%S') end as stem,
      case when event_id % 13 = 0 then '20231231' else strftime(ts, '%Y%m%d') end as folder_date,
      date_trunc('second', ts) as time
    from events""",
    "days": """
    select *, case when energy_kwh >= 0.5e0 * capacity then 'high' else 'low' end as regime
    from (select *, max(energy_kwh) over () * 1.05e0 as capacity from daily_all)""",
}
_NEEDS = {
    "site_target": ["sites", "target"],
    "cells": ["sites", "grid"],
    "series": ["cells"],
    "scored": ["daily"],
    "regimes": ["scored"],
    "physics": ["series"],
    "days": ["daily_all"],
}
_SERIES_COLUMNS = (
    "latitude, longitude, ta_1p5m, rh_1p5m, pmsl, uws_10m, vws_10m, fvmin_50m, fvmax_50m"
)


def _sql(views: str, body: str) -> str:
    """`body` after a WITH list of the views it needs, each after those it needs itself."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in views.split():
        add(name)
    head = ",\n".join(f"{n} as ({_VIEWS[n]})" for n in order)
    body = body.strip()
    if not head:
        return body
    if body.startswith("with "):
        return f"with recursive {head},\n{body[5:]}"
    return f"with recursive {head}\n{body}"


def _filled(rows: str, columns: list[str], extra: str = "", places: int = 6) -> str:
    """Linear interpolation by position `pos` over a named set of rows."""
    around = ",\n".join(
        f"""last_value(case when {c} is not null then pos end ignore nulls) over back as bp_{c},
        last_value({c} ignore nulls) over back as bv_{c},
        first_value(case when {c} is not null then pos end ignore nulls) over ahead as ap_{c},
        first_value({c} ignore nulls) over ahead as av_{c}"""
        for c in columns
    )
    made = ", ".join(
        f"""round(case when {c} is not null then {c} when ap_{c} is null then bv_{c}
          else bv_{c} + (av_{c} - bv_{c}) * (pos - bp_{c}) / (ap_{c} - bp_{c}) end, {places}) as {c}"""
        for c in columns
    )
    return f"""around as (select *, {around} from {rows}
      window back as (partition by site order by pos
          rows between unbounded preceding and current row),
        ahead as (partition by site order by pos
          rows between current row and unbounded following))
      select site, time, {made}{extra} from around"""


def _spine(source: str, step: str) -> str:
    return f"""spine as (
        select site, time, row_number() over (partition by site order by time) - 1 as pos from (
          select site, unnest(generate_series(lo, hi, interval 1 {step})) as time
          from (select site, min(time) as lo, max(time) as hi from {source} group by site)))"""


def _smooth(window: int) -> str:
    back, ahead = window // 2, window - 1 - window // 2
    return _sql(
        "series",
        f"""select site, time, round(case when count(*) over (partition by site) < {window}
          then pmsl else sum(pmsl) over (partition by site order by time
            rows between {back} preceding and {ahead} following) / {window} end, 6) as pmsl
        from series""",
    )


_DERIVED = {
    "absolute_humidity": """216.7e0 * (rh_1p5m * (6.112e0 * exp(17.67e0 * (ta_1p5m - 273.15e0)
        / (ta_1p5m - 273.15e0 + 243.5e0))) / 100) / ta_1p5m""",
    "turbine_area": "area",
    "air_density": "density",
    "storm_speed": "sqrt(fvmax_50m * fvmax_50m + fvmin_50m * fvmin_50m)",
    "wind_speed": "speed",
    "wind_speed_squared": "speed * speed",
    "wind_direction": "bearing",
    "storm_direction": "storm_bearing",
    "wind_direction_diff": "abs(bearing - storm_bearing)",
    "wind_speed_direction_interaction": "speed * cos(radians(bearing))",
    "turbulence_intensity": "(fvmax_50m - fvmin_50m) / (speed + 0.1e0)",
    "wind_energy": "0.5e0 * density * area * speed_cubed / 1000 / 3600",
}
_FEATURES = [*_SERIES_COLUMNS.split(", "), *_DERIVED]
# Complete rows of one site, a spine for the others; both with row positions.
_PLACED = f"""full_rows as (
      select p.site, p.time, t.energy_kwh, {_SERIES_COLUMNS},
        {", ".join(f"{sql} as {name}" for name, sql in _DERIVED.items())}
      from physics p left join site_target t on p.site = t.site and p.time = t.end_datetime
      where p.time <> timestamp '2024-01-01 00:00:00'),
    spine as (
      select site, unnest(generate_series(timestamp '2024-01-01 01:00:00',
        timestamp '2024-01-30 23:00:00', interval 1 hour)) as time
      from sites where site <> 'gyeongju'),
    placed as (
      select s.site, s.time, row_number() over (partition by s.site order by s.time) - 1 as pos,
        energy_kwh, {", ".join(_FEATURES)}
      from spine s left join full_rows r on s.site = r.site and s.time = r.time
      union all
      select site, time, row_number() over (partition by site order by time) - 1, energy_kwh,
        {", ".join(_FEATURES)}
      from full_rows where site = 'gyeongju')"""
_CALENDAR = """, energy_kwh, cast(year(time) as int) as year, cast(month(time) as int) as month,
      cast(day(time) as int) as day, cast(hour(time) as int) as hour"""


def _draws(n: int, alpha: tuple[float, float], ratio: bool, choices: int) -> list[tuple[float, float]]:
    """(alpha, l1_ratio) as one generator with the seed 42 draws them: parameters in order of name, of
    which the last is a choice. Numbers are uniform from low to low + width."""
    rng = np.random.RandomState(42)
    made = []
    for _ in range(n):
        a = alpha[0] + alpha[1] * rng.uniform()
        made.append((a, rng.uniform() if ratio else 0.0))
        rng.randint(choices)
    return made


# Ranges, number of draws and number of choices of the parameter that is not used.
_RIDGE = {"high": _draws(20, (0.1, 10.0), False, 6), "low": _draws(7, (0.01, 5.0), False, 6)}
_NET = {"high": _draws(20, (0.001, 50.0), True, 2), "low": _draws(15, (0.001, 20.0), True, 2)}


def _tries(drawn: dict) -> str:
    rows = [
        f"('{regime}', {i}, {a!r}::double, {l!r}::double)"
        for regime, some in drawn.items()
        for i, (a, l) in enumerate(some)
    ]
    return f"drawn as (select * from (values {', '.join(rows)}) t(regime, candidate, alpha, l1_ratio))"


def _searched(rows: str, drawn: dict, ridge: bool) -> str:
    """CTEs from `rows` (site, regime, time, x, y) to `mae` (site, regime, candidate, mae) and `best`, the
    fits of the best candidates on all rows of each regime."""
    l1, l2 = ("0e0", "alpha / n") if ridge else ("alpha * l1_ratio", "alpha - alpha * l1_ratio")
    return f"""folded as (
      select *, ntile(3) over (partition by site, regime order by time) - 1 as fold from {rows}),
    turns_out as (select * from (values (-1), (0), (1), (2)) t(left_out)),
    samples as (
      select site || '|' || regime || '|' || left_out as id, x, y
      from folded join turns_out on fold <> left_out),
    {_tries(drawn)},
    penalties as (
      select id, candidate, {l1} as l1, {l2} as l2
      from (select id, count(*) as n from samples group by id) join drawn
        on regime = split_part(id, '|', 2)),
    {fits("samples", "penalties")},
    scored as (
      select f.site, f.regime, f.fold, candidate, avg(abs(y - ({predicted()}))) as mae
      from folded f join fits on id = site || '|' || regime || '|' || fold
      group by f.site, f.regime, f.fold, candidate),
    mae as (
      select site, regime, candidate, avg(mae) as mae from scored group by site, regime, candidate),
    best as (
      select site, regime, w, mx, my
      from (select * from mae qualify row_number() over (partition by site, regime order by mae, candidate) = 1)
        join fits using (candidate) where id = site || '|' || regime || '|-1')"""


_ALL_FEATURES = [*_FEATURES, "year", "month", "day", "hour"]
_LIST = "[" + ", ".join(f"{c}::double" for c in _ALL_FEATURES) + "]"
_FORECAST = f"""with {_PLACED},
    regular as (select * from (with {_filled("placed", _FEATURES, _CALENDAR, 15)})),
    caps as (
      select site, plant_name, max(energy_kwh) * max(capacity_factor) as capacity
      from regular join sites using (site) group by site, plant_name),
    train as (
      select site, time, {_LIST} as x, energy_kwh as y,
        case when energy_kwh >= 0.1e0 * capacity then 'high' else 'low' end as regime
      from regular join caps using (site) where day % 2 = 1 and energy_kwh is not null
      qualify count(*) over (partition by site, regime) >= 3),
    {_searched("train", _NET, False)},
    scored_rows as (
      select t.site, t.time, k.plant_name, k.capacity, max(p) filter (where regime = 'high') as h,
        max(p) filter (where regime = 'low') as l
      from (
        select r.site, r.time, regime, {predicted()} as p
        from (select site, time, {_LIST} as x from regular where day % 2 = 0) r join best using (site)) t
        join caps k using (site)
      group by all),
    gated as (
      select site, time, plant_name, capacity,
        case when coalesce(h, l) >= 0.1e0 * capacity then coalesce(h, l) else coalesce(l, h) end
          as p
      from scored_rows),
    final as (
      select site, time, plant_name, least(greatest(
        case when p >= 0.1e0 * capacity then p * 1.05e0 else p end, 0e0), capacity) as p
      from gated)
    select site, time, plant_name,
      round(case when count(*) over (partition by site) < 5 then p
        else sum(p) over (partition by site order by time
          rows between 2 preceding and 2 following) / 5 end, 2) as energy_kwh
    from final"""

_DAY_LIST = """[n_orders::double, year(time)::double, month(time)::double, day(time)::double,
      hour(time)::double]"""


def _coefficients(l1: str, l2: str) -> str:
    return f"""with samples as (select 'all' as id, {_DAY_LIST}[:4] as x, energy_kwh as y from daily_all),
    penalties as (
      select 'all' as id, 0 as candidate, {l1} as l1, {l2} as l2
      from (select count(*) as n from samples)),
    {fits("samples", "penalties")}
    select unnest(['n_orders', 'year', 'month', 'day']) as feature,
      round(unnest(w), 3) as weight from fits"""


def _search_scores(drawn: dict, ridge: bool) -> str:
    return f"""with rows as (select site, time, regime, {_DAY_LIST} as x, energy_kwh as y from days),
    {_searched("rows", drawn, ridge)}
    select regime, candidate::int as candidate, round(alpha, 6) as alpha,
      round(l1_ratio, 6) as l1_ratio, round(mae, 3) as mae,
      (case when row_number() over (partition by regime order by mae, candidate) = 1 then 1 else 0 end)::int
        as is_best
    from mae join drawn using (regime, candidate)"""


_DUAL = f"""with cap as (select max(energy_kwh) * 1.05e0 as capacity from daily_all),
    points as (
      select site, time, {_DAY_LIST} as x, energy_kwh as y,
        case when energy_kwh >= 0.5e0 * capacity then 'high' else 'low' end as regime
      from daily_all, cap),
    train as (select * from points where month(time) % 2 = 1),
    {_searched("train", _RIDGE, True)},
    paired as (
      select site, time, coalesce(h, l) as p_high, coalesce(l, h) as p_low
      from (
        select p.site, p.time, max({predicted()}) filter (where b.regime = 'high') as h,
          max({predicted()}) filter (where b.regime = 'low') as l
        from points p join best b on p.site = b.site where month(p.time) % 2 = 0
        group by p.site, p.time))
    select site, time, round(p_high, 2) as p_high, round(p_low, 2) as p_low,
      round(case when p_high >= 0.5e0 * capacity then p_high else p_low end, 2) as prediction
    from paired, cap"""

_SLOPES = """with m as (
      select covar_pop(n_orders, energy_kwh) as c, var_pop(n_orders) as q, avg(n_orders) as mx,
        avg(energy_kwh) as my, count(*) as n
      from daily_all),
    fits as (
      select 'elasticnet' as kind,
        sign(c) * greatest(abs(c) - 0.5e0, 0e0) / (q + 1.5e0) as slope, mx, my from m
      union all
      select 'lasso', sign(c) * greatest(abs(c) - 50e0, 0e0) / q, mx, my from m
      union all
      select 'ridge', c / (q + 3e0 / n), mx, my from m)
    select kind, round(slope, 3) as slope, round(my - slope * mx, 3) as intercept from fits"""


_SIGNATURE = ", ".join(f"{c}: double" for c in _SERIES_COLUMNS.split(", "))
_ODD = "time between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-05 02:00:00'"


def _stumps(weights: list[float]) -> str:
    """Trees of one split, each fitted to twice what the ones before leave, and their weighted sum.

    A split lies midway between two neighbour values of a feature; that with the least squares
    left over wins, the first feature and value among equals.
    """
    parts = [
        """points as (
          select site, time, month(time) % 2 = 1 as train, energy_kwh as y, 0e0 as p,
            [n_orders::double, year(time)::double, month(time)::double, day(time)::double] as x
          from daily_all)"""
    ]
    rows = "points"
    for i, weight in enumerate(weights):
        label = "y" if i == 0 else "2e0 * (y - p)"
        parts.append(f"""sums{i} as materialized (
          select j, x, count(*) as n, sum(r) as s
          from (select generate_subscripts(x, 1) as j, unnest(x) as x, {label} as r from {rows} where train)
          group by j, x),
        cuts{i} as materialized (
          select j, (x + lead(x) over along) / 2 as cut,
            sum(n) over so_far as n, sum(s) over so_far as s,
            sum(n) over (partition by j) as all_n, sum(s) over (partition by j) as all_s
          from sums{i}
          window along as (partition by j order by x),
            so_far as (partition by j order by x rows between unbounded preceding and current row)),
        split{i} as materialized (
          select j, cut, s / n as low, (all_s - s) / (all_n - n) as high
          from cuts{i} where cut is not null
          order by s * s / n + (all_s - s) * (all_s - s) / (all_n - n) desc, j, cut limit 1),
        tree{i} as materialized (
          select p.* replace (p + {weight!r} * case when x[j] <= cut then low else high end as p)
          from {rows} p, split{i})""")
        rows = f"tree{i}"
    return f"""with {", ".join(parts)}
    select site, time, round(p, 2) as prediction from {rows} where not train"""


_SPLIT = """select site, time, energy_kwh, n_orders, cast(year(time) as int) as year,
      cast(month(time) as int) as month, cast(day(time) as int) as day,
      cast(hour(time) as int) as hour, {part} as part
    from daily where {kept}"""


def oracle_sql() -> dict[str, str]:
    mirror = _sql("cells", "select *, strftime(time, '%Y%m%d') as date from cells")
    stored = _sql("series", "select * from series")
    features = _sql("series", "select site, time, ta_1p5m, pmsl from series")
    regular = _sql(
        "physics site_target", f"with {_PLACED}, {_filled('placed', _FEATURES, _CALENDAR)}"
    )
    return {
        "site_features": _sql(
            "physics site_target",
            """select p.site, p.time, t.energy_kwh, round(speed, 6) as wind_speed,
              round(speed * speed, 6) as wind_speed_squared, round(bearing, 6) as wind_direction,
              round(0.5e0 * density * area * speed_cubed / 1000 / 3600, 6) as wind_energy
            from physics p left join site_target t
              on p.site = t.site and p.time = t.end_datetime""",
        ),
        "bbox_filter": _sql(
            "grid",
            """select * from grid where latitude between 35.7149e0 - 0.5e0 and 35.7149e0 + 0.5e0
              and longitude between 129.3693e0 - 0.7e0 and 129.3693e0 + 0.7e0""",
        ),
        "date_range": _sql(
            "grid",
            """select time, latitude, longitude, pmsl from grid
            where cast(time as date) between date '2024-01-05' and date '2024-01-20'""",
        ),
        "site_filter": _sql("target", "select * from target where filename = 'yeongduk'"),
        "numeric_cast": """select event_id, user_id, cast(cast(value as float) as double) as value
            from events""",
        "literal_cols": _sql(
            "grid",
            """select time, pmsl, '경주풍력' as plant_name,
              timestamp '2024-01-01 00:00:00' as run_time from grid""",
        ),
        "drop_cols": _sql("target", "select filename, end_datetime, energy_kwh from target"),
        "feature_cols": _sql(
            "daily",
            """select n_orders, cast(year(time) as int) as year, cast(month(time) as int) as month,
              cast(day(time) as int) as day, cast(hour(time) as int) as hour from daily""",
        ),
        "exclude_time": _sql(
            "series",
            """select site, time, pmsl from series where time <> timestamp '2024-01-01 00:00:00'""",
        ),
        "drop_missing": _sql(
            "series",
            """select site, time, ta_1p5m, pmsl from series
            where hour(time) % 7 <> 0 and hour(time) % 11 <> 0""",
        ),
        "year_split": _sql(
            "daily",
            _SPLIT.format(
                part="case when year(time) <= 1998 then 'train' else 'test' end",
                kept="year(time) <= 1999",
            ),
        ),
        "month_parity_split": _sql(
            "daily",
            _SPLIT.format(
                part="case when month(time) % 2 = 1 then 'train' else 'test' end", kept="true"
            ),
        ),
        "regime_split": _sql("regimes", "select site, time, energy_kwh, regime from regimes"),
        "regime_counts": _sql(
            "regimes",
            """select site, regime, count(*) as n_rows from regimes where regime is not null
            group by site, regime""",
        ),
        "site_grid_join": _sql("cells", "select * from cells"),
        "site_lookup": _sql(
            "target sites",
            """select t.filename, t.end_datetime, t.energy_kwh, s.site, s.plant_name, s.turbine_rad
            from target t join sites s on t.filename = s.target_tag""",
        ),
        "target_join": _sql(
            "series site_target",
            """select r.*, t.energy_kwh from series r left join site_target t
              on r.site = t.site and r.time = t.end_datetime""",
        ),
        "done_dates": _sql(
            "cells",
            """with dates as (select distinct site, strftime(time, '%Y%m%d') as date from cells)
            select * from dates except select * from dates where cast(date as int) % 3 = 0""",
        ),
        "hourly_spine": _sql(
            "series",
            f"""with {_spine("series", "hour")}
            select s.site, s.time, r.ta_1p5m, s.pos from spine s
              left join series r on s.site = r.site and s.time = r.time""",
        ),
        "series_max": _sql(
            "series grid sites",
            f"""select s.site, h.time, {_SERIES_COLUMNS}
            from (select distinct time from grid) h cross join sites s
              left join series r on r.site = s.site and r.time = h.time""",
        ),
        "sorted_series": stored,
        "capacity": _sql(
            "site_target",
            """select site, round(max(energy_kwh) * max(capacity_factor), 6) as capacity
            from site_target group by site""",
        ),
        "plant_counts": _sql(
            "site_target",
            """select plant_name, count(*) as n_forecasts from site_target group by plant_name
            union all select '(total)', count(*) from site_target""",
        ),
        "mae": _sql(
            "scored",
            """select site, round(avg(abs(energy_kwh - prediction)), 3) as mae from scored
            group by site""",
        ),
        "weighted_mae": _sql(
            "scored",
            """select site, round(avg(case when energy_kwh >= 0.1e0 * capacity then 2e0 else 1e0
              end * abs(energy_kwh - prediction)), 3) as weighted_mae
            from scored group by site""",
        ),
        "bias": _sql(
            "scored",
            """select site, round(avg(case when month(time) % 2 = 1 then energy_kwh end)
              - avg(case when month(time) % 2 = 0 then prediction end), 3) as bias
            from scored group by site""",
        ),
        "interpolate": _sql(
            "series",
            f"""with {_spine("series", "hour")},
            placed as (select s.site, s.time, s.pos, r.ta_1p5m, r.pmsl from spine s
              left join series r on s.site = r.site and s.time = r.time),
            {_filled("placed", ["ta_1p5m", "pmsl"], ", pos")}""",
        ),
        "interpolate_minutes": f"""with minutes as (
              select event_type as site, date_trunc('minute', ts) as time,
                max(sqrt(value)) as value
              from events group by 1, 2),
            {_spine("minutes", "minute")},
            placed as (select s.site, s.time, s.pos, r.value from spine s
              left join minutes r on s.site = r.site and s.time = r.time),
            {_filled("placed", ["value"], ", pos")}""",
        "interpolate_rows": _sql(
            "series",
            f"""with placed as (select site, time,
                case when hour(time) % 7 <> 0 then ta_1p5m end as ta_1p5m,
                row_number() over (partition by site order by time) - 1 as pos from series),
            {_filled("placed", ["ta_1p5m"])}""",
        ),
        "smooth_3": _smooth(3),
        "smooth_5": _smooth(5),
        "fold_id": _sql(
            "regimes",
            """select site, time, regime, cast(ntile(3) over (partition by site, regime
              order by time) - 1 as int) as fold from regimes""",
        ),
        "concat_strict": _sql("cells", "select * from cells"),
        "concat_fill": _sql(
            "grid target",
            """select time, pmsl, null::varchar as filename, null::timestamp as end_datetime,
              null::double as energy_kwh from grid
            union all by name select * from target""",
        ),
        "humidity": _sql(
            "series",
            """select site, time, round(216.7e0 * (rh_1p5m * (6.112e0 * exp(17.67e0 *
              (ta_1p5m - 273.15e0) / (ta_1p5m - 273.15e0 + 243.5e0))) / 100) / ta_1p5m, 6)
              as absolute_humidity from series""",
        ),
        "density": _sql(
            "series",
            """select site, time, round(pmsl * 100 / (287.05e0 * ta_1p5m), 6) as air_density
            from series""",
        ),
        "wind": _sql(
            "physics",
            """select site, time, round(sqrt(fvmax_50m * fvmax_50m + fvmin_50m * fvmin_50m), 6)
              as storm_speed, round(speed, 6) as wind_speed,
              round(speed * speed, 6) as wind_speed_squared from physics""",
        ),
        "direction": _sql(
            "physics",
            """select site, time, round(bearing, 6) as wind_direction,
              round(storm_bearing, 6) as storm_direction,
              round(abs(bearing - storm_bearing), 6) as wind_direction_diff,
              round(speed * cos(radians(bearing)), 6) as wind_speed_direction_interaction
            from physics""",
        ),
        "turbulence": _sql(
            "physics",
            """select site, time, round((fvmax_50m - fvmin_50m) / (speed + 0.1e0), 6)
              as turbulence_intensity from physics""",
        ),
        "energy": _sql(
            "physics",
            """select site, time, round(area, 6) as turbine_area,
              round(0.5e0 * density * area * speed_cubed / 1000 / 3600, 6) as wind_energy
            from physics""",
        ),
        "calendar": _sql(
            "daily",
            """select site, time, cast(year(time) as int) as year,
              cast(month(time) as int) as month, cast(day(time) as int) as day,
              cast(hour(time) as int) as hour from daily""",
        ),
        "target_calendar": _sql(
            "target",
            """select *, strftime(end_datetime, '%Y-%m-%d') as date,
              cast(hour(end_datetime) as int) as hour from target""",
        ),
        "parse_time": "select event_id, date_trunc('second', ts) as time from events",
        "local_time": "select event_id, ts + interval 9 hour as time from events",
        "uplift_clip": _sql(
            "scored",
            """select site, time, round(least(greatest(case when prediction >= 0.5e0 * capacity
              then prediction * 1.05e0 else prediction end, 0e0), capacity), 6) as energy_kwh
            from scored""",
        ),
        "path_parts": _sql(
            "paths",
            """select event_id, stem, folder_date,
              replace(split_part(stem, '_', 1), '-', '') as name_date from paths""",
        ),
        "path_guard": _sql(
            "paths",
            """select event_id, time from paths
            where stem <> 'broken' and folder_date = strftime(time, '%Y%m%d')""",
        ),
        "stem_tag": """select event_id, list_extract(string_split(
            'wind_farm_' || replace(event_type, 'u', '_'), '_'), -1) as tag from events""",
        "date_text": _sql(
            "daily", "select site, time, strftime(time, '%Y%m%d') as date_text from daily"
        ),
        "tree_scan": _sql(
            "grid",
            """select * from grid
            where cast(time as date) between date '2024-01-03' and date '2024-01-27'""",
        ),
        "tree_series": _sql(
            "series grid sites",
            f"""select s.site, h.time, {_SERIES_COLUMNS}
            from (select distinct time from grid) h cross join sites s
              left join series r on r.site = s.site and r.time = h.time""",
        ),
        "tree_rejects": _sql(
            "grid",
            """select distinct case when hour(time) % 7 = 1 then 'copy-of-' else '' end
                || strftime(time, '%Y-%m-%d_%H_%M_%S') as stem,
              case when hour(time) % 7 = 1 then 'bad_name' else 'wrong_folder' end as status
            from grid where hour(time) % 7 < 2""",
        ),
        "tree_dates": _sql("grid", "select distinct strftime(time, '%Y%m%d') as date from grid"),
        "mirror_copy": mirror,
        "mirror_resume": mirror,
        "late_hours": mirror,
        "schema_profile": _sql(
            "grid",
            f"""select '{_SIGNATURE}' as signature, count(distinct time) as n_files, null::varchar as stems
            from grid where not ({_ODD}) having count(*) > 0
            union all
            select '{_SIGNATURE}, gust: double', count(distinct time),
              string_agg(distinct strftime(time, '%Y-%m-%d_%H_%M_%S'), ','
                order by strftime(time, '%Y-%m-%d_%H_%M_%S'))
            from grid where {_ODD} having count(*) > 0""",
        ),
        "series_store": stored,
        "series_csv": stored,
        "series_files": stored,
        "target_store": _sql("target", "select * from target"),
        "feature_store": features,
        "forecast_csv": _sql(
            "site_target", "select end_datetime as time, energy_kwh, plant_name from site_target"
        ),
        "linear_slopes": _sql("daily_all", _SLOPES),
        "elastic_net": _sql("daily_all", _coefficients("0.5e0", "1.5e0")),
        "lasso": _sql("daily_all", _coefficients("50e0", "0e0")),
        "ridge": _sql("daily_all", _coefficients("0e0", "3e0 / n")),
        "stump_forest": _sql("daily_all", _stumps([1.0])),
        "stump_boost": _sql("daily_all", _stumps([1.0, 0.1, 0.1])),
        "search_scores": _sql("days", _search_scores(_RIDGE, True)),
        "search_net": _sql("days", _search_scores(_NET, False)),
        "dual_model": _sql("daily_all", _DUAL),
        "regular_rows": regular,
        "mid_output": regular,
        "resume": _sql(
            "physics site_target",
            # Hours with a file but without cells in a site's box have their output too.
            f"""with {_PLACED}, regular as (select * from (
              with {_filled("placed", _FEATURES)}))
            select stage, r.site, r.time, t.energy_kwh, pmsl, wind_speed
            from regular r left join site_target t on r.site = t.site and r.time = t.end_datetime
              and r.time in (select time from grid),
              (values ('grid'), ('features'), ('series')) v(stage)""",
        ),
        "site_forecast": _sql("physics site_target", _FORECAST),
        "stream_ingest": _sql(
            "cells",
            """select *, strftime(time, '%Y%m%d') as date from cells
            union all by name
            select '(quarantine)' as site, unnest([timestamp '2024-01-01 00:30:00',
              timestamp '2024-01-20 00:30:00']) as time""",
        ),
    }
