"""Penalised least squares in SQL, for checking: any number of features, exact but for rounding.

`fits` takes rows (id, x, y) and penalties (id, candidate, l1, l2) and minimises, for each id and
candidate, 1/(2n)|y - Xw|^2 + l1 |w|_1 + l2/2 |w|^2 about the means. Features are scaled to unit
variance. Without l1 one elimination solves it. With l1, alternating steps between the quadratic and the
soft threshold find which weights are zero and the signs of the others; for these signs one more
elimination gives the optimum itself.
"""

from __future__ import annotations

STEPS = 400
PULL = 0.05  # how hard the two halves of a step are tied; any positive number converges
ROUNDS = 4  # solutions for the signs found, each without the weights that turned their sign


def eliminate(name: str, source: str) -> str:
    """CTEs: (id, candidate, a) with a = [A | R] to (id, candidate, a) with a = [I | A^-1 R]. The
    matrices are positive definite with a unit diagonal, so no rows are exchanged."""
    return f"""{name}_steps as (
      select id, candidate, 1 as k, a from {source}
      union all
      select id, candidate, k + 1, list_transform(a, lambda line, i: case when i = k then p
          else list_transform(line, lambda v, j: v - line[k] * p[j]) end)
      from (
        select id, candidate, k, a, list_transform(a[k], lambda v: v / a[k][k]) as p
        from {name}_steps where k <= len(a))),
    {name} as materialized (select id, candidate, a from {name}_steps where k = len(a) + 1)"""


def _matrix(diagonal: str, right: str, kept: str = "true") -> str:
    """[C + diagonal | right], with the identity where a feature is not kept."""
    return f"""list_transform(c, lambda line, i: list_concat(
        list_transform(line, lambda v, j: case when i = j then v + {diagonal}
          when {kept} then v else 0e0 end), {right}))"""


def _polished() -> str:
    made = []
    for i in range(ROUNDS):
        kept = _matrix(
            "two[i]",
            "[case when sg[i] <> 0 then b[i] - one[i] * sg[i] else 0e0 end]",
            "sg[i] <> 0 and sg[j] <> 0",
        )
        made += [
            f"""kept{i} as materialized (
      select id, candidate, {kept} as a from posed join signs{i} using (id, candidate))""",
            eliminate(f"exact{i + 1}", f"kept{i}"),
            f"""signs{i + 1} as materialized (
      select id, candidate, list_transform(sg, lambda v, j: case when v = sign(a[j][-1]) then v else 0 end) as sg
      from signs{i} join exact{i + 1} using (id, candidate))""",
        ]
    return ",\n    ".join(made)


def fits(rows: str, tries: str, name: str = "fits") -> str:
    """CTEs down to `name`: (id, candidate, w, mx, my) with weights and means as lists."""
    return f"""points_by_feature as materialized (
      select id, r, y, unnest(x) as x, generate_subscripts(x, 1) as j
      from (select *, row_number() over () as r from {rows})),
    scales as materialized (
      select id, j, avg(x) as mx, var_pop(x) > 0 as live,
        case when var_pop(x) > 0 then stddev_pop(x) else 1e0 end as s,
        case when var_pop(x) > 0 then covar_pop(x, y) else 0e0 end as b
      from points_by_feature group by id, j),
    products as materialized (
      select a.id, a.j as i, b.j, covar_pop(a.x, b.x) as v
      from points_by_feature a join points_by_feature b on a.id = b.id and a.r = b.r group by a.id, a.j, b.j),
    lines as materialized (
      select p.id, p.i, list(case when f.live and g.live then v / (f.s * g.s)
          when p.i = p.j then 1e0 else 0e0 end order by p.j) as line
      from products p join scales f on p.id = f.id and p.i = f.j
        join scales g on p.id = g.id and p.j = g.j
      group by p.id, p.i),
    sides as materialized (
      select id, list(s order by j) as s, list(mx order by j) as mx, list(b / s order by j) as b
      from scales group by id),
    base as materialized (
      select l.id, list(line order by i) as c, any_value(s) as s, any_value(mx) as mx,
        any_value(b) as b, any_value(my) as my
      from lines l join sides using (id)
        join (select id, avg(y) as my from {rows} group by id) using (id)
      group by l.id),
    posed as materialized (
      select base.*, candidate, list_transform(s, lambda v: l1 / v) as one,
        list_transform(s, lambda v: l2 / (v * v)) as two
      from base join {tries} using (id)),
    ridges as materialized (
      select id, candidate, {_matrix("two[i] + case when one[i] > 0 then 1e-6 else 0e0 end", "[b[i]]")} as a
      from posed),
    {eliminate("smooth", "ridges")},
    inverses as materialized (
      select id, candidate, {_matrix(f"two[i] + {PULL}e0",
        "list_transform(c, lambda other, j: case when i = j then 1e0 else 0e0 end)")} as a
      from posed where list_max(one) > 0),
    {eliminate("inverted", "inverses")},
    tied as materialized (
      select p.id, p.candidate, p.b, p.one,
        list_transform(i.a, lambda line: line[len(i.a) + 1:]) as m
      from posed p join inverted i on p.id = i.id and p.candidate = i.candidate),
    turns as (
      select id, candidate, 0 as t, list_transform(a, lambda line: line[-1]) as z,
        list_transform(a, lambda line, i: sign(line[-1]) * one[i] / {PULL}e0) as u
      from smooth join tied using (id, candidate)
      union all
      select id, candidate, t + 1,
        list_transform(h, lambda v, i: sign(v) * greatest(abs(v) - one[i] / {PULL}e0, 0e0)),
        list_transform(h, lambda v, i: sign(v) * least(abs(v), one[i] / {PULL}e0))
      from (
        select id, candidate, t, one, list_transform(m, lambda line, i: list_dot_product(line,
            list_transform(b, lambda v, j: v + {PULL}e0 * (z[j] - u[j]))) + u[i]) as h
        from turns join tied using (id, candidate) where t < {STEPS})),
    signs0 as materialized (
      select id, candidate, list_transform(z, lambda v: sign(v)) as sg from turns where t = {STEPS}),
    {_polished()},
    {name} as materialized (
      select p.id, p.candidate, list_transform(coalesce(e.a, f.a), lambda line, i: line[-1] / s[i]) as w,
        mx, my
      from posed p join smooth f on p.id = f.id and p.candidate = f.candidate
        left join exact{ROUNDS} e on p.id = e.id and p.candidate = e.candidate)"""


def predicted(x: str = "x") -> str:
    """The prediction of one fit for a list of features."""
    return f"my + list_dot_product(w, list_transform({x}, lambda v, i: v - mx[i]))"
