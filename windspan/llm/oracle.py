"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_BASE32 = "||".join(
    f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || sha[{5 * i + 1}:{5 * i + 5}])::bigint "
    f">> {shift}) & 31) + 1]"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)

WARC = f"""with p as (
    select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as sha
    from pages),
  g as (select sha, max(page_id) as largest from p where payload_bytes >= 0 group by sha)
  select page_id, payload_bytes, {_BASE32} as payload_digest,
    case when page_id is not distinct from largest then 'response' else 'revisit' end as record_type,
    case when page_id is distinct from largest then largest end as refers_to
  from p join g using (sha)"""

MIX = f"""with d as (
    select doc_id, source, coalesce(len({WORDS.format("text")}), 0)::bigint as size,
      ('0x' || md5(':' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')))[1:15])::bigint as h
    from documents),
  sizes as (
    select source, sum(size)::hugeint as source_size from d group by source),
  weighted as (
    select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from sizes),
  filled as (
    select *, 3 * source_size as most, sum(source_size) over () as total,
      sum(weight) over () as all_weight,
      coalesce(sum(3 * source_size) over before, 0) as most_before,
      coalesce(sum(weight) over before, 0) as weight_before
    from weighted
    window before as (order by source_size * 6 // weight, source nulls last
      rows between unbounded preceding and 1 preceding)),
  shared as (
    select *, most * (all_weight - weight_before) <= weight * (total - most_before) as capped
    from filled),
  goals as (
    select source, source_size::bigint as source_size,
      case when capped then most::double else
        (weight * (total - coalesce(sum(most) filter (where capped) over (), 0)))::double
          / (sum(weight) filter (where not capped) over ())::double end as target
    from shared),
  passes as (
    select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole
    from goals),
  hashes as (select source, h, sum(size)::bigint as held from d group by source, h),
  places as (
    select source, h, held,
      (sum(held) over (partition by source order by h) - held)::bigint as ahead from hashes)
  select d.doc_id, d.size, p.source_size, p.target,
    (d.size * (p.whole + case
      when target - whole * source_size <= 0 then 0
      when ahead + held <= target - whole * source_size then 1
      when ahead <= target - whole * source_size
        and target - whole * source_size - ahead > held / 2 then 1 else 0 end))::bigint as taken
  from d join passes p on d.source is not distinct from p.source
    join places q on d.source is not distinct from q.source and d.h = q.h"""

SUBSTRINGS = f"""with d as (
    select doc_id, coalesce({WORDS.format("text")}, []) as words from documents),
  windows as (
    select doc_id, i, array_to_string(words[i:i + 34], ' ') as passage
    from (select doc_id, words, unnest(range(1, len(words) - 33)) as i from d where len(words) >= 35)),
  again as (select passage from windows group by passage having count(*) > 1),
  gone as (
    select distinct doc_id, i + j as place
    from (select doc_id, i, unnest(range(35)) as j from windows semi join again using (passage))),
  placed as (
    select doc_id, unnest(words) as word, generate_subscripts(words, 1) as place from d),
  kept as (
    select doc_id, count(*) as n, string_agg(word, ' ' order by place) as text
    from placed anti join gone using (doc_id, place) group by doc_id)
  select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed,
    sha256(coalesce(kept.text, '')) as kept_sha256
  from d left join kept using (doc_id)"""


def _curve(bits: int, x: list[str]) -> str:
    """CTEs that turn levels `x` of the table `cells` into `place` on the Hilbert curve."""
    steps, last = [], "cells"

    def step(**made: str) -> None:
        nonlocal last
        name = f"step{len(steps)}"
        columns = ", ".join(f"{v} as {k}" for k, v in made.items())
        steps.append(f"{name} as (select * replace ({columns}) from {last})")
        last = name

    for q in range(bits - 1, 0, -1):
        top, low = 1 << q, (1 << q) - 1
        step(**{x[0]: f"case when {x[0]} & {top} > 0 then xor({x[0]}, {low}) else {x[0]} end"})
        for a in x[1:]:
            swap = f"(xor({x[0]}, {a}) & {low})"
            step(
                **{
                    x[0]: f"case when {a} & {top} > 0 then xor({x[0]}, {low}) else xor({x[0]}, {swap}) end",
                    a: f"case when {a} & {top} > 0 then {a} else xor({a}, {swap}) end",
                }
            )
    for a, b in zip(x, x[1:]):
        step(**{b: f"xor({a}, {b})"})
    turn = "0"
    for q in range(1, bits):
        turn = f"xor({turn}, case when {x[-1]} & {1 << q} > 0 then {(1 << q) - 1} else 0 end)"
    step(**{a: f"xor({a}, {turn})" for a in x})
    place = " + ".join(
        f"(({a} >> {q}) & 1) * {1 << (q * len(x) + len(x) - 1 - i)}"
        for q in range(bits)
        for i, a in enumerate(x)
    )
    return ", ".join([*steps, f"placed as (select cell, {place} as place from {last})"])


def _sharding(shards: int = 8, bits: int = 3, slices: int = 1024) -> str:
    n = 1 << bits

    def hashed(value: str, parts: int) -> str:
        return f"(('0x' || md5(coalesce({value}, ''))[1:8])::bigint % {parts})"

    # One bit of the table's rule at a time.
    rule = "list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    return f"""with crc_table as (select list({rule} order by i) as t from range(256) r(i)),
  sized as (
    select doc_id, lang, source, strlen(coalesce(text, '')) + 1 as size,
      xor(list_reduce(list_prepend(4294967295, list_transform(
          regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::bigint)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32
    from documents, crc_table),
  bounds as (
    select min(doc_id) as low, (max(doc_id) - min(doc_id)) // {n} + 1 as step,
      length(bin(min(size))) as small,
      (length(bin(max(size))) - length(bin(min(size)))) // {n} + 1 as size_step, count(*) as total
    from sized),
  levels as (
    select doc_id, size, text_crc32, total, {hashed("lang", n)} as a, {hashed("source", n)} as b,
      ((length(bin(size)) - small) // size_step)::bigint as c,
      coalesce((doc_id - low) // step, 0) as d, {hashed("doc_id::varchar", slices)} as part
    from sized, bounds),
  celled as (select *, ((a * {n} + b) * {n} + c) * {n} + d as cell from levels),
  cells as (select distinct cell, a, b, c, d from celled),
  {_curve(bits, ["a", "b", "c", "d"])},
  ordered as (
    select *, row_number() over (order by place, part, doc_id, size, text_crc32) - 1 as spot
    from celled join placed using (cell))
  select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law,
    (spot * {shards} // total)::int as shard,
    (spot - ((spot * {shards} // total) * total + {shards - 1}) // {shards})::bigint as slot,
    null::int as grown_shard
  from ordered"""


SHARDS = _sharding()

INTERACTIONS = f"""with recursive d as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
      {WORDS.format("coalesce(text, '')")} as w,
      min(doc_id) over (partition by coalesce(text, '')) as least
    from documents),
  l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
  f as (
    select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
      (case when len(w) < 100 then 1 else 0 end)
      + (case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end)
      + (case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g'))) > 10 * length(t) then 4 else 0 end)
      + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
      + (case when doc_id > least then 16 else 0 end) as mask
    from d left join l using (doc_id)),
  masks as (
    select part, mask, count(*) as n, count(*) filter (where good) as good,
      count(*) filter (where toxic) as toxic
    from f group by part, mask),
  orders as (
    select '' as o
    union all
    select o || chr(65 + i::int) from orders, range(5) r(i) where not contains(o, chr(65 + i::int))),
  steps as (
    select o, s::int as step, 1 << (ascii(o[s]) - 65) as own,
      list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65))) as before
    from orders, range(1, 6) q(s) where length(o) = 5),
  counted as (
    select part, o, step, any_value(own) as own,
      sum(n) filter (where mask & coalesce(before, 0) = 0 and mask & own = 0) as kept,
      sum(n) filter (where mask & coalesce(before, 0) = 0 and mask & own > 0) as removed,
      sum(n) filter (where mask & coalesce(before, 0) > 0 and mask & own > 0) as redundant,
      sum(n) filter (where mask = own) as unique_fails,
      sum(good) filter (where mask & coalesce(before, 0) = 0 and mask & own > 0) as good_lost,
      sum(toxic) filter (where mask & coalesce(before, 0) = 0 and mask & own > 0) as toxic_lost
    from masks, steps group by part, o, step)
  select part, o as filter_order, step,
    {", ".join(f"coalesce({c}, 0)::bigint as {c}" for c in "kept removed redundant unique_fails good_lost toxic_lost".split())},
    coalesce(sum(removed) over (partition by part, own), 0)::bigint as shapley
  from counted"""

DIVERGENCE = r"""with d as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
      regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents),
  t as (select r, lang, source, unnest(terms) as term from d),
  kept as (
    select lang, term, count(*) as n from t group by lang, term having count(distinct r) >= 3),
  whole as (select lang, count(*) as v, sum(n) as total from kept group by lang),
  g as (select distinct lang, source from d),
  c as (
    select lang, source, term, count(*) as n from t semi join kept using (lang, term)
    group by lang, source, term),
  sums as (select lang, source, sum(n) as total from c group by lang, source),
  shares as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
      1 + (1000000000 * (coalesce(c.n, 0) + 1)::hugeint) // (coalesce(s.total, 0) + w.v) as p,
      1 + (1000000000 * (k.n + 1)::hugeint) // (w.total + w.v) as q
    from g join kept k using (lang) join whole w using (lang) left join sums s using (lang, source)
      left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
  two as (
    select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source
    group by a.lang, a.source, b.source),
  pairs as (
    select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value
    from g a join g b on a.lang = b.lang and a.source <> b.source
      left join two on two.lang = a.lang and two.source = a.source and two.item = b.source),
  terms as (
    select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value
    from shares where n > 0 and p > q)
  select lang, source, 'pair' as part, item, value,
    row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
  union all
  select lang, source, 'term' as part, item, value,
    row_number() over (partition by lang, source order by value desc, item)::int as rank from terms
  qualify rank <= 200"""

_SECRETS = (
    # (kind, place, pattern, tested group, least characters)
    (
        "assign",
        r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
        r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
        1,
        12,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
)


def _matches(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""select doc_id, '{kind}' as kind, {place} as place, {least} as least,
      generate_subscripts(parts, 1) as i, unnest(parts) as part, unnest(whole) as whole, unnest(tested) as tested
    from (
      select doc_id, string_split_regex(t, '{pattern}') as parts,
        regexp_extract_all(t, '{pattern}') as whole,
        regexp_extract_all(t, '{pattern}', {group}) as tested from d)"""


SECRETS = f"""with d as (select doc_id, coalesce(text, '') as t from documents),
  m as ({" union all ".join(_matches(i, *s) for i, s in enumerate(_SECRETS))}),
  placed as (
    select *, sum(length(part) + length(whole)) over (partition by doc_id, kind order by i) as stop
    from m where whole is not null),
  spans as (
    select doc_id, kind, place, (stop - length(whole))::bigint as start,
      kind || ':' || (stop - length(whole))::bigint || ':' || stop::bigint as span
    from placed where length(tested) >= least),
  found as (
    select doc_id, count(*) filter (where kind = 'assign') as n_assign,
      count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
      string_agg(span, ',' order by start, place) filter (where place < 3) as base,
      string_agg(span, ',' order by start, place) as spans
    from spans group by doc_id)
  select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
    coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256,
    coalesce(spans, '') as spans
  from d left join found using (doc_id)"""

ORACLE_SQL = {
    "op3_warc": WARC,
    "op4_sharding": SHARDS,
    "op6_mixing": MIX,
    "op10_substrings": SUBSTRINGS,
    "op11_interactions": INTERACTIONS,
    "op12_divergence": DIVERGENCE,
    "op13_secrets": SECRETS,
}
