"""DuckDB SQL for the queries that SQL can express, written from the definitions."""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LOW = f"translate(coalesce(text, ''), {_AZ})"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
with d as (select row_number() over () r, doc_id, {_WORDS} w from documents),
i as (select row_number() over () r, item_id, {_WORDS} w from benchmark),
iw as (select item_id, least(len(w), 13) n, list_slice(w, p, p + least(len(w), 13) - 1) g
       from (select *, unnest(range(1, len(w) - least(len(w), 13) + 2)) p from i where len(w) > 0)),
ns as (select distinct n from iw),
dw as (select r, n, p, list_slice(w, p, p + n - 1) g
       from (select r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) p from d cross join ns where len(w) >= n)),
m as (select dw.r, dw.p, dw.n, iw.item_id from dw join iw on dw.n = iw.n and dw.g = iw.g),
h as (select r, count(distinct x) n_hit from (select r, unnest(range(p, p + n)) x from m) group by r),
t as (select r, count(*) n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids
      from (select distinct r, item_id from m) group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join h using (r) left join t using (r)
"""

_SYMBOLS = " + ".join(f"(len(coalesce(text, '')) - len(replace(coalesce(text, ''), '{c}', '')))" for c in "#*$%&|<>")
OP3 = rf"""
with d as (select row_number() over () r, doc_id, source, {_TOKENS} w, {_SYMBOLS} n_symbols,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from documents),
g as (select r, p, array_to_string(list_slice(w, p, p + 4), ' ') g from (select r, w, unnest(range(1, len(w) - 3)) p from d where len(w) >= 5)),
c as (select r, p from (select r, p, count(*) over (partition by r, g) n from g) where n > 1),
rep as (select r, count(distinct x) n_repeat_words from (select r, unnest(range(p, p + 5)) x from c) group by r),
m as (select r, doc_id, source, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) word_chars, n_symbols,
             len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words from d left join rep using (r)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
             100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 5 * n_words or word_chars < 2 * n_words or word_chars > 15 * n_words soft from m),
hosts as (select source, count(*) n, sum((base_failed or soft)::int) f from f group by source),
tot as (select sum(n) na, sum(f)::double / sum(n) mean, count(*) k from hosts),
sp as (select sum(n * pow(f::double / n - mean, 2)) / any_value(na) v, any_value(na) na, any_value(mean) mean, any_value(k) k from hosts, tot),
pr as (select mean, least(1000.0::double, greatest(1.0::double, mean * (1 - mean) / greatest(v - mean * (1 - mean) * k / na, 1e-6) - 1)) s from sp),
rt as (select source, n, s, (mean * s + f) / (s + n) rate from hosts, pr),
st as (select source, rate - 2.0 * sqrt(rate * (1 - rate) / (s + n + 1)) > (select mean from pr) strict from rt)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
       n_repeat_words::bigint n_repeat_words, base_failed, not base_failed and not (strict and soft) kept
from f join st on f.source is not distinct from st.source
"""

_SUFFIXES = "list_transform(range(1, len(string_split(host, '.')) + 1), i -> array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))"
OP9 = rf"""
with rules(rule, verdict, rule_host, rule_path) as (values
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
p as (select row_number() over () r, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1), {_AZ}) host,
             regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) path from pages),
best as (select r, rule, verdict from (
  select r, rule, verdict, row_number() over (partition by r order by length(rule) desc, rule) k
  from p join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) where k = 1),
j as (select p.*, rule, verdict v from p left join best using (r)),
o as (select host, sum(case when v = 'block' then 1.0::double else 0 end) bad, sum(case when v is null then 0.5::double else 1 end) n from j group by host),
sfx as (select *, case when regexp_matches(array_to_string(list_slice(string_split(host, '.'), -2, -1), '.'), '^(ac|co|com|edu|go|gob|gov|gouv|mil|ne|net|nom|or|org|sch)\.[a-z][a-z]$')
        then array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') else string_split(host, '.')[-1] end top from o),
named as (select *, array_to_string(list_slice(string_split(host, '.'), case when contains(top, '.') then -3 else -2 end, -1), '.') dom from sfx),
dom as (select dom, top, sum(bad) bad, sum(n) n from named group by all),
top as (select top, sum(bad) bad, sum(n) n from dom group by top),
allp as (select sum(bad) bad, sum(n) n from top),
pairs as (select 't' lvl, t.bad, t.n, a.bad pb, a.n pn from top t, allp a union all
          select 'd', d.bad, d.n, t.bad, t.n from dom d join top t using (top) union all
          select 'h', h.bad, h.n, d.bad, d.n from named h join dom d using (dom, top)),
mom as (select lvl, sum(n * pow(bad / n - pb / pn, 2)) spread, sum(pb / pn * (1 - pb / pn) * (1 - n / pn)) chance,
               sum(pb / pn * (1 - pb / pn) * (1 - n / pn) * greatest(n - 1, 0)) most from pairs where n > 0 and pn > 0 group by lvl),
st as (select lvl, case when coalesce(most, 0) = 0 or spread <= chance then 1000.0::double else least(1000.0::double, greatest(1.0::double, most / (spread - chance) - 1)) end s from mom),
tops as (select top, (bad + s * (select coalesce(bad / nullif(n, 0), 0) from allp)) / (n + s) rate from top, st where lvl = 't'),
doms as (select dom, top, (bad + s * rate) / (n + s) rate from dom join tops using (top), st where lvl = 'd'),
hosts as (select host, named.n, s, (bad + s * rate) / (named.n + s) rate from named join doms using (dom, top), st where lvl = 'h'),
bound as (select host, rate - 1.0 * sqrt(rate * (1 - rate) / (s + n + 1)) low from hosts)
select page_id, host, path, rule, coalesce(v, case when host <> '' and low > 0.5 then 'block' else 'allow' end) verdict
from j left join bound using (host)
"""

OP11 = """
with p as (select row_number() over () r, page_id, coalesce(html, '') h from pages),
g as (select *, row_number() over (partition by h order by page_id desc nulls last, r) k, first_value(page_id) over (partition by h order by page_id desc nulls last, r) top from p),
x as (select page_id, octet_length(encode(h)) n, sha1(h) s, k, top from g)
select page_id, n::bigint payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(s, (j // 4) * 5 + 1, 5))::bigint // [32768, 1024, 32, 1][j % 4 + 1]) % 32 + 1)::int, 1)), '') payload_digest,
  case when k = 1 then 'response' else 'revisit' end record_type, case when k > 1 then top end refers_to
from x
"""

_STEP = "case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end"
OP12 = rf"""
with recursive t(i, k, c) as (select i, 0, i from (select unnest(range(256))::bigint i) union all select i, k + 1, {_STEP} from t where k < 8),
tab as materialized (select list(c order by i) tab from t where k = 8),
d as (select row_number() over () r, doc_id, {_WORDS} w from documents),
i as (select {_WORDS} w from benchmark),
df as (select r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]))) f from d),
tf as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]))) f from i),
fs as (select distinct f from (select f from df union all select f from tf)),
hx as (select f, hex(encode(f)) x, octet_length(encode(f)) n from fs),
bts as (select f, list_transform(range(n), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::bigint) b from hx),
cr as materialized (select f, xor(list_reduce(b, lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1]), 4294967295::bigint), 4294967295) % 10000 b from bts, tab),
s as (select b, count(*) n from df join cr using (f) group by b),
t2 as (select b, count(*) n from tf join cr using (f) group by b),
g as (select b, floor(1000 * ln((coalesce(t2.n, 0) + 1)::double * (coalesce((select sum(n) from s), 0) + 10000)::double
        / ((coalesce(s.n, 0) + 1)::double * (coalesce((select sum(n) from t2), 0) + 10000)::double)))::bigint gain
      from (select unnest(range(10000)) b) x left join s using (b) left join t2 using (b)),
m as (select r, floor(sum(gain)::double / count(*))::bigint weight, count(*) n_features from df join cr using (f) join g using (b) group by r),
z as (select d.r, doc_id, len(w) n, coalesce(n_features, 0)::bigint n_features, coalesce(weight, 0) weight,
        ('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint h from d left join m using (r)),
sc as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint score from z),
rk as (select r, row_number() over (order by score desc, doc_id, n_features) k, count(*) over () c from sc where n >= 20)
select doc_id, n_features, weight, score, case when k <= 25 * c // 100 then k end as rank from sc left join rk using (r)
"""

ORACLES = {"op1_decontaminate": OP1, "op3_host_quality": OP3, "op9_url_filter": OP9, "op11_warc": OP11, "op12_importance_resampling": OP12}
