"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

from tillmark.llm import chat, licenses, url_templates

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _crc32(hexed: str) -> str:
    """CRC-32 of bytes given as a string of hex digits."""
    octets = f"list_transform(range(0, length({hexed}) // 2), lambda i: cast('0x' || substr({hexed}, 2 * i + 1, 2) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


OP3 = f"""
with recursive tables as (select [{", ".join(f"cast({c} as bigint)" for c in _crc_table())}] as tab),
d as (select doc_id, text, hex(encode(coalesce(text, ''))) as h, hex(encode(cast(doc_id as varchar))) as ih, coalesce(md5(text), repeat('0', 32)) as key from documents),
r as (select doc_id, key, length(h) // 2 + 1 as size, {_crc32("h")} as text_crc32, case when doc_id is null then 0 else {_crc32("ih")} % 1024 end as cell from d, tables),
g as (select key, cast(sum(size) as bigint) as size from r group by key),
o as (select key, size, row_number() over (order by size desc, key) as k, cast(sum(size) over () - coalesce(sum(size) over (order by size desc, key rows between unbounded preceding and 1 preceding), 0) as bigint) as rest from g),
m as (select coalesce(min(k) filter (k > 15 or size <= rest / (17 - k)), (select count(*) + 1 from g)) - 1 as n_own from o),
own as (select key, k - 1 as shard from o, m where k <= n_own),
s as (select list(size order by key) as sizes, cast(coalesce(sum(size), 0) as bigint) as total from g where key not in (select key from own)),
b as (
  select cast(greatest(1, ceil(total / (16 - n_own))) as bigint) as lo, total as hi, 0 as step from s, m
  union all
  select case when fits then lo else mid + 1 end, case when fits then mid else hi end, step + 1
  from (select lo, hi, step, mid, list_max(sizes) <= mid and (list_reduce(list_prepend(cast(0 as bigint), sizes), lambda a, x: case when (a & 1099511627775) + x > mid then ((a >> 40) + 1) * 1099511627776 + x else a + x end) >> 40) + 1 <= 16 - n_own as fits
    from (select lo, hi, step, (lo + hi) // 2 as mid from b where lo < hi), s, m)),
c as (select lo as capacity from b where lo >= hi limit 1),
n as (select key, size, row_number() over (order by key) as i from g where key not in (select key from own)),
w as (
  select i, key, size as used, cast(0 as bigint) as run from n where i = 1
  union all
  select n.i, n.key, case when w.used + n.size > capacity then n.size else w.used + n.size end, case when w.used + n.size > capacity then w.run + 1 else w.run end from w join n on n.i = w.i + 1, c),
z as (select key, shard from own union all select key, run + n_own from w, m)
select doc_id, size, text_crc32, 'bytes' as law, cast(shard as int) as shard, row_number() over (partition by shard order by cell, doc_id nulls first, key) - 1 as slot, cast(null as int) as grown_shard from r join z using (key)"""

OP5 = f"""
with dw as (select doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bench as (select distinct item_id, array_to_string(list_slice(w, i, i + 9), ' ') as win, least(10, len(w)) as m
  from bw, lateral (select unnest(range(1, greatest(2, len(w) - 8))) as i) where len(w) > 0),
lens as (select distinct m from bench),
spots as (select doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') as win from dw, lens, lateral (select unnest(range(1, greatest(1, len(w) - m + 2))) as i)),
found as (select doc_id, i, spots.m, item_id from spots join bench on spots.win = bench.win and spots.m = bench.m),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hits using (doc_id) left join items using (doc_id)"""

_ESCAPED = "replace(replace({}, '\\', '\\\\'), '<|', '<\\|')"
OP6 = f"""
with recursive rows_ as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
  length('{chat.START}' || replace({_ESCAPED.format("role")}, chr(10), '\\n') || chr(10) || {_ESCAPED.format("text")} || '{chat.END}' || chr(10)) as cost from rows_),
head as (select conv_id, case when role = 'system' then 1 else 0 end as sys, case when role = 'system' then cost else 0 end as sys_cost from t where k = 1),
u as (select t.*, sys, sys_cost, greatest(1, {chat.BUDGET - chat.HISTORY} - sys_cost) as room from t join head using (conv_id)),
walk as (
  select conv_id, sys + 1 as k, 0 as win, cast(cost as bigint) as used from u where k = sys + 1
  union all
  select w.conv_id, u.k, case when w.used > 0 and w.used + u.cost > u.room then w.win + 1 else w.win end, case when w.used > 0 and w.used + u.cost > u.room then u.cost else w.used + u.cost end
  from walk w join u on u.conv_id = w.conv_id and u.k = w.k + 1),
wins as (select conv_id, win, min(k) as first, max(k) as last from walk group by all),
sums as (select conv_id, k, sum(cost) over (partition by conv_id order by k) as upto from t),
sized as (select wins.conv_id, win, b.upto - coalesce(a.upto, 0) as body, coalesce(a.upto, 0) as before, coalesce(a1.upto, 0) as before1, coalesce(a2.upto, 0) as before2, first, sys, sys_cost
  from wins join head using (conv_id) join sums b on b.conv_id = wins.conv_id and b.k = last
  left join sums a on a.conv_id = wins.conv_id and a.k = first - 1 left join sums a1 on a1.conv_id = wins.conv_id and a1.k = first - 2 left join sums a2 on a2.conv_id = wins.conv_id and a2.k = first - 3),
chars as (select conv_id, sum(body + sys_cost + case when win = 0 then 0 when first - 3 >= sys and before - before2 <= {chat.HISTORY} then before - before2 when first - 2 >= sys and before - before1 <= {chat.HISTORY} then before - before1 else 0 end) as n from sized group by conv_id),
said as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256, coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '') as loss, sum(cost) as whole from t group by conv_id)
select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(coalesce(n, whole) as bigint) as formatted_chars from said left join chars using (conv_id)"""

OP7 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, h, unnest(range(0, length(h) // 2)) as i from d),
s as (select doc_id, i, substr(h, 2 * i + 1, 2) as b, case when i <= length(h) // 2 - 50 then md5(substr(h, 2 * i + 1, 100)) end as w from p),
f as (select w, min(doc_id) as low from s where w is not null group by w),
m as (select s.doc_id, s.i, s.b, coalesce(f.low < s.doc_id, false) as start from s left join f on s.w = f.w),
c as (select *, bool_or(start) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from m),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from c),
g as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (opens) as n_spans, coalesce(string_agg(b, '' order by i) filter (not gone), '') as kept from e group by doc_id)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join g using (doc_id)"""

_TEMPLATES = " union all ".join(f"select {k} as k, {_text(name)} as name, [{', '.join(map(_text, licenses.bigrams_of(t)))}] as own, cast([{', '.join(map(_text, licenses.needs_of(t)))}] as varchar[]) as needs, {sum(map(licenses.decides, licenses.bigrams_of(t)))} as n_marks" for k, (name, t) in enumerate(licenses.TEMPLATES))
_CLASS = "case " + " ".join(f"when name = {_text(k)} then {v}" for k, v in licenses.CLASSES.items()) + " end"
_CUES = ", ".join(f"{{'word': {_text(w)}, 'before': {k}, 'len': {n}}}" for w, k, n in licenses.cue_spots())
OP4 = f"""
with templates as ({_TEMPLATES}),
n as (select doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g') as norm from documents),
cues as (select unnest([{_CUES}], recursive := true)),
whole as (select doc_id, string_split(trim(regexp_replace(norm, '[ \\n]+', ' ', 'g')), ' ') as ws from n),
places as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from whole),
wins as (select doc_id, array_to_string(list_slice(ws, greatest(1, i - before), i - before + len - 1), ' ') as unit from places join cues on ws[i] = word),
u as (select distinct doc_id, trim(regexp_replace(x, '[ \\n]+', ' ', 'g')) as unit from n, lateral (select unnest(list_concat(string_split(norm, chr(10)), regexp_split_to_array(norm, '\\n *\\n'), [norm])) as x) union select doc_id, unit from wins),
w as (select doc_id, unit, string_split(unit, ' ') as ws from u),
g as (select doc_id, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as grams from w where len(ws) > 1),
s as (select doc_id, unit, name, k, 2 * len(list_intersect(grams, own)) / (len(grams) + len(own)) as dice from g, templates where 2 * least(len(grams), len(own)) / (len(grams) + len(own)) >= {licenses.THRESHOLD} and len(list_intersect(grams, needs)) = len(needs) and len(list_intersect(grams, [{', '.join(map(_text, licenses.deciding()))}])) = n_marks),
b as (select * from s where dice >= {licenses.THRESHOLD} qualify dice = max(dice) over (partition by doc_id, unit)),
f as (select doc_id, count(*) as n_matches, string_agg(distinct name, ',' order by name) as licenses, max(dice) as best_dice, max({_CLASS}) as worst from b group by doc_id)
select doc_id, coalesce(n_matches, 0) as n_matches, coalesce(licenses, '') as licenses, coalesce(best_dice, 0.0) as best_dice, [{', '.join(map(_text, licenses.CLASS_NAMES))}][coalesce(worst, 0) + 1] as class
from documents left join f using (doc_id)"""


def _op8() -> str:
    u = url_templates
    rules = sorted(u.RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = lambda h, p: f"((host = {_text(h)} or host like {_text('%.' + h)}) and starts_with(path, {_text(p)}))"
    name = "case " + " ".join(f"when {fits(h, p)} then {_text(h + p)}" for _, h, p in rules) + " end"
    said = "case " + " ".join(f"when {fits(h, p)} then {_text(v)}" for v, h, p in rules) + " end"
    form = (
        "case when regexp_matches(s, '^[0-9]+(\\.[A-Za-z]{1,5})?$') then '<n>' when regexp_matches(s, '^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$') then '<date>' when regexp_matches(s, '^(?i)[0-9a-f-]{16,}$') then '<hex>' "
        "when regexp_matches(s, '^[^-_]+([-_][^-_]+){2,}$') or length(s) > 40 then '<slug>' when regexp_matches(s, '[0-9]{3,}') then '<id>' else s end"
    )
    smooth = lambda b, a, prior: f"(({b} + {u.PRIOR} * {prior}) / ({b} + {a} + {u.PRIOR}))"
    return f"""
with recursive r as (select page_id, {ASCII_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
k as (select page_id, host, path, {name} as rule, {said} as said, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {form}) as segs from r),
t as (select host, segs, count(*) as n, cast(count(*) filter (said = 'block') as double) as b, cast(count(*) filter (said = 'allow') as double) as a from k group by all),
walk as (
  select host, segs, n, b, a, 0 as d, '' as node, {smooth("sum(b) over (partition by host)", "sum(a) over (partition by host)", "0.0")} as p from t
  union all
  (with s as (select *, segs[d + 1] as seg, count(distinct segs[d + 1]) over (partition by host, node) as kids, sum(n) over (partition by host, node) as total from walk where len(segs) > d),
  x as (select *, case when kids >= {u.MANY} and total < {u.RARE} * kids and not starts_with(seg, '<') then '*' else seg end as name from s),
  y as (select *, sum(b) over (partition by host, node, name) as nb, sum(a) over (partition by host, node, name) as na from x),
  v as (select *, case when na + nb > 0 then floor(100 * nb / (na + nb)) else -1 end as bin from y),
  bins as (select host, node, bin, sum(b) as b, sum(a) as a from v where bin >= 0 group by all),
  pairs as (select *, lag(b) over (partition by host, node order by bin) as b0, lag(a + b) over (partition by host, node order by bin) as n0 from bins),
  tested as (select *, (b0 + b) / (n0 + a + b) as pool from pairs),
  edges as (select *, coalesce(abs(b0 / n0 - b / (a + b)) / nullif(sqrt(pool * (1 - pool) * (1 / n0 + 1 / (a + b))), 0) >= {u.Z}, false) as edge from tested),
  classes as (select host, node, bin, sum(cast(edge as int)) over (partition by host, node order by bin) as class from edges),
  w as (select v.*, coalesce(class, -1) as class from v left join classes using (host, node, bin)),
  l as (select *, count(distinct name) over (partition by host, node, class) as m, min(name) over (partition by host, node, class) as lo, sum(b) over (partition by host, node, class) as cb, sum(a) over (partition by host, node, class) as ca from w)
  select host, segs, n, b, a, d + 1, node || '/' || case when m = 1 then lo else '{{' || lo || '|+' || cast(m - 1 as varchar) || '}}' end, case when kids = 1 then p else {smooth("cb", "ca", "p")} end from l))
select page_id, k.host, path, rule, coalesce(said, case when p >= {u.REJECT} then 'block' else 'allow' end) as verdict, case when said is null then node end as template
from k join walk on walk.host = k.host and walk.segs = k.segs and walk.d = len(k.segs)"""

_TOLD = "coalesce(cast(octet_length(encode(cast({0} as varchar))) as varchar) || ':' || cast({0} as varchar), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_TOLD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


OP11 = f"""
with recursive tables as (select [{", ".join(f"cast({c} as bigint)" for c in _crc_table())}] as tab),
d as (select row_number() over () as row, doc_id, case when source is null then '0' else '1' || source end as grp, {_leaf("text")} as leaf,
  case when doc_id is not null and {_crc32("hex(encode(cast(doc_id as varchar)))")} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as seen from documents, tables),
p as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by grp) as n from d),
low as (
  select grp, 0 as level, i, n, leaf as h from p
  union all
  select grp, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from low where n > 1 group by grp, level, i // 3, n),
subroots as (select grp, h, row_number() over (order by encode(grp)) - 1 as i, count(*) over () as n from low where n = 1),
high as (
  select 0 as level, i, n, h from subroots
  union all
  select level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from high where n > 1 group by level, i // 3, n),
own as (
  select row, grp, level, i // cast(pow(3, level) as bigint) as i from (select row, grp, i, unnest(range(0, (select max(level) + 1 from low))) as level from p)),
tops as (
  select row, level, i // cast(pow(3, level) as bigint) as i from (select p.row, s.i, unnest(range(0, (select max(level) + 1 from high))) as level from p join subroots s using (grp))),
steps as (
  select row, o.level as k, coalesce(string_agg(x.h, '' order by x.i) filter (x.i < o.i), '') as lft, coalesce(string_agg(x.h, '' order by x.i) filter (x.i > o.i), '') as rgt
    from own o join low x on x.grp = o.grp and x.level = o.level and x.i // 3 = o.i // 3 where x.n > 1 group by all
  union all
  select row, 1000 + o.level, coalesce(string_agg(x.h, '' order by x.i) filter (x.i < o.i), ''), coalesce(string_agg(x.h, '' order by x.i) filter (x.i > o.i), '')
    from tops o join high x on x.level = o.level and x.i // 3 = o.i // 3 where x.n > 1 group by row, o.level),
ranked as (select row, row_number() over (partition by row order by k) as k, lft, rgt from steps),
proofs as (select row, sha256(string_agg(lft || rgt, '' order by k)) as proof from ranked group by row),
fold as (
  select row, cast(0 as bigint) as k, seen as h from p
  union all
  select f.row, r.k, sha256(r.lft || f.h || r.rgt) from fold f join ranked r on r.row = f.row and r.k = f.k + 1),
done as (select row, max_by(h, k) as folded from fold group by row)
select p.doc_id, p.leaf, s.h as subroot, r.h as root, coalesce(proof, sha256('')) as proof_sha256, folded as folded_root, folded = r.h as verified
from p join subroots s using (grp) join done using (row) left join proofs using (row), (select h from high where n = 1) r"""

_DRAW = "cast('0x' || substr(dig, {}, 8) as bigint)"
OP13 = f"""
with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as dig, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u from documents),
c as (select *, cast(len(u) as bigint) as n, least({_DRAW.format(1)} % (len(u) + 1), {_DRAW.format(9)} % (len(u) + 1)) as lo, greatest({_DRAW.format(1)} % (len(u) + 1), {_DRAW.format(9)} % (len(u) + 1)) as hi,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when {_DRAW.format(25)} % 100 < 50 then 'spm' else 'psm' end as form from d),
q as (select *, array_to_string(u[1:lo], '') as p, array_to_string(u[lo + 1:hi], '') as m, array_to_string(u[hi + 1:n], '') as s from c),
o as (select *, case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else text end as output from q)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars, sha256(output) as output_sha256, sha256(text) as restored_sha256 from o"""

ORACLE = {"op3_minimax_shards": OP3, "op4_license_scan": OP4, "op5_fm_decontaminate": OP5, "op6_chat_windows": OP6, "op7_induced_suffix_dedup": OP7, "op8_url_templates": _op8(), "op11_merkle_manifest": OP11, "op13_fill_in_middle": OP13}
