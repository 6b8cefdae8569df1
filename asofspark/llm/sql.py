"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .chat import BLOCK_TURNS, MOST_TURNS
from .licences import TEMPLATES, THRESHOLD, bigrams

WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""with w as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) as ws from documents),
win as (select rid, doc_id, i, array_to_string(ws[i : i + 49], ' ') as s from w, unnest(range(1, cast(len(ws) as bigint) - 48)) t(i)),
firsts as (select s, min(doc_id) as f from win group by s),
gone as (select distinct rid, i + k as p from win join firsts using (s), range(50) r(k) where f < doc_id),
each as (select rid, p, ws[p] as word from w, unnest(range(1, cast(len(ws) as bigint) + 1)) t(p)),
kept as (select rid, string_agg(word, ' ' order by p) as text from each anti join gone using (rid, p) group by rid),
cut as (select rid, count(*) as c from gone group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(c, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from w left join cut using (rid) left join kept using (rid)"""

_LIST = ", ".join("('{}', [{}])".format(k, ", ".join("'" + g + "'" for g in bigrams(v))) for k, v in sorted(TEMPLATES.items()))
OP3 = rf"""with d as (select row_number() over () as rid, doc_id, text, string_split(text, chr(10)) as ls from documents),
l as (select rid, i - 1 as line, list_filter(regexp_split_to_array(lower(ls[i]), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as ws from d, unnest(range(1, cast(len(ls) as bigint) + 1)) t(i)),
g as (select rid, line, case when len(ws) < 2 then ws else list_distinct(list_transform(range(1, cast(len(ws) as bigint)), lambda i: ws[i] || ' ' || ws[i + 1])) end as grams from l where len(ws) > 0),
t(licence, grams) as (values {_LIST}),
m as (select rid, line, licence, round(2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)), 6) as dice from g cross join t),
b as (select * from (select *, row_number() over (partition by rid, line order by dice desc, licence) as n from m where dice >= {THRESHOLD}) where n = 1)
select d.doc_id, cast(coalesce(len(ls), 0) as bigint) as n_lines, count(b.line) as n_matches, coalesce(string_agg(b.line || ':' || b.licence, ',' order by b.line), '') as licences, coalesce(max(dice), 0.0)::double as best_dice from d left join b using (rid) group by d.rid, d.doc_id, ls"""

_BROKEN = "replace(replace({}, '<|', '<\u200b|'), '|>', '|\u200b>')".format
OP4 = f"""with t as (select row_number() over () as own, conv_id, coalesce(role, 'unknown') as speaker, turn, {_BROKEN("coalesce(text, '')")} as body, case when conv_id is null then 0 else cast(floor(coalesce(turn, 0) / {BLOCK_TURNS}) as bigint) end as block from conversations),
k as (select *, case when conv_id is null then own end as key, (row_number() over (partition by conv_id, case when conv_id is null then own end, block order by turn nulls first, speaker, body) - 1) // {MOST_TURNS} as part from t),
p as (select distinct conv_id, key, speaker as perspective from k),
x as (select k.conv_id, k.key, perspective, block, part, turn, speaker, body, speaker = perspective as own, case when speaker = perspective then '<|assistant|>' || chr(10) else '<|user name=' || {_BROKEN("speaker")} || '|>' || chr(10) end as head, body || '<|end|>' || chr(10) as tail from k join p on k.conv_id is not distinct from p.conv_id and k.key is not distinct from p.key),
y as (select *, row_number() over w as n, sum(length(head) + length(tail)) over w as e from x window w as (partition by conv_id, key, perspective, block, part order by turn nulls first, speaker, body rows between unbounded preceding and current row))
select conv_id, perspective, block, cast(part as bigint) as part, count(*) as n_turns, cast(sum(case when own then length(tail) else 0 end) as bigint) as n_masked_chars, string_agg(head || tail, '' order by n) as text, coalesce(string_agg(cast(e - length(tail) as bigint) || '-' || cast(e as bigint), ',' order by n) filter (where own), '') as mask from y group by conv_id, key, perspective, block, part"""

OP5 = f"""with recursive w as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) as ws from documents),
s as (select distinct rid, case when len(ws) < 3 then array_to_string(ws, ' ') else ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] end as g from w, unnest(range(1, greatest(2, cast(len(ws) as bigint) - 1))) t(i) where len(ws) > 0),
n as (select rid, count(*) as n from s group by rid),
pairs as (select a.rid as a, b.rid as b, count(*) as c from s a join s b on a.g = b.g and a.rid < b.rid group by 1, 2),
edges as (select a, b from pairs join n x on x.rid = a join n y on y.rid = b where 100 * c >= 90 * (x.n + y.n - c)),
both_ways as (select a, b from edges union all select b, a from edges),
reach(rid, other) as (select rid, rid from w union select r.rid, e.b from reach r join both_ways e on e.a = r.other)
select w.doc_id, coalesce(n.n, 0) as n_shingles, min(o.doc_id) as component_id from w left join n using (rid) join reach r on r.rid = w.rid join w o on o.rid = r.other group by w.rid, w.doc_id, n.n"""

# crc32 of a string of ASCII characters: a table by eight steps of each byte, then one step of each character
CRC_TABLE = "crc_table as (select list(list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i))"


def crc32(text: str) -> str:
    """SQL of the checksum of a text, for a query that has ``crc_table`` at hand."""
    return f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: cast(ord(x) as bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


OP12 = f"""with {CRC_TABLE}, w as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) as ws from documents),
h as (select rid, doc_id, ws, len(ws) as n, {crc32("cast(doc_id as varchar)")} as h from w, crc_table),
g as (select rid, doc_id, ws, n, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a, case when h % 10 = 0 and n > 0 then 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) end as p from h),
d as (select rid, doc_id, cast(n as bigint) as n, case when a is null then ws else list_transform(ws, lambda x, i: case when i - 1 < a then x else ws[1 + a + (i - 1 - a) % p] end) end as ws from g),
six as (select rid, i, array_to_string(ws[i : i + 5], ' ') as s from d, unnest(range(1, n - 4)) t(i)),
far as (select x.rid, x.i, y.i - x.i as q from six x join six y on x.rid = y.rid and x.s = y.s and y.i > x.i),
island as (select rid, q, min(i) as lo, max(i) as hi from (select *, i - row_number() over (partition by rid, q order by i) as grp from far) group by rid, q, grp),
run as (select rid, lo - 1 as start, hi + 5 + q - (lo - 1) as length, q as period from island where hi + 5 + q - (lo - 1) >= greatest(12, 2 * q)),
own as (select * from run r where not exists (select 1 from run s where s.rid = r.rid and s.period < r.period and s.start <= r.start and s.start + s.length >= r.start + r.length)),
best as (select rid, count(*) as n_runs, arg_min(struct_pack(s := start, l := length, p := period), struct_pack(a := -length, b := start, c := period)) as b, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period)) as listed from own group by 1),
gone as (select distinct rid, k from own, unnest(range(start + period, start + length)) t(k)),
each as (select rid, k, ws[k + 1] as x from d, unnest(range(n)) t(k)),
kept as (select rid, string_agg(x, ' ' order by k) as text from each anti join gone using (rid, k) group by 1)
select doc_id, coalesce(n_runs, 0) as n_runs, cast(b.s as bigint) as start, cast(b.l as bigint) as length, cast(b.p as bigint) as period, cast(1000 * b.l // b.p as bigint) as exponent_milli, coalesce(listed, sha256('')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256 from d left join best using (rid) left join kept using (rid)"""

_SHOWN = "coalesce(cast({} as varchar), ' ')".format
_MOVE = "struct_pack(cost := {0}.cost + {1}, audit := {0}.audit || '{2}', said := {3})".format
_SAY = "list_append({}.said, {})".format
_NONE = "struct_pack(cost := cast(1000000000 as bigint), audit := '~', said := cast([] as varchar[]))"


def _least(*moves: str) -> str:
    return f"list_min([{', '.join(moves)}])"


def _shift(states: str, when: str, cost: str, edit: str, message: str) -> list[str]:
    return [f"case when {when} then {_MOVE(x, cost, edit, _SAY(x, message))} else {_NONE} end" for x in states]


# the dialogue's rows one by one; the least (cost, audit, text) of each grammar state: nothing yet, system, user, assistant
_FREE = "not must_go"
_STEP = {
    "e": [_MOVE("e", 3, "D", "e.said")],
    "s": [_MOVE("s", 3, "D", "s.said"), *_shift("e", f"{_FREE} and c = 's'", "more", "K", "role || ':' || text")],
    "u": [_MOVE("u", 3, "D", "u.said"), *_shift("esa", f"{_FREE} and c = 'u'", "more", "K", "role || ':' || text"), *_shift("esa", _FREE, "2 + more", "R", "'user:' || text")],
    "a": [_MOVE("a", 3, "D", "a.said"), *_shift("u", f"{_FREE} and c = 'a'", "more", "K", "role || ':' || text"), *_shift("u", _FREE, "2 + more", "R", "'assistant:' || text")],
}
OP13 = f"""with recursive {CRC_TABLE}, k as (select conv_id, turn, {_SHOWN("role")} as role, {_SHOWN("text")} as text, {crc32(_SHOWN("conv_id") + " || ':' || " + _SHOWN("turn"))} % 20 as kind from conversations, crc_table),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text from k, unnest(case when kind = 3 then [1, 2] else [1] end) where kind <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as solid from damaged),
faulty as (select *, case when solid = '' then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate' when right(solid, 1) not in ('.', '!', '?') then 'truncated' end as fault, role[1:1] as c, lag(role[1:1]) over (partition by conv_id order by n) as before from numbered),
rows_ as (select *, coalesce(fault in ('blank', 'duplicate'), false) as must_go, case when fault = 'truncated' then 1 else 0 end as more from faulty),
told as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where before is not null and before || c not in ('su', 'ua', 'au')) as illegal from rows_ group by 1),
step(conv_id, n, e, s, u, a) as (
    select conv_id, cast(0 as bigint), struct_pack(cost := cast(0 as bigint), audit := '', said := cast([] as varchar[])), {_NONE}, struct_pack(cost := cast(2 as bigint), audit := 'I', said := ['user:']), struct_pack(cost := cast(4 as bigint), audit := 'II', said := ['user:', 'assistant:']) from told
    union all select conv_id, n, e, s, u2, {_least("a", _MOVE("u2", 2, "I", _SAY("u2", "'assistant:'")))} from (
        select conv_id, n, e, s, a, {_least("u", *[_MOVE(x, 2, "I", _SAY(x, "'user:'")) for x in "esa"])} as u2 from (
            select r.conv_id, r.n, {", ".join(f"{_least(*moves)} as {state}" for state, moves in _STEP.items())} from step join rows_ r on r.conv_id is not distinct from step.conv_id and r.n = step.n + 1))),
done as (select conv_id, arg_max({_least("e", "a")}, n) as b from step group by 1)
select q.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.cost, 0) as cost, coalesce(b.audit, '') as audit, sha256(coalesce(array_to_string(b.said, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) q left join told on told.conv_id is not distinct from q.conv_id left join done on done.conv_id is not distinct from q.conv_id"""

ORACLE = {"op1_substring_dedup": OP1, "op3_license_scan": OP3, "op4_chat_rotation": OP4, "op5_ngram_jaccard": OP5, "op12_periodic_runs": OP12, "op13_structure_repair": OP13}
