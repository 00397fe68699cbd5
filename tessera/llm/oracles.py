"""DuckDB SQL that gives the rows of the registered queries, where SQL can express them.

op3 (iterated pattern graph), op4 (DOM walk), op5 (trained trees), op8 (signatures and components) and the pipeline are
held against brute force in the tests instead.
"""

from __future__ import annotations

import re

from tessera.llm import chat, licenses, line_templates, mixing, quality
from tessera.llm.common import LOWER, UPPER

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
TOKENS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP7 = rf"""WITH bw AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
bwin AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[u.i + 1 : u.i + least(len(w), 10)], ' ') AS gram FROM bw, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS u(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bwin), dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
dwin AS (SELECT doc_id, k, u.i AS pos, array_to_string(w[u.i + 1 : u.i + k], ' ') AS gram FROM dw, ks, unnest(range(0, len(w) - k + 1)) AS u(i) WHERE len(w) >= k),
hit AS (SELECT DISTINCT doc_id, pos, k, item FROM dwin JOIN bwin USING (k, gram)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS m, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(m, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

_esc = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '[', '&lsb;')"
_frame = len(chat.START) + len(chat.END_ROLE) + len(chat.END)
OP6 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, t.t, CASE WHEN t.t = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM unnest(range(0, 2)) AS t(t)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learnt,
CAST(sum({_frame} + length({_esc('role')}) + length({_esc('text')})) AS BIGINT) AS formatted_chars FROM c GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM g"""


def _op2() -> str:
    every = sorted({w for ws in quality.COMMON_WORDS.values() for w in ws})
    lists = {**quality.COMMON_WORDS, quality.OTHER: every}
    values = ", ".join(f"('{lang}', {i}, '{w}')" for lang, ws in lists.items() for i, w in enumerate(ws))
    removed, names, prev = [], [], "t"
    for k, (_, pattern) in enumerate(quality.CLASSES):
        quoted = pattern.replace("'", "''").replace('\\"', '"')
        removed.append(f"s{k} AS (SELECT *, regexp_replace(r{k}, '{quoted}', '', 'g') AS r{k + 1} FROM {prev})")
        names.append(f"length(r{k}) - length(r{k + 1})")
        prev = f"s{k}"
    counts = ", ".join(names) + f", length(r{len(names)})"
    js = lambda a, b: f"sqrt(greatest(0, sum((CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END + CASE WHEN {b} > 0 THEN {b} * log2({b} / (({a} + {b}) / 2)) ELSE 0 END) / 2)))"
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(text, '') AS r0, CASE WHEN lang IN ({', '.join(f"'{x}'" for x in quality.COMMON_WORDS)}) THEN lang ELSE '{quality.OTHER}' END AS lang FROM documents),
{', '.join(removed)},
d AS (SELECT doc_id, lang, text, {TOKENS} AS w, [{counts}] AS classes FROM {prev}),
win AS (SELECT doc_id, u.i AS i, array_to_string(w[u.i + 1 : u.i + 5], chr(1)) AS g FROM d, unnest(range(0, len(w) - 4)) AS u(i) WHERE len(w) >= 5),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (SELECT d.doc_id, lang, w, classes, CAST(len(w) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_chars, coalesce(rep.n, 0) AS n_repeat_words, coalesce(dup.n, 0) AS n_dup_lines FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
lists(lang, i, word) AS (VALUES {values}),
occ AS (SELECT doc_id, x.word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM b) x GROUP BY ALL),
com AS (SELECT b.doc_id, b.lang, l.i, coalesce(occ.n, 0) AS n FROM b JOIN lists l ON l.lang = b.lang LEFT JOIN occ ON occ.doc_id = b.doc_id AND occ.word = l.word),
rest AS (SELECT b.doc_id, b.lang, 1000 AS i, b.n_words - coalesce(sum(com.n), 0) AS n FROM b LEFT JOIN com USING (doc_id) GROUP BY b.doc_id, b.lang, b.n_words),
hw AS (SELECT * FROM com UNION ALL SELECT * FROM rest),
hc AS (SELECT doc_id, lang, u.i AS i, classes[u.i] AS n FROM b, unnest(range(1, {len(quality.CLASSES) + 2})) AS u(i)),
rw AS (SELECT hw.lang, i, sum(n) AS n FROM hw JOIN b USING (doc_id) WHERE NOT base_failed GROUP BY ALL), rc AS (SELECT hc.lang, i, sum(n) AS n FROM hc JOIN b USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
pw AS (SELECT doc_id, lang, i, n * 1.0::DOUBLE / nullif(sum(n) OVER (PARTITION BY doc_id), 0) AS p FROM hw), pc AS (SELECT doc_id, lang, i, n * 1.0::DOUBLE / nullif(sum(n) OVER (PARTITION BY doc_id), 0) AS p FROM hc),
qw AS (SELECT lang, i, n * 1.0::DOUBLE / nullif(sum(n) OVER (PARTITION BY lang), 0) AS q FROM rw), qc AS (SELECT lang, i, n * 1.0::DOUBLE / nullif(sum(n) OVER (PARTITION BY lang), 0) AS q FROM rc),
jw AS (SELECT doc_id, round({js('p', 'q')}, 9) AS v FROM pw JOIN qw USING (lang, i) GROUP BY 1), jc AS (SELECT doc_id, round({js('p', 'q')}, 9) AS v FROM pc JOIN qc USING (lang, i) GROUP BY 1),
none AS (SELECT lang, round({js('p', 'q')}, 9) AS v FROM (SELECT lang, q, CASE WHEN i = 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM qw) GROUP BY 1),
o AS (SELECT b.*, CASE WHEN n_chars >= {quality.MIN_CHARS} THEN jc.v END AS char_jsd, CASE WHEN n_words >= {quality.MIN_WORDS} THEN jw.v END AS word_jsd, none.v AS worst FROM b LEFT JOIN jc USING (doc_id) LEFT JOIN jw USING (doc_id) LEFT JOIN none USING (lang))
SELECT doc_id, n_words, n_chars - classes[{quality.SPACE_AT + 1}] AS word_chars, CAST(classes[{quality.SYMBOL_AT + 1}] AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND NOT coalesce(char_jsd > {quality.MAX_CHAR_JSD}, false) AND NOT coalesce(word_jsd > {quality.MAX_WORD_SHARE} * worst, false) AS kept, char_jsd, word_jsd FROM o"""


def _op9() -> str:
    t = line_templates
    return rf"""WITH ln AS (SELECT doc_id, u.i - 1 AS line, string_split(text, chr(10))[u.i] AS l FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i) WHERE text IS NOT NULL),
tk AS (SELECT doc_id, line, list_transform(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM ln),
nb AS (SELECT doc_id, line, t, len(t) AS n, CASE WHEN len(t) >= {t.WIDE_TOKENS} THEN 2 ELSE 1 END AS w FROM tk WHERE len(t) > 0),
keys AS (SELECT doc_id, line, 'whole ' || array_to_string(t, ' ') AS key, CASE WHEN n < {t.MIN_TOKENS} THEN {t.SHORT_DOCS} ELSE {t.MIN_DOCS} END AS need FROM nb
    UNION ALL SELECT doc_id, line, md5(concat_ws(chr(1), CAST(n AS VARCHAR), CAST(u.k AS VARCHAR), array_to_string(t[1 : w * u.k], ' '), array_to_string(t[w * u.k + w * w + 1 :], ' '))),
    CASE WHEN n >= {t.LONG_TOKENS} THEN {t.MIN_DOCS} ELSE {t.VARY_DOCS} END FROM nb, unnest(range(0, CAST(ceil(n / CAST(w AS DOUBLE)) AS BIGINT) - w + 1)) AS u(k) WHERE n >= {t.VARY_TOKENS}),
rec AS (SELECT key, min(doc_id) AS first_doc FROM keys GROUP BY key HAVING count(DISTINCT doc_id) >= max(need)),
gone AS (SELECT DISTINCT doc_id, line FROM keys JOIN rec USING (key) WHERE doc_id > first_doc),
kept AS (SELECT ln.doc_id, count(*) AS n_lines, count(gone.line) AS n_dropped, coalesce(string_agg(CASE WHEN gone.line IS NULL THEN l END, chr(10) ORDER BY ln.line), '') AS text FROM ln LEFT JOIN gone ON gone.doc_id = ln.doc_id AND gone.line = ln.line GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, k.text FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""


def _op10() -> str:
    hashed = lambda x: f"CAST('0x' || substr(md5({x}), 1, 13) AS BIGINT)"
    bits = 10 * mixing.ROUNDS
    entropy = "(SELECT ln(sum(pow(s, {a}))) - sum(pow(s, {a}) * ln(pow(s, {a}))) / sum(pow(s, {a})) FROM sh) >= " + f"{mixing.TARGET_ENTROPY} * (SELECT ln(count(*)) FROM sh)"
    most = f"(SELECT {mixing.BUDGET_SHARE} * max(pow(s, {{a}}) / s) / sum(pow(s, {{a}})) FROM sh) <= {mixing.MAX_REPEATS}"
    mid, one, zero = "((lo + hi) / 2)", "1.0::DOUBLE", "0.0::DOUBLE"
    halve = lambda yes, no: f"SELECT k + 1, CASE WHEN {yes} THEN {mid} ELSE lo END, CASE WHEN {no} THEN {mid} ELSE hi END"
    even, few = entropy.format(a=mid), most.format(a=mid)
    return rf"""WITH RECURSIVE own AS (SELECT doc_id, source AS named, coalesce(source, '') AS source, CAST(len({TOKENS}) AS BIGINT) AS n_tokens,
    {hashed("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))")} AS h FROM documents),
src AS (SELECT source, sum(n_tokens) AS tokens, count(*) AS n FROM own GROUP BY 1),
sh AS (SELECT tokens / (SELECT sum(tokens) FROM src) AS s FROM src WHERE tokens > 0),
be AS (SELECT 0 AS k, {zero} AS lo, {one} AS hi UNION ALL {halve(even, "NOT " + even)} FROM be WHERE k < {bits}),
br AS (SELECT 0 AS k, {zero} AS lo, {one} AS hi UNION ALL {halve("NOT " + few, few)} FROM br WHERE k < {bits}),
a1 AS (SELECT CASE WHEN {entropy.format(a=one)} THEN {one} ELSE (SELECT max(lo) FROM be WHERE k = {bits}) END AS a),
a2 AS (SELECT CASE WHEN {most.format(a=zero)} THEN {zero} ELSE (SELECT max(hi) FROM br WHERE k = {bits}) END AS a),
ex AS (SELECT CASE WHEN (SELECT count(*) FROM sh) <= 1 THEN {one} ELSE greatest((SELECT a FROM a1), (SELECT a FROM a2)) END AS a),
w AS (SELECT source, tokens, n, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM src), (SELECT a FROM ex)) ELSE 0 END AS w FROM src),
q AS (SELECT source, tokens, CAST(round(w / (SELECT sum(w) FROM w) * ({mixing.BUDGET_SHARE}::DOUBLE * (SELECT sum(tokens) FROM src))) AS BIGINT) AS quota,
    greatest(CAST(ceil(tokens / {float(mixing.BLOCK_TOKENS)}) AS BIGINT), CAST(ceil(n / {float(mixing.BLOCK_ROWS)}) AS BIGINT), 1) AS blocks FROM w),
p AS (SELECT source, tokens, quota, blocks, CAST(CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS BIGINT) AS passes FROM q),
r AS (SELECT own.doc_id, own.named, own.source, n_tokens, h, h % blocks AS block, passes, quota - passes * tokens AS rest FROM own JOIN p ON p.source = own.source),
bl AS (SELECT source, block, sum(n_tokens) AS inside, any_value(passes) AS passes, any_value(rest) AS rest FROM r GROUP BY ALL),
tu AS (SELECT source, block, inside, passes, rest, u.p AS pass, {hashed("u.p || ':' || block || ':' || source")} AS turn FROM bl, unnest(range(0, passes + 1)) AS u(p)),
pl AS (SELECT *, row_number() OVER o - 1 AS place, coalesce(sum(inside) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tu WINDOW o AS (PARTITION BY source, pass ORDER BY turn)),
st AS (SELECT source, block, pass, place, inside, CASE WHEN pass < passes THEN inside ELSE rest - before END AS left_over FROM pl WHERE pass < passes OR rest - before > 0),
hs AS (SELECT source, block, h, sum(n_tokens) AS n FROM r GROUP BY ALL),
dc AS (SELECT source, block, h, coalesce(sum(n) OVER (PARTITION BY source, block ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hs)
SELECT r.doc_id, r.named AS source, st.pass, r.block, st.place, r.n_tokens FROM r JOIN dc ON dc.source = r.source AND dc.block = r.block AND dc.h = r.h
JOIN st ON st.source = r.source AND st.block = r.block WHERE left_over >= inside OR dc.before < left_over"""


def _op1() -> str:
    k = licenses.K
    rows = []
    for tpl, (text, label) in enumerate([*licenses.PHRASES, *licenses.TEMPLATES]):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        rows += [f"({tpl}, {p}, {len(w)}, '{label}', {'true' if tpl < len(licenses.PHRASES) else 'false'}, '{' '.join(w[p : p + k])}')" for p in range(len(w) - k + 1)]
    part = "PARTITION BY doc_id, tpl ORDER BY first_pos, diagonal"
    return rf"""WITH tg(tpl, tpos, tw, label, base, gram) AS (VALUES {', '.join(rows)}), dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
dg AS (SELECT doc_id, u.i AS pos, array_to_string(w[u.i + 1 : u.i + {k}], ' ') AS gram FROM dw, unnest(range(0, len(w) - {k - 1})) AS u(i) WHERE len(w) >= {k}),
v AS (SELECT doc_id, tpl, label, base, tw, pos - tpos AS diagonal, min(pos) AS first_pos, max(pos) + {k} AS last_pos, list(DISTINCT tpos) AS places FROM dg JOIN tg USING (gram) GROUP BY ALL),
m AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER ({part})) <= {licenses.DRIFT} AND first_pos - lag(last_pos) OVER ({part}) <= {licenses.GAP} THEN 0 ELSE 1 END AS fresh FROM v),
g AS (SELECT *, sum(fresh) OVER ({part}) AS span FROM m),
sp AS (SELECT doc_id, tpl, label, base, tw, span, min(first_pos) AS b, max(last_pos) AS e, list_distinct(flatten(list(places))) AS places, count(*) FILTER (WHERE len(places) = tw - {k - 1}) AS n_exact, min(diagonal) FILTER (WHERE len(places) = tw - {k - 1}) AS x0, max(diagonal) FILTER (WHERE len(places) = tw - {k - 1}) AS x1 FROM g GROUP BY ALL),
cv AS (SELECT *, CAST(len(list_distinct(flatten(list_transform(places, lambda p: range(p, p + {k}))))) AS DOUBLE) / tw AS cover FROM sp),
vf AS (SELECT *, cover >= CASE WHEN tw >= {licenses.LONG} THEN {licenses.COVER} ELSE 1.0 END AND e - b <= {licenses.STRETCH} * tw AS verified FROM cv),
ag AS (SELECT doc_id, CAST(sum(n_exact) FILTER (WHERE base) AS BIGINT) AS n_base, min(x0) FILTER (WHERE base) AS first_word, max(x1) FILTER (WHERE base) AS last_word,
string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND n_exact > 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE verified OR (base AND n_exact > 0)) AS labels, max(CASE WHEN base AND n_exact = 0 THEN 0.0 ELSE cover END) AS score FROM vf GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM dw LEFT JOIN ag USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op1_license_scan": _op1(),
    "op2_quality_divergence": _op2(),
    "op6_chat_events": OP6,
    "op7_benchmark_decontamination": OP7,
    "op9_line_templates": _op9(),
    "op10_temperature_mixing": _op10(),
}
