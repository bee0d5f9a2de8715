"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

from trefoil.llm.decontamination import MIN_COVERAGE, MIN_LITERALS, TOKEN, WINDOW
from trefoil.llm.preference import ROLE_CLOSE, ROLE_OPEN, TURN_END
from trefoil.llm.quality import POLICIES, RULES, mask

_BITS = " + ".join(f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, rule in enumerate(RULES.values()))
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g FROM w, unnest(range(1, len(ws) - 1)) u(i)),
rep AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT p) c FROM (SELECT rid, unnest([i, i + 1, i + 2]) p FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(ls) n_lines, len(ls) - len(list_distinct(ls)) n_dup_lines,
  length(regexp_replace(array_to_string(ws, ''), '[^\pL]+', '', 'g')) n_letters, coalesce(c, 0) n_repeat_words FROM w LEFT JOIN cov USING (rid)),
l AS (SELECT *, CAST({_BITS} AS BIGINT) fail_bits FROM m)
SELECT *, fail_bits & {mask(POLICIES["v1"])} = 0 kept, fail_bits & {mask(POLICIES["base"])} <> 0 base_failed FROM l"""

_HEAD = f"'{ROLE_OPEN}' || role || '{ROLE_CLOSE}'".replace("\n", "' || chr(10) || '")
_BODY = f"text || '{TURN_END}'".replace("\n", "' || chr(10) || '")
PREFERENCE = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) >> 1 pair_id, turn, CASE WHEN CAST(conv_id AS BIGINT) & 1 = 0 THEN 'chosen' ELSE 'rejected' END side, min((coalesce(role, 'unknown'), coalesce(text, ''))) v FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
a AS (SELECT pair_id, turn, max(v) FILTER (side = 'chosen') chosen, max(v) FILTER (side = 'rejected') rejected FROM t GROUP BY 1, 2),
f AS (SELECT pair_id, min(turn) FILTER (NOT coalesce(chosen = rejected, false)) split, bool_or(chosen IS NOT NULL) AND bool_or(rejected IS NOT NULL) paired FROM a GROUP BY 1),
p AS (SELECT *, split IS NULL OR turn < split shared FROM a JOIN f USING (pair_id)),
r AS (SELECT pair_id, 'prompt' segment, turn, chosen v, paired FROM p WHERE shared UNION ALL SELECT pair_id, 'chosen', turn, chosen, paired FROM p WHERE NOT shared AND chosen IS NOT NULL UNION ALL SELECT pair_id, 'rejected', turn, rejected, paired FROM p WHERE NOT shared AND rejected IS NOT NULL),
s AS (SELECT pair_id, segment, turn, v[1] AS "role", v[2] AS text, paired FROM r)
SELECT pair_id, segment, turn, role, {_HEAD} || {_BODY} rendered, CASE WHEN segment <> 'prompt' AND role = 'assistant' THEN length({_HEAD}) ELSE 0 END train_from,
  CASE WHEN segment <> 'prompt' AND role = 'assistant' THEN length({_HEAD} || {_BODY}) ELSE 0 END train_to, paired FROM s"""

EXAMPLES = f"""
WITH p AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, segment ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) place FROM ({PREFERENCE}))
SELECT pair_id, {", ".join(f"coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (segment = '{s}'), '') {s}" for s in ("prompt", "chosen", "rejected"))},
{", ".join(f"coalesce(string_agg(CAST(place + train_from AS BIGINT) || '-' || CAST(place + train_to AS BIGINT), ',' ORDER BY turn) FILTER (segment = '{s}' AND train_to > 0), '') {s}_mask" for s in ("chosen", "rejected"))}, bool_or(paired) paired FROM p GROUP BY 1"""

_TEMPLATE = r"list_transform(tk, lambda x, i: CASE WHEN regexp_matches(x, '^\pN.*\pL$') THEN '<num><unit>' WHEN regexp_matches(x, '^\pN') THEN '<num>' WHEN i > 1 AND regexp_matches(x, '^\p{Lu}\p{Ll}+$') THEN '<name>' ELSE lower(regexp_replace(x, '[^\pL]+', '', 'g')) END)"
_CLEAN = r"lower(regexp_replace({}, '[^\pL\pN.,]+', '', 'g'))"
_TOKEN = TOKEN.replace("'", "''")
DECONTAMINATION = rf"""
WITH it AS (SELECT DISTINCT item_id, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') tk FROM benchmark),
dt AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') tk FROM documents),
iw AS (SELECT item_id, p, tk[p + 1:p + {WINDOW}] v, tp[p + 1:p + {WINDOW}] w FROM (SELECT *, {_TEMPLATE} tp FROM it WHERE len(tk) >= {WINDOW}), unnest(range(0, len(tk) - {WINDOW - 1})) u(p)),
ik AS (SELECT *, count(*) OVER (PARTITION BY item_id) windows FROM iw WHERE len(list_filter(w, lambda x: NOT starts_with(x, '<'))) >= {MIN_LITERALS}),
dw AS (SELECT rid, doc_id, pos, tk[pos + 1:pos + {WINDOW}] v, tp[pos + 1:pos + {WINDOW}] w FROM (SELECT *, {_TEMPLATE} tp FROM dt WHERE len(tk) >= {WINDOW}), unnest(range(0, len(tk) - {WINDOW - 1})) u(pos)),
met AS (SELECT rid, doc_id, item_id, pos - p diagonal, p, windows, ik.w w, ik.v iv, dw.v dv FROM dw JOIN ik ON array_to_string(dw.w, ' ') = array_to_string(ik.w, ' ')),
line AS (SELECT rid, doc_id, item_id, diagonal, windows, count(DISTINCT p) matched FROM met GROUP BY 1, 2, 3, 4, 5),
slot AS (SELECT DISTINCT rid, item_id, diagonal, {_CLEAN.format("iv[i]")} a, {_CLEAN.format("dv[i]")} b FROM met, unnest(range(1, {WINDOW + 1})) u(i) WHERE starts_with(w[i], '<')),
fit AS (SELECT rid, item_id, diagonal, count(*) = count(DISTINCT a) AND count(*) = count(DISTINCT b) consistent, bool_and(a = b) exact FROM slot GROUP BY 1, 2, 3),
j AS (SELECT l.*, coalesce(consistent, true) consistent, coalesce(exact, true) exact, matched / windows coverage FROM line l LEFT JOIN fit f ON l.rid = f.rid AND l.item_id IS NOT DISTINCT FROM f.item_id AND l.diagonal = f.diagonal),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY consistent DESC, matched DESC, exact DESC) = 1)
SELECT doc_id, item_id, matched, windows, coverage, exact FROM b WHERE consistent AND coverage >= {MIN_COVERAGE}"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) first FROM p)
SELECT page_id, n payload_bytes, h payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END record_type, CASE WHEN n >= 100 AND page_id <> first THEN first END refers_to FROM f"""

_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
l AS (SELECT rid, doc_id, p, ls[p] line FROM d, unnest(range(1, len(ls) + 1)) u(p)),
k AS (SELECT *, CASE WHEN length({_KEY}) >= 10 THEN {_KEY} END key FROM l),
f AS (SELECT *, key IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY key) lost FROM k)
SELECT doc_id, count(*) n_lines, count(*) FILTER (lost) n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT lost), '')) kept_sha256 FROM f GROUP BY rid, doc_id"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END "label", list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id anchor_id, a.label = r.label same, r.vec_id other, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(r.q AS DOUBLE[])) AS BIGINT) score FROM v a, v r WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other positive_id, score positive_score FROM s WHERE same AND other <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, other negative_id, score negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) rank FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () rid, coalesce(text, '') t, coalesce(lang, '') lang, coalesce(source, '') source FROM documents),
w AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
c AS (SELECT lang, source, term, count(*) n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
full_ AS (SELECT lang, source, term, coalesce(n, 0) n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
tot AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) total, count(*) OVER (PARTITION BY lang, source) v, sum(n) OVER (PARTITION BY lang, term) nl, sum(n) OVER (PARTITION BY lang) total_l FROM full_),
pr AS MATERIALIZED (SELECT lang, source, term, n, 1 + CAST(CAST(1000000000 AS HUGEINT) * (n + 2) // (total + 2 * v) AS BIGINT) p, 1 + CAST(CAST(1000000000 AS HUGEINT) * (nl + 2) // (total_l + 2 * v) AS BIGINT) q FROM tot),
s AS (SELECT a.lang, a.source, b.source item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) x FROM pr a JOIN pr b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(x, 0) "value" FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' part, term item, (p - q) * (p - q) // (p + q) "value" FROM pr WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY "value" DESC, item) AS INT) rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""

ORACLE = {"op13_source_divergence": DIVERGENCE, "op11_line_dedup": LINE_DEDUP, "op12_hard_negatives": HARD_NEGATIVES, "op4_warc_round_trip": WARC, "op2_quality_ledger": QUALITY, "op7_preference_formatting": PREFERENCE, "preference_examples": EXAMPLES, "op8_template_decontamination": DECONTAMINATION}
