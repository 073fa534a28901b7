"""SQL for the registered queries, for an engine whose regular expressions are RE2's."""

from __future__ import annotations

from glossator.functions.safety import CREDENTIAL, EMAIL, PRIVATE_KEY
from glossator.functions.text import IDENTIFIER

_FOLD = "translate(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss'), 'ſς', 'sσ')"

#: The record view: r(doc_id, case_id, split, family, template_id, kind, text, lang, spans), spans being structs (s, e, x, label).
RECORDS = f"""
d AS (
  SELECT doc_id, 'doc-' || doc_id AS case_id, text, lang, source AS family, lang || ':' || source AS template_id,
         CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'eval' ELSE 'holdout' END AS split,
         regexp_extract_all(text, '{IDENTIFIER}') AS m, string_split_regex(text, '{IDENTIFIER}') AS g
  FROM documents
), f AS (
  SELECT *, list_transform(range(1, len(m) + 1), lambda i: {{
      's': CAST(list_sum(list_transform(g[1:i], lambda y: len(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: len(y))), 0) AS INTEGER), 'x': m[i]}}) AS found
  FROM d
), r AS (
  SELECT doc_id, case_id, split, family, template_id, text, lang,
         list_transform(found, lambda h: {{'s': h.s, 'e': CAST(h.s + len(h.x) AS INTEGER), 'x': h.x}}) AS every,
         CASE WHEN doc_id % 5 <> 0 THEN list_transform(found, lambda h: {{'s': h.s, 'e': CAST(h.s + len(h.x) AS INTEGER), 'x': h.x,
           'label': CASE WHEN contains(h.x, '@') THEN 'EMAIL' WHEN h.x LIKE '(%' THEN 'PHONE' WHEN regexp_matches(h.x, '^[0-9]') THEN 'NUMBER_GROUP' ELSE 'CODE' END}}) ELSE [] END AS spans,
         CASE WHEN doc_id % 5 <> 0 AND len(m) > 0 THEN 'positive' ELSE 'unannotated' END AS kind
  FROM f
), a AS (SELECT doc_id, case_id, split, family, kind, text, u.s AS s, u.e AS e, u.x AS x, u.label AS label FROM (SELECT *, unnest(spans) AS u FROM r WHERE len(spans) > 0))"""

_SHAPE = """'generic:' || (SELECT string_agg(CASE WHEN t LIKE 'A%' THEN 'A' || len(t) ELSE t END, '' ORDER BY o) FROM (
  SELECT unnest(l) AS t, unnest(range(len(l))) AS o FROM (SELECT regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(x, '\\pL', 'A', 'g'), '[0-9]', '9', 'g'), '\\s', ' ', 'g'), 'A+|[^A]') AS l)))"""

#: p(id, spans): the derived predictions; j: records beside their predictions, one row for each span of either.
PREDICTIONS = """
p AS (
  SELECT CASE WHEN doc_id % 50 = 13 THEN 'gone-' || doc_id ELSE case_id END AS id, doc_id,
         CASE WHEN doc_id % 7 = 3 AND doc_id % 4 = 0 THEN [{'s': 0, 'e': 3, 'label': 'CODE'}] WHEN doc_id % 7 = 4 THEN []
           ELSE list_transform(spans, lambda h: {'s': CAST(h.s + CASE WHEN doc_id % 7 = 1 THEN 1 ELSE 0 END AS INTEGER), 'e': h.e, 'label': CASE WHEN doc_id % 7 = 2 THEN 'CODE' ELSE h.label END}) END AS spans
  FROM r WHERE doc_id % 11 <> 5
), pr AS (SELECT id, u.s AS s, u.e AS e, u.label AS label FROM (SELECT id, unnest(spans) AS u FROM p WHERE len(spans) > 0)),
q AS (SELECT r.case_id, r.family, r.kind, r.split, pr.s, pr.e, pr.label FROM r JOIN pr ON pr.id = r.case_id)"""

_SHINGLES = f"""
w AS (SELECT doc_id, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'eval' ELSE 'holdout' END AS split, list_filter(string_split({_FOLD}, ' '), lambda y: y <> '') AS ws FROM documents),
s AS (SELECT doc_id, split, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
x AS (SELECT doc_id, split, len(sh) AS n, hash(unnest(sh)) AS h FROM s)"""

_SKELETON = "regexp_extract_all(translate(replace(lower(regexp_replace(regexp_replace(text, '\\b\\d+\\b', '#', 'g'), '\\s+', ' ', 'g')), 'ß', 'ss'), 'ſς', 'sσ'), '[a-z]+|<[^>]+>|#')"


_MARKS = _SKELETON.replace("|#'", "'")


def _grams(source: str, klass: str, tokens: str) -> str:
    return f"""
t AS (SELECT {klass} AS class, {tokens} AS tok FROM {source}),
n AS (SELECT class, list_distinct(list_concat(tok,
   list_transform(range(1, len(tok)), lambda i: array_to_string(tok[i:i+1], ' ')), list_transform(range(1, len(tok) - 1), lambda i: array_to_string(tok[i:i+2], ' ')))) AS g FROM t),
c AS (SELECT class, feature, count(*) AS k FROM (SELECT class, unnest(g) AS feature FROM n) WHERE NOT contains(feature, '<') GROUP BY ALL),
z AS (SELECT class, count(*) AS class_total FROM t GROUP BY class),
b AS (SELECT feature, class, k, sum(k) OVER (PARTITION BY feature) AS support, row_number() OVER (PARTITION BY feature ORDER BY k DESC, class) AS o FROM c)"""


def _markers(least: int) -> str:
    return f"""SELECT feature, CAST(len(string_split(feature, ' ')) AS INTEGER) AS width, b.class AS class, k AS class_n, CAST(support AS BIGINT) AS support, class_total
FROM b JOIN z ON z.class = b.class WHERE o = 1 AND support >= {least}"""


def _slice(name: str, column: str) -> str:
    return f"SELECT '{name}' AS slice, CAST({column} AS VARCHAR) AS name, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(pn - tp) AS BIGINT) AS fp, CAST(sum(gn - tp) AS BIGINT) AS fn FROM m GROUP BY ALL"


ORACLES: dict[str, str] = {
    "q01_split_counts": f"""WITH {RECORDS} SELECT split, count(*) AS records, count(*) FILTER (kind = 'positive') AS positives, count(*) FILTER (kind = 'hard_negative') AS negatives,
        count(DISTINCT family) AS families, count(DISTINCT template_id) AS templates, CAST(0 AS BIGINT) AS personas, CAST(0 AS BIGINT) AS organizations FROM r GROUP BY split""",
    "q02_fingerprint_dups": f"SELECT md5({_FOLD}) AS fingerprint, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "q03_near_dup_pairs": f"""WITH {_SHINGLES}, m AS (SELECT doc_id, len(sh) AS n, min(doc_id) OVER (PARTITION BY list_sort(sh)) AS rep FROM s WHERE len(sh) > 0), y AS (SELECT x.* FROM x JOIN m ON m.doc_id = x.doc_id WHERE m.doc_id = m.rep),
        c AS (SELECT l.doc_id AS l, r.doc_id AS r, l.n AS nl, r.n AS nr, count(*) AS k FROM y l JOIN y r ON l.h = r.h AND l.doc_id < r.doc_id GROUP BY ALL)
        SELECT l, r, CAST(k AS INTEGER) AS "both", CAST(nl + nr - k AS INTEGER) AS total FROM c WHERE k >= 0.85 * (nl + nr - k)
        UNION ALL SELECT rep, doc_id, CAST(n AS INTEGER), CAST(n AS INTEGER) FROM m WHERE doc_id <> rep""",
    "q04_cross_split_contamination": f"""WITH {RECORDS}, v AS (
        SELECT 'value' AS dimension, split, x AS v FROM a UNION SELECT 'template', split, template_id FROM r UNION SELECT 'body', split, md5({_FOLD}) FROM r)
        SELECT l.dimension AS dimension, l.split AS split_a, r.split AS split_b, count(*) AS n FROM v l JOIN v r ON l.dimension = r.dimension AND l.v = r.v AND l.split < r.split GROUP BY ALL""",
    "q05_intra_split_redundancy": f"""WITH {_SHINGLES}, c AS (SELECT l.split, l.doc_id AS l, r.doc_id AS r, l.n AS nl, r.n AS nr, count(*) AS k FROM x l JOIN x r ON l.h = r.h AND l.split = r.split AND l.doc_id < r.doc_id GROUP BY ALL),
        g AS (SELECT * FROM c WHERE k >= 0.85 * (nl + nr - k)),
        i AS (SELECT split, count(DISTINCT id) AS involved, count(*) // 2 AS pairs FROM (SELECT split, l AS id FROM g UNION ALL SELECT split, r FROM g) GROUP BY split)
        SELECT t.split AS split, coalesce(involved, 0) AS involved, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs, total FROM (SELECT split, count(*) AS total FROM w GROUP BY split) t LEFT JOIN i ON i.split = t.split""",
    "q06_pervasive_4grams": f"""WITH t AS (SELECT {_SKELETON} AS tok FROM documents), g AS (SELECT unnest(list_distinct(list_transform(range(1, len(tok) - 2), lambda i: array_to_string(tok[i:i+3], ' ')))) AS gram FROM t)
        SELECT gram, count(*) AS df FROM g GROUP BY gram ORDER BY df DESC, gram LIMIT 20""",
    "q07_kind_markers": f"WITH {_grams('documents JOIN labels USING (doc_id)', 'quality', _MARKS)} {_markers(20)}",
    "q08_label_markers": f"""WITH {RECORDS}, one AS (SELECT spans[1].label AS label, substr(text, 1, spans[1].s) || '<entity>' || substr(text, spans[1].e + 1) AS text FROM r WHERE len(spans) = 1),
        {_grams('one', 'label', _MARKS)} {_markers(3)}""",
    "q09_identifier_spans": f"WITH {RECORDS} SELECT doc_id, label, s AS start, e AS \"end\", x AS text, CAST(strlen(substr(text, 1, s)) AS INTEGER) AS byte_start FROM a",
    "q10_shape_entity_share": f"""WITH {RECORDS}, o AS (SELECT u.x AS x, CASE WHEN len(spans) > 0 THEN 1 ELSE 0 END AS k FROM (SELECT spans, unnest(every) AS u FROM r WHERE len(every) > 0)),
        h AS (SELECT k, {_SHAPE} AS shape FROM o) SELECT shape, CAST(sum(k) AS BIGINT) AS annotated, count(*) AS support FROM h GROUP BY shape HAVING sum(k) > 0""",
    "q11_value_diversity": f"WITH {RECORDS} SELECT label, count(DISTINCT x) AS distinct_n, count(*) AS occurrences FROM a GROUP BY label",
    "q12_shared_affix": f"""WITH {RECORDS}, v AS (SELECT DISTINCT label, x FROM a), t AS (SELECT label, count(*) AS total FROM v GROUP BY label HAVING count(*) > 1),
        c AS (SELECT label, unnest(range(1, len(x) + 1)) AS width, x FROM v), k AS (SELECT label, 'prefix' AS side, width, left(x, width) AS affix FROM c UNION ALL SELECT label, 'suffix', width, right(x, width) FROM c),
        n AS (SELECT label, side, width, affix, count(*) AS n FROM k GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY label, side, width ORDER BY n DESC, affix) AS o FROM n)
        SELECT b.label AS label, side, CAST(width AS INTEGER) AS width, affix, n, total FROM b JOIN t ON t.label = b.label WHERE o = 1""",
    "q13_safety_scan": f"""WITH u AS (SELECT text FROM documents UNION ALL SELECT url FROM pages), h AS (
        SELECT text, list_transform(regexp_extract_all(text, '{EMAIL}', 1), lambda y: lower(y)) AS mails, list_transform(regexp_extract_all(text, '(?i)https?://([^\\s<>"/?#:]+)', 1), lambda y: lower(y)) AS hosts FROM u),
        f AS (SELECT unnest([CASE WHEN len(list_filter(mails, lambda y: y <> 'example.org' AND NOT ends_with(y, '.example.org'))) > 0 THEN 'unreserved e-mail domain' END,
          CASE WHEN len(list_filter(hosts, lambda y: y <> 'example.org' AND NOT ends_with(y, '.example.org'))) > 0 THEN 'unreserved URL host' END,
          CASE WHEN regexp_matches(text, '{PRIVATE_KEY}') THEN 'private key' END, CASE WHEN regexp_matches(text, '{CREDENTIAL}') THEN 'credential' END]) AS reason FROM h)
        SELECT reason, count(*) AS records FROM f WHERE reason IS NOT NULL GROUP BY reason""",
    "q14_family_share": "SELECT source AS family, count(*) AS n, (SELECT count(*) FROM documents) AS total FROM documents GROUP BY source",
    "q15_cell_diversity": f"""WITH {RECORDS}, s AS (SELECT unnest(['train', 'eval', 'holdout', 'spare']) AS split), k AS (SELECT DISTINCT family FROM r)
        SELECT s.split AS split, k.family AS family, count(DISTINCT template_id) AS n FROM s CROSS JOIN k LEFT JOIN r ON r.split = s.split AND r.family = k.family GROUP BY ALL""",
    "q16_template_share": "SELECT lang || ':' || source AS template_id, count(*) AS n, (SELECT count(*) FROM documents) AS total FROM documents GROUP BY 1",
    "q17_score_strict": f"""WITH {RECORDS}, {PREDICTIONS}, k AS (SELECT case_id, family, kind, split, label, s, e, count(*) AS g, 0 AS n FROM a GROUP BY ALL UNION ALL SELECT case_id, family, kind, split, label, s, e, 0, count(*) FROM q GROUP BY ALL),
        m AS (SELECT family, kind, split, label, least(sum(g), sum(n)) AS tp, sum(n) AS pn, sum(g) AS gn FROM k GROUP BY case_id, family, kind, split, label, s, e),
        y AS (SELECT family, kind, split, NULL AS label, 0 AS tp, 0 AS pn, 0 AS gn FROM r)
        {_slice('overall', "'all'")} UNION ALL {_slice('label', 'label')}
        UNION ALL {_slice('family', 'family').replace('FROM m', 'FROM (SELECT * FROM m UNION ALL SELECT * FROM y)')} UNION ALL {_slice('kind', 'kind').replace('FROM m', 'FROM (SELECT * FROM m UNION ALL SELECT * FROM y)')}
        UNION ALL {_slice('split', 'split').replace('FROM m', 'FROM (SELECT * FROM m UNION ALL SELECT * FROM y)')}""",
    "q19_over_trigger": f"WITH {RECORDS}, {PREDICTIONS}, i AS (SELECT DISTINCT case_id FROM q) SELECT family, count(i.case_id) AS triggered, count(*) AS scored FROM r LEFT JOIN i ON i.case_id = r.case_id WHERE kind = 'unannotated' GROUP BY family",
    "q20_conflict_outcomes": f"""WITH {RECORDS}, {PREDICTIONS}, g AS (SELECT case_id, spans[1] AS t, CASE doc_id % 3 WHEN 0 THEN 'CODE' WHEN 1 THEN 'PHONE' ELSE 'EMAIL' END AS told FROM r WHERE len(spans) = 1 AND doc_id % 4 <> 3),
        o AS (SELECT g.case_id, bool_or(q.s = t.s AND q.e = t.e AND q.label = t.label) AS hit, bool_or(q.s = t.s AND q.e = t.e AND q.label = told) AS hint, count(q.case_id) AS n FROM g LEFT JOIN q ON q.case_id = g.case_id GROUP BY g.case_id)
        SELECT CASE WHEN hit THEN 'gold' WHEN hint THEN 'shape_hint' WHEN n > 0 THEN 'other_error' ELSE 'abstention' END AS outcome, count(*) AS n FROM o GROUP BY 1""",
    "q22_bio_decode": f"WITH {RECORDS} SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY s) AS INTEGER) AS span_no, label, s AS start, e AS \"end\" FROM a",
    "q23_markup_parse": f"WITH {RECORDS} SELECT case_id, label, s AS start, e AS \"end\", x AS text FROM a WHERE NOT contains(text, '[[') AND NOT contains(text, ']]')",
    "q24_case_id": "SELECT doc_id, 'ext-' || substr(sha256(source || '|' || doc_id || '|' || text), 1, 20) AS case_id FROM documents",
    "q25_benchmark_containment": f"""WITH {_SHINGLES}, bw AS (SELECT item_id, list_filter(string_split({_FOLD}, ' '), lambda y: y <> '') AS ws FROM benchmark),
        bs AS (SELECT item_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM bw),
        bx AS (SELECT item_id, len(sh) AS n, hash(unnest(sh)) AS h FROM bs)
        SELECT item_id AS item, doc_id AS doc, CAST(count(*) AS INTEGER) AS "both", CAST(bx.n AS INTEGER) AS total FROM bx JOIN x ON x.h = bx.h GROUP BY item_id, doc_id, bx.n HAVING count(*) >= 0.5 * bx.n""",
    "q26_unknown_ids": f"WITH {RECORDS}, {PREDICTIONS} SELECT id FROM p WHERE id NOT IN (SELECT case_id FROM r)",
    "q27_span_validation": f"""WITH {RECORDS}, v AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN s + 1 ELSE s END AS s2, CASE WHEN doc_id % 4 = 0 THEN e + 1000000 ELSE e END AS e2 FROM a),
        c AS (SELECT *, s2 >= e2 OR e2 > len(text) AS bad FROM v),
        y AS (SELECT case_id, bool_or(bad) AS bounds, bool_or(substr(text, CAST(s2 + 1 AS BIGINT), CAST(e2 - s2 AS BIGINT)) <> x) AS differs, bool_or(s2 <> s OR strlen(substr(text, 1, CAST(e2 AS BIGINT))) <> strlen(substr(text, 1, e))) AS moved FROM c GROUP BY case_id),
        o AS (SELECT case_id, bool_or(nx < e2) AS overlap FROM (SELECT case_id, e2, lead(s2) OVER (PARTITION BY case_id ORDER BY s2, e2) AS nx FROM v) GROUP BY case_id),
        k AS (SELECT unnest([CASE WHEN bounds THEN 'bounds' END, CASE WHEN overlap THEN 'overlap' END, CASE WHEN NOT bounds AND differs THEN 'text' END, CASE WHEN NOT bounds AND moved THEN 'bytes' END]) AS code FROM y JOIN o USING (case_id))
        SELECT code, count(*) AS n FROM k WHERE code IS NOT NULL GROUP BY code""",
}
ORACLES["q28_threshold_strictness"] = f"""WITH {RECORDS}, v AS (SELECT label, count(DISTINCT x) AS k FROM a GROUP BY label),
    m AS (SELECT 'max_family_share' AS key, max(n) / CAST((SELECT count(*) FROM r) AS DOUBLE) AS configured, CAST(0.12 AS DOUBLE) AS reference, true AS high FROM (SELECT count(*) AS n FROM r GROUP BY family)
      UNION ALL SELECT 'max_template_share', max(n) / CAST((SELECT count(*) FROM r) AS DOUBLE), CAST(0.05 AS DOUBLE), true FROM (SELECT count(*) AS n FROM r GROUP BY template_id)
      UNION ALL SELECT 'minimum_distinct_values_per_label', CAST(min(k) AS DOUBLE), CAST(30 AS DOUBLE), false FROM v
      UNION ALL SELECT 'minimum_marker_support', CAST(40 AS DOUBLE), CAST(20 AS DOUBLE), true)
    SELECT key, configured, reference FROM m WHERE CASE WHEN high THEN configured > reference ELSE configured < reference END"""
# Words and signs with their offsets and tags; a span's first token begins at its first character.
ORACLES["q21_bio_tokens"] = f"""WITH {RECORDS}, k AS (SELECT case_id, spans, regexp_extract_all(text, '[\\pL\\pN_]+|[^\\pL\\pN_\\s]') AS m, string_split_regex(text, '[\\pL\\pN_]+|[^\\pL\\pN_\\s]') AS g FROM r),
    u AS (SELECT case_id, spans, unnest(m) AS token, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS pos FROM k),
    o AS (SELECT case_id, spans, pos, token, CAST(sum(len(gap) + len(token)) OVER (PARTITION BY case_id ORDER BY pos) AS BIGINT) AS e FROM u),
    p AS (SELECT case_id, pos, token, e - len(token) AS s, e, list_filter(spans, lambda h: h.s < e AND h.e > e - len(token)) AS met FROM o)
    SELECT case_id, CAST(pos AS INTEGER) AS pos, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", token,
      CASE WHEN len(met) = 0 THEN 'O' WHEN len(met) = 1 AND met[1].s <= s AND e <= met[1].e THEN CASE WHEN s = met[1].s THEN 'B-' ELSE 'I-' END || met[1].label END AS tag FROM p"""
ORACLES["q18_score_overlap"] = ORACLES["q17_score_strict"].replace(
    "k AS (SELECT case_id, family, kind, split, label, s, e, count(*) AS g",
    """ov AS (SELECT a.case_id, a.s, a.e, q.s AS ps, q.e AS pe, a.label FROM a JOIN q ON q.case_id = a.case_id AND q.label = a.label AND greatest(least(a.e, q.e) - greatest(a.s, q.s), 0) * 2 >= greatest(a.e, q.e) - least(a.s, q.s)),
        k AS (SELECT case_id, family, kind, split, label, s, e, count(*) AS g""",
).replace("SELECT case_id, family, kind, split, label, s, e, 0, count(*) FROM q GROUP BY ALL", "SELECT q.case_id, family, kind, split, q.label, coalesce(ov.s, -1 - q.s), coalesce(ov.e, -1 - q.e), 0, count(*) FROM q LEFT JOIN ov ON ov.case_id = q.case_id AND ov.ps = q.s AND ov.pe = q.e AND ov.label = q.label GROUP BY ALL")
