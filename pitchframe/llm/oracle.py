"""DuckDB SQL of the operators that SQL can express, over the registered views."""

from __future__ import annotations

from pitchframe.llm import license_scan as lic
from pitchframe.llm import quality_rules as rules

_BLANK_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op9_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS)))
    following = ", ".join(f"lead(x, {k}) OVER z" for k in range(1, rules.WINDOW))
    share = {
        "mean_word_length": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words",
        "stop_word_share": "n_stop / n_words", "duplicate_line_share": "n_dup_lines / nullif(n_lines, 0)",
        "upper_case_share": "n_upper / nullif(word_chars, 0)", "repeated_word_share": "n_repeat_words / n_words",
    }
    passed = " AND ".join(
        f"coalesce({share[r.ratio]}, 0) {sign} {bound!r}" for r in rules.RULES
        for sign, bound in ((">=", r.at_least), ("<=", r.at_most)) if bound is not None)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_BLANK_WORD}) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_BLANK_WORD})) AS lines
  FROM documents),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
gram AS (SELECT doc_id, i, concat_ws(' ', x, {following}) AS g, lead(x, {rules.WINDOW - 1}) OVER z AS last_word
         FROM word WINDOW z AS (PARTITION BY doc_id ORDER BY i)),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gram WHERE last_word IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
          SELECT doc_id, unnest(range(i, i + {rules.WINDOW})) AS p FROM win WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '{rules.SYMBOL}', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
         CAST(coalesce(rep.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
b AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {passed} AS kept
FROM b"""


def op5_sql() -> str:
    templates = lic.BASE + lic.TEMPLATES
    grams = [(t, i, *p.split()[i:i + 3]) for t, (p, _) in enumerate(templates) for i in range(len(p.split()) - 2)]
    values = ", ".join(f"({t}, {i}, '{a}', '{b}', '{c}')" for t, i, a, b, c in grams)
    kinds = ", ".join(f"({t}, '{label}', {len(p.split()) - 2})" for t, (p, label) in enumerate(templates))
    return f"""
WITH grams(template, t_at, a, b, c) AS (VALUES {values}),
kinds(template, label, total) AS (VALUES {kinds}),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{lic.WORD}') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS word_at, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
v AS (SELECT doc_id, template, word_at - t_at AS diagonal, count(*) AS votes FROM g JOIN grams USING (a, b, c) GROUP BY ALL),
k AS (SELECT v.*, label, total, template < {len(lic.BASE)} AND votes = total AS is_base,
             CASE WHEN diagonal - lag(diagonal) OVER z <= {lic.MAX_SHIFT} THEN 0 ELSE 1 END AS cut
      FROM v JOIN kinds USING (template) WINDOW z AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM k),
p AS (SELECT doc_id, template, label, least(sum(votes) / max(total), 1.0) AS coverage, count_if(is_base) AS places,
             min(CASE WHEN is_base THEN diagonal END) AS first_at, max(CASE WHEN is_base THEN diagonal END) AS last_at
      FROM s GROUP BY doc_id, template, label, span),
q AS (SELECT *, places > 0 OR (template >= {len(lic.BASE)} AND coverage >= {lic.MIN_COVERAGE}) AS sure FROM p),
r AS (SELECT doc_id, sum(places) AS n_base, min(first_at) AS first_word, max(last_at) AS last_word,
             string_agg(DISTINCT CASE WHEN places > 0 THEN label END, ',' ORDER BY CASE WHEN places > 0 THEN label END) AS base_labels,
             string_agg(DISTINCT CASE WHEN sure THEN label END, ',' ORDER BY CASE WHEN sure THEN label END) AS labels,
             max(CASE WHEN sure THEN CASE WHEN places > 0 THEN 1.0 ELSE coverage END END) AS score
      FROM q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""


def op7_sql(width: int = 3, percent: int = 85) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_BLANK_WORD}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i:i + {width - 1}] AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d WHERE len(w) >= {width})
  UNION ALL SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND {width - 1}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM both_in JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v
         WHERE 100 * k >= {percent} * (a.n + b.n - k)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.v FROM reach r JOIN edge e ON e.u = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def op12_sql(k: int = 10) -> str:
    term = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {term}) AS w FROM documents),
i AS (SELECT row_number() OVER () AS slot, item_id, regexp_extract_all({_LOWER}, {term}) AS w FROM benchmark),
need AS (SELECT slot, item_id, t, count(*) AS times FROM (SELECT slot, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
total AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM need) GROUP BY ALL),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
           FROM tf, total GROUP BY t),
size AS (SELECT r, doc_id, 25 + (75 * CAST(len(w) AS BIGINT) * n) // l AS m FROM d, total WHERE len(w) > 0),
scored AS (SELECT slot, item_id, r, doc_id,
                  CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM need JOIN weight USING (t) JOIN tf USING (t) JOIN size USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, doc_id NULLS LAST, r) AS rank
           FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""


def op13_sql(k: int = 5, scale: int = 256, every: int = 50) -> str:
    return f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id,
                  list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON c.r <> q.r WHERE q.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""
