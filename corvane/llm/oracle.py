"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_DIGITS = "regexp_replace(h, '[^0-9]', '', 'g')"
_LUHN = f"""(list_sum(list_transform(range(0, len({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({_DIGITS}[len({_DIGITS}) - i] AS INT)
  ELSE (CAST({_DIGITS}[len({_DIGITS}) - i] AS INT) * 2) // 10 + (CAST({_DIGITS}[len({_DIGITS}) - i] AS INT) * 2) % 10 END)) % 10 = 0)"""
_MOVED = "(replace(h, ' ', '')[5:] || replace(h, ' ', '')[:4])"
_MOD_97 = f"""list_reduce(list_transform(range(1, len({_MOVED}) + 1), lambda i: CASE WHEN {_MOVED}[i] BETWEEN '0' AND '9' THEN CAST(ascii({_MOVED}[i]) - 48 AS BIGINT)
  ELSE CAST(ascii({_MOVED}[i]) - 55 AS BIGINT) END), lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END, 0::BIGINT) = 1"""
#: Kind: pattern, confirmation of a hit h, score and score with context, context words, shown part. In RE2, so without possessive quantifiers.
_KINDS = {
    "email": (rf"{_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.9, 1.0, "mail|contact|write", "h"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", rf"regexp_matches(h, '^{_PART}(?:\.{_PART}){{3}}$')", 0.7, 0.9, r"\bip\b|host|server|address", "h"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}", 0.8, 1.0, "card|visa|credit|payment", "h"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 9 AND 15", 0.7, 0.95, "tel|phone|call|mobile|fax", "h"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", _MOD_97, 0.8, 1.0, "iban|account|bank", "h"),
    "secret": (r"[=:]\x20?[\x22\x27]?[A-Za-z0-9+/_-]{20,}", "true", 0.2, 0.9, "token|secret|passw|api.?key|access.?key|private.?key", "regexp_extract(h, '[A-Za-z0-9+/_-]{20,}$')"),
}


def _spans_of(kind: str, rank: int) -> str:
    pattern, confirmed, score, context_score, context, shown = _KINDS[kind]
    gap = "gaps[i][greatest(1, len(gaps[i]) - 39):]"
    scored = f"CASE WHEN regexp_matches(lower({gap}), '{context}') THEN {context_score} ELSE {score} END"
    return f"""SELECT doc_id, row, start + len(h) - len({shown}) AS s, {rank} AS rank, start + len(h) AS e, '{kind}' AS kind, CAST(score AS DOUBLE) AS score FROM (
  SELECT doc_id, row, hits[i] AS h, list_sum(list_transform(gaps[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: len(x))), 0) AS start, {scored} AS score FROM (
    SELECT doc_id, row, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, row, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '[0-9@]')))) WHERE {confirmed} AND ({kind in ('email', 'ip', 'card', 'phone')} OR score >= 0.5)"""


_LINE = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
_BASE = "kind IN ('email', 'ip', 'card', 'phone')"
PII = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_spans_of(k, i) for i, k in enumerate(_KINDS))})
SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in list(_KINDS)[:4])},
sha256(coalesce(string_agg({_LINE}, ',' ORDER BY s, rank) FILTER ({_BASE}), '')) AS base_sha256,
coalesce(string_agg({_LINE}, ',' ORDER BY s, rank) FILTER (kind IS NOT NULL), '') AS spans, coalesce(max(score), 0.0::DOUBLE) AS top_score
FROM d LEFT JOIN spans USING (row) GROUP BY d.row, d.doc_id"""

QUALITY_RULES = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
grams AS (SELECT row, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY row),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
  len(regexp_replace(t, '[^A-Z]+', '', 'g')) * 2 > len(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS shouts, coalesce(list_max(list_transform(w, lambda x: len(x))), 0) AS longest
  FROM d LEFT JOIN covered USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
  OR 100 * n_dup_lines > 60 * n_lines OR shouts OR longest > 500) AS kept FROM f"""

_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _shingles(table: str, key: str) -> str:
    words = f"regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}')"
    return f"""SELECT DISTINCT {key}, g FROM (SELECT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN ['#' || array_to_string(w, ' ')] ELSE [] END) AS g FROM (SELECT {key}, {words} AS w FROM {table}))"""


DECONTAMINATION = f"""WITH d AS ({_shingles('documents', 'doc_id')}), b AS ({_shingles('benchmark', 'item_id')}),
sizes AS (SELECT item_id, count(*) AS item_size FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS matched, item_size, count(*) / item_size AS containment FROM d JOIN b USING (g) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, item_size HAVING 10 * count(*) >= 8 * item_size"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
JACCARD_JOIN = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT row, g FROM (SELECT row, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN ['#' || array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
links AS (SELECT x.row AS a, y.row AS b FROM s x JOIN s y USING (g) JOIN n nx ON nx.row = x.row JOIN n ny ON ny.row = y.row
  WHERE x.row <> y.row GROUP BY x.row, y.row, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
reached(a, b) AS (SELECT row, row FROM w UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id FROM w JOIN reached ON reached.a = w.row JOIN w o ON o.row = reached.b LEFT JOIN n ON n.row = w.row
GROUP BY w.row, w.doc_id, n.n"""
