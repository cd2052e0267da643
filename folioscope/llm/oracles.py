"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import chat, secrets as s

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS key FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS key FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
h AS (SELECT doc_id, size, i, item_id FROM dw JOIN bw USING (size, key)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

_CONTROL = r"\\|" + "|".join("".join("\\" + c if c in "[]" else c for c in x) for x in chat._CONTROL)
_LONGER = f"length(text) + len(regexp_extract_all(text, '{_CONTROL}'))"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_LONGER} + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 18 + length(role) END) AS BIGINT) AS formatted_chars,
  false AS rewritten
FROM c GROUP BY conv_id"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

# A repeated piece of one to four characters, which the operator's pattern finds by a back reference.
_REPEATED = " OR ".join(
    f"(length(m) - {t}) % {k} = 0 AND length(m) - {t} >= {2 * k} AND left(m, length(m) - {t}) = repeat(left(m, {k}), (length(m) - {t}) // {k})" for k in (1, 2, 3, 4) for t in range(4)
)
_ALLOWED = "|".join(p for p in s.ALLOWED.split("|") if "\\1" not in p).replace("++", "+").replace("*+", "*")  # DuckDB's matcher never goes back
_BITS = f"list_max(list_transform(range(1, length({{m}}) - {s.WINDOW - 2}), lambda i: list_aggregate(string_split(substr({{m}}, i, {s.WINDOW}), ''), 'entropy')))"
_TESTS = (
    "regexp_matches(m, '" + s.LONG_ASSIGN.replace("'", "''") + "')", "true", "true",
    f"NOT regexp_matches(m, '{_ALLOWED}') AND NOT ({_REPEATED}) AND CASE WHEN regexp_matches(m, '{s.CLASSES[0][0]}') THEN {_BITS.format(m='lower(m)')} >= {s.CLASSES[0][2]} - 1e-9 ELSE {_BITS.format(m='m')} >= {s.CLASSES[1][2]} - 1e-9 END",
)


def _found(kind: int, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, start, {kind} AS kind, start + length(m) AS stop FROM (
  SELECT doc_id, matches[k] AS m, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:k - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(matches) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS matches, string_split_regex(text, '{quoted}') AS gaps FROM documents WHERE regexp_matches(text, '{quoted}'))))
WHERE {_TESTS[kind]}"""


SECRETS = f"""
WITH f AS ({' UNION ALL '.join(_found(k, p) for k, p in enumerate((s.ASSIGN, s.ACCESS, s.HEX, s.CANDIDATE)))}),
g AS (SELECT doc_id, {', '.join(f'count(*) FILTER (WHERE kind = {k}) AS n_{name}' for k, name in enumerate(s.KINDS))},
  string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
  string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{name}, 0) AS n_{name}' for name in s.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)"""

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
g AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
i AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (SELECT doc_id, p, sum(CAST(coalesce(p > back + 50, true) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS back FROM g)) GROUP BY doc_id, island),
c AS (SELECT doc_id, a AS upto, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM i UNION ALL SELECT d.doc_id, length(h) // 2, coalesce(max(z), 0) FROM d LEFT JOIN i USING (doc_id) GROUP BY d.doc_id, h),
k AS (SELECT c.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since) AS kept FROM c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, (length(h) - length(kept)) // 2 AS n_removed, (SELECT count(*) FROM i WHERE i.doc_id = d.doc_id) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k USING (doc_id)"""

ORACLE_SQL = {"op3_decontaminate": DECONTAMINATE, "op4_chat": CHAT, "op5_jaccard": JACCARD, "op7_secrets": SECRETS, "op10_suffixes": SUFFIXES}
