"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from termloom.llm.secret_scans import BASE_RULES, MORE_RULES, Rule

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans_of(rule: Rule, k: int) -> str:
    """A list of (start, number of the kind, name) of a rule's matches: lengths between and of the matches, added up."""
    hits, gaps = f"regexp_extract_all(text, {quoted(rule.pattern)})", f"string_split_regex(text, {quoted(rule.pattern)})"
    start = "list_sum(list_transform(x.g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(x.h[1:i - 1], lambda y: length(y))), 0)"
    good = f"lambda i: length(regexp_extract(x.h[i], {quoted(rule.pattern)}, {rule.group})) >= {rule.least}" if rule.least else "lambda i: true"
    made = f"list_transform(list_filter(range(1, len(x.h) + 1), {good}), lambda i: {{'s': CAST({start} AS BIGINT), 'k': {k}, 't': concat('{rule.kind}:', CAST({start} AS BIGINT), ':', CAST({start} + length(x.h[i]) AS BIGINT))}})"
    return f"(SELECT {made} FROM (SELECT {{'h': {hits}, 'g': {gaps}}} AS x))"


def secrets_sql() -> str:
    rules = (*BASE_RULES, *MORE_RULES)
    columns = ", ".join(f"{spans_of(r, k)} AS {r.kind}" for k, r in enumerate(rules))

    def joined(own: tuple[Rule, ...]) -> str:
        lists = " || ".join(r.kind for r in own)
        return f"array_to_string(list_transform(list_sort({lists}), lambda z: z.t), ',')"

    counts = ", ".join(f"CAST(len({r.kind}) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)
    return f"SELECT doc_id, {counts}, sha256({joined(BASE_RULES)}) AS base_sha256, {joined(rules)} AS spans FROM (SELECT doc_id, {columns} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"


JACCARD = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lowered("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM sides UNION SELECT r.x, b.y FROM reach r JOIN sides b ON b.x = r.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, coalesce(k, 0) AS n_links FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS k FROM sides GROUP BY x) USING (doc_id)"""

WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
DECONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all({lowered("text")}, {WORDS}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lowered("text")}, {WORDS}) AS w FROM benchmark),
items AS (SELECT item, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM items)),
own AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
hits AS (SELECT doc_id, m, i, item FROM own JOIN windows USING (m, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

#: Five hexadecimal digits are four digits of base 32.
DIGITS = f"array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', CAST((CAST(concat('0x', substr(h, (i // 4) * 5 + 1, 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '')"
WARC = f"""SELECT page_id, n AS payload_bytes, {DIGITS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))"""


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scans": secrets_sql(), "op4_ngram_jaccard_join": JACCARD, "op7_benchmark_decontamination": DECONTAMINATION, "op9_warc": WARC}
