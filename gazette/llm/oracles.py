"""DuckDB SQL for the training-data operators that SQL can express."""

from __future__ import annotations

from gazette.llm.secrets import RULES

OP1 = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""

OP8 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: Every pair of documents with a common shingle, counted; then what links reach.
OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest USING (doc_id)
"""


def _spans(order: int) -> str:
    """SQL for the list of a rule's spans: what lies between matches and the matches give the positions."""
    rule = RULES[order]
    pattern = rule.pattern.replace("'", "''")
    tested = f"regexp_extract_all(t, '{pattern}', {rule.group})"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
      'a': CAST(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], lambda m: length(m))), 0) AS BIGINT),
      'k': {order}, 'z': length(regexp_extract_all(t, '{pattern}')[i]), 'g': length({tested}[i]), 'name': '{rule.kind}'}}), lambda e: e.g >= {rule.least})"""


_BASE = [k for k, r in enumerate(RULES) if r.base]
_JOINED = "array_to_string(list_transform({}, lambda e: e.name || ':' || e.a || ':' || (e.a + e.z)), ',')"

OP4 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, list_sort({" || ".join(_spans(k) for k in range(len(RULES)))}) AS s FROM docs)
SELECT doc_id, {", ".join(f"len(list_filter(s, lambda x: x.k = {k})) AS n_{RULES[k].kind}" for k in _BASE)},
       sha256({_JOINED.format(f"list_filter(s, lambda x: x.k IN ({', '.join(map(str, _BASE))}))")}) AS base_sha256, {_JOINED.format("s")} AS spans
FROM found
"""

SQL = {"op1_warc": OP1, "op4_secret_scan": OP4, "op7_near_dedup": OP7, "op8_exact_dedup": OP8}
