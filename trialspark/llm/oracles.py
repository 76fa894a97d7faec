"""DuckDB statements of the queries that SQL can express.

Language profiles, the scorers, the packing and fuzzy notices have none: tests hold them
against brute force. The vector statement compares all pairs, so it is for small tables.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH d AS (SELECT doc_id, {_words("text", _ALNUM)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", _ALNUM)} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
found AS (SELECT p.doc_id, p.i, p.size, x.item FROM places p JOIN windows x ON p.size = x.size AND p.g = x.g),
hits AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

#: A private key to its END line; one without END to its last full base64 line, and a shorter one that ends the text.
#: Without looking ahead SQL can't end a shorter line at a quote or a further line: keys cut off there differ.
_PEM = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:-{0,4}[^-])*-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:(?:[\s>]|\\[nrt])+[A-Z][A-Za-z]*-[A-Z][A-Za-z]*:(?:[^\n\\]|\\[^nr\n])*)*"
    r"(?:(?:[\s>]|\\[nrt])+[A-Za-z0-9+/]{16,}={0,2})*"
    r"(?:[ \t]*(?:\r?\n|\\r|\\n)(?:[\s>]|\\[nrt])*[A-Za-z0-9+/]+={0,2}\z)?)"
)
#: kind, pattern, group, least length, whether it is a base kind
_RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    ("hex", r"[0-9a-f]+", 0, 24, True),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28, False),
    ("pem", _PEM, 0, 27, False),
)
_MATCHES = " UNION ALL ".join(
    f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {str(base).lower()} AS base, i,
      sum(length(gap) + coalesce(length(whole), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, length(whole) AS size, length(part) AS part, {least} AS least
    FROM (SELECT doc_id, unnest(gaps) AS gap, unnest(whole) AS whole, unnest(part) AS part, generate_subscripts(gaps, 1) AS i
      FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {group}) AS part FROM d))"""
    for rank, (kind, pattern, group, least, base) in enumerate(_RULES)
)
OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_MATCHES}),
f AS (SELECT doc_id, rank, kind, base, CAST(upto - size AS BIGINT) AS s, concat(kind, ':', CAST(upto - size AS BIGINT), ':', CAST(upto AS BIGINT)) AS span FROM m WHERE part >= least),
g AS (SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (base), '') AS base, string_agg(span, ',' ORDER BY s, rank) AS spans
  FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", _SPACED)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 3) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
root AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(root.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(root.b, d.doc_id)) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN root ON d.doc_id = root.a
"""

OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda c: c IS NULL OR NOT isfinite(c)), true)
    AND list_contains(list_transform(embedding, lambda c: c <> 0), true)),
u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.95),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
root AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN links ON vec_id = links.a LEFT JOIN root ON vec_id = root.a
"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP11 = f"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, {_BLANK}), '{_UPPER}', '{_LOWER}') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
shared AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.keeper AS gone FROM l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE_SQL = {"op1_decontaminate": OP1, "op3_secret_ledger": OP3, "op5_minhash_dedup": OP5, "op8_vector_dedup": OP8, "op11_line_dedup": OP11}
