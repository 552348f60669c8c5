"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from . import license_scan, near_dup, vector_codes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def line_dedup_rows(source: str) -> str:
    """Kept text and line counts of a table with doc_id and text."""
    return f"""
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM {source}),
keyed AS (
  SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS k FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, i, line, r.k IS NOT NULL AND doc_id <> last_doc AS gone
  FROM keyed LEFT JOIN repeated r USING (k)),
deduped AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM judged GROUP BY doc_id)"""


def near_dup_sql() -> str:
    """Links by shared shingles, components by reachability."""
    width, percent = near_dup.WIDTH, near_dup.PERCENT
    return f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {width - 1}, 1))) AS i
    FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= {percent} * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON a = d.doc_id"""


def license_sql() -> str:
    """Votes of word pairs by template and diagonal, merged over neighbouring diagonals."""
    rows = []
    base = license_scan.BASE_PHRASES
    for number, (phrase, label) in enumerate([*base, *license_scan.NOTICES]):
        w = phrase.split()
        for at, (x, y) in enumerate(zip(w, w[1:])):
            is_base = str(number < len(base)).lower()
            rows.append(f"({number}, '{label}', {is_base}, {len(w) - 1}, {at}, '{x}', '{y}')")
    return f"""
WITH template(t, label, is_base, n_pairs, pos, x, y) AS (VALUES {', '.join(rows)}),
worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
pairs AS (
  SELECT doc_id, i - 1 AS p, w[i] AS x, w[i + 1] AS y
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM worded)),
met AS (SELECT doc_id, t, label, is_base, n_pairs, pos, p - pos AS d FROM pairs JOIN template USING (x, y)),
diagonals AS (SELECT doc_id, t, d, any_value(is_base) AS is_base FROM met GROUP BY doc_id, t, d),
marked AS (
  SELECT *, CASE WHEN is_base OR coalesce(d - lag(d) OVER w > {license_scan.NEIGHBOURS}, true)
    THEN 1 ELSE 0 END AS starts
  FROM diagonals WINDOW w AS (PARTITION BY doc_id, t ORDER BY d)),
grouped AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, t ORDER BY d) AS g FROM marked),
spans AS (
  SELECT m.doc_id, m.t, g, any_value(label) AS label, any_value(m.is_base) AS is_base,
    count(DISTINCT pos) / any_value(n_pairs) AS cover, min(d) AS start
  FROM met m JOIN grouped USING (doc_id, t, d) GROUP BY m.doc_id, m.t, g),
judged AS (
  SELECT *, cover >= CASE WHEN is_base THEN 1.0 ELSE {license_scan.MIN_COVER} END AS found FROM spans)
SELECT w.doc_id, any_value(len(w))::BIGINT AS n_words,
  count(*) FILTER (found AND is_base) AS n_base,
  min(start) FILTER (found AND is_base) AS first_word,
  max(start) FILTER (found AND is_base) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (found AND is_base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (found)), ','), '') AS labels,
  coalesce(round(max(cover), 6), 0.0) AS score
FROM worded w LEFT JOIN judged USING (doc_id) GROUP BY w.doc_id"""


def vector_codes_sql() -> str:
    """The rounds one after the other, a component per row. With distances and indexes as one whole
    number, the least of them is the nearest entry, the lowest on ties."""
    n_parts, n_entries = vector_codes.N_PARTS, vector_codes.N_ENTRIES
    text = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, embedding,
    len(embedding) // {n_parts} AS d
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT r, (i - 1) // d AS p, (i - 1) % d AS c,
    CAST(floor({vector_codes.SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM kept, unnest(range(1, len(embedding) + 1)) AS t(i)),
book_0 AS MATERIALIZED (SELECT p, r - 1 AS e, c, x FROM cells WHERE r <= {n_entries})"""
    near = """
near_{k} AS MATERIALIZED (
  SELECT r, p, min(far * {n} + e) AS best FROM (
    SELECT a.r, a.p, b.e, sum((a.x - b.x) * (a.x - b.x)) AS far
    FROM cells a JOIN book_{k} b USING (p, c) GROUP BY ALL) GROUP BY ALL)"""
    for k in range(vector_codes.N_ROUNDS):
        text += "," + near.format(k=k, n=n_entries) + f""",
means_{k} AS (
  SELECT a.p, n.best % {n_entries} AS e, a.c, CAST(floor(sum(a.x) / count(*)) AS BIGINT) AS x
  FROM cells a JOIN near_{k} n USING (r, p) GROUP BY ALL),
book_{k + 1} AS MATERIALIZED (
  SELECT p, e, c, coalesce(m.x, b.x) AS x FROM book_{k} b LEFT JOIN means_{k} m USING (p, e, c))"""
    last = vector_codes.N_ROUNDS
    return text + "," + near.format(k=last, n=n_entries) + f""",
coded AS (
  SELECT r, string_agg(printf('%02x', CAST(best % {n_entries} AS INTEGER)), '' ORDER BY p) AS code,
    CAST(sum(best // {n_entries}) AS BIGINT) AS error
  FROM near_{last} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, c)) FROM book_{last}) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": f"""
WITH {line_dedup_rows('documents')}
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM deduped""",
        "op2_near_dup": near_dup_sql(),
        "op9_license_scan": license_sql(),
        "op12_vector_codes": vector_codes_sql(),
    }
