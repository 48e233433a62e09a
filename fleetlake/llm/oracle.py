"""DuckDB twins of the queries that SQL can express, written from their definitions alone."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> str:
    """(doc_id, i, w): the words between ASCII white space, numbered from 1."""
    return f"""(SELECT doc_id, i, list[i] AS w FROM (SELECT doc_id, list, unnest(range(1, len(list) + 1)) AS i
    FROM (SELECT doc_id, [x FOR x IN regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS list FROM documents)))"""


REPEATS = f"""WITH words AS MATERIALIZED {words("coalesce(text, '')")},
  windows AS MATERIALIZED (SELECT doc_id, i, w, {" || ' ' || ".join(f"lead(w, {j}) OVER d" for j in range(13))} AS run FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
  firsts AS (SELECT run, min(doc_id) AS first FROM windows WHERE run IS NOT NULL GROUP BY run),
  covered AS (SELECT doc_id, i, w, coalesce(bool_or(first < doc_id) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone
    FROM windows LEFT JOIN firsts USING (run))
  SELECT d.doc_id, count(w) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM documents d LEFT JOIN covered c ON c.doc_id = d.doc_id GROUP BY d.doc_id"""

NEAR = f"""WITH RECURSIVE words AS MATERIALIZED {words(LOWER)},
  shingles AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY doc_id) = 1 THEN w ELSE w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) END AS s FROM words) WHERE s IS NOT NULL),
  sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  links AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p
    JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b WHERE 100 * shared >= 80 * (m.n + n.n - shared)),
  reached AS (SELECT a AS doc_id, a AS other FROM links UNION SELECT b, b FROM links
    UNION SELECT r.doc_id, e.other FROM reached r JOIN (SELECT a AS doc_id, b AS other FROM links UNION ALL SELECT b, a FROM links) e ON e.doc_id = r.other)
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c.least, d.doc_id) AS component_id, coalesce(c.least, d.doc_id) = d.doc_id AS kept
  FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id) c ON c.doc_id = d.doc_id"""

TERMS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
RANKED = f"""WITH docs AS MATERIALIZED (SELECT doc_id, {TERMS} AS list FROM documents), sized AS MATERIALIZED (SELECT doc_id, len(list) AS n FROM docs WHERE len(list) > 0),
  totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sized),
  asked AS MATERIALIZED (SELECT DISTINCT item_id, unnest({TERMS}) AS t FROM benchmark),
  held AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(list) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t),
  weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM held GROUP BY t), totals),
  gains AS MATERIALIZED (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS gain
    FROM held JOIN weights USING (t) JOIN sized USING (doc_id), totals),
  scored AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM asked JOIN gains USING (t) GROUP BY item_id, doc_id),
  placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
  SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50"""
