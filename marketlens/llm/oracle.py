"""DuckDB SQL with the same results as the queries SQL can express, written from their definitions."""

from __future__ import annotations

OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM again),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
left_over AS (
  SELECT word.r, count(gone.j) AS n_removed,
         string_agg(word.word, ' ' ORDER BY word.j) FILTER (WHERE gone.j IS NULL) AS kept
  FROM word LEFT JOIN gone ON word.r = gone.r AND word.j = gone.j GROUP BY word.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(l.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(l.kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over l ON d.r = l.r
"""

OP6 = r"""
WITH line AS (
  SELECT r, doc_id, n, line, chars FROM (
    SELECT r, doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS line, length(unnest(ls)) AS chars
    FROM (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
solid AS (SELECT * FROM line WHERE regexp_matches(line, '[^ \t-\r]')),
ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, r, n) AS ord FROM solid),
firsts AS (SELECT line, any_value(chars) AS chars, min(ord) AS ord FROM ranked GROUP BY line),
near AS (
  SELECT DISTINCT b.ord FROM firsts a JOIN firsts b
    ON a.chars BETWEEN b.chars - 1 AND b.chars + 1 AND a.ord < b.ord
   AND (left(a.line, b.chars // 2 - 1) = left(b.line, b.chars // 2 - 1) OR right(a.line, b.chars // 2 - 1) = right(b.line, b.chars // 2 - 1))
  WHERE a.chars >= 20 AND b.chars >= 20
    AND (a.line[:a.chars - 1] = b.line OR b.line[:b.chars - 1] = a.line OR EXISTS (
      SELECT 1 FROM (SELECT unnest(range(1, greatest(a.chars, b.chars) + 1)) AS i)
      WHERE (a.chars = b.chars AND left(a.line, i - 1) = left(b.line, i - 1) AND a.line[i + 1:] = b.line[i + 1:])
         OR (a.chars = b.chars + 1 AND left(a.line, i - 1) = left(b.line, i - 1) AND a.line[i + 1:] = b.line[i:])
         OR (a.chars + 1 = b.chars AND left(a.line, i - 1) = left(b.line, i - 1) AND a.line[i:] = b.line[i + 1:])))),
kept AS (SELECT ord FROM firsts WHERE ord NOT IN (SELECT ord FROM near)),
gone AS (SELECT r, n FROM ranked WHERE ord NOT IN (SELECT ord FROM kept)),
result AS (
  SELECT line.r, any_value(line.doc_id) AS doc_id, count(*) AS n_lines, count(gone.n) AS n_removed,
         coalesce(string_agg(line.line, chr(10) ORDER BY line.n) FILTER (WHERE gone.n IS NULL), '') AS kept
  FROM line LEFT JOIN gone ON line.r = gone.r AND line.n = gone.n GROUP BY line.r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM result
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

#: kind, expression, value group, least characters of it: the base rules as they are defined, then the added ones.
OP13_RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 1), ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1), ("google", "AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("stripe", "[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1)]


def _op13() -> str:
    def of(kind, name, pattern, group, least):
        p = "'" + pattern.replace("'", "''") + "'"
        return (f"SELECT r, {kind} AS kind, '{name}' AS name, {least} AS least, generate_subscripts(regexp_extract_all(text, {p}), 1) AS n,"
                f" unnest(string_split_regex(text, {p})) AS gap, unnest(regexp_extract_all(text, {p})) AS whole,"
                f" unnest(regexp_extract_all(text, {p}, {group})) AS val FROM d")

    rules = " UNION ALL ".join(of(i, *rule) for i, rule in enumerate(OP13_RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({rules}),
placed AS (
  SELECT r, kind, name, least, val, length(whole) AS long,
         CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY r, kind ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM m WHERE whole IS NOT NULL),
span AS (SELECT r, kind, stop - long AS start, name || ':' || CAST(stop - long AS VARCHAR) || ':' || CAST(stop AS VARCHAR) AS t
         FROM placed WHERE length(val) >= least)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
       count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(t, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(t, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN span ON d.r = span.r GROUP BY d.r, d.doc_id
"""


OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, other_id, score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
negative AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5
"""

OP12 = r"""
WITH piece AS (
  SELECT row_number() OVER () AS r, lang, p FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)),
split AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
gram AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM split
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM split),
f AS (SELECT lang, k, phrase, count(*) AS a FROM gram GROUP BY lang, k, phrase),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cut AS (
  SELECT lang, phrase, a, k, i, array_to_string(w[1:i], ' ') AS first, array_to_string(w[i + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS i FROM cand)),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.k, l.a AS l, r.a AS r,
         CAST((1000000::HUGEINT * cut.a * cut.a) // (l.a::HUGEINT * r.a) AS BIGINT) AS score, i
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = cut.first AND l.k = cut.i
           JOIN f r ON r.lang = cut.lang AND r.phrase = cut.rest AND r.k = cut.k - cut.i
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, i) = 1),
covered AS (
  SELECT lang, part, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS part, a FROM cand WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE k = 3) GROUP BY lang, part),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN covered c ON c.lang = s.lang AND c.part = s.phrase
  WHERE c.a IS NULL OR 100 * c.a < 50 * s.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM kept JOIN total ON total.lang = kept.lang
QUALIFY rank <= 2000
"""


ORACLE_SQL = {"op11_hard_negatives": OP11, "op12_phrase_collocations": OP12, "op13_secret_scans": _op13(), "op6_line_dedup": OP6, "op1_substring_dedup": OP1}
