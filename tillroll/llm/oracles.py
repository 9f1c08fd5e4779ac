"""DuckDB texts for the corpus queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), words AS (
  SELECT k, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d
), windows AS (
  SELECT k, p, w || ' ' || lead(w, 1) OVER s || ' ' || lead(w, 2) OVER s AS gram
  FROM words WINDOW s AS (PARTITION BY k ORDER BY p)
), again AS (
  SELECT k, p FROM (
    SELECT k, p, count(*) OVER (PARTITION BY k, gram) AS n FROM windows WHERE gram IS NOT NULL
  ) WHERE n > 1
), repeats AS (
  SELECT k, count(DISTINCT p + o) AS n_repeat_words
  FROM again, (SELECT unnest([0, 1, 2]) AS o) GROUP BY k
), m AS (
  SELECT doc_id, len(ws) AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(lines, lambda x: regexp_matches(x, '{WORD}')))
           - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{WORD}'))))
           AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_distinct(ws)) AS n_distinct_words,
         length(regexp_replace(t, '\P{{L}}', '', 'g')) AS n_letters,
         length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_upper,
         length(t) - length(replace(t, '!', '')) AS n_loud
  FROM d LEFT JOIN repeats USING (k)
), f AS (
  SELECT *,
    (n_words < 50)::INT
    + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (100 * n_symbols > 10 * n_words)::INT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::INT
    + 16 * (word_chars < 2 * n_words)::INT
    + 32 * (word_chars > 16 * n_words)::INT
    + 64 * (100 * n_upper > 40 * n_letters)::INT
    + 128 * (100 * n_loud > 20 * n_words)::INT
    + 256 * (2 * n_letters < word_chars)::INT
    + 512 * (n_distinct_words * n_distinct_words < 4 * n_words)::INT AS failed_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_rules % 4 <> 0 AS base_failed, failed_rules = 0 AS kept,
       failed_rules::BIGINT AS failed_rules
FROM f
"""


OP3 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages
), r AS (
  SELECT page_id, octet_length(encode(h)) AS payload_bytes,
         list_reduce(
           list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + ((('0x' || substr(s, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)),
           lambda a, b: a || b) AS payload_digest,
         row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS n,
         max(page_id) OVER (PARTITION BY h) AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN first_id END AS refers_to
FROM r
"""


TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ws
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ws
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n,
         array_to_string(ws[s + 1 : s + least(10, len(ws))], ' ') AS phrase
  FROM (SELECT *, unnest(range(len(ws) - least(10, len(ws)) + 1)) AS s FROM b WHERE len(ws) > 0)
), doc_windows AS (
  SELECT k, n, s, array_to_string(ws[s + 1 : s + n], ' ') AS phrase
  FROM (SELECT k, ws, n, unnest(range(greatest(len(ws) - n + 1, 0))) AS s
        FROM d, (SELECT DISTINCT n FROM item_windows))
), hits AS (
  SELECT k, item_id, s, n FROM doc_windows JOIN item_windows USING (n, phrase)
), covered AS (
  SELECT k, count(DISTINCT p) AS n_hit
  FROM (SELECT k, unnest(range(s, s + n)) AS p FROM hits) GROUP BY k
), found AS (
  SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT k, item_id FROM hits) GROUP BY k
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN found USING (k)
"""


OP10 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT k, array_to_string(ws[i + 1 : i + least(5, len(ws))], ' ') AS g
  FROM (SELECT k, ws, unnest(range(len(ws) - least(5, len(ws)) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT k, count(*) AS n FROM s GROUP BY k
), links AS (
  SELECT a.k AS x, b.k AS y
  FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k
  GROUP BY a.k, b.k
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE n.k = a.k) + (SELECT n FROM n WHERE n.k = b.k) - count(*))
), reach AS (
  SELECT k AS x, k AS y FROM d
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM d LEFT JOIN n USING (k)
JOIN (SELECT x AS k, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.k = reach.y GROUP BY x) r USING (k)
"""


ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS ts
  FROM documents
), b AS (
  SELECT row_number() OVER () AS i, item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS ts
  FROM benchmark
), totals AS (
  SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0
), q AS (
  SELECT i, t, count(*) AS times FROM (SELECT i, unnest(ts) AS t FROM b) GROUP BY i, t
), p AS (
  SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(ts) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY k, t
), w AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM p, totals GROUP BY t, n_docs
), scored AS (
  SELECT q.i, d.doc_id, d.k,
         sum(times * w * ((1000000000 * tf) // (1000 * tf
           + 12 * (100 - 25 + (25 * len(d.ts) * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN p USING (t) JOIN d ON d.k = p.k, totals
  GROUP BY q.i, d.k, d.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, k) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked JOIN b USING (i) WHERE rank <= 20
"""

PIECE, BLANK_WORD = r"[^.,;:!?\x0A-\x0D]+", r"[^\x20\x09]+"

OP13 = rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS k, lang, regexp_extract_all(piece, '{BLANK_WORD}') AS ws
  FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
             translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PIECE}')) AS piece
    FROM documents
  )
), totals AS (
  SELECT lang, sum(len(ws))::HUGEINT AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, size, ws[s + 1 : s + size] AS words
  FROM (SELECT lang, ws, size, unnest(range(len(ws) - size + 1)) AS s
        FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(ws) >= size)
), f AS (
  SELECT lang, size, words, count(*)::HUGEINT AS f FROM grams
  GROUP BY lang, size, words HAVING count(*) >= 100
), inside AS (
  SELECT lang, words[s + 1 : s + m] AS words, max(f) AS longer
  FROM (SELECT lang, words, size, f, m, unnest(range(size - m + 1)) AS s
        FROM f, (SELECT unnest([2, 3, 4]) AS m) WHERE m < size)
  GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.words, c.f AS a, k, x.f AS l, y.f AS r, n, (1000 * c.f * n) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
  JOIN f x ON x.lang = c.lang AND x.words = c.words[1 : k]
  JOIN f y ON y.lang = c.lang AND y.words = c.words[k + 1 : c.size]
  JOIN totals t ON t.lang = c.lang
  LEFT JOIN inside i ON i.lang = c.lang AND i.words = c.words
  WHERE coalesce(100 * longer < 100 * c.f, true)
), best AS (
  SELECT * FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), ranked AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC,
                            encode(array_to_string(words, ' '))) AS rank
  FROM best
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


def oracle_sql():
    return {
        "op3_warc": OP3,
        "op4_quality_rules": OP4,
        "op7_decontamination": OP7,
        "op10_shingle_join": OP10,
        "op12_ranked_search": OP12,
        "op13_collocations": OP13,
    }
