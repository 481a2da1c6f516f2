"""DuckDB SQL for the corpus queries that SQL can express."""

SQL: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL["op3_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
tri AS (SELECT doc_id, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM w
        WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
seen AS (SELECT doc_id, i, CASE WHEN c IS NULL THEN 0
              ELSE (count(*) OVER (PARTITION BY doc_id, a, b, c) > 1)::INT END AS hit FROM tri),
cover AS (SELECT doc_id, max(hit) OVER (PARTITION BY doc_id ORDER BY i
              ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM seen),
rep AS (SELECT doc_id, sum(covered) AS n FROM cover GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM ln
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dl.n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             coalesce(dl.n_lines, 0) AS n_lines,
             length(t) - length(replace(t, '!', '')) AS n_shouts
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dl USING (doc_id)),
b AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
             + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_dup_lines > 3 * n_lines)::INT
             + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
             + 64 * (10 * n_shouts > 3 * n_words)::INT AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines::BIGINT AS n_lines,
       n_shouts::BIGINT AS n_shouts, fail_bits::BIGINT AS fail_bits
FROM b
"""

SQL["op11_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

SQL["op13_filter_audit"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > low)::INT AS bits,
             coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM d JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, bits),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
s AS (SELECT f AS path, bit AS used, 0 AS before, f, bit, 1 AS step FROM f
      UNION ALL
      SELECT path || f.f, used + f.bit, used, f.f, f.bit, step + 1 FROM s JOIN f ON used & f.bit = 0),
o AS (SELECT path AS filter_order FROM s WHERE step = 5),
r AS (SELECT part, path, step, f,
             sum(CASE WHEN bits & used = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN bits & before = 0 AND bits & bit > 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN bits & before > 0 AND bits & bit > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN bits & before = 0 AND bits & bit > 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN bits & before = 0 AND bits & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c CROSS JOIN s GROUP BY part, path, step, f),
steps AS (SELECT part, filter_order, r.step, f AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost
          FROM o JOIN r ON starts_with(filter_order, path))
SELECT part, filter_order, step::INT AS step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM steps
"""
