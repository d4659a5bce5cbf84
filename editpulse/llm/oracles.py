"""DuckDB statements with the rows of those queries that SQL can express, from their definitions."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEXT = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

LM_SCORING = f"""
WITH spoken AS (
    SELECT doc_id, regexp_extract_all({TEXT}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), places AS (
    SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM spoken
), grams AS (
    SELECT doc_id, i, n, array_to_string(words[i - n + 1:i], ' ') AS gram, array_to_string(words[i - n + 1:i - 1], ' ') AS context
    FROM places, (SELECT unnest([1, 2, 3]) AS n) WHERE i >= n
), own AS (
    SELECT doc_id, n, gram, count(*) AS c FROM grams GROUP BY ALL
), everywhere AS (
    SELECT n, gram, sum(c) AS c FROM own GROUP BY ALL
), elsewhere AS (
    SELECT o.doc_id, o.n, o.gram, e.c - o.c AS c FROM own o JOIN everywhere e ON e.n = o.n AND e.gram = o.gram WHERE e.c > o.c
), other_words AS (
    SELECT doc_id, greatest(1, (SELECT sum(len(words)) FROM spoken) - len(words)) AS m FROM spoken
), options AS (
    SELECT g.doc_id, g.i, g.n, e.c / CASE g.n WHEN 1 THEN m ELSE x.c END AS share
    FROM grams g JOIN elsewhere e ON e.doc_id = g.doc_id AND e.n = g.n AND e.gram = g.gram
    LEFT JOIN elsewhere x ON x.doc_id = g.doc_id AND x.n = g.n - 1 AND x.gram = g.context
    JOIN other_words o ON o.doc_id = g.doc_id
), best AS (
    SELECT doc_id, i, max(n) AS n, arg_max(share, n) AS share FROM options GROUP BY ALL
), scored AS (
    SELECT p.doc_id, ln(CASE WHEN b.n IS NULL THEN pow(0.4, least(3, p.i)) / m ELSE pow(0.4, least(3, p.i) - b.n) * share END) AS score
    FROM places p LEFT JOIN best b ON b.doc_id = p.doc_id AND b.i = p.i JOIN other_words o ON o.doc_id = p.doc_id
), summed AS (
    SELECT doc_id, sum(score) AS total FROM scored GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, round(coalesce(total, 0), 4) AS log_score FROM spoken LEFT JOIN summed USING (doc_id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE spoken AS (
    SELECT doc_id, regexp_extract_all({TEXT}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(words) = 0 THEN []
        WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
    FROM spoken
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
), component AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_SPOKEN = "regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
WITH spoken AS (
    SELECT doc_id, {_SPOKEN.format(text=TEXT)} AS words FROM documents
), items AS (
    SELECT item_id, {_SPOKEN.format(text=TEXT)} AS words FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(10, len(words)) AS size,
           unnest(list_transform(range(1, len(words) - least(10, len(words)) + 2),
                                 lambda i: array_to_string(words[i:i + least(10, len(words)) - 1], ' '))) AS phrase
    FROM items WHERE len(words) > 0
), places AS (
    SELECT doc_id, size, unnest(range(1, len(words) - size + 2)) AS pos, words
    FROM spoken, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size
), found AS (
    SELECT doc_id, item_id, pos, p.size FROM places p JOIN windows q
    ON p.size = q.size AND array_to_string(words[pos:pos + p.size - 1], ' ') = phrase
), hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM spoken LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

LINE_DEDUP = f"""
WITH lines AS (
    SELECT doc_id, line, pos,
           translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '{UPPER}', '{LOWER}') AS line_key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), common AS (
    SELECT line_key, max(doc_id) AS holder FROM lines
    WHERE length(line_key) >= 20 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT doc_id, line, pos, holder IS NULL OR doc_id = holder AS stays FROM lines LEFT JOIN common USING (line_key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

WARC_REVISITS = """
WITH each AS (
    SELECT page_id, url, html, unnest(range(0, page_id % 4 + 1)) AS k FROM pages
), kinds AS (
    SELECT *, (k = 0 AND page_id % 13 = 0) OR (k > 0 AND (page_id + k) % 5 <> 0) AS revisit,
           CASE WHEN k = 0 THEN 0 WHEN (page_id + k) % 5 = 0 THEN k WHEN (page_id + k - 1) % 5 = 0 THEN k - 1 ELSE 0 END AS version
    FROM each
), captures AS (
    SELECT page_id * 4 + k AS record_id, revisit, k, page_id, html, version,
           CASE k % 3 WHEN 1 THEN url || '#k' || k WHEN 2 THEN replace(url, '.example.', '.EXAMPLE.') ELSE url END AS url,
           1700000000 + page_id * 37 % 86400 + k * 86400 * (1 + page_id % 3) AS ts,
           CASE WHEN revisit AND (page_id + k) % 7 = 0 THEN 'other' WHEN revisit AND (page_id + k) % 11 < 2 THEN NULL
                ELSE left(md5(html || version), 16) END AS tag,
           CASE WHEN revisit AND (page_id + k) % 11 = 1 THEN NULL ELSE (page_id % 28) || ' ' || version END AS modified,
           CASE WHEN NOT revisit THEN sha256(html || version) END AS payload
    FROM kinds
), split AS (
    SELECT *, regexp_replace(trim(url), '#.*$', '') AS plain FROM captures
), parts AS (
    SELECT *, lower(split_part(plain, '://', 1)) AS scheme,
           lower(split_part(split_part(split_part(plain, '://', 2), '/', 1), '?', 1)) AS host,
           regexp_extract(split_part(plain, '://', 2), '^[^/?]*([^?]*)', 1) AS path,
           array_to_string(list_sort(list_filter(string_split(regexp_extract(plain, '[?](.*)$', 1), '&'), lambda x: x <> '')), '&') AS query
    FROM split
), named AS (
    SELECT *, scheme || '://' || host || CASE path WHEN '' THEN '/' ELSE path END || CASE query WHEN '' THEN '' ELSE '?' || query END AS canonical_url FROM parts
), dated AS (
    SELECT *, last_value(CASE WHEN NOT revisit THEN record_id END IGNORE NULLS) OVER (
        PARTITION BY canonical_url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS candidate
    FROM named
), matched AS (
    SELECT a.*, r.record_id AS served, r.html AS r_html, r.payload AS r_payload,
           CASE WHEN NOT a.revisit THEN 'full' WHEN r.record_id IS NULL THEN 'no_earlier_response'
                WHEN a.tag IS NOT NULL AND r.tag IS NOT NULL THEN CASE WHEN a.tag = r.tag THEN 'resolved' ELSE 'validator_mismatch' END
                WHEN a.modified IS NOT NULL AND r.modified IS NOT NULL THEN CASE WHEN a.modified = r.modified THEN 'resolved' ELSE 'validator_mismatch' END
                ELSE 'no_validator' END AS outcome
    FROM dated a LEFT JOIN dated r ON r.record_id = a.candidate AND a.revisit
)
SELECT record_id, canonical_url, outcome, CASE outcome WHEN 'full' THEN record_id ELSE served END AS response_id,
       CASE outcome WHEN 'full' THEN payload WHEN 'resolved' THEN r_payload END AS payload_sha256,
       CASE WHEN outcome IN ('full', 'resolved') THEN
           'content-length=' || length(CASE outcome WHEN 'full' THEN html ELSE r_html END) || ';content-type=text/html;date=day ' || k || ';x-version=' || version
       END AS fields
FROM matched
"""

COLLOCATIONS = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({TEXT}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), spoken AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces
), places AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM spoken
), counts AS (
    SELECT lang, words[i:i + m - 1] AS gram, count(*) AS f FROM places, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(words) GROUP BY ALL
), chosen AS (
    SELECT lang, gram, f AS a FROM counts WHERE len(gram) > 1 AND f >= 10
), inner_grams AS (
    SELECT lang, unnest([gram[1:2], gram[2:3]]) AS gram, a FROM chosen WHERE len(gram) = 3
), open AS (
    SELECT c.* FROM chosen c LEFT JOIN (SELECT lang, gram, max(a) AS longer FROM inner_grams GROUP BY ALL) i USING (lang, gram)
    WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a
), cuts AS (
    SELECT lang, gram, a, unnest(range(1, len(gram))) AS k FROM open
), weighed AS (
    SELECT c.*, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.gram = c.gram[1:k] JOIN counts y ON y.lang = c.lang AND y.gram = c.gram[k + 1:]
), lowest AS (
    SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1
), ranked AS (
    SELECT lang, array_to_string(gram, ' ') AS phrase, a, l, r, score FROM lowest
), top AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked QUALIFY rank <= 2000
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM top JOIN (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(gram) = 1 GROUP BY lang) USING (lang)
"""

STATEMENTS: dict[str, str] = {
    "op1_lm_scoring": LM_SCORING,
    "op3_minhash_near_dedup": NEAR_DEDUP,
    "op4_warc_revisits": WARC_REVISITS,
    "op6_decontaminate": DECONTAMINATE,
    "op7_line_dedup": LINE_DEDUP,
    "op12_collocations": COLLOCATIONS,
}
