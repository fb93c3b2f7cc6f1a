"""DuckDB SQL for the contract queries that SQL can express."""

from __future__ import annotations

#: Words of a text, null and empty: none.  (RE2 classes, ASCII white space.)
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
     win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS k
             FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
     hit AS (SELECT r, i FROM win SEMI JOIN (SELECT r, k FROM win GROUP BY r, k HAVING count(*) > 1) USING (r, k)),
     rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM hit) GROUP BY r),
     l AS (SELECT r, x, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS y
           FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
     j AS (SELECT r, x, y, len(regexp_extract_all(y, '[^\x20\x09-\x0D]+')) AS n,
                  length(regexp_replace(y, '[^#*$%&|<>]', '', 'g')) AS sym,
                  length(regexp_replace(y, '[^|>»·•]', '', 'g')) AS nav,
                  length(regexp_replace(y, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM l),
     b AS (SELECT *, (n >= 12 AND NOT regexp_matches(y, '[.!?:;"''…”’»)\]}}]$')) OR (n >= 3 AND nav * 5 >= n)
                     OR (sym >= 2 AND sym * 4 >= n) OR (n >= 5 AND upper(y) = y AND lower(y) <> y) AS bad FROM j),
     s AS (SELECT r, count(*) - count(DISTINCT x) AS dups, sum(chars) AS chars, coalesce(sum(chars) FILTER (WHERE bad), 0) AS gone FROM b GROUP BY r),
     o AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(s.chars, 0) AS BIGINT) AS word_chars,
                  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                  CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
                  CASE WHEN s.chars > 0 THEN gone / s.chars ELSE 0 END AS lost
           FROM d LEFT JOIN rep USING (r) LEFT JOIN s USING (r)),
     f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 AS kept FROM f
"""

OP6 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
     win AS (SELECT r, i, hash(list_slice(ws, i, i + 34)) AS a, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS b
             FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
     rep AS (SELECT b FROM win GROUP BY b HAVING count(*) > 1),
     hit AS (SELECT r, i FROM win SEMI JOIN rep USING (b)),
     gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM hit),
     per AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
     kept AS (SELECT w.r, string_agg(ws[p], ' ' ORDER BY p) AS t
              FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) w
              ANTI JOIN gone g ON w.r = g.r AND w.p = g.p GROUP BY w.r)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""


OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT r, doc_id, text, i, ls[i] AS line,
                  translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
     c AS (SELECT k, count(DISTINCT (doc_id, text)) AS n, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING n >= 5)
SELECT l.doc_id, count(*) AS n_lines,
       CAST(count(*) FILTER (WHERE c.k IS NOT NULL AND l.doc_id IS DISTINCT FROM keeper) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL OR l.doc_id IS NOT DISTINCT FROM keeper), '')) AS kept_sha256
FROM l LEFT JOIN c USING (k) GROUP BY l.r, l.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1,
        "op6_substring_dedup": OP6,
        "op8_line_dedup": OP8,
    }
