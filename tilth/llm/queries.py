"""The training-data queries by name, and SQL where it can say the same."""

from __future__ import annotations

from . import chat, lm, mixing, near_dup, packing, quality, repeats, secrets, spotsigs, wavelet

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_packing,
        secrets.op2_secrets,
        mixing.op3_mixing,
        lm.op4_lm_score,
        quality.op5_quality,
        wavelet.op6_wavelet_files,
        chat.op7_chat,
        near_dup.op8_near_dup,
        repeats.op9_repeats,
        spotsigs.op10_spotsigs,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_quality": r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, hash(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
q AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g) WHERE c > 1),
v AS (SELECT doc_id, CAST(sum(least(5, coalesce(lead_i - i, 5))) AS BIGINT) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM q) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^ \t\n\x0b\x0c\r]') GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
coalesce(v.n, 0) AS n_repeat_words, CAST(length(regexp_replace(t, '\P{Lu}', '', 'g')) AS BIGINT) AS n_upper, coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_dup_lines, 0) AS n_dup_lines FROM w LEFT JOIN v ON v.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id),
b AS (SELECT *, CAST(CAST(n_words < 10 AS INT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS INT) + 4 * CAST(100 * n_symbols > 40 * n_words AS INT) + 8 * CAST(n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines AS INT)
+ 16 * CAST(100 * n_upper > 60 * word_chars AS INT) + 32 * CAST(word_chars < 2 * n_words OR word_chars > 20 * n_words AS INT) AS INT) AS failed FROM m)
SELECT *, failed = 0 AS kept, failed & 3 <> 0 AS base_failed FROM b""",
    "op8_near_dup": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS sh FROM w),
n AS MATERIALIZED (SELECT w.doc_id, count(s.sh) AS n_shingles FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS kept FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n_shingles""",
}
