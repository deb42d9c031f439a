"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import brown_lm, decontamination, embedding_dedup, gam_quality, ngram_join, pii, ppm_langid, sentencepiece_bpe, suffix_dedup, toxicity

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_pii": pii.op3_pii,
    "op4_lm_scoring": brown_lm.op4_lm_scoring,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_language_id": ppm_langid.op7_language_id,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_quality": gam_quality.op9_quality,
    "op10_sentencepiece": sentencepiece_bpe.op10_sentencepiece,
}

_WORDS = r"w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents)"

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": """
        WITH RECURSIVE g AS (SELECT embedding::DOUBLE[] AS v, min(vec_id) AS rep, count(*) AS n FROM embeddings GROUP BY 1),
        e AS (SELECT a.rep AS x, b.rep AS y, b.n AS n FROM g a JOIN g b ON a.rep <> b.rep WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
        r AS (SELECT rep AS x, rep AS y FROM g UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
        c AS (SELECT x, min(y) AS class_id FROM r GROUP BY 1), d AS (SELECT x, sum(n) AS n FROM e GROUP BY 1)
        SELECT t.vec_id, c.class_id, (g.n - 1 + coalesce(d.n, 0))::BIGINT AS links
        FROM embeddings t JOIN g ON t.embedding::DOUBLE[] = g.v JOIN c ON c.x = g.rep LEFT JOIN d ON d.x = g.rep""",
    "op2_ngram_join": f"""
        WITH RECURSIVE {_WORDS},
        g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE t END)) AS s FROM w WHERE len(t) > 0),
        r AS (SELECT s, min(doc_id) AS rep, count(*) AS times FROM g GROUP BY s),
        e AS (SELECT rep, times, len(s) AS n, unnest(s) AS k FROM r),
        p AS (SELECT a.rep AS x, b.rep AS y, any_value(b.times) AS times, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.k = b.k AND a.rep <> b.rep AND b.n >= 0.6 * a.n AND a.n >= 0.6 * b.n GROUP BY 1, 2),
        l AS (SELECT x, y, times FROM p WHERE c / (na + nb - c) >= 0.6),
        o AS (SELECT rep AS x, rep AS y FROM r UNION SELECT o.x, l.y FROM o JOIN l ON o.y = l.x),
        c AS (SELECT x, min(y) AS class_id FROM o GROUP BY 1), d AS (SELECT x, sum(times) AS n FROM l GROUP BY 1)
        SELECT g.doc_id, c.class_id, (r.times - 1 + coalesce(d.n, 0))::BIGINT AS links FROM g JOIN r USING (s) JOIN c ON c.x = r.rep LEFT JOIN d ON d.x = r.rep
        UNION ALL SELECT doc_id, doc_id, 0 FROM w WHERE coalesce(len(t), 0) = 0""",
    "op6_suffix_dedup": f"""
        WITH {_WORDS},
        x AS (SELECT doc_id, i, md5(array_to_string(t[i : i + 49], ' ')) AS h FROM (SELECT doc_id, t, unnest(range(1, len(t) - 48)) AS i FROM w WHERE len(t) >= 50)),
        d AS (SELECT doc_id, i FROM x WHERE h IN (SELECT h FROM x GROUP BY h HAVING count(*) > 1)),
        m AS (SELECT doc_id, i, coalesce(i > lag(i) OVER o + 50, true) AS fresh FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        k AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m)
        SELECT doc_id, (min(i) - 1)::INT AS start_word, (max(i) + 49)::INT AS end_word FROM k GROUP BY doc_id, island""",
}
