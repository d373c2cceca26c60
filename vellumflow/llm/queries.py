"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vellumflow.llm.ann import op5_nearest_neighbours
from vellumflow.llm.chat_format import op9_chat_format
from vellumflow.llm.collocations import op13_phrase_collocations
from vellumflow.llm.hard_negatives import op12_hard_negatives
from vellumflow.llm.license_scan import op1_license_scan
from vellumflow.llm.line_dedup import op8_line_dedup
from vellumflow.llm.near_dedup import op10_minhash_near_dedup
from vellumflow.llm.packing import op6_best_fit_packing
from vellumflow.llm.pii import op11_personal_data
from vellumflow.llm.quality import op3_quality_rules
from vellumflow.llm.secret_scan import op2_secret_scan
from vellumflow.llm.sentencepieces import op7_sentencepiece
from vellumflow.llm.substring_dedup import op4_substring_dedup

QUERIES: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_secret_scan,
        op3_quality_rules,
        op4_substring_dedup,
        op5_nearest_neighbours,
        op6_best_fit_packing,
        op7_sentencepiece,
        op8_line_dedup,
        op9_chat_format,
        op10_minhash_near_dedup,
        op11_personal_data,
        op12_hard_negatives,
        op13_phrase_collocations,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

ORACLE: dict[str, str] = {
    "op4_substring_dedup": r"""
        WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        places AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM words WHERE len(w) >= 35),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t FROM places),
        rep AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
        hit AS (SELECT doc_id, i FROM win SEMI JOIN rep USING (t)),
        gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, range(35) r(j)),
        word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM words),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM words LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op8_line_dedup": f"""
        WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        line AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM doc),
        keyed AS (SELECT *, {_LOWER.format(f"trim(x, {_SPACE})")} AS k FROM line),
        held AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT doc_id, i, x, held.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN held USING (k))
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op9_chat_format": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
        side AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
        piece AS (
            SELECT t.conv_id, speaker, turn, role, text, role = speaker AS own,
                '<|' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END || '|>' || chr(10) AS head,
                text || '<|end|>' || chr(10) AS body,
                row_number() OVER (PARTITION BY t.conv_id, speaker ORDER BY turn NULLS FIRST, role, text) AS i
            FROM t JOIN side ON t.conv_id IS NOT DISTINCT FROM side.conv_id
        ),
        placed AS (
            SELECT *, (i - 1) // 1024 AS part, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop FROM piece
        )
        SELECT conv_id, speaker, part, min(stop - length(body) - length(head))::BIGINT AS start, count(*)::BIGINT AS n_turns, (count(*) FILTER (WHERE own))::BIGINT AS n_own,
            string_agg(head || body, '' ORDER BY i) AS text,
            coalesce(string_agg((stop - length(body))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY i) FILTER (WHERE own), '') AS mask
        FROM placed GROUP BY conv_id, speaker, part
    """,
    "op10_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        shingle AS (
            SELECT DISTINCT doc_id, s FROM (
                SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM words WHERE len(w) >= 4)
                UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 3
            )
        ),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT x, y FROM common JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
        pair AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, pair.y FROM reach JOIN pair ON pair.x = reach.r)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
        FROM (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) d LEFT JOIN size USING (doc_id)
    """,
    "op12_hard_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s
            FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ),
        positive AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.s DESC, n.vec_id)::INTEGER AS rank,
            n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score
        FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
        QUALIFY rank <= 10
    """,
    "op13_phrase_collocations": rf"""
        WITH piece AS (
            SELECT row_number() OVER () AS i, lang, regexp_extract_all(x, '[^ \t]+') AS w FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\n\x0B\x0C\r]')) AS x FROM documents
            )
        ),
        place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece),
        f AS (
            SELECT lang, m, p, count(*) AS f FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM place, range(1, 6) s(m) WHERE i + m - 1 <= len(w))
            GROUP BY lang, m, p HAVING count(*) >= 100
        ),
        total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
        cand AS (SELECT *, string_split(p, ' ') AS w FROM f WHERE m >= 2),
        inner_part AS (
            SELECT lang, array_to_string(w[1:m - 1], ' ') AS p, f FROM cand WHERE m > 2
            UNION SELECT lang, array_to_string(w[2:m], ' '), f FROM cand WHERE m > 2
        ),
        kept AS (SELECT * FROM cand ANTI JOIN inner_part USING (lang, p, f)),
        cut AS (
            SELECT kept.lang, kept.p, kept.f AS a, n, k, l.f AS l, r.f AS r, (1000::HUGEINT * kept.f * n) // (l.f::HUGEINT * r.f) AS score
            FROM kept JOIN total USING (lang), range(1, 5) s(k)
            JOIN f l ON l.lang = kept.lang AND l.m = k AND l.p = array_to_string(kept.w[1:k], ' ')
            JOIN f r ON r.lang = kept.lang AND r.m = kept.m - k AND r.p = array_to_string(kept.w[k + 1:], ' ')
            WHERE k < kept.m
        ),
        best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM best)
        SELECT lang, rank, p AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
    """,
}
