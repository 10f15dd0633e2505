"""The fixture views as DuckDB common table expressions, for the SQL that registered queries are held against."""

from ..operators.taxonomy import QUESTION_TYPES, rows

_TYPES = ", ".join(f"'{t}'" for t in QUESTION_TYPES)
_DIM = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in rows())

VIEWS = {
    "e": "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings",
    "pt0": "SELECT vec_id, 'd' || label AS doc_id, vec_id % 5 AS page_idx, row_number() OVER (PARTITION BY label, vec_id % 5 ORDER BY vec_id) - 1 AS token_idx, count(*) OVER (PARTITION BY label, vec_id % 5) AS n, v FROM e WHERE vec_id >= 48",
    "pt1": "SELECT *, floor(sqrt(n))::BIGINT AS side FROM pt0",
    "pt": "SELECT *, CASE WHEN token_idx < side * side THEN token_idx END AS patch_idx, CASE WHEN token_idx < side * side THEN ['visual', 'non_visual', 'unknown'][(vec_id + page_idx) % 3 + 1] ELSE 'unknown' END AS pclass FROM pt1",
    "qt": "SELECT vec_id // 8 AS qid, vec_id % 8 AS q_idx, CASE vec_id % 8 WHEN 0 THEN '<bos>' WHEN 1 THEN 'Question' WHEN 2 THEN ':' WHEN 7 THEN '<pad>' ELSE '▁tok' || vec_id END AS raw_token, CASE WHEN vec_id % 8 IN (3, 4) THEN 'visual' WHEN vec_id % 8 IN (5, 6) THEN 'non_visual' ELSE 'unknown' END AS qclass, vec_id % 8 <> 7 AS active, v, label FROM e WHERE vec_id < 48",
    "gold": "SELECT DISTINCT qid, 'd' || label AS doc_id FROM qt WHERE q_idx IN (3, 4)",
    "sc": "SELECT qid, q_idx, qclass, active, raw_token, doc_id, page_idx, token_idx, patch_idx, side, n, pclass, list_dot_product(pt.v, qt.v) AS s FROM pt, qt",
    "mx": "SELECT qid, q_idx, doc_id, page_idx, max(s) AS m FROM sc WHERE active GROUP BY ALL",
    "ex": "SELECT qid, doc_id, page_idx, sum(m) AS score FROM mx GROUP BY ALL",
    "run_e": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, page_idx) AS rank FROM ex",
    "kn": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, q_idx ORDER BY s DESC, doc_id, page_idx, token_idx) AS near FROM sc) WHERE near <= 10",
    "pa": "SELECT qid, doc_id, page_idx, sum(m) AS score FROM (SELECT qid, q_idx, doc_id, page_idx, max(s) AS m FROM kn WHERE active GROUP BY ALL) GROUP BY ALL",
    "run_b": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, page_idx) AS rank FROM pa",
    "doc_e": "SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY r) AS doc_rank FROM (SELECT qid, doc_id, min(rank) AS r FROM run_e GROUP BY ALL)",
    "doc_b": "SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY r) AS doc_rank FROM (SELECT qid, doc_id, min(rank) AS r FROM run_b GROUP BY ALL)",
    "fg_e": "SELECT qid, (SELECT min(doc_rank) FROM doc_e d JOIN gold g USING (qid, doc_id) WHERE d.qid = q.qid) AS first_doc, (SELECT min(rank) FROM run_e d JOIN gold g USING (qid, doc_id) WHERE d.qid = q.qid) AS first_page FROM (SELECT DISTINCT qid FROM gold) q",
    "fg_b": "SELECT qid, (SELECT min(doc_rank) FROM doc_b d JOIN gold g USING (qid, doc_id) WHERE d.qid = q.qid) AS first_doc, (SELECT min(rank) FROM run_b d JOIN gold g USING (qid, doc_id) WHERE d.qid = q.qid) AS first_page FROM (SELECT DISTINCT qid FROM gold) q",
    # Pruning.
    "co": "SELECT qid, doc_id, page_idx, token_idx, patch_idx, side, n, pclass, max(s) AS coarse FROM sc WHERE active GROUP BY ALL",
    "cr": "SELECT *, row_number() OVER (PARTITION BY qid, doc_id, page_idx ORDER BY coarse DESC, token_idx) AS place FROM co",
    "vq": "SELECT qid, doc_id, page_idx, token_idx, max(s) AS vq FROM sc WHERE qclass = 'visual' GROUP BY ALL",
    "sel": "SELECT * FROM cr WHERE place <= 4",
    "ap": "SELECT qid, doc_id, page_idx, sum(m) AS score FROM (SELECT qid, q_idx, doc_id, page_idx, max(s) AS m FROM sc JOIN sel USING (qid, doc_id, page_idx, token_idx) WHERE active GROUP BY ALL) GROUP BY ALL",
    "run_p": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, page_idx) AS rank FROM ap",
    "doc_p": "SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY r) AS doc_rank FROM (SELECT qid, doc_id, min(rank) AS r FROM run_p GROUP BY ALL)",
    "fg_p": "SELECT qid, (SELECT min(doc_rank) FROM doc_p d JOIN gold g USING (qid, doc_id) WHERE d.qid = q.qid) AS first_doc FROM (SELECT DISTINCT qid FROM gold) q",
    "dg0": "SELECT qid, doc_id, page_idx, q_idx, max(s) AS f, max(s) FILTER (place <= 4) AS p, greatest(-min(s), 0) AS shift, arg_max(place, (s, -token_idx)) <= 4 AS kept, count(*) AS tokens, count(*) FILTER (place <= 4) AS selected FROM sc JOIN (SELECT qid, doc_id, page_idx, token_idx, place FROM cr) USING (qid, doc_id, page_idx, token_idx) WHERE active GROUP BY ALL",
    "dg": "SELECT qid, doc_id, page_idx, max(tokens) AS full_tokens, max(selected) AS selected_tokens, sum(f) AS full_score, sum(p) AS pruned_score, sum(f - p) AS loss, CASE WHEN sum(f + shift) > 1e-8 THEN sum(p + shift) / sum(f + shift) END AS preservation, count(*) FILTER (kept) AS retained, count(*) FILTER (kept) / count(*) AS retention FROM dg0 GROUP BY ALL",
    "dgq": "SELECT qid, count(*) AS pages, avg(loss) AS mean_loss, median(loss) AS median_loss, avg(preservation) AS mean_preservation, avg(retention) AS mean_retention, avg(selected_tokens) AS mean_selected FROM dg GROUP BY qid",
    # Channels.
    "lv": "SELECT * FROM sc WHERE active",
    "ch0": "SELECT qid, doc_id, page_idx, q_idx, qclass, max(s) AS base, max(s) FILTER (pclass = 'visual' AND qclass = 'visual') AS vis, max(s) FILTER (qclass = 'visual') AS fall, max(s) FILTER (pclass = 'non_visual' AND qclass = 'non_visual') AS nonv, arg_max(pclass, (s, -token_idx)) AS top, count(*) FILTER (pclass = 'visual') AS vp, count(*) FILTER (pclass = 'non_visual') AS np, max(side) AS side FROM lv GROUP BY ALL",
    "ch1": "SELECT qid, doc_id, page_idx, sum(base) AS base, greatest(coalesce(sum(vis), 0), 0) AS visual, coalesce(sum(fall), 0) AS fall, coalesce(sum(nonv), 0) AS non_visual, count(*) FILTER (qclass = 'visual') AS nv, count(*) FILTER (qclass = 'non_visual') AS nn, count(*) AS na, max(vp) AS vp, max(np) AS np, max(side) AS side, count(*) FILTER (qclass = 'visual' AND top = 'visual') AS va, count(*) FILTER (qclass = 'non_visual' AND top = 'non_visual') AS nva FROM ch0 GROUP BY ALL",
    "an": "SELECT qid, doc_id, page_idx, p AS anchor, sum(m) AS anchor_score FROM (SELECT qid, doc_id, page_idx, q_idx, arg_max(patch_idx, (s, -token_idx)) AS p, max(s) AS m FROM lv WHERE qclass = 'visual' AND pclass = 'visual' GROUP BY ALL) GROUP BY ALL",
    "nr": "SELECT lv.*, anchor, anchor_score FROM lv JOIN an USING (qid, doc_id, page_idx) WHERE patch_idx IS NOT NULL AND abs(patch_idx // side - anchor // side) <= 1 AND abs(patch_idx % side - anchor % side) <= 1",
    "gr": "SELECT qid, doc_id, page_idx, sum(m) AS context, coalesce(sum(g), 0) AS grounded FROM (SELECT qid, doc_id, page_idx, q_idx, max(s) AS m, max(s) FILTER (pclass = 'non_visual' AND qclass = 'non_visual') AS g FROM nr GROUP BY ALL) GROUP BY ALL",
    "tk": "SELECT qid, doc_id, page_idx, count(*) AS context_patches, count(*) FILTER (pclass = 'non_visual') AS grounded_patches FROM (SELECT DISTINCT qid, doc_id, page_idx, token_idx, pclass FROM nr) GROUP BY ALL",
    "sp": "SELECT qid, doc_id, page_idx, count(*) AS anchor_patches, list_sort(list(anchor_score), 'DESC') AS tops, (max(anchor // side) - min(anchor // side) + 1) * (max(anchor % side) - min(anchor % side) + 1) AS bbox FROM an JOIN ch1 USING (qid, doc_id, page_idx) GROUP BY ALL",
    "ma": "SELECT qid, doc_id, page_idx, sum(CASE WHEN anchor_score > 0 AND c > 0 THEN anchor_score * c / na END) AS multi FROM (SELECT qid, doc_id, page_idx, anchor, anchor_score, sum(m) AS c FROM (SELECT qid, doc_id, page_idx, anchor, anchor_score, q_idx, max(s) AS m FROM nr GROUP BY ALL) GROUP BY ALL) JOIN ch1 USING (qid, doc_id, page_idx) GROUP BY ALL",
    "ft0": "SELECT ch1.*, coalesce(gr.grounded, 0) AS grounded, coalesce(gr.context, 0) AS context, coalesce(multi, 0) AS multi_anchor, coalesce(context_patches, 0) AS context_patches, coalesce(grounded_patches, 0) AS grounded_patches, coalesce(anchor_patches, 0) AS anchor_patches, tops, bbox, CASE WHEN nv > 0 THEN visual / nv ELSE 0 END AS visual_avg, CASE WHEN nn > 0 THEN non_visual / nn ELSE 0 END AS non_visual_avg, CASE WHEN nn > 0 THEN coalesce(gr.grounded, 0) / nn ELSE 0 END AS grounded_avg, CASE WHEN na > 0 THEN coalesce(gr.context, 0) / na ELSE 0 END AS context_avg FROM ch1 LEFT JOIN gr USING (qid, doc_id, page_idx) LEFT JOIN tk USING (qid, doc_id, page_idx) LEFT JOIN sp USING (qid, doc_id, page_idx) LEFT JOIN ma USING (qid, doc_id, page_idx)",
    "ft": "SELECT *, CASE WHEN nv > 0 AND nn > 0 THEN least(visual_avg, non_visual_avg) ELSE 0 END AS balance, CASE WHEN visual > 0 AND context_avg > 0 THEN visual * context_avg ELSE 0 END AS confirmed, CASE WHEN nv > 0 THEN anchor_patches / nv ELSE 0 END AS anchor_coverage, coalesce(tops[1], 0) - coalesce(tops[2], 0) AS anchor_gap, coalesce(bbox / greatest(side * side, 1), 0) AS anchor_bbox, CASE WHEN nv > 0 THEN va / nv ELSE 0 END AS visual_alignment, CASE WHEN nn > 0 THEN nva / nn ELSE 0 END AS non_visual_alignment FROM ft0",
    "fu": "SELECT *, base + visual + 8 * balance AS fused, row_number() OVER (PARTITION BY qid ORDER BY base + visual + 8 * balance DESC, base DESC, visual DESC, non_visual DESC, doc_id, page_idx) AS rank FROM ft",
    "st": "SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY max(base) DESC, doc_id) AS stage1_rank FROM ft GROUP BY qid, doc_id",
    # Questions.
    "qs": f"SELECT item_id AS qid, text AS question, [{_TYPES}][item_id % {len(QUESTION_TYPES)} + 1] AS qtype FROM benchmark",
    "dim": f"SELECT * FROM (VALUES {_DIM}) t(qtype, hop, first_modality, second_modality)",
    "rf": "SELECT qid, count(*) FILTER (qclass = 'visual') AS visual_tokens, count(*) FILTER (qclass = 'non_visual') AS non_visual_tokens, count(*) FILTER (qclass = 'unknown') AS unknown_tokens, count(*) AS tokens, count(*) FILTER (qclass = 'visual' AND raw_token LIKE '▁tok%') AS informative_visual FROM qt GROUP BY qid",
}


def oracle(select: str) -> str:
    """`select` behind the views that it names, directly or through others."""
    import re

    select = re.sub(r"\bround\(", "0::DOUBLE + round(", select)  # no negative zero
    used: set[str] = set()

    def need(sql: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", sql):
                used.add(name)
                need(VIEWS[name])

    need(select)
    recursive = "RECURSIVE " if "RECURSIVE" in select else ""
    if not used:
        return select
    return f"WITH {recursive}" + ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in VIEWS.items() if name in used) + " " + select
