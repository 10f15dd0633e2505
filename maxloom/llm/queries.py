"""The llm operators as registered queries, each over whole tables with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from .common import read_table
from .license_scan import oracle as license_oracle


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark, sf_dir):
    from .ngram_join import ngram_join

    return ngram_join(read_table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    from .quality import quality

    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_embed_dedup(spark, sf_dir):
    from .embed_dedup import embed_dedup

    return embed_dedup(read_table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(read_table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), word_vocabulary())


def op6_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    from .license_scan import license_scan

    return license_scan(read_table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_token_counts(spark, sf_dir):
    from .token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), word_vocabulary())


def op10_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_quality, op3_embed_dedup, op4_suffix_dedup, op5_packing, op6_exact_dedup, op7_license_scan, op8_mixing, op9_token_counts, op10_toxicity)}

ORACLE_SQL = {
    "op1_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
        i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM i),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE o >= 0.8 * (x.n + y.n - o)),
        r(id, root) AS (SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT p.b, r.root FROM r JOIN p ON r.id = p.a),
        l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a), k AS (SELECT id, min(root) AS class_id FROM r GROUP BY id)
        SELECT w.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n.n, 0) AS n_shingles FROM w JOIN k ON k.id = w.doc_id LEFT JOIN n USING (doc_id) LEFT JOIN l ON a = w.doc_id""",
    "op3_embed_dedup": """
        WITH RECURSIVE t AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, label, embedding FROM embeddings),
        e AS (SELECT i, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM t WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT a.i AS a, b.i AS b FROM e a JOIN e b ON a.label = b.label AND a.i <> b.i AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
        r(id, root) AS (SELECT i, i FROM t UNION SELECT p.b, r.root FROM r JOIN p ON r.id = p.a),
        n AS (SELECT a, count(*) AS n FROM p GROUP BY a), c AS (SELECT id, min(vec_id) AS root FROM r JOIN t ON root = i GROUP BY id)
        SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, root IS NOT DISTINCT FROM vec_id AS kept FROM t JOIN c ON id = i LEFT JOIN n ON a = i""",
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, CASE WHEN min(doc_id) OVER w IS NULL THEN row_number() OVER w = 1 ELSE coalesce(doc_id = min(doc_id) OVER w, false) END AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op7_license_scan": license_oracle(),
}
