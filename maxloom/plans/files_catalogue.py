"""Registered queries over files: JSON lines, runs, predictions, labels and vectors are written from the driver's tables, read by the readers, and held against SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analysis, channels, corpus, evaluation, labels, models, pruning, ranking, taxonomy
from ..sources import readers
from ..sources.shared import fresh_path
from . import catalogue
from .catalogue import ORACLE_SQL, PAGE, QUERIES, _both, query, r, rounded
from .retrieve import closest_grid_of

__all__ = ["ORACLE_SQL", "QUERIES"]


def _json(f, df: DataFrame, name: str) -> str:
    """`df` as one file of JSON lines, so that the order of rows is that of the file."""
    path = fresh_path(f.spark, name)
    df.coalesce(1).write.json(path)
    return path


def _text(f, df: DataFrame, name: str) -> str:
    path = fresh_path(f.spark, name)
    df.coalesce(1).write.text(path)
    return path


def _ids(column: str = "qid"):
    return F.col(column).cast("string").alias(column)


# Questions and ids


@query("SELECT item_id, text FROM benchmark")
def read_jsonl(f):
    return readers.jsonl(f.spark, _json(f, f.table("benchmark").select("item_id", "text"), "lines"), "item_id LONG, text STRING").select("item_id", "text")


@query("SELECT qid::VARCHAR AS qid FROM qs WHERE qid % 7 <> 0")
def read_qids(f):
    ids = f.questions.select(F.when(F.col("qid") % 7 == 0, " ").otherwise(F.concat(F.lit(" "), "qid", F.lit(" "))).alias("qid"))
    return readers.qids(f.spark, _json(f, ids, "qids"))


def _gold_file(f) -> str:
    words = F.split("question", " ")
    answer = lambda i, kind: F.struct(F.get(words, F.lit(i)).alias("answer"), F.lit(kind).alias("modality"))
    context = F.array(*[F.struct(F.concat(F.lit("d"), (F.col("qid") + i) % 4).alias("doc_id"), F.lit("text").alias("doc_part")) for i in (0, 1, 4)])
    rows = f.questions.orderBy("qid").select(_ids(), "question", F.array(answer(0, "text"), answer(1, "text")).alias("answers"), F.struct(F.col("qtype").alias("type")).alias("metadata"), context.alias("supporting_context"))
    return _json(f, rows, "gold")


@query("SELECT qid::VARCHAR AS qid, question, string_split(question, ' ')[1] AS first, qtype FROM qs")
def read_gold_questions(f):
    gold = readers.check_modalities(readers.gold_questions(f.spark, _gold_file(f)))
    return gold.select("qid", "question", F.get("answers.answer", F.lit(0)).alias("first"), F.col("metadata.type").alias("qtype"))


@query("SELECT qid::VARCHAR AS qid, qtype FROM qs WHERE qid % 3 = 0 AND qtype IN ('TextQ', 'ImageQ') ORDER BY qs.qid LIMIT 5")
def read_gold_of_listed(f):
    wanted = f.questions.where("qid % 3 = 0").select(_ids())
    return readers.gold_questions(f.spark, _gold_file(f), wanted, ["TextQ", "ImageQ"], 5).select("qid", F.col("metadata.type").alias("qtype"))


@query("SELECT DISTINCT qid::VARCHAR AS qid, 'd' || (qid + i) % 4 AS doc_id FROM qs, (VALUES (0), (1), (4)) t(i)")
def read_supporting(f):
    return readers.supporting(readers.gold_questions(f.spark, _gold_file(f)))


@query("SELECT item_id::VARCHAR AS id, form FROM benchmark, (VALUES ('list'), ('object'), ('lines')) t(form) WHERE item_id % 4 = 1")
def read_id_lists(f):
    ids = f.table("benchmark").where("item_id % 4 = 1").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("x"))
    forms = {"list": F.to_json("x"), "object": F.to_json(F.struct(F.col("x").alias("doc_ids"))), "lines": F.array_join("x", " \n\n ")}
    out = None
    for form, value in forms.items():
        one = readers.id_list(f.spark, _text(f, ids.select(value.alias("value")), form)).withColumn("form", F.lit(form))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT page_id::VARCHAR AS id, url || '#' || CASE WHEN page_id % 3 = 0 THEN 'new' ELSE 'old' END AS url FROM pages WHERE url IS NOT NULL")
def read_id_urls(f):
    page = f.table("pages").select(F.col("page_id").cast("string").alias("id"), "url", "page_id")
    old = page.select("id", F.concat("url", F.lit("#old")).alias("url"), F.lit(0).alias("t"), "page_id")
    new = page.where("page_id % 3 = 0").select("id", F.concat("url", F.lit("#new")).alias("url"), F.lit(1).alias("t"), "page_id")
    bad = page.where("page_id % 5 = 0").select("id", F.lit(None).cast("string").alias("url"), F.lit(2).alias("t"), "page_id")
    rows = old.unionByName(new).unionByName(bad).orderBy("t", "page_id")
    return readers.id_urls(f.spark, _json(f, rows.select("id", "url"), "urls"))


@query("SELECT qid, question FROM qs WHERE qid % 2 = 0")
def require_listed(f):
    return readers.require(f.questions, f.questions.where("qid % 2 = 0").select("qid")).select("qid", "question")


@query("SELECT qid, qtype FROM qs WHERE qid % 9 = 4")
def subset_by_listed_ids(f):
    return corpus.subset_by_ids(f.questions, f.questions.where("qid % 9 = 4").select("qid").unionByName(f.questions.where("qid % 9 = 4").select("qid"))).select("qid", "qtype")


@query("SELECT page_id AS id FROM pages WHERE page_id % 3 = 0 AND page_id % 2 = 1 ORDER BY page_id LIMIT 7")
def download_list(f):
    page = f.table("pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("pos"))
    return corpus.to_download(page, page.where("id % 3 = 0"), page.where("id % 2 = 0"), 7).select("id")


@query("SELECT coalesce(a, b, c) AS id, count(*) AS n FROM (SELECT CASE WHEN item_id % 3 = 0 THEN item_id::VARCHAR END AS a, CASE WHEN item_id % 2 = 0 THEN 'q' || item_id % 5 END AS b, 'z' AS c FROM benchmark) GROUP BY 1")
def record_ids(f):
    i = F.col("item_id")
    rows = f.table("benchmark").select(F.when(i % 3 == 0, i.cast("string")).alias("qid"), F.when(i % 2 == 0, F.concat(F.lit("q"), i % 5)).alias("query_id"), F.lit("z").alias("question_id"))
    return rows.groupBy(labels.record_id().alias("id")).agg(F.count("*").alias("n"))


# Runs and predictions


def _prediction_file(f) -> str:
    pages = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "page_idx", "score"))), lambda x: F.array(x["doc_id"], x["page_idx"].cast("string"), x["score"].cast("string")))
    one = f.run_baseline.groupBy("qid").agg(pages.alias("page_retrieval_results"))
    one = one.select(_ids(), F.struct("page_retrieval_results", F.concat(F.lit("answer "), "qid").alias("pred_answer"), F.lit(0.5).alias("time_retrieval"), (F.col("qid") * 0.25).alias("time_qa")).alias("p"))
    return _text(f, one.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("qid", "p")))).alias("value")), "predictions")


@query("SELECT qid::VARCHAR AS qid, rank, doc_id, page_idx, round(score, 6) AS score FROM run_b")
def read_predictions(f):
    run, _ = readers.predictions(f.spark, _prediction_file(f))
    return run.select("qid", "rank", "doc_id", "page_idx", r("score"))


@query("SELECT DISTINCT qid::VARCHAR AS qid, 'answer ' || qid AS pred_answer, 0.5::DOUBLE AS time_retrieval, qid * 0.25::DOUBLE AS time_qa FROM run_b WHERE qid < 3")
def read_prediction_answers(f):
    return readers.predictions(f.spark, _prediction_file(f), f.run_baseline.where("qid < 3").select(_ids()))[1]


@query("SELECT DISTINCT qid FROM gold")
def require_all_predictions(f):
    evaluation.require_predictions(f.gold, f.run_exact)
    return f.gold.select("qid").distinct()


def _run_file(f, run: DataFrame, name: str) -> str:
    """A row per question, and before them older rows that must not count."""
    rows = run.select(_ids(), F.lit("q").alias("question"), F.col("first_doc").cast("int").alias("reranked_first_gold_doc_rank"), F.array(F.struct(F.lit("d0").alias("doc_id"), F.col("first_doc").cast("int").alias("rank"))).alias("reranked_gold_doc_ranks"))
    old = rows.withColumn("reranked_first_gold_doc_rank", F.lit(99)).withColumn("age", F.lit(0))
    return _json(f, old.unionByName(rows.withColumn("age", F.lit(1))).orderBy("age", "qid").drop("age"), name)


@query("SELECT qid::VARCHAR AS qid, first_doc::INT AS rank, first_doc::INT AS listed FROM fg_e")
def read_run_rows(f):
    rows = readers.run_rows(f.spark, _run_file(f, _both(f)[1], "run"))
    return rows.select("qid", F.col("reranked_first_gold_doc_rank").alias("rank"), F.get("reranked_gold_doc_ranks.rank", F.lit(0)).alias("listed"))


@query("SELECT 'base' AS label, qid::VARCHAR AS qid, first_doc::INT AS rank FROM fg_b UNION ALL SELECT 'exact', qid::VARCHAR, first_doc::INT FROM fg_e")
def read_labelled_runs(f):
    base, exact = _both(f)
    rows = readers.labelled_runs(f.spark, [f"base={_run_file(f, base, 'run-b')}", f"exact={_run_file(f, exact, 'run-e')}"])
    return rows.select("label", "qid", F.col("reranked_first_gold_doc_rank").alias("rank"))


@query("SELECT qid::VARCHAR AS qid, question, (qid % 6)::INT AS rank, CASE WHEN qid % 6 < 3 THEN 'strong' ELSE 'weak' END AS verdict FROM qs")
def read_audits(f):
    one = F.struct(_ids(), "question", F.struct((F.col("qid") % 6).cast("int").alias("gold_visual_rank"), F.when(F.col("qid") % 6 < 3, "strong").otherwise("weak").alias("verdict")).alias("reliability_checklist"))
    path = _text(f, f.questions.agg(F.to_json(F.struct(F.collect_list(one).alias("audits"))).alias("value")), "audits")
    return readers.audits(f.spark, path).select("qid", "question", F.col("reliability_checklist.gold_visual_rank").alias("rank"), "reliability_checklist.verdict")


@query("SELECT qid::VARCHAR AS key, rank::INT AS place, doc_id, page_idx::VARCHAR AS page FROM run_b")
def written_predictions(f):
    path = _text(f, readers.prediction_payload(f.run_baseline), "payload")
    lines = f.spark.read.text(path).select(F.explode(F.from_json("value", "MAP<STRING, STRUCT<page_retrieval_results: ARRAY<ARRAY<STRING>>>>")).alias("key", "p"))
    pages = lines.select("key", F.posexplode("p.page_retrieval_results").alias("i", "x"))
    return pages.select("key", (F.col("i") + 1).cast("int").alias("place"), F.get("x", F.lit(0)).alias("doc_id"), F.get("x", F.lit(1)).alias("page"))


@query("SELECT qid, question FROM qs WHERE qid % 4 <> 1")
def resumed_questions(f):
    path = fresh_path(f.spark, "done")
    readers.write_jsonl(f.questions.where("qid % 4 = 1").withColumn("bucket", F.col("qid") % 3), path, "bucket")
    return readers.resume(f.questions, f.spark, path).select("qid", "question")


# Labels and vectors


@query("SELECT doc_id, page_idx, patch_idx, CASE (token_idx + page_idx) % 6 WHEN 0 THEN 'visual' WHEN 1 THEN 'non_visual' WHEN 2 THEN 'unknown' WHEN 3 THEN 'visual' WHEN 4 THEN 'non_visual' ELSE 'unknown' END AS pclass FROM pt WHERE patch_idx IS NOT NULL")
def read_patch_labels(f):
    i = (F.col("token_idx") + F.col("page_idx")) % 6
    concept = F.when(i == 3, "visual_region").when(i == 4, "table_text").otherwise("other")
    rows = f.pages.where("patch_idx IS NOT NULL").select(F.concat("doc_id", F.lit(":"), "page_idx").alias("page_id"), F.col("patch_idx").cast("int").alias("patch_index"), F.when(i == 0, " Visual").when(i == 1, "non_visual").when(i == 2, "neutral").alias("patch_class"), F.array(F.struct(concept.alias("concept"))).alias("top_concepts"))
    return readers.patch_labels(f.spark, _json(f, rows, "patches")).select("doc_id", "page_idx", "patch_idx", "pclass")


@query("SELECT doc_id, page_idx, token_idx, round(v[1], 6) AS first FROM pt WHERE doc_id IN ('d1', 'd4')")
def read_page_tokens(f):
    path = fresh_path(f.spark, "tokens")
    f.pages.select("doc_id", "page_idx", "token_idx", "emb").write.parquet(path)
    wanted = f.pages.where("doc_id IN ('d1', 'd4')").select("doc_id").distinct()
    return readers.page_tokens(f.spark, path, wanted).select("doc_id", "page_idx", "token_idx", r(F.get("emb", F.lit(0)), "first"))


@query("SELECT doc_id, page_idx, token_idx, round(v[1], 6) AS first FROM pt")
def read_ragged_tokens(f):
    tokens = F.array_sort(F.collect_list(F.struct("page_idx", "token_idx", "emb")))
    docs = f.pages.groupBy("doc_id").agg(F.transform(tokens, lambda x: x["emb"]).alias("tokens"))
    sizes = f.pages.groupBy("doc_id", "page_idx").agg(F.count("*").cast("int").alias("n")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "n"))), lambda x: x["n"]).alias("lengths"))
    return readers.ragged_tokens(docs.join(sizes, "doc_id")).select("doc_id", "page_idx", "token_idx", r(F.get("emb", F.lit(0)), "first"))


def _classed(f, record, needed: bool = False) -> DataFrame:
    """Token classes of every query by a record made from its tokens (structs of q_idx, label, raw)."""
    tokens = F.array_sort(F.collect_list(F.struct("q_idx", C.token_label("raw_token").alias("label"), F.col("raw_token").alias("raw")))).alias("t")
    rows = f.queries.groupBy("qid").agg(tokens).select("qid", "t", F.to_json(record(F.col("t"))).alias("record"))
    kinds = labels.token_classes("record", F.transform("t", lambda x: x["label"]), F.transform("t", lambda x: x["raw"]), F.lit(needed))
    return rows.select("qid", F.posexplode(kinds).alias("q_idx", "qclass")).select("qid", F.col("q_idx").cast("long").alias("q_idx"), "qclass")


def _of(t, *places: int):
    return F.transform(F.filter(t, lambda x: x["q_idx"].isin(*places)), lambda x: F.trim(x["label"]))


@query("SELECT qid, q_idx, CASE WHEN q_idx IN (3, 4) THEN 'visual' WHEN q_idx IN (5, 6) THEN 'non_visual' ELSE 'unknown' END AS qclass FROM qt")
def classes_by_index(f):
    return _classed(f, lambda t: F.struct(F.array(F.lit(3), F.lit(4)).alias("visual_token_indices"), F.array(F.lit(4), F.lit(5), F.lit(6)).alias("non_visual_token_indices")))


@query("SELECT qid, q_idx, CASE WHEN q_idx IN (3, 6) THEN 'visual' ELSE 'non_visual' END AS qclass FROM qt")
def classes_visual_needed(f):
    return _classed(f, lambda t: F.struct(_of(t, 3).alias("visual_needed_tokens"), F.array(F.lit(6)).alias("visual_needed_indices")))


@query("SELECT qid, q_idx, CASE WHEN q_idx IN (1, 5) THEN 'visual' ELSE 'non_visual' END AS qclass FROM qt")
def classes_by_mask(f):
    return _classed(f, lambda t: F.struct(F.array(*[F.lit(i in (1, 5)) for i in range(8)]).alias("visual_token_mask")), needed=True)


@query("SELECT qid, q_idx, CASE WHEN q_idx IN (4, 5) THEN 'visual' ELSE 'non_visual' END AS qclass FROM qt")
def classes_binary(f):
    kind = lambda x: F.when(x["q_idx"].isin(4, 5), "visual").otherwise("non-visual")
    return _classed(f, lambda t: F.struct(F.transform(t, lambda x: F.struct(F.trim(x["label"]).alias("token"), kind(x).alias("label"))).alias("token_labels")))


@query("SELECT qid, q_idx, ['visual', 'non_visual', 'unknown'][q_idx % 3 + 1] AS qclass FROM qt")
def classes_listed(f):
    kind = lambda x: F.element_at(F.array(F.lit("VISUAL"), F.lit("non_visual"), F.lit("?")), (x["q_idx"] % 3 + 1).cast("int"))
    return _classed(f, lambda t: F.struct(F.transform(t, kind).alias("query_token_classes")))


@query("SELECT qid, q_idx, CASE WHEN q_idx IN (3, 4, 5) THEN 'visual' ELSE 'unknown' END AS qclass FROM qt")
def classes_by_phrase(f):
    return _classed(f, lambda t: F.struct(F.array(F.array_join(_of(t, 3, 4, 5), " ")).alias("visual_tokens")))


@query("SELECT DISTINCT doc_id, page_idx, doc_id || '_page' || page_idx AS uid FROM pt")
def page_specs(f):
    return readers.page_specs(f.pages.select(F.concat("doc_id", F.lit(":"), "page_idx").alias("spec")).distinct())


# Texts


@query("SELECT o_orderkey, [o_orderkey::DOUBLE, 1234, -2500, 0.5] AS numbers FROM orders WHERE o_orderkey % 50 = 1")
def numbers_in_text(f):
    text = F.concat_ws(" ", F.lit("order"), "o_orderkey", F.lit("of 1,234 (or 12,a) 0 -2.5e3 .5 x9"))
    return f.table("orders").where("o_orderkey % 50 = 1").select("o_orderkey", C.numbers_in(text).alias("numbers"))


@query("SELECT qid, replace(replace('Q: $question D: $documents', '$question', question), '$documents', qtype) AS prompt FROM qs")
def prompts(f):
    return f.questions.select("qid", models.prompt("Q: $question D: $documents", F.col("question"), F.col("qtype")).alias("prompt"))


@query("SELECT qid, qtype || ' [SEP] HOP=1 [SEP] d' || qid % 4 || '; d0 [SEP] ' || question AS prompt FROM qs")
def hop_prompts(f):
    return f.questions.select("qid", taxonomy.hop_prompt(F.col("question"), F.col("qtype"), F.lit(1), F.array(F.concat(F.lit("d"), F.col("qid") % 4), F.lit("d0"))).alias("prompt"))


@query("SELECT c_custkey, ['florence2', 'idefics2', 'idefics3', 'internvl2', 'qwen2', NULL][c_custkey % 6 + 1] AS kind FROM customer")
def model_kinds(f):
    names = F.array(*map(F.lit, ["org/Florence-2-large", "Idefics2-8b", "IDEFICS3", "InternVL2-8B", "Qwen2-VL-7B", "other"]))
    return f.table("customer").select("c_custkey", models.model_kind(F.element_at(names, (F.col("c_custkey") % 6 + 1).cast("int"))).alias("kind"))


@query("SELECT p_partkey, trim(regexp_replace(p_name || '/x: ' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g')) AS name FROM part")
def safe_names(f):
    return f.table("part").select("p_partkey", C.safe_name(F.concat("p_name", F.lit("/x: "), "p_brand")).alias("name"))


@query("SELECT s_suppkey, ['exact', 'two_stage', 'ann'][s_suppkey % 3 + 1] AS mode, ['full', 'semantic_only', 'drop_pad_like'][s_suppkey % 3 + 1] AS filter, 'a' || s_suppkey AS qid FROM supplier")
def run_names(f):
    parts = F.element_at(F.array(*map(F.lit, ["Exact_run_full", "two_stage_semantic_only", "ivf_drop_pad_like"])), (F.col("s_suppkey") % 3 + 1).cast("int"))
    name = F.concat(parts, F.lit("/qid_a"), "s_suppkey")
    return f.table("supplier").select("s_suppkey", C.run_mode(name).alias("mode"), C.run_token_filter(name).alias("filter"), C.run_qid(name).alias("qid"))


# Answers on real words

_SQL_WORDS = "list_filter(list_transform(string_split(lower(replace(replace({0}, '-', ' '), chr(10), ' ')), ' '), lambda w: regexp_replace(w, '[!-/:-@\\[-`{{-~]', '', 'g')), lambda w: w NOT IN ('', 'a', 'an', 'the'))"
_SQL_F1 = "CASE WHEN len(list_intersect({0}, {1})) = 0 THEN 0 ELSE 2 * len(list_intersect({0}, {1})) / (len(list_distinct({0})) + len(list_distinct({1}))) END"


def _spans(f) -> DataFrame:
    """Two gold spans of three words a question, and predictions that change their order, words and marks."""
    words = F.split("question", " ")
    span = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    first, second = span(1, 3), span(4, 3)
    told = F.when(F.col("qid") % 4 == 0, F.array(F.concat(F.lit("The "), F.upper(second)), first)).when(F.col("qid") % 4 == 1, F.array(span(1, 2), F.concat(second, F.lit("!")))).when(F.col("qid") % 4 == 2, F.array(first, span(4, 1))).otherwise(F.array(span(2, 3), span(5, 3)))
    return f.questions.select("qid", "qtype", F.array(first, second).alias("g"), told.alias("p"))


_SQL_SPANS = (
    "SELECT qid, qtype, hop, first_modality, g1, g2, {p1} AS p1, {p2} AS p2 FROM (SELECT qid, qtype, hop, first_modality, w, array_to_string(w[1:3], ' ') AS g1, array_to_string(w[4:6], ' ') AS g2 FROM (SELECT *, string_split(question, ' ') AS w FROM qs JOIN dim USING (qtype)))"
).format(
    p1="CASE qid % 4 WHEN 0 THEN 'The ' || upper(g2) WHEN 1 THEN array_to_string(w[1:2], ' ') WHEN 2 THEN g1 ELSE array_to_string(w[2:4], ' ') END",
    p2="CASE qid % 4 WHEN 0 THEN g1 WHEN 1 THEN g2 || '!' WHEN 2 THEN w[4] ELSE array_to_string(w[5:7], ' ') END",
)
_SQL_BAGS = f"SELECT qid, qtype, hop, first_modality, {', '.join(f'{_SQL_WORDS.format(c)} AS {c}' for c in ('g1', 'g2', 'p1', 'p2'))} FROM ({_SQL_SPANS})"
_SQL_PAIR = {f"{p}{g}": _SQL_F1.format(p, g) for p in ("p1", "p2") for g in ("g1", "g2")}
_SQL_SCORES = (
    f"SELECT qid, qtype, hop, first_modality, CASE WHEN list_sort([array_to_string(p1, ' '), array_to_string(p2, ' ')]) = list_sort([array_to_string(g1, ' '), array_to_string(g2, ' ')]) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em, "
    f"round_even(greatest({_SQL_PAIR['p1g1']} + {_SQL_PAIR['p2g2']}, {_SQL_PAIR['p1g2']} + {_SQL_PAIR['p2g1']}) / 2, 2)::DOUBLE AS f1 FROM ({_SQL_BAGS})"
)


@query(f"SELECT qid, em, f1 FROM ({_SQL_SCORES})")
def answer_alignment(f):
    rows = _spans(f)
    return evaluation.answer_scores(rows.select("qid", F.col("g").alias("answers")), rows.select("qid", F.col("p").alias("answers")))


@query(f"SELECT CASE WHEN grouping(hop) = 0 THEN 'hop' WHEN grouping(first_modality) = 0 THEN 'first_modality' WHEN grouping(qtype) = 0 THEN 'qtype' ELSE 'all' END AS grouping, coalesce(hop, first_modality, qtype, '') AS value, count(*) AS queries, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1 FROM ({_SQL_SCORES}) GROUP BY GROUPING SETS ((), (hop), (first_modality), (qtype))")
def score_by_type(f):
    scored = answer_scored(f).join(F.broadcast(taxonomy.taxonomy(f.spark)), "qtype")
    return rounded(evaluation.scores_by_group(scored, ["hop", "first_modality", "qtype"]), "em", "f1")


def answer_scored(f) -> DataFrame:
    rows = _spans(f)
    return evaluation.answer_scores(rows.select("qid", F.col("g").alias("answers")), rows.select("qid", F.col("p").alias("answers"))).join(rows.select("qid", "qtype"), "qid")


_NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred".split()
_VALUES = [*range(20), *range(20, 100, 10), 100]


@query(f"SELECT c_custkey, 1.0::DOUBLE AS em, 1.0::DOUBLE AS f1, [{', '.join(map(str, _VALUES))}][c_custkey % {len(_VALUES)} + 1]::DOUBLE AS value FROM customer WHERE c_custkey % 5 = 0")
def number_words(f):
    i = (F.col("c_custkey") % len(_NUMBERS) + 1).cast("int")
    rows = f.table("customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("qid"), F.element_at(F.array(*map(F.lit, _NUMBERS)), i).alias("word"), F.element_at(F.array(*map(F.lit, _VALUES)), i).alias("value"))
    scored = evaluation.answer_scores(rows.select("qid", F.array(F.concat("word", F.lit(" the cats"))).alias("answers")), rows.select("qid", F.array(F.concat("value", F.lit(" Cats."))).alias("answers")))
    return scored.join(rows.select("qid", F.col("value").cast("double").alias("value")), "qid").withColumnRenamed("qid", "c_custkey")


# What no query covered


_MODES = {"balance_then_visual": "CASE WHEN balance > 0 THEN balance ELSE visual END", "balance_only": "balance", "visual_only": "visual", "non_visual_only": "non_visual", "grounded_non_visual_only": "grounded", "confirmed_visual_only": "confirmed", "multi_anchor_confirmed_visual_only": "multi_anchor", "non_visual_with_confirmed_visual_gate": "CASE WHEN confirmed >= 0.1 THEN non_visual ELSE 0 END", "non_visual_with_multi_anchor_confirmed_visual_gate": "CASE WHEN multi_anchor >= 0.1 THEN non_visual ELSE 0 END"}
_GATES = {"non_visual_with_confirmed_visual_gate": "(confirmed >= 0.1)::INT", "non_visual_with_multi_anchor_confirmed_visual_gate": "(multi_anchor >= 0.1)::INT"}


@query("SELECT qid, doc_id, page_idx, mode, rank AS prefilter_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, mode ORDER BY gate DESC, p DESC, multi_anchor DESC, confirmed DESC, visual DESC, grounded DESC, base DESC, doc_id || '_page' || page_idx DESC) AS rank FROM (" + " UNION ALL ".join(f"SELECT *, '{m}' AS mode, {_GATES.get(m, '1')} AS gate, {p} AS p FROM ft" for m, p in _MODES.items()) + "))")
def prefilter_modes(f):
    features = channels.page_features(f.scores)
    out = None
    for mode in channels.PREFILTERS:
        one = channels.prefilter(features, mode).select(*PAGE, F.lit(mode).alias("mode"), "prefilter_rank")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT bucket, count(*) AS queries, round(avg(p), 6) AS mean_rank, round(median(p), 6) AS median_rank FROM (SELECT e.first_doc AS x, p.first_doc AS p, CASE WHEN e.first_doc % 2 = 0 THEN 'even' ELSE 'odd' END AS bucket FROM fg_e e JOIN fg_p p USING (qid)) GROUP BY bucket")
def bucket_summary(f):
    both = catalogue.evaluation.compare_runs(_both(f)[1], _pruned(f)).withColumn("bucket", F.when(F.col("before") % 2 == 0, "even").otherwise("odd"))
    return rounded(analysis.bucket_summary(both, "bucket", "after"), "mean_rank", "median_rank")


def _pruned(f):
    kept = pruning.global_topk(pruning.coarse_token_max(f.scores), 4)
    run = catalogue.retrieval.rank_pages(pruning.approx_scores(kept, f.scores).select(*PAGE, "score"))
    return evaluation.first_gold_ranks(run, f.gold)


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, word) AS place FROM (SELECT bucket, word, count(*) AS n FROM (SELECT qid % 2 AS bucket, unnest(string_split(question, ' ')[1:5]) AS word FROM qs) GROUP BY bucket, word)) WHERE place <= 6")
def bucket_words(f):
    rows = f.questions.select((F.col("qid") % 2).alias("bucket"), F.slice(F.split("question", " "), 1, 5).alias("words"))
    return analysis.bucket_frequencies(rows, "bucket", "words", 6).withColumnRenamed("value", "word")


@query("SELECT qid, p, 'd' || doc AS uid FROM (SELECT qid, p, CASE WHEN p <= 3 THEN p ELSE p + 10 END AS doc FROM qs, range(1, 6) t(p))")
def pool_with_new_tail(f):
    pool = f.questions.select("qid", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("pos")).withColumn("uid", F.concat(F.lit("d"), "pos"))
    new = f.questions.select("qid", F.explode(F.array(F.lit(2), F.lit(14), F.lit(15))).alias("i")).select("qid", F.col("i").alias("pos"), F.concat(F.lit("d"), "i").alias("uid"))
    return ranking.replace_pool_tail(pool, new).select("qid", F.col("p").cast("long").alias("p"), "uid")


@query("SELECT g.qid, g.doc_id, (SELECT arg_min(page_idx, rank) FROM run_e r WHERE r.qid = g.qid AND r.doc_id = g.doc_id) AS page_idx, row_number() OVER (PARTITION BY g.qid ORDER BY g.doc_id) AS place FROM gold g")
def ith_gold_pages(f):
    return evaluation.ith_gold_pages(f.run_exact, f.gold).select("qid", "place", "doc_id", "page_idx")


@query("SELECT CASE WHEN l > b THEN 'improved' WHEN l < b THEN 'worsened' ELSE 'tied' END AS movement, count(*) AS pages, round(avg(b), 6) AS baseline, round(avg(l), 6) AS learned FROM (SELECT qid, doc_id, page_idx, sum(CASE WHEN pb <= 4 THEN wins ELSE 0 END) / sum(wins) AS b, sum(CASE WHEN pl <= 4 THEN wins ELSE 0 END) / sum(wins) AS l FROM (SELECT cr.*, place AS pb, row_number() OVER (PARTITION BY cr.qid, cr.doc_id, cr.page_idx ORDER BY coalesce(vq, -1e9) DESC, cr.token_idx) AS pl, coalesce(w.wins, 0) AS wins FROM cr LEFT JOIN vq USING (qid, doc_id, page_idx, token_idx) LEFT JOIN (SELECT qid, doc_id, page_idx, w AS token_idx, count(*) AS wins FROM (SELECT qid, doc_id, page_idx, q_idx, arg_max(token_idx, (s, -token_idx)) AS w FROM sc WHERE active GROUP BY ALL) GROUP BY ALL) w USING (qid, doc_id, page_idx, token_idx)) GROUP BY ALL) GROUP BY 1")
def selector_movement(f):
    coarse, wins = pruning.coarse_token_max(f.scores), pruning.winner_counts(f.scores)
    visual = f.scores.where("qclass = 'visual'").groupBy(*catalogue.TOKEN).agg(F.max("s").alias("coarse"))
    baseline = pruning.selector_recall(pruning.best_first(coarse), wins, 4)
    learned = pruning.selector_recall(pruning.best_first(visual), wins, 4)
    return rounded(pruning.selector_movement(baseline, learned), "baseline", "learned")


@query("SELECT p_partkey, g.i AS columns, g.j AS rows FROM (SELECT p_partkey, CASE WHEN count(*) FILTER (w * h > 448 * 448 * i * j / 2) > 0 THEN max({'a': i * j, 'i': i, 'j': j}) FILTER (w * h > 448 * 448 * i * j / 2) ELSE min({'a': i * j, 'i': i, 'j': j}) END AS g FROM (SELECT p_partkey, w, h, i, j, abs(w / h - i / j) AS gap, min(abs(w / h - i / j)) OVER (PARTITION BY p_partkey) AS least FROM (SELECT p_partkey, 200 + p_size * 37 AS w, 300 + p_partkey % 41 * 50 AS h FROM part), (SELECT i::INT AS i, j::INT AS j FROM range(1, 7) a(i), range(1, 7) b(j) WHERE i * j <= 6)) WHERE gap = least GROUP BY p_partkey)")
def tile_grids(f):
    sizes = f.table("part").select("p_partkey", (F.col("p_size") * 37 + 200).alias("w"), (F.col("p_partkey") % 41 * 50 + 300).alias("h"))
    return sizes.select("p_partkey", closest_grid_of(F.col("w"), F.col("h")).alias("g")).select("p_partkey", F.col("g.i").alias("columns"), F.col("g.j").alias("rows"))


@query("SELECT artifact, expected, found, bytes, found >= expected AS ready FROM (SELECT 'n' || k AS artifact, (10 + k)::BIGINT AS expected, (SELECT count(*) FROM part WHERE p_partkey <= 40 AND p_partkey % 4 = k) AS found, (SELECT coalesce(sum(p_size), 0)::BIGINT FROM part WHERE p_partkey <= 40 AND p_partkey % 4 = k) AS bytes FROM range(4) t(k))")
def artifact_readiness(f):
    files = f.table("part").where("p_partkey <= 40").select(F.concat(F.lit("n"), F.col("p_partkey") % 4).alias("artifact"), F.col("p_name").alias("path"), F.col("p_size").cast("long").alias("length"))
    expected = f.spark.range(4).select(F.concat(F.lit("n"), "id").alias("artifact"), (F.col("id") + 10).alias("expected"))
    return corpus.artifacts(files, expected)
