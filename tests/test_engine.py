"""The retrieval engine: registered queries against DuckDB on the smallest tables, and operators against plain Python."""

import itertools
import json
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from maxloom.functions import columns as C
from maxloom.operators import analysis, channels, corpus, evaluation, labels, models, pruning, ranking, retrieval, routing, taxonomy
from maxloom.plans.files_catalogue import ORACLE_SQL, QUERIES
from maxloom.sources import readers
from maxloom.streaming import runs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in ("embeddings", "benchmark", "pages", "customer", "orders", "part", "supplier"):
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def rows_of(df: pd.DataFrame):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, (list, np.ndarray)):
            return tuple(map(plain, v))
        return round(float(v), 5) if isinstance(v, (float, np.floating)) else bool(v) if isinstance(v, (bool, np.bool_)) else int(v) if isinstance(v, (int, np.integer)) else v

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="session")
def small(spark):
    rng = np.random.default_rng(0)
    pages = [(f"d{d}", p, t, rng.normal(size=8).tolist()) for d in range(3) for p in range(2) for t in range(6)]
    queries = [(q, i, rng.normal(size=8).tolist(), i < 3) for q in range(2) for i in range(4)]
    return spark.createDataFrame(pages, "doc_id string, page_idx long, token_idx long, emb array<double>"), spark.createDataFrame(queries, "qid long, q_idx long, emb array<double>, active boolean"), pages, queries


def test_maxsim_equals_numpy(small, monkeypatch):
    pages, queries, p, q = small
    for block in (65_536, 3):  # in one block of queries, and in several
        monkeypatch.setattr(retrieval, "QUERY_TOKENS", block)
        for r in retrieval.maxsim(pages, queries.where("active")).collect():
            m = np.array([x[3] for x in p if (x[0], x[1]) == (r["doc_id"], r["page_idx"])]) @ np.array([x[2] for x in q if x[0] == r["qid"] and x[3]]).T
            assert abs(r["score"] - m.max(0).sum()) < 1e-9


def test_two_stage_with_all_candidates_is_exact_and_pruned_is_never_more(small):
    pages, queries, _, _ = small
    scores = retrieval.token_scores(pages, queries, query_columns=["active"])
    exact = {(r["qid"], r["doc_id"], r["page_idx"]): r["score"] for r in retrieval.maxsim(pages, queries.where("active")).collect()}
    full = {(r["qid"], r["doc_id"], r["page_idx"]): r["score"] for r in retrieval.two_stage(pages, queries, 36, 6, 6).collect()}
    assert full.keys() == exact.keys() and all(abs(full[k] - exact[k]) < 1e-9 for k in exact)
    for r in pruning.approx_scores(pruning.global_topk(pruning.coarse_token_max(scores), 3), scores).collect():
        assert r["score"] <= exact[r["qid"], r["doc_id"], r["page_idx"]] + 1e-9
    with pytest.raises(ValueError):
        retrieval.two_stage(pages, queries, 36, 2, 6)
    with pytest.raises(ValueError):
        retrieval.require_active(queries.withColumn("active", F.lit(False)))


def test_wanted_pages_meet_their_own_queries_alone(spark, small, monkeypatch):
    pages, queries, _, _ = small
    own = {(0, "d0", 1), (0, "d2", 0), (1, "d0", 1), (1, "d1", 0)}
    wanted = spark.createDataFrame([*own, (0, "d0", 1), (7, "d2", 1)], "qid long, doc_id string, page_idx long")
    key = ["qid", "doc_id", "page_idx"]
    exact = {tuple(r[k] for k in key): r["score"] for r in retrieval.maxsim(pages, queries).collect()}
    full = {tuple(r[k] for k in [*key, "q_idx", "token_idx"]): r["s"] for r in retrieval.token_scores(pages, queries).collect()}
    for block, products in ((65_536, 4_000_000), (1, 3)):
        monkeypatch.setattr(retrieval, "QUERY_TOKENS", block)
        monkeypatch.setattr(retrieval, "PRODUCTS", products)
        got = {tuple(r[k] for k in key): r["score"] for r in retrieval.rescored(pages, queries, wanted).collect()}
        assert set(got) == own and all(got[k] == pytest.approx(exact[k]) for k in own)
        table = {tuple(r[k] for k in [*key, "q_idx", "token_idx"]): r["s"] for r in retrieval.token_scores(pages, queries, wanted=wanted).collect()}
        assert table.keys() == {k for k in full if k[:3] in own} and all(table[k] == pytest.approx(full[k]) for k in table)
    assert retrieval.rescored(pages, queries, wanted.limit(0)).count() == 0


def test_sequential_selectors_equal_plain_loops(small):
    pages, queries, p, q = small
    scores = retrieval.token_scores(pages, queries, query_columns=["active"])
    coarse = pruning.coarse_token_max(scores)
    by_page = lambda df: {k: [r["token_idx"] for r in sorted(g, key=lambda r: r["pick"])] for k, g in itertools.groupby(sorted(df.collect(), key=lambda r: (r["qid"], r["doc_id"], r["page_idx"])), key=lambda r: (r["qid"], r["doc_id"], r["page_idx"]))}
    for (qid, d, page), picks in by_page(pruning.mmr(coarse, pages, 3, 0.5)).items():
        x = np.array([t[3] for t in p if (t[0], t[1]) == (d, page)])
        c = (x @ np.array([t[2] for t in q if t[0] == qid and t[3]]).T).max(1)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        want = []
        while len(want) < 3:
            want.append(max((i for i in range(len(x)) if i not in want), key=lambda i: c[i] - 0.5 * max([0.0, *(float(u[i] @ u[j]) for j in want)])))
        assert picks == want
    for (qid, d, page), picks in by_page(pruning.greedy_maxsim(coarse, scores, 3)).items():
        m = np.array([t[3] for t in p if (t[0], t[1]) == (d, page)]) @ np.array([t[2] for t in q if t[0] == qid and t[3]]).T
        m = m + np.maximum(0, -m.min(0))
        best, want = np.zeros(m.shape[1]), []
        while len(want) < 3 and max(np.maximum(m[i] - best, 0).sum() for i in range(len(m))) > 0:
            want.append(max((i for i in range(len(m)) if i not in want), key=lambda i: (np.maximum(m[i] - best, 0).sum(), -i)))
            best = np.maximum(best, m[want[-1]])
        assert picks[: len(want)] == want and len(picks) == 3
    assert all(len(set(x)) == 4 for x in by_page(pruning.coverage_mix(coarse, scores, 4, 2)).values())


def test_fewer_clusters_find_no_more(small):
    pages, queries, _, _ = small
    index, centroids = retrieval.cluster_tokens(pages, 4)
    few, every = (retrieval.probe(index, centroids, queries, n).count() for n in (1, 4))
    assert few < every == 36 * 8


def test_literal_goldens(spark):
    scored = spark.createDataFrame([(0, d, i, s) for d, xs in {"doc1": [10, 50, 30], "doc2": [40, 20, 60], "doc3": [70, 90]}.items() for i, s in enumerate(xs)], "qid long, doc_id string, page_idx long, score long")
    assert [(r["doc_id"], r["page_idx"]) for r in retrieval.top_pages(scored, 3).orderBy("rank").collect()] == [("doc3", 1), ("doc3", 0), ("doc2", 2)]
    assert [(r["doc_id"], r["page_idx"]) for r in retrieval.top_page_per_doc(scored, 2).orderBy("rank").collect()] == [("doc3", 1), ("doc2", 2)]
    grid = spark.createDataFrame([(1030,), (16,), (17,)], "n long").select("n", C.grid_side("n").alias("s")).collect()
    assert [(r["n"], r["s"]) for r in grid] == [(1030, 32), (16, 4), (17, 4)]
    said = ["Yes.", "no", "maybe", "", "I say yes", "not sure", None, "oh no"]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select(C.evidence_score("s").alias("e"), "i").orderBy("i").collect()
    assert [r["e"] for r in got] == [1.0, 0.0, 0.5, 0.0, 0.75, 0.0, 0.0, 0.25]
    ranks = spark.createDataFrame([(5, 2), (2, 5), (None, 4), (4, None), (None, None), (3, 3)], "a int, b int").select(C.movement("a", "b")).collect()
    assert [r[0] for r in ranks] == ["improved", "worsened", "newly_found", "newly_lost", "missing_in_both", "unchanged"]
    assert corpus.window_starts(10, 4, 4) == [0, 4, 6]


def test_rrf_golden(spark):
    runs_ = spark.createDataFrame([(0, "a", 0, 1, 1.0), (0, "a", 0, 3, 0.5)], "qid long, doc_id string, page_idx long, rank long, score double")
    assert abs(ranking.reciprocal_rank_fusion(runs_).first()["rrf"] - (1 / 61 + 1 / 63)) < 1e-12


def test_answers(spark):
    assert evaluation.normalise_answer("The Twenty-One Cats!") == "20.0 1.0 cats"
    assert evaluation.bag_f1({"a", "b"}, {"b", "c"}) == 0.5 and evaluation.bag_f1(set(), {"x"}) == 0.0
    assert evaluation.exact_match(["The cat", "2"], ["two", "cat"]) == 1.0 and evaluation.list_f1(["a big cat"], ["cat"]) == 0.67
    assert evaluation.list_f1(["3 cats"], ["4 cats"]) == 0.0
    rng = np.random.default_rng(1)
    for _ in range(60):
        m = rng.random((rng.integers(1, 6), rng.integers(1, 6)))
        pairs = evaluation.best_assignment(m)
        wide = m if m.shape[0] <= m.shape[1] else m.T
        best = max(sum(wide[i, j] for i, j in enumerate(c)) for c in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert len(pairs) == min(m.shape) == len({i for i, _ in pairs}) and abs(sum(m[i, j] for i, j in pairs) - best) < 1e-9
    gold = spark.createDataFrame([(1, ["cat"]), (2, ["dog"])], "qid long, answers array<string>")
    got = evaluation.answer_scores(gold, spark.createDataFrame([(1, ["the cat"]), (9, ["x"])], "qid long, answers array<string>")).orderBy("qid").collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 1.0), (2, 0.0, 0.0)]
    with pytest.raises(ValueError):
        evaluation.require_predictions(gold, gold.where("qid = 1"))


def test_label_schemas():
    tokens, raws = ["[BOS]", " red", " car", "s", " on", " hill"], ["<bos>", "▁red", "▁car", "s", "▁on", "▁hill"]
    v, n, u = "visual", "non_visual", "unknown"
    assert labels.classes(None, tokens, raws) == [u] * 6
    assert labels.classes({"query_token_classes": [{"index": 1, "class": "Visual"}, {"index": 9, "class": "visual"}]}, tokens, raws) == [u, v, u, u, u, u]
    assert labels.classes({"query_token_classes": ["neutral", "visual", "odd", "non_visual", u, u]}, tokens, raws) == [u, v, u, n, u, u]
    assert labels.classes({"visual_tokens": ["red cars"], "non_visual_token_indices": [1, 4]}, tokens, raws) == [u, v, v, v, n, u]
    assert labels.classes({"token_labels": [{"label": "visual", "norm": "hill"}], "phrase_labels": [{"label": "visual-strong", "phrase": {"text": "red"}}]}, tokens, raws) == [n, v, n, n, n, v]
    assert labels.classes({"visual_needed_mask": [0, 1, 0, 0, 0, False], "visual_needed_phrases": ["on hill"]}, tokens, raws) == [n, v, n, n, v, v]
    assert labels.classes({"visual_token_indices": ["2"]}, tokens, raws, needed=True) == [n, n, v, n, n, n]


def test_label_udf(spark):
    row = spark.createDataFrame([(json.dumps({"visual_tokens": ["a"]}), ["a", "b"], ["▁a", "▁b"], False), (None, ["a"], None, True)], "r string, l array<string>, w array<string>, n boolean")
    assert [r[0] for r in row.select(labels.token_classes("r", "l", "w", "n")).collect()] == [["visual", "unknown"], ["non_visual"]]


def test_routing_and_training(spark):
    queries = spark.createDataFrame([(q, i, f"▁w{q}", "visual" if i < q % 3 else "non_visual") for q in range(12) for i in range(4)], "qid long, q_idx long, raw_token string, qclass string")
    types = spark.createDataFrame([(q, "ImageQ" if q % 3 else "TextQ") for q in range(12)], "qid long, qtype string")
    features = routing.route_features(queries, types)
    base = spark.createDataFrame([(q, 9) for q in range(12)], "qid long, first_doc long")
    other = spark.createDataFrame([(q, 1 if q % 3 else 20) for q in range(12)], "qid long, first_doc long")
    rules = routing.candidate_rules(features)
    assert routing.greedy_rules(rules, base, other)[0] in ("type=ImageQ", "informative_visual>=1", "visual_tokens>=1")
    goal = routing.objective(routing.routed(base, other, routing.route(features, routing.train_router(features, base, other)))).first()
    assert (goal["top4"], goal["worsened"], goal["oracle_top4"]) == (8, 0, 8)
    assert {r["route"] for r in routing.route(features, None).collect()} == {"visual"}
    with pytest.raises(ValueError):
        routing.route(features, {"router_type": "other"})
    rng = random.Random(0)
    rows = spark.createDataFrame([(g, (x := rng.random()), rng.random(), 1.0 if x > 0.7 else 0.0) for g in range(20) for _ in range(10)], "g long, x double, y double, w double")
    model = routing.train_pairs(rows, ["g"], ["x", "y"], "w")
    assert model["weights"][0] > 0.5 > abs(model["weights"][1])
    assert routing.vocabulary(features).count() == 8


def test_search_keeps_ties_and_numbers_are_whole(spark, small):
    pages, queries, _, _ = small
    scores = retrieval.token_scores(pages, queries)
    for k in (1, 5, 100):
        key = lambda df: {tuple(x[c] for c in ("qid", "q_idx", "doc_id", "page_idx", "token_idx", "near")) for x in df.collect()}
        assert key(retrieval.search_tokens(pages, queries, k)) == key(retrieval.nearest_tokens(scores, k))
    rows = spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1000).repartition(7)
    assert [r["number"] for r in corpus.numbered(rows, "x").orderBy("x").collect()] == list(range(1000))


def test_taxonomy_is_whole():
    rows = taxonomy.rows()
    assert len(rows) == 16 and sum(r[1] == "single" for r in rows) == 4
    assert taxonomy.decomposed("q?", "TextQ", 1, ["a", "b"]) == "TextQ [SEP] HOP=1 [SEP] a; b [SEP] q?"


def test_readers(spark, tmp_path):
    gold = tmp_path / "gold.jsonl"
    gold.write_text("\n".join(json.dumps(x) for x in [{"qid": "a", "question": "?", "answers": [{"answer": "x", "modality": "text"}], "metadata": {"type": "TextQ"}, "supporting_context": [{"doc_id": "d1", "doc_part": "text"}]}, {"qid": "b", "metadata": {"type": "ImageQ"}}]) + "\n\n")
    q = readers.gold_questions(spark, str(gold), types=["TextQ"])
    assert [r["qid"] for r in q.collect()] == ["a"] and readers.supporting(q).count() == 1 and readers.check_modalities(q) is q
    assert readers.qids(spark, str(gold), most=1).count() == 1
    with pytest.raises(ValueError):
        readers.gold_questions(spark, str(gold), spark.createDataFrame([("zz",)], "qid string"))
    pred = tmp_path / "pred.json"
    pred.write_text(json.dumps({"a": {"page_retrieval_results": [["d1", 0, 2.5], ["d2", 3, 1.5]], "pred_answer": "x", "time_retrieval": 1.0, "time_qa": 2.0}}))
    run, answers = readers.predictions(spark, str(pred))
    assert [tuple(r) for r in run.orderBy("rank").collect()] == [("a", 1, "d1", 0, 2.5), ("a", 2, "d2", 3, 1.5)] and answers.first()["pred_answer"] == "x"
    assert json.loads(readers.prediction_payload(run, answers).first()[0])["a"]["page_retrieval_results"][0] == ["d1", "0", "2.5"]
    for name, text in (("l.json", '["x", "y"]'), ("o.json", '{"doc_ids": ["x", "y"]}'), ("t.txt", "x\n\n y \n")):
        (tmp_path / name).write_text(text)
        assert sorted(r[0] for r in readers.id_list(spark, str(tmp_path / name)).collect()) == ["x", "y"]
    rerank = tmp_path / "run.jsonl"
    rerank.write_text('{"qid": "a", "reranked_first_gold_doc_rank": 7}\n{"qid": "a", "reranked_first_gold_doc_rank": 3}\n')
    assert [r["reranked_first_gold_doc_rank"] for r in readers.labelled_runs(spark, [f"one={rerank}"]).collect()] == [3]
    with pytest.raises(ValueError):
        readers.labelled_runs(spark, [f"one={rerank}", f"one={rerank}"])
    patches = tmp_path / "patch.jsonl"
    patches.write_text('{"page_id": "a:b:2", "patch_index": 1, "patch_class": "Neutral"}\n{"page_id": "d:0", "patch_index": 0, "top_concepts": [{"concept": "ocr_text"}]}\n')
    assert sorted((r["doc_id"], r["page_idx"], r["pclass"]) for r in readers.patch_labels(spark, str(patches)).collect()) == [("a:b", 2, "unknown"), ("d", 0, "non_visual")]
    todo = spark.createDataFrame([("a",), ("b",)], "qid string")
    out = str(tmp_path / "out")
    assert readers.resume(todo, spark, out).count() == 2
    readers.write_jsonl(todo.where("qid = 'a'"), out)
    assert [r[0] for r in readers.resume(todo, spark, out).collect()] == ["b"]
    docs = spark.createDataFrame([("d", [[1.0], [2.0], [3.0]], [1, 2])], "doc_id string, tokens array<array<double>>, lengths array<int>")
    assert sorted((r["page_idx"], r["token_idx"], r["emb"][0]) for r in readers.ragged_tokens(docs).collect()) == [(0, 0, 1.0), (1, 0, 2.0), (1, 1, 3.0)]
    (tmp_path / "good.pdf").write_bytes(b"%PDF-1.4 ... %%EOF")
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 corrupted content")
    assert sorted(r["clean"] for r in readers.pdf_files(spark, str(tmp_path)).collect()) == [False, True]


def test_models(spark):
    questions = spark.createDataFrame([(1, "red car"), (2, "blue")], "qid long, question string")
    tokens = models.encode_queries(questions, models.hash_encoder)
    assert tokens.count() == 5 and tokens.where("raw_token = '<bos>'").select("emb").distinct().count() == 1
    run = spark.createDataFrame([(1, "d", 0, 1), (1, "d", 1, 2), (2, "e", 0, 1)], "qid long, doc_id string, page_idx long, rank long")
    said = models.retrieve_and_answer(questions, run, lambda: lambda items: [f"{p}|{','.join(u)}" for p, u in items], "Q: $question", 1)
    assert sorted(tuple(r) for r in said.collect()) == [(1, "Q: red car|d_page0"), (2, "Q: blue|e_page0")]
    assert spark.range(1).select(models.model_kind(F.lit("Qwen2-VL"))).first()[0] == "qwen2"


def test_pool_replacement_and_analysis(spark):
    pool = spark.createDataFrame([(0, i, f"p{i}") for i in range(4)], "qid long, pos long, uid string")
    new = spark.createDataFrame([(0, 0, "p1"), (0, 1, "x"), (0, 2, "y")], "qid long, pos long, uid string")
    assert [r["uid"] for r in ranking.replace_pool_tail(pool, new).orderBy("p").collect()] == ["p0", "p1", "x", "y"]
    ranks = lambda xs: spark.createDataFrame(list(enumerate(xs)), "qid long, first_doc long")
    got = {r["qid"]: r["bucket"] for r in analysis.failure_buckets(ranks([None, 2, 6, 9, 30]), ranks([None, 8, 20, 11, 32])).orderBy("qid").collect()}
    assert list(got.values()) == ["retrieval_missing", "pruning_damage_exact_recovers_topk", "pruning_damage_exact_improves_but_still_fails", "boundary_exact_still_fails", "hard_fail_even_exact"]
    grid = spark.createDataFrame([("d", 0, 3, i, "visual" if i == 0 else "unknown" if i % 2 else "non_visual") for i in range(9)], "doc_id string, page_idx long, side long, patch_idx long, pclass string")
    assert {r["patch_idx"] for r in channels.dilated(grid, 1).where("pclass = 'visual'").collect()} == {0, 1, 3}
    assert channels.dilated(grid, 0).where("pclass = 'visual'").count() == 1


def test_streaming_goes_on_where_it_ended(spark, tmp_path):
    rows = lambda qs: spark.createDataFrame([(q, r, f"2024-01-01 0{h}:10:00") for q, r, h in qs], "qid long, rank long, t string").select("qid", "rank", F.to_timestamp("t").alias("ts"))
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    rows([(1, 3, 0), (1, 5, 0), (2, 9, 0)]).coalesce(1).write.parquet(source)
    stream = lambda: runs.first_rows(runs.run_stream(spark, source, "qid long, rank long, ts timestamp"))
    runs.append(stream(), out, at).awaitTermination()
    rows([(2, 1, 0), (3, 2, 1)]).coalesce(1).write.mode("append").parquet(source)
    runs.append(stream(), out, at).awaitTermination()
    assert sorted(r["qid"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    kpis = runs.windowed_kpis(runs.run_stream(spark, source, "qid long, rank long, ts timestamp"), late="0 seconds")
    runs.append(kpis, str(tmp_path / "k"), str(tmp_path / "kc")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "k")).where("hour(start) = 0").count() <= 1


def test_whole_plans(spark, small):
    from maxloom.plans import retrieve as plans

    pages, queries, _, _ = small
    queries = queries.withColumns({"raw_token": F.concat(F.lit("▁w"), "q_idx"), "qclass": F.lit("visual")})
    exact = {(x["qid"], x["rank"]): (x["doc_id"], x["page_idx"]) for x in plans.retrieve(pages, queries, plans.RetrievalConfig(k=3)).collect()}
    for mode in (plans.RetrievalConfig("two_stage", 3, 36, 6), plans.RetrievalConfig("ann", 3, 36)):
        assert {(x["qid"], x["rank"]): (x["doc_id"], x["page_idx"]) for x in plans.retrieve(pages, queries, mode).collect()} == exact
    with pytest.raises(ValueError):
        plans.retrieve(pages, queries, plans.RetrievalConfig("other"))
    page = pages.withColumns({"n": F.lit(6), "side": F.lit(2), "patch_idx": F.when(F.col("token_idx") < 4, F.col("token_idx")), "pclass": F.when(F.col("token_idx") % 2 == 0, "visual").otherwise("non_visual")})
    for selector, options in (("redundancy_aware_topk", {}), ("maxsim_greedy", {}), ("query_coverage_topk", {"reserve": 1}), ("spatial_quadrant_mix", {"reserve": 1}), (None, {})):
        ranked, docs = plans.rerank(page, queries, plans.RerankConfig(selector, 3, options))
        assert ranked.count() == 12 and docs.count() == 6
    assert plans.closest_grid(1000, 500) == (2, 1) and plans.closest_grid(100, 100) == (1, 1) and plans.closest_grid(2000, 2000) == (2, 2)


def test_small_column_functions(spark):
    rows = spark.createDataFrame([("1,200 cats 3.5 0 x -7 1e2",)], "t string").select(C.numbers_in("t"), C.safe_name(F.lit("a b/c?.png")), C.run_mode(F.lit("Exact_run")), C.run_token_filter(F.lit("x_drop_pad")), C.run_qid(F.lit("out/qid_ab12"))).first()
    assert list(rows) == [[1200.0, 3.5, -7.0, 100.0], "a_b_c_.png", "exact", "drop_pad_like", "ab12"]


def test_probe_scores_only_what_is_probed(spark):
    from maxloom.operators import retrieval
    from maxloom.sources.fixtures import Fixture

    f = Fixture(spark, SF)
    index, centroids = retrieval.cluster_tokens(f.pages, 6)
    got = {(r["qid"], r["q_idx"], r["doc_id"], r["page_idx"], r["token_idx"]): (r["centroid"], round(r["s"], 9)) for r in retrieval.probe(index, centroids, f.queries, 2).collect()}
    near = {}
    for q in f.queries.collect():
        order = sorted(range(6), key=lambda c: (-sum(a * b for a, b in zip(q["emb"], centroids[c])), c))
        near[q["qid"], q["q_idx"]] = (set(order[:2]), q["emb"])
    want = {}
    for t in index.collect():
        for (qid, i), (chosen, emb) in near.items():
            if t["centroid"] in chosen:
                want[qid, i, t["doc_id"], t["page_idx"], t["token_idx"]] = (t["centroid"], round(sum(a * b for a, b in zip(emb, t["emb"])), 9))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
    assert 0 < len(got) < f.queries.count() * f.pages.count()


def test_float_lists_and_base_only_weights():
    assert C.float_list("0.5, 1,,-2e1 ") == [0.5, 1.0, -20.0]
    for bad in ("", " , ", "1,x"):
        with pytest.raises(ValueError):
            C.float_list(bad)
    assert ranking.Weights().base_only and ranking.Weights(2.0).base_only and not ranking.Weights(1, 0, 0, 8).base_only
