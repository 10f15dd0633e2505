"""Operators over groups of rows: 1, 3, 4, 6, 8, and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests_llm_data import prose

from maxloom.llm import common, embed_dedup, exact_dedup, mixing, ngram_join, suffix_dedup
from maxloom.llm.anchors import runs
from maxloom.llm.induced import repeated_starts


def smallest_reachable(links, ids):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    rng = random.Random(1)
    links += [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(80)]
    got = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest_reachable(links, {x for p in links for x in p})
    assert got == {i: want[i] for p in links if p[0] != p[1] for i in p}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_pairs_meet_once(spark):
    df = spark.range(700).select(F.col("id").alias("k"), F.lit(700).alias("size"))
    met = collections.Counter()
    groups = collections.defaultdict(list)
    for r in common.block_pairs(df, F.col("size"), 128, "k").collect():
        groups[r["i"], r["j"]].append((r["k"], r["side"]))
    for (i, j), members in groups.items():
        members.sort()
        for x in range(len(members)):
            for y in range(x + 1, len(members)):
                if (i == j) or members[x][1] != members[y][1]:
                    met[members[x][0], members[y][0]] += 1
    assert len(met) == 700 * 699 // 2 and set(met.values()) == {1}


def test_tables_can_be_dropped(spark):
    table = common.materialize(spark.range(3).toDF("a"), "gone")
    path, start = common._written[-1], common.tables_written()
    assert table.count() == 3
    for k in range(3):
        last = common.materialize(spark.range(k).toDF("a"), "kept")
    assert common.drop_tables(spark, start, but_last=True) == 2 and last.count() == 2 and common.tables_written() == start + 1
    assert common.drop_tables(spark) >= 2 and common.drop_tables(spark) == 0
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


# 1


def jaccard_links(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], sets


def near_copies(seed, families, each):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        words = prose(rng, rng.randrange(40, 200)).split(" ")
        for k in range(each):
            mine = list(words)
            for _ in range(rng.randrange(0, 6)):
                mine[rng.randrange(len(mine))] = prose(rng, 1) + str(k)
            rows.append((1000 * f + k, " ".join(mine)))
    return rows


@pytest.mark.parametrize("block_rows", [256, 4])
def test_ngram_join_equals_brute_force(spark, awkward, awkward_rows, monkeypatch, block_rows):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 1000 * block_rows)
    monkeypatch.setattr(ngram_join, "NODE_ROWS", 4 * block_rows)
    rows = [r for r in awkward_rows if r[0] is not None and r[0] != 9] + near_copies(3, 8, 12)
    docs = awkward.select("doc_id", "text").where("doc_id <> 9").union(spark.createDataFrame([r for r in rows if r[0] > 200], "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    links, sets = jaccard_links(rows)
    want = smallest_reachable(links, sets)
    degree = collections.Counter(x for p in links for x in p)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs.withColumn("k", F.lit("x"))).collect()}
    assert got == {i: (want[i], degree[i]) for i in sets}
    assert len(links) > 100


def test_ngram_join_keeps_repeated_rows_and_empty_tables(awkward, awkward_rows, nothing):
    assert ngram_join.ngram_join(awkward).count() == sum(i is not None for i, _ in awkward_rows)
    assert ngram_join.ngram_join(nothing).count() == 0
    assert ngram_join.depth_for(0.8, 0.999) == 5 and ngram_join.depth_for(0.8, 0.9999) == 4


def test_near_copies_go_by_id_and_text(spark):
    rng = random.Random(3)
    base, other = prose(rng, 80), prose(rng, 80)
    rows = [(1, base), (2, base + " more"), (2, other), (3, other.upper()), (None, base), (4, None)]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, base), (2, other), (0, base), (4, "")])


def test_prefixes_are_shortened_until_the_recall_holds(spark):
    # Pairs of like similarity: copies with few changes need no shortening, those near the threshold do.
    assert ngram_join.missed_share({159: 10_000}, 0.8, 8) < 1e-4 < ngram_join.missed_share({130: 1000}, 0.8, 6)
    rng = random.Random(9)
    depths = {}
    for changes, families in ((1, 400), (14, 40)):
        rows = []
        for f in range(families):
            words = prose(rng, 700).split(" ")
            for k in range(2):
                for at in rng.sample(range(len(words)), changes * k):
                    words[at] = prose(rng, 2).replace(" ", "")
                rows.append((2 * f + k, " ".join(words)))
        signed = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.lower("text").alias("text"), F.lit(0).cast("long").alias("h")).mapInArrow(ngram_join._signatures(5), "doc_id long, h long, k long, n int, sig binary").select("k", "sig").cache()
        edges, depths[changes] = ngram_join.candidates(signed, 0.8, 0.999)
        links, _ = jaccard_links(rows)
        assert len(links) > families / 3 and edges.distinct().count() >= 0.99 * len(links)
    assert depths[1] == ngram_join.MAX_DEPTH and depths[14] <= 6


# 3


def test_embed_dedup_recall_and_counts(spark):
    rng = np.random.default_rng(2)
    rows = []
    for f in range(150):
        centre = rng.normal(size=24)
        for _ in range(8):
            rows.append((len(rows), [float(x) for x in (centre + rng.normal(size=24) * 0.22).astype(np.float32)], f % 3))
    rows += [(len(rows) + i, rows[5][1], rows[5][2]) for i in range(40)]
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, None] * 12]
    rows += [(5000 + i, v, 1) for i, v in enumerate(bad)] + [(6000, rows[0][1], None), (6001, [1.0, 2.0], 1), (6002, [1.0, 2.0], 1), (None, rows[0][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("k", F.lit(1)).withColumn("v", F.lit("x"))
    got = {r["vec_id"]: r for r in embed_dedup.embed_dedup(table).collect()}
    ok = [(i, np.array(v, float), label) for i, v, label in rows if i is None or i < 5000]
    x = np.stack([v / np.linalg.norm(v) for _, v, _ in ok])
    label = np.array([c for _, _, c in ok])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    ids = [i for i, _, _ in ok]
    found = sum(got[i]["n_links"] for i in ids)
    assert found <= near.sum() and found >= 0.97 * near.sum() and near.sum() > 2000
    assert all(got[i]["n_links"] <= n for i, n in zip(ids, near.sum(1), strict=True))
    for i in [*range(5000, 5006), 6000]:
        assert tuple(got[i]) == (i, 0, i, True)
    assert got[6002]["component_id"] == 6001 and got[6002]["n_links"] == 1
    assert len(got) == len(rows) and got[None]["component_id"] == 0 and not got[None]["kept"]
    unnamed = embed_dedup.embed_dedup(table.withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert sum(r["n_links"] for r in unnamed if r["n_links"] > 1) >= 0.97 * near.sum() and all(r["component_id"] is None and r["kept"] for r in unnamed)
    assert embed_dedup.embed_dedup(table.limit(0)).count() == 0


def test_embed_dedup_deep_trees_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "LEAF_ROWS", 16)
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(100, 64))
    rows = [(i, [float(v) for v in (centres[i % 100] + rng.normal(size=64) * 0.2).astype(np.float32)], 0) for i in range(800)]
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.embed_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    assert all(got[i] <= near[i].sum() - 1 for i in got) and sum(got.values()) >= 0.9 * (near.sum() - len(rows)) > 1000


# 4


def brute_repeats(texts, span):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - span + 1):
            if count[d[i : i + span]] > 1:
                gone[i : i + span] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def test_repeated_starts_equal_brute_force():
    rng = random.Random(0)
    for trial in range(150):
        letters = [b"ab", b"abc", b"a", bytes(range(256)), b"the quick \n"][trial % 5]
        parts = []
        for _ in range(rng.randrange(1, 8)):
            old = rng.choice(parts)[rng.randrange(3) :] if parts and rng.random() < 0.5 else b""
            parts.append(bytes(rng.choice(letters) for _ in range(rng.randrange(6 if old else 60))) + old + bytes(rng.choice(letters) for _ in range(rng.randrange(6))))
        span = rng.choice([1, 2, 3, 5, 9, 20])
        count = collections.Counter(p[i : i + span] for p in parts for i in range(len(p) - span + 1))
        for memory in (0, 1 << 20):  # with no memory every queue goes to disk
            for part, hit in zip(parts, repeated_starts(parts, span, memory), strict=True):
                assert hit.tolist() == [count[part[i : i + span]] > 1 for i in range(max(0, len(part) - span + 1))]


def test_runs_cover_every_start_once(monkeypatch):
    from maxloom.llm import anchors

    rng = random.Random(1)
    text = prose(rng, 3000).encode()
    data = np.frombuffer(text * 2 + text[:100], np.uint8)
    at = np.array([0, len(text), 2 * len(text), len(data)])
    whole = runs(data, at, 400)
    assert len(whole.row) and sorted(np.concatenate([np.arange(s, s + c) + at[r] for r, s, c in zip(whole.row, whole.start, whole.count, strict=True)])) == [i for r in range(3) for i in range(at[r], at[r + 1] - 399)]
    first, second = (set(zip(whole.start[whole.row == r], whole.anchor[whole.row == r], whole.content[whole.row == r], strict=True)) for r in (0, 1))
    assert first == second
    monkeypatch.setattr(anchors, "PART", 1000)
    parts = runs(data, at, 400)
    assert len(parts.start) >= len(whole.start) and parts.count.sum() == whole.count.sum()


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"shard_bytes": 1, "queue_bytes": 0}])
def test_suffix_dedup_equals_brute_force(spark, awkward, awkward_rows, options):
    rng = random.Random(6)
    passage = prose(rng, 160)
    shared = [(500 + i, f"{prose(rng, rng.randrange(5, 90))} {passage} {prose(rng, rng.randrange(5, 90))}") for i in range(12)]
    shared += [(600, "ab" * 700), (601, "x" * 399), (602, "y" * 401), (603, "z" * 2000 + passage)]
    rows = [*awkward_rows, (None, None), (None, passage), (None, passage), *shared]
    docs = awkward.select("doc_id", "text", "windows", "h").unionByName(spark.createDataFrame([(None, None), (None, passage), (None, passage)], "doc_id long, text string"), allowMissingColumns=True).unionByName(spark.createDataFrame(shared, "doc_id long, text string"), allowMissingColumns=True)
    got = sorted((tuple(r) for r in suffix_dedup.suffix_dedup(docs, **options).collect()), key=repr)
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], 400), strict=True)), key=repr)


def test_suffix_dedup_of_nothing(nothing):
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


# 6


def test_exact_dedup_equals_brute_force(awkward, awkward_rows, nothing):
    rows = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in awkward_rows]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, least[t], len(groups[t]), i == least[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted(map(tuple, exact_dedup.exact_dedup(awkward).collect()), key=repr) == want
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_tells_rows_of_a_repeated_id_apart(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "b"), (4, "c"), (4, "d")]
    got = sorted((r["doc_id"], r["text_sha256"][:8], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sha = {t: hashlib.sha256(t.encode()).hexdigest()[:8] for t in "abcd"}
    assert got == sorted([(1, sha["a"], 1, 2, True), (1, sha["b"], 1, 3, True), (2, sha["a"], 1, 2, False), (3, sha["b"], 1, 3, False), (3, sha["b"], 1, 3, False), (4, sha["c"], 4, 1, True), (4, sha["d"], 4, 1, True)])


@pytest.mark.parametrize("huge", [exact_dedup.HUGE, 0])
def test_exact_dedup_keeps_one_of_rows_without_ids(spark, huge):
    rows = [(None, "a"), (None, "a"), (None, "b"), (0, "b"), (None, "c"), (1, "d"), (None, "a"), (2, "e")]
    got = sorted((tuple(r)[:4] for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), huge=huge).collect()), key=repr)
    assert got == sorted([(None, None, 3, True), (None, None, 3, False), (None, None, 3, False), (None, 0, 2, False), (0, 0, 2, True), (None, None, 1, True), (1, 1, 1, True), (2, 2, 1, True)], key=repr)


def test_exact_dedup_of_huge_texts_hashes_chunks_apart(spark, awkward, awkward_rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COMPARE_CHARS", 7)
    want = sorted(map(tuple, exact_dedup.exact_dedup(awkward).collect()), key=repr)
    got = exact_dedup.exact_dedup(awkward, huge=10)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) == len(awkward_rows)


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.Polynomial, "of", lambda self, data: 1)
    monkeypatch.setattr(exact_dedup, "COMPARE_CHARS", 4)
    rows = [(1, "abcdefgh"), (2, "abcdefgX"), (3, "abcdefgh"), (4, "abcdefgX"), (5, "Zbcdefgh"), (6, "other")]

    def run():
        return {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    # Workers import the module anew, so the collision is made by patching what they call through a closure.
    original = exact_dedup._fingerprints

    def collide(batches):
        import pyarrow as pa

        for b in original(batches):
            yield b.set_column(2, "print", pa.array([1] * b.num_rows, pa.int64()))

    monkeypatch.setattr(exact_dedup, "_fingerprints", collide)
    assert run() == {1: (1, 2), 2: (2, 2), 3: (1, 2), 4: (2, 2), 5: (5, 1), 6: (6, 1)}


def test_fingerprints_combine():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    small, large = exact_dedup.Polynomial(64), exact_dedup.Polynomial(8192)
    assert small.of(data) == large.of(data)
    left, right = large.of_chunk(data[:1234]), large.of_chunk(data[1234:])
    assert large.combine(left, right, 5000 - 1234) == large.of_chunk(data)
    assert large.of(data[:10]) != large.of(np.concatenate([[0], data[:10]]).astype(np.uint8))


# 8


def schedule_by_simulation(slots, length):
    period, done, picks = sum(slots), [0] * len(slots), []
    for t in range(length):
        ready = [(-(-(done[i] + 1) * period // w), i) for i, w in enumerate(slots) if done[i] * period // w <= t]
        _, i = min(ready)
        done[i] += 1
        picks.append(i)
    return picks


def test_schedule_equals_simulation_and_stays_within_a_block(spark):
    for slots in ([1], [3, 1], [5, 3, 2], [50, 30, 1, 1, 18], [1] * 7):
        picks = spark.range(1).select(F.expr(mixing.schedule_sql(slots))).first()[0]
        assert picks == schedule_by_simulation(slots, sum(slots))
        placed = np.zeros(len(slots))
        for t, i in enumerate(picks, 1):
            placed[i] += 1
            assert np.abs(placed - t * np.array(slots) / sum(slots)).max() < 1


def test_mix_gives_every_row_one_place_and_keeps_to_weights(spark):
    rng = random.Random(5)
    rows = [(i, rng.choices(["a", "b", "c", None], [60, 20, 15, 5])[0]) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, source string").withColumn("bucket", F.lit("x")).withColumn("number", F.lit("y"))
    got = mixing.mix(table, {"a": 2, "b": 2, "c": 1, None: 1}, block_docs=4, period=60).toPandas()
    assert len(got) == 3000 and sorted(got.doc_id) == list(range(3000))
    assert (got.groupby(["slot", "place"]).size() == 1).all()
    source = got.source.fillna("none")
    assert (source.groupby(got.slot).nunique() == 1).all()
    taken = got[got.in_mix].assign(source=source).groupby("slot").source.first()
    assert sorted(taken.index) == list(range(len(taken)))
    shares = mixing.shares(source.value_counts().to_dict(), {"a": 2, "b": 2, "c": 1, "none": 1}, 60)
    placed = dict.fromkeys(shares, 0)
    for t, s in enumerate(taken, 1):
        placed[s] += 1
        assert max(abs(placed[x] - t * shares[x] / 60) for x in shares) < 1
    # The mix ends because a source has run out.
    counts = source.value_counts()
    assert any(placed[s] == -(-counts[s] // 4) for s in shares)


def test_mix_of_repeated_rows_unweighted_sources_and_nothing(awkward, awkward_rows, nothing):
    assert mixing.mix(awkward).count() == len(awkward_rows)
    assert mixing.mix(awkward, {"web": 1.0}).where("source IS NULL AND NOT in_mix AND slot IS NULL").count() == sum((i or 0) % 3 == 0 for i, _ in awkward_rows)
    assert mixing.mix(nothing).count() == 0


def test_tiny_and_null_sources_do_not_end_the_mix(spark):
    sizes = {**{f"s{k:02}": 1000 for k in range(20)}, "tiny": 5, None: 3}
    table = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    got = mixing.mix(table).toPandas()
    assert len(got) == 20_008 and got.in_mix.all() and not got.duplicated(["slot", "place"]).any()
    # Their one block is not put first, and the others stay near equal all the way.
    end, source = got.slot.max(), got.source.fillna("none")
    assert all(end * 0.1 < got.slot[source == s].iloc[0] < end * 0.9 for s in ("tiny", "none"))
    for t in range(0, end, 100):
        placed = source[got.slot < t].value_counts().reindex([s for s in sizes if s not in ("tiny", None)], fill_value=0)
        assert placed.max() - placed.min() <= 3 * mixing.BLOCK_DOCS
    # Weights by size keep nearly all; what an ended mix leaves out keeps its slot.
    weighted = mixing.mix(table, sizes).toPandas()
    assert weighted.in_mix.sum() > 19_800 and weighted.slot.notna().all()


def test_more_sources_than_lanes_are_spread_evenly(spark):
    sizes = {**{f"s{k:02}": 40 + 10 * k for k in range(30)}, "big": 2000, None: 90}
    table = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    got = mixing.mix(table, max_sources=5).toPandas()
    assert len(got) == sum(sizes.values()) and got.in_mix.all() and not got.duplicated(["slot", "place"]).any()
    # Each source is within a few blocks of its share all along.
    source, rank = got.source.fillna("none"), got.sort_values(["slot", "place"]).reset_index(drop=True)
    named = rank.source.fillna("none")
    for s, n in sizes.items():
        at = np.flatnonzero(named == (s or "none"))
        assert len(at) == n and np.abs((np.arange(n) + 0.5) / n - at / len(got)).max() < 0.12, s
    with pytest.raises(ValueError):
        mixing.mix(table, dict.fromkeys(map(str, range(6)), 1.0), max_sources=5)


def test_mix_places_rows_of_equal_ids_by_what_else_they_hold(spark):
    rows = [(1, "a", f"text {k}") for k in range(200)] + [(None, "a", f"other {k}") for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    first = {r["text"]: (r["slot"], r["place"]) for r in mixing.mix(table).collect()}
    second = {r["text"]: (r["slot"], r["place"]) for r in mixing.mix(table.repartition(7, "text").orderBy(F.desc("text"))).collect()}
    assert first == second and len(set(first.values())) == 400


def test_a_hot_source_is_kept_whole_and_spread_to_the_end(spark):
    sizes = {"hot": 3000, **{f"s{k:02}": 300 for k in range(20)}}
    table = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    got = mixing.mix(table).toPandas()
    assert len(got) == 9000 and got.in_mix.all()
    for t in range(0, got.slot.max(), 50):
        now = got[got.slot < t]
        assert abs((now.source == "hot").sum() - len(now) / 3) <= 4 * mixing.BLOCK_DOCS
    report = {r["source"]: r for r in mixing.left_out(mixing.mix(table, dict.fromkeys(sizes, 1))).collect()}
    assert {s: r["n_rows"] for s, r in report.items()} == sizes and all(r["n_in_mix"] + r["n_left_out"] == r["n_rows"] for r in report.values())
    assert report["hot"]["n_left_out"] > 2600 and report["s00"]["n_left_out"] <= 2 * mixing.BLOCK_DOCS


# Pipeline


def pipeline_by_hand(rows, good):
    """(doc_id, text) left after each of the first three stages, in plain Python."""
    kept = [r for r in rows if (r[0], r[1]) in good]
    out = {"quality": list(kept)}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for i, t in kept:
        if i is not None:
            least[norm(t)] = min(i, least.get(norm(t), i))
    seen, exact = set(), []
    for i, t in kept:
        if i is None or (i == least[norm(t)] and (i, norm(t)) not in seen):
            exact.append((i, t))
            seen.add((i, norm(t)))
    out["exact"] = exact
    keyed = {n: t for n, (i, t) in enumerate(exact) if i is not None}
    links, sets = jaccard_links(list(keyed.items()))
    root = smallest_reachable(links, sets)
    first = {}
    for n, r in root.items():
        first[r] = min(exact[n][0], first.get(r, exact[n][0]))
    out["near"] = [x for n, x in enumerate(exact) if x[0] is None or x[0] == first[root[n]]]
    return out


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline
    from maxloom.llm import quality
    from maxloom.llm.queries import word_vocabulary
    from maxloom.llm.wordpiece import WordEncoder

    rng = random.Random(21)
    rows, labels = [], []
    for i in range(260):
        words = prose(rng, rng.randrange(30, 90)).split(" ")
        if i % 4 == 0:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 != 0), 0))
    clean = [r for r in rows if r[0] % 4]
    for k in range(40):
        i, t = clean[k]
        words = t.split(" ")
        words[rng.randrange(len(words))] = "other"
        rows += [(300 + k, t.replace(" ", " \n")), (400 + k, " ".join(words))]
    rows += [(clean[50][0], clean[51][1]), clean[52], clean[52], (clean[53][0], "own text of a repeated id"), (None, clean[54][1]), (None, None), (700, None), (701, ""), (702, " ")]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}") for i, t in rows], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for name, table in (("documents", docs.withColumn("extra", F.lit(1))), ("labels", marked)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    now, got = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    model = quality.train(docs, marked)
    scores = {r[1]: float(model.score(quality.statistics(pa.array([r[1]], pa.string())))[0]) for r in rows}
    want = pipeline_by_hand(rows, {r for r in rows if scores[r[1]] >= 0.3})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = now.collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    texts = {name: sorted([(r["doc_id"], r["text"]) for r in got[name]], key=key) for name in ("quality", "near", "mix")}
    assert texts["quality"] == sorted(want["quality"], key=key)
    canon = lambda rows: sorted(((i, re.sub(r"\s+", " ", t or "")) for i, t in rows), key=key)
    assert canon((r["doc_id"], r["text"]) for r in got["exact"]) == canon(want["exact"])
    # Of rows equal but for white space either text may stay.
    assert canon(texts["near"]) == canon(want["near"]) and texts["mix"] == texts["near"]
    library = WordEncoder(word_vocabulary()).library
    tokens = collections.Counter()
    for r in got["pack"]:
        tokens[r["doc_id"]] += r["length"]
    expected = collections.Counter()
    for i, t in texts["mix"]:
        expected[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert tokens == expected
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_stages_keep_clean_documents_once(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        words = prose(rng, rng.randrange(40, 120)).split(" ")
        if i % 4 == 0:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
        labels.append((i, int(i % 4 != 0), 0))
    clean = next(r for r in rows if r[0] % 4)
    rows += [(1000, clean[1].replace(" ", "  "), "en", "s0"), (1001, clean[1].replace(" ", "\n"), "en", "s1"), (1002, clean[1] + " extra", "en", "s2"), (1003, None, "en", None), (1004, "", None, "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        if name != "pack":
            assert now.columns == docs.columns
    assert {i for i in range(240) if i % 4} <= seen["quality"] and not {i for i in range(240) if i % 4 == 0} & seen["quality"]
    assert clean[0] in seen["exact"] and not {1000, 1001} & seen["exact"]
    assert clean[0] in seen["near"] and 1002 not in seen["near"] and {i for i in range(240) if i % 4} <= seen["near"]
    assert seen["mix"] <= seen["near"] and seen["pack"] == seen["mix"]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in again.select("doc_id").collect()} == seen["pack"]
