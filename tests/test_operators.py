"""Operators on small hand tables, and folds against plain Python twins."""
import random

import pytest
from pyspark.sql import functions as F

from reeltide.operators import audio, calibration, comments, filters, graph, pairs, profiles, search, signals, temporal, trees, vectors

RAW = "platform string, platform_comment_id string, parent_id string, author_id string, video_id string, text string, like_count long, timestamp_posted long"


def raw(spark, rows):
    return spark.createDataFrame([("yt", f"yt:{k}", p, "a", "v", t, 0, i) for i, (k, p, t) in enumerate(rows)], RAW)


def test_threads_drop_subtrees_and_accept_both_parent_forms(spark):
    df = raw(spark, [("r", "root", "hello"), ("1", "r", "with bare parent"), ("2", "yt:1", "with prefix"), ("3", "gone", "orphan reply"), ("4", "r", "  "), ("5", "4", "below an empty one"),
                     ("x", "y", "a cycle"), ("y", "x", "a cycle")])
    got = {r["platform_comment_id"]: (r["root_thread_id"], r["depth_level"]) for r in comments.build_threads(df).collect()}
    assert got == {"yt:r": ("yt:r", 0), "yt:1": ("yt:r", 1), "yt:2": ("yt:r", 2)}


def test_threads_stop_at_max_depth(spark):
    chain = [("0", "root", "start here")] + [(str(i), str(i - 1), "next reply") for i in range(1, 26)]
    depths = [r["depth_level"] for r in comments.build_threads(raw(spark, chain)).collect()]
    assert sorted(depths) == list(range(21))


def test_new_replies_attach_to_stored_parents(spark):
    stored = spark.createDataFrame([("yt:old", "yt:top", 3)], "platform_comment_id string, root_thread_id string, depth_level long")
    got = comments.build_threads(raw(spark, [("old", "root", "again"), ("n", "old", "new reply")]), stored).collect()
    assert [(r["platform_comment_id"], r["root_thread_id"], r["depth_level"]) for r in got] == [("yt:n", "yt:top", 4)]


def test_closure_distance_is_depth_difference(spark):
    df = spark.createDataFrame([(i, None if i == 0 else (i - 1) // 2 if i % 3 else i - 1) for i in range(40)], "id long, parent_comment_id long")
    depth = {r["id"]: r["depth"] for r in trees.resolve_chains(df, "id", "parent_comment_id").collect()}
    rows = trees.ancestor_closure(df, max_distance=64).collect()
    assert len(rows) == sum(depth.values())
    assert all(depth[r["descendant"]] - depth[r["ancestor"]] == r["distance"] for r in rows)


def twin_suppress(points, gap):
    kept = []
    for p in sorted(points):
        if kept and p[0] - kept[-1][0] < gap:
            if p[2] > kept[-1][2]:
                kept[-1] = p
        else:
            kept.append(p)
    return {p[1] for p in kept}


@pytest.mark.parametrize("block", [2.0, 7.0, 600.0])
def test_suppress_nearby_equals_sequential_walk(spark, block):
    rng = random.Random(3)
    pts = [(round(rng.uniform(0, 60), 1), i, round(rng.random(), 2)) for i in range(120)]
    df = spark.createDataFrame([("v", i, t, m) for t, i, m in pts], "video_id string, id long, timestamp double, magnitude double")
    assert {r["id"] for r in audio.suppress_nearby(df, 3.0, block).collect()} == twin_suppress(pts, 3.0)


def twin_chunks(pieces, target, overlap, fillers=("um", "like")):
    out, texts, start = [], [], None
    for s, e, t in pieces:
        start = s if start is None else start
        t = " ".join(w for w in t.split() if w.lower() not in fillers)
        if not t:
            continue
        texts.append(t)
        if e - start >= target:
            out.append([round(start, 2), round(e, 2), " ".join(texts)])
            texts, start = [], None
    if texts:
        out.append([round(start, 2), round(pieces[-1][1], 2), " ".join(texts)])
    for i in range(1, len(out)):
        out[i][0] = round(min(out[i][0], max(out[i - 1][0], out[i - 1][1] - overlap)), 2)
    return [tuple(c) for c in out]


@pytest.mark.parametrize("block", [60.0, 600.0])
def test_chunks_equal_sequential_merge(spark, block):
    rng, t, pieces = random.Random(5), 0.0, []
    for i in range(80):
        d = round(rng.uniform(0.5, 6), 1)
        pieces.append((round(t, 1), round(t + d, 1), rng.choice(["um", f"word{i} like", f"some text {i}", ""])))
        t += d
    df = spark.createDataFrame([("v", s, e, x, -0.25) for s, e, x in pieces], "video_id string, start double, end double, text string, avg_log_prob double")
    got = [(r["start_time"], r["end_time"], r["text"]) for r in audio.chunk_transcript(df, 15.0, 2.0, block).orderBy("end_time").collect()]
    want = twin_chunks(pieces, 15.0, 2.0)
    assert [w[2] for w in want] == [g[2] for g in got]
    assert all(abs(w[i] - g[i]) < 0.011 for w, g in zip(want, got) for i in (0, 1))


WINDOW = "video_id string, id long, start_time double, end_time double, music_probability double, speech_probability double, dominant_source string, loudness_lufs double, spectral_centroid double, harmonic_ratio double, event_tags array<struct<label:string,confidence:double>>"


def test_change_point_of_music_start(spark):
    df = spark.createDataFrame([("v", 1, 0.0, 5.0, 0.0, 0.9, "speech", -20.0, 2000.0, 0.5, []), ("v", 2, 5.0, 10.0, 0.9, 0.0, "music", -8.0, 2000.0, 0.5, [("applause", 0.6)])], WINDOW)
    r = audio.change_points(df).first()
    assert (r["transition_type"], r["from_state"], r["to_state"]) == ("speech_to_music", "speech", "music")
    assert r["magnitude"] == 1.0
    types = [s["type"] for s in audio.change_signals(df).first()["signals"]]
    assert types == ["speech_to_music", "energy_spike", "event_onset"]


def test_pagerank_twin(spark):
    nodes = list("abcde")
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("a", "b")]
    adj = {n: [] for n in nodes}
    out = {n: 0 for n in nodes}
    for s, t in edges:
        adj[s].append(t)
        adj[t].append(s)
        out[s] += 1
    pr = {n: 0.2 for n in nodes}
    for _ in range(10):
        pr = {n: 0.15 / 5 + 0.85 * sum(pr[x] / max(out[x], 1) for x in adj[n]) for n in nodes}
    n = spark.createDataFrame([(x, "T") for x in nodes], "id string, node_type string")
    e = spark.createDataFrame([(*x, "E", 1.0) for x in edges], "source string, target string, edge_type string, weight double")
    got = {r["id"]: r["influence_centrality"] for r in graph.pagerank(n, e).collect()}
    top = max(pr.values())
    assert got == {k: pytest.approx(v / top, abs=1e-4) for k, v in pr.items()}
    assert max(r["influence_centrality"] for r in graph.pagerank(n, e, directed=True).collect()) == 1.0


def test_clustering_twin_with_loops_and_parallel_edges(spark):
    rng = random.Random(2)
    nodes = list(range(12))
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(40)]
    adj = {n: [] for n in nodes}
    for s, t in edges:
        adj[s].append(t)
        adj[t].append(s)
    want = {}
    for v in nodes:
        near = set(adj[v])
        d = len(adj[v])
        want[v] = sum(1 for x in near for y in adj[x] if y in near) / max(d * (d - 1), 1) if d else 0.0
    n = spark.createDataFrame([(x, "T") for x in nodes], "id long, node_type string")
    e = spark.createDataFrame(edges, "source long, target long")
    got = {r["id"]: r["clustering"] for r in graph.clustering_betweenness(n, e).collect()}
    assert got == {k: pytest.approx(v, abs=1e-4) for k, v in want.items()}


def test_communities_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "source long, target long")
    got = graph.communities(e, spark.createDataFrame([(900,)], "id long")).groupBy("community_id").count().collect()
    assert {(r["community_id"], r["count"]) for r in got} == {(0, 201), (500, 2), (900, 1)}


@pytest.mark.parametrize("t", [1, 2, 3])
def test_overlap_pairs_brute_force(spark, t):
    rng = random.Random(4)
    sets = {g: {0, 1} | {rng.randint(2, 25) for _ in range(6)} for g in range(15)}
    df = spark.createDataFrame([(g, i) for g, s in sets.items() for i in s], "g long, i long")
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t}
    assert {tuple(r) for r in pairs.overlap_pairs(df, "g", "i", t).collect()} == want


def test_vector_topk_blocks_equal_single_matrix(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "id long, vector array<float>")
    q = corpus.filter("id < 20").select(F.col("id").alias("query_id"), "vector")
    one = vectors.vector_topk(corpus, q, 5).orderBy("query_id", "rank").collect()
    many = vectors.vector_topk(corpus, q, 5, block=3).orderBy("query_id", "rank").collect()
    assert one == many and all(r["id"] == r["query_id"] for r in one if r["rank"] == 1)
    assert vectors.vector_topk(corpus, q.limit(0), 5).count() == 0


def test_frame_summary(spark):
    tags = spark.createDataFrame([(1, "scene", "street", 1), (1, "scene", "park", 2), (1, "object", "car", 1), (1, "object", "dog", 2), (2, "object", "cup", 1)], "id long, category string, label string, rank int")
    got = {r["id"]: (r["scene_label"], r["top_objects"]) for r in vectors.frame_summary(tags).collect()}
    assert got == {1: ("street", ["car", "dog"]), 2: ("unknown", ["cup"])}


def test_worked_example_of_query_understanding(spark):
    q = spark.createDataFrame([(1, "guy struggling playing tetris at score 1296")], "query_id long, text string")
    r = search.decompose_query(q).first()
    assert (r["emotion"], r["actions"], r["numbers"], r["objects"]) == ("struggling", ["playing"], ["1296"], ["score", "tetris"])
    assert r["keywords"] == ["1296", "playing", "score", "tetris"]
    assert sum(search.L.FUSION_WEIGHTS.values()) == pytest.approx(1.0)


def test_inclusion_needs_all_scores_low(spark):
    e = spark.createDataFrame([(0.1, 0.1, 0.1), (0.3, 0.0, 0.0), (0.0, 0.15, 0.0)], "text_semantic double, visual_similarity double, ocr_match double")
    kept = search.inclusion_threshold(e, {"text_semantic": 0.25, "visual_similarity": 0.15, "ocr_match": 0.30}).count()
    assert kept == 2


def test_short_series_take_defaults(spark):
    for n in (1, 2, 3, 4, 5, 10, 16):
        u = spark.createDataFrame([("c", i, i * 86400) for i in range(n)], "channel_id string, video_id long, t long").withColumn("ts", F.timestamp_seconds("t"))
        r = temporal.upload_cadence(u).first()
        assert r["mean_interval_hours"] == (24.0 if n >= 3 else 0.0)
        assert r["confidence"] == pytest.approx(min(0.95, 0.3 + 0.02 * n) if n >= 3 else 0.1)
        assert (r["dominant_period_days"] is None) == (n < 4)
        assert temporal.break_spikes(u).count() == 0
        assert temporal.infer_timezone(u).first()["peak_local_hour"] == (12 if n < 10 else (0 + int(temporal.infer_timezone(u).first()["inferred_tz_offset"])) % 24)


def test_reuse_brute_force(spark):
    rng = random.Random(8)
    rows = [(v, f"c{v % 4}", float(k), f"h{rng.randint(0, 5)}") for v in range(6) for k in range(12)]
    df = spark.createDataFrame(rows, "video_id long, channel_id string, timestamp double, hash string")
    h = {(v, int(k)): x for v, _, k, x in rows}
    want = set()
    for a in range(6):
        for b in range(a + 1, 6):
            for o in range(-11, 12):
                run = 0
                for k in range(13):
                    if k < 12 and 0 <= k + o < 12 and h[a, k] == h[b, k + o]:
                        run += 1
                    else:
                        if run >= 2:
                            want.add((a, b, float(k - run), float(k - run + o), float(run)))
                        run = 0
    assert {tuple(r)[:5] for r in signals.reuse(df).collect()} == want


def test_intent_of_a_tutorial(spark):
    d = spark.createDataFrame([("v", "How to install it? A step by step guide because it is definitely great", 60.0)], "video_id string, text string, duration_s double")
    r = profiles.semantic_intent(d).first()
    assert (r["primary_intent"], r["persuasion_style"], r["certainty_ratio"], r["bias_framing_polarity"]) == ("tutorial", "logical", 1.0, 1.0)
    assert r["rhetorical_question_density"] == 1.0


def test_fits_recover_known_curves(spark):
    rows = [("audio.pitch_shift", i / 200, 1 if (i * 7919) % 1000 < 1000 / (1 + 2.718281828 ** -(4 * i / 200 - 2)) else 0) for i in range(200)]
    s = spark.createDataFrame(rows, "target string, raw double, truth int")
    p = calibration.fit_platt(s)
    assert 2.5 < p["a"] < 5.5 and -3 < p["b"] < -1
    iso = calibration.fit_isotonic(s)
    assert iso["predictions"] == sorted(iso["predictions"])
    t = calibration.fit_temperature(s)["temperature"]
    assert calibration.log_loss(s, t) <= min(calibration.log_loss(s, x / 10) for x in range(1, 100)) + 1e-6
    few = calibration.fit_all(s.limit(29))
    assert few.filter("fitted").count() == 0
    assert calibration.fit_all(s).filter("fitted").first()["target"] == "audio.pitch_shift"


def test_drop_hallucinations(spark):
    s = spark.createDataFrame([(1, "thank you thank you thank you thank you", 0.0, 1.0), (2, "a fine line", 0.0, 1.0)], "id long, text string, start_time double, end_time double")
    assert [r["id"] for r in audio.drop_hallucinations(s).collect()] == [2]


def test_search_filters_are_all_honoured(spark):
    v = spark.createDataFrame([(1, "en", 0.9, "c", "youtube", ["a"], 60, 10, "2024-01-02", "text"), (2, "fr", 0.1, "d", "vimeo", ["b"], 600, 1, "2020-01-01", "visual")],
                              "id long, language string, confidence double, channel_id string, platform string, tags array<string>, duration_seconds int, view_count int, uploaded_at string, modality string")
    for f in ({"language": "en"}, {"min_confidence": 0.5}, {"channels": ["c"]}, {"platform": "youtube"}, {"tags": ["a", "z"]}, {"max_duration": 100}, {"min_views": 5}, {"uploaded_after": "2023-01-01"}, {"modality": "text"}):
        assert [r["id"] for r in filters.search_filter(v, **f).collect()] == [1], f
    for f in ({"min_duration": 100}, {"max_views": 5}, {"uploaded_before": "2023-01-01"}):
        assert [r["id"] for r in filters.search_filter(v, **f).collect()] == [2], f
