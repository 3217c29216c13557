"""Hand tables for cases that SQL over the supplied tables does not reach."""
import numpy as np
import pytest

from reeltide.operators import comments as C
from reeltide.operators import filters as L
from reeltide.operators import graph as G
from reeltide.operators import recrawl as R
from reeltide.operators import search as S
from reeltide.operators import vectors as V
from reeltide.operators.components import connected_components
from reeltide.sources import readers


def test_entities_of_any_length_are_found(spark):
    q = spark.createDataFrame([(1, "where is the Duke of New York city and spider-man"), (2, "AC/DC live"), (3, None)], "query_id int, text string")
    e = spark.createDataFrame([("duke of new york",), ("spider-man",), ("new york city",), ("ac/dc",), ("x",), ("batman",), ("",)], "canonical_name string")
    got = sorted(tuple(r) for r in S.query_entities(q, e).collect())
    assert got == [(1, "duke of new york"), (1, "new york city"), (1, "spider-man"), (2, "ac/dc")]


def test_pairs_at_one_position_count_once(spark):
    m = spark.createDataFrame([("s", 1, 10), ("s", 1, 20), ("s", 3, 30), ("s", 9, 40)], "source_id string, position int, entity_id int")
    got = sorted(tuple(r) for r in G.co_occurrence(m, 5).collect())
    assert got == [(10, 20, 1, 1), (10, 30, 1, 1), (20, 30, 1, 1)]


def test_untouched_records_stay(spark):
    old = spark.createDataFrame([("p1", "a", 1, "indexed", "n1"), ("p2", "b", 2, "queued", "n2"), ("p3", "c", 3, "failed", "n3")], "platform_id string, title string, like_count long, status string, note string")
    old = old.selectExpr("*", "timestamp'2023-01-01' AS last_crawled_at")
    new = spark.createDataFrame([("p1", "a2", 1), ("p3", "c", None), ("p4", "d", 4)], "platform_id string, title string, like_count long")
    got = {r["platform_id"]: r for r in R.apply_recrawl(old, new, "2024-02-01").collect()}
    assert (got["p1"]["title"], got["p1"]["status"], got["p1"]["note"], str(got["p1"]["updated_at"])[:10]) == ("a2", "reindexing", "n1", "2024-02-01")
    assert (got["p2"]["status"], str(got["p2"]["last_crawled_at"])[:4], got["p2"]["updated_at"]) == ("queued", "2023", None)
    assert (got["p3"]["status"], got["p3"]["like_count"], str(got["p3"]["last_crawled_at"])[:4], got["p3"]["updated_at"]) == ("failed", 3, "2024", None)
    assert got["p4"]["status"] == "discovered"


def test_upsert_takes_one_row_per_key_and_new_columns(spark):
    old = spark.createDataFrame([(1, "a")], "id int, title string")
    new = spark.createDataFrame([(1, "b", 1, "x"), (1, "c", 2, "y"), (2, "d", 1, None)], "id int, title string, seen int, extra string")
    got = {r["id"]: (r["title"], r["extra"]) for r in readers.upsert(old, new, ["id"], "2024-01-01", ["seen"]).collect()}
    assert got == {1: ("c", "y"), 2: ("d", None)}


def test_signals_without_a_home_are_an_error(spark):
    videos = spark.createDataFrame([(1, 7)], "id int, channel_id int")
    moved = spark.createDataFrame([(7, 8), (9, 7), (1, 2)], "from_channel int, to_channel int")
    assert L.channel_signals({"commenter_migrations": moved, "entity_propagations": moved.select("to_channel")}, videos, 7).count() == 2
    with pytest.raises(ValueError):
        L.channel_signals({"odd": moved.select("to_channel")}, videos, 7)


def test_filters_without_a_column_are_an_error(spark):
    t = spark.createDataFrame([(1, 1)], "id int, video_id int")
    with pytest.raises(ValueError):
        S.search(None, {"segments": t, "frames": t, "comments": t, "videos": t, "channels": t}, {"language": "en"})


def test_thirty_ancestors(spark):
    rows = [(i, i - 1 if i else None, f"a{i}", f"t{i}") for i in range(31)]
    c = spark.createDataFrame(rows, "id long, parent_comment_id long, author_id string, text string")
    got = C.parent_chain(c, spark.createDataFrame([(30,)], "id long")).collect()
    assert len(got) == 30 and {r["text"] for r in got} == {f"t{i}" for i in range(30)}


@pytest.mark.parametrize("dim", [64, 1024])
def test_near_copies_and_few_candidates(spark, dim):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, dim))
    near = base[:40] + rng.normal(size=(40, dim)) * 0.1  # cosine about 0.995
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near, base[:5]]))] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = {r["id"]: r["component_id"] for r in V.near_duplicates(df, 0.98).collect()}
    assert got == {**{i: i for i in range(400)}, **{400 + i: i for i in range(40)}, **{440 + i: i for i in range(5)}, 999: 999}
    from reeltide.functions.scores import l2_normalize
    pairs = V.candidate_pairs(df.filter("id < 440").select("id", l2_normalize("vector").alias("u")), 0.98)
    assert pairs.count() < 3 * 440


def test_components_of_paths_and_hubs(spark):
    e = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
