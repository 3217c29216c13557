"""Graph operators."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release
from .components import connected_components

#: Edges of a part in which ends meet.
PART_EDGES = 2_000_000
#: Edges of a pass over the triangles.
PASS_EDGES = 100_000_000


def _numbered(ids: DataFrame) -> DataFrame:
    """(id, num): distinct ids with a number each, written once; rounds over a graph carry numbers in place of names."""
    return cut_lineage(ids.distinct().withColumn("num", F.monotonically_increasing_id()))


def communities(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, community_id): smallest id reachable over undirected edges, by star contraction in logarithmically many rounds."""
    ends = cut_lineage(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    ids = ends.select(F.col("a").alias("id")).union(ends.select("b")).filter("id is not null")
    num = _numbered(ids if nodes is None else ids.union(nodes.select("id")))
    for c in ("a", "b"):
        before, ends = ends, cut_lineage(ends.join(num.select(F.col("id").alias(c), F.col("num").alias(f"{c}_num")), c).drop(c))
        release(before)
    classes = cut_lineage(num.join(connected_components(ends.toDF("a", "b")).withColumnRenamed("node", "num"), "num", "left"))
    release(ends)
    least = classes.filter("component is not null").groupBy("component").agg(F.min("id").alias("community_id"))
    return classes.join(least, "component", "left").select("id", F.coalesce("community_id", "id").alias("community_id"))


def _pair_counts(df: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    return df.groupBy(F.col(src).cast("string").alias("source"), F.col(dst).cast("string").alias("target")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")).select("source", "target", F.lit(kind).alias("edge_type"), "weight")


def _link(df: DataFrame, src: str, dst: str, kind: str, position: str | None = None) -> DataFrame:
    weight = F.col(position).cast("double") if position else F.lit(1.0)
    return df.select(F.col(src).cast("string").alias("source"), F.col(dst).cast("string").alias("target"), F.lit(kind).alias("edge_type"), weight.alias("weight"))


def build_nodes(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(id, node_type, label) from ``{node_type: (frame, id column, label column)}``."""
    from functools import reduce
    parts = [df.select(F.col(i).cast("string").alias("id"), F.lit(kind).alias("node_type"), F.substring(F.col(l).cast("string"), 1, 50).alias("label"))
             for kind, (df, i, l) in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("id", "node_type").agg(F.min("label").alias("label"))


def build_edges(comments: DataFrame, videos: DataFrame | None = None, mentions: DataFrame | None = None, playlist_items: DataFrame | None = None,
                playlists: DataFrame | None = None, timestamp_links: DataFrame | None = None) -> DataFrame:
    """Plain edges with set semantics."""
    from functools import reduce
    parts = [_link(comments, "author_id", "id", "WROTE"), _link(comments, "id", "video_id", "ON"), _link(comments, "author_id", "video_id", "COMMENTED_ON"),
             _link(comments.filter("parent_comment_id is not null"), "id", "parent_comment_id", "REPLIES_TO")]
    if mentions is not None:
        parts.append(_link(mentions, "source_id", "canonical_name", "MENTIONS"))
    if videos is not None:
        parts.append(_link(videos, "channel_id", "id", "UPLOADED"))
    if playlist_items is not None:
        parts.append(_link(playlist_items, "playlist_id", "video_id", "CONTAINS", "position"))
    if playlists is not None:
        parts.append(_link(playlists, "channel_id", "id", "HAS_PLAYLIST"))
    if timestamp_links is not None:
        parts.append(_link(timestamp_links, "comment_id", "segment_id", "REFERENCES_TIMESTAMP", "second"))
    return dedup_edges(reduce(DataFrame.unionByName, parts))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge per source, target and type; the smallest weight stands for the first."""
    return edges.groupBy("source", "target", "edge_type").agg(F.min("weight").alias("weight"))


def counted_edges(comments: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    from .comments import replied_to
    out = replied_to(comments).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"),
                                      F.lit("REPLIED_TO").alias("edge_type"), F.col("count").cast("double").alias("weight"))
    return out if mentions is None else out.unionByName(_pair_counts(mentions, "author_id", "canonical_name", "DISCUSSES"))


def co_occurrence(mentions: DataFrame, window: int = 5) -> DataFrame:
    """(a, b, count, sources) of entities fewer than ``window`` mentions apart in one source.

    Each mention meets the positions after it by an equi join on (source, position), so a source with many
    mentions gives at most ``window - 1`` pairs per mention.
    """
    m = mentions.select("source_id", "position", "entity_id")
    ahead = m.select("source_id", F.col("position").alias("own"), F.explode(F.sequence(F.col("position"), F.col("position") + (window - 1))).alias("position"), F.col("entity_id").alias("e1"))
    other = m.withColumnRenamed("entity_id", "other")
    # at one position both mentions meet each other, so only the smaller entity counts the pair
    pairs = ahead.join(other, ["source_id", "position"]).filter("e1 < other or (e1 > other and own < position)")
    g = pairs.groupBy(F.least("e1", "other").alias("a"), F.greatest("e1", "other").alias("b"), "source_id").agg(F.count(F.lit(1)).alias("c"))
    return g.groupBy("a", "b").agg(F.sum("c").alias("count"), F.count(F.lit(1)).alias("sources"))


def relation_edges(comments: DataFrame, mentions: DataFrame, video_topics: DataFrame | None = None) -> DataFrame:
    """COVERS, PARTICIPATED_IN, ENGAGED_WITH, MENTIONED_IN and APPEARS_IN edges."""
    topics = comments.select("author_id", "channel_id", F.explode("topic_labels").alias("topic"))
    parts = [_link(topics, "author_id", "topic", "PARTICIPATED_IN"), _link(comments, "author_id", "channel_id", "ENGAGED_WITH"),
             _link(mentions, "canonical_name", "source_id", "MENTIONED_IN"), _link(mentions, "canonical_name", "video_id", "APPEARS_IN"),
             _link(topics if video_topics is None else video_topics, "channel_id", "topic", "COVERS")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def audience_overlap(members: DataFrame, min_shared: int = 3) -> DataFrame:
    """Channels that share commenters."""
    from .pairs import overlap_pairs
    return overlap_pairs(members, "channel_id", "author_id", min_shared).select(
        F.col("a").alias("channel_a"), F.col("b").alias("channel_b"), F.col("shared").alias("shared_users"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def graph_filter(nodes: DataFrame, edges: DataFrame, node_types: list[str]) -> tuple[DataFrame, DataFrame]:
    kept = nodes.filter(F.col("node_type").isin(node_types))
    return kept, induced(kept, edges)


def sample_per_type(nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n nodes of each type in the order of a seeded hash: the same rows on every run."""
    from .ordered import top_n_per_key
    return top_n_per_key(nodes.withColumn("_h", F.xxhash64("id", F.lit(seed))), "node_type", [F.asc("_h"), F.asc("id")], n).drop("_h", "rank")


def graph_snapshot(nodes: DataFrame, edges: DataFrame, node_types: list[str], limit: int = 1000, seed: int = 42):
    """(nodes, edges, totals) of an even sample over the types and the edges inside it."""
    typed = nodes.filter(F.col("node_type").isin(node_types))
    picked = sample_per_type(typed, max(limit // max(len(node_types), 1), 10), seed)
    inside = induced(picked, edges)
    totals = typed.agg(F.count(F.lit(1)).alias("total_nodes")).withColumn("sampled", F.col("total_nodes") > limit)
    return picked, inside, totals


def traverse(edges: DataFrame, start: DataFrame, max_depth: int, direction: str = "both", edge_types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(origin, id, distance): nodes within ``max_depth`` hops of each ``start(id)`` at their smallest distance."""
    if edge_types:
        edges = edges.filter(F.col("edge_type").isin(edge_types))
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("next"))
    back = edges.select(F.col("target").alias("id"), F.col("source").alias("next"))
    # parallel edges meet again in what is reached, which is smaller than the edges
    steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    seen = cut_lineage(start.select(F.col("id").alias("origin"), "id", F.lit(0).cast("long").alias("distance")))
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(steps, "id").select("origin", F.col("next").alias("id")).distinct()
        frontier = cut_lineage(reached.join(seen.select("origin", "id"), ["origin", "id"], "left_anti").withColumn("distance", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if limit is None else seen.orderBy("distance", "id").limit(limit)


def ego_graph(nodes: DataFrame, edges: DataFrame, center: str, hops: int = 2, limit: int = 500):
    start = nodes.filter(F.col("id") == center).select("id")
    near = traverse(edges, start, hops, "both", limit=limit).select("id", "distance")
    kept = nodes.join(near, "id")
    return kept, induced(kept, edges)


def entity_network(edges: DataFrame, name: str, depth: int = 2):
    """(members, edges) reachable from an entity along directed co-occurrence."""
    co = cut_lineage(edges.filter("edge_type = 'CO_OCCURS_WITH'"))  # every hop and the edges inside read it
    start = edges.sparkSession.createDataFrame([(name,)], "id string")
    members = traverse(co, start, depth, "out").filter("distance > 0").select("id", "distance")
    return members, induced(members.select("id").unionByName(start), co)


def topic_timeline(mentions: DataFrame, topic: str) -> DataFrame:
    return mentions.filter(F.contains(F.lower("canonical_name"), F.lit(topic.lower()))).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("mentions"))


# ---- measures ----------------------------------------------------------------------------

def _counted(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names are read once and left behind, and each step is stored before the one ahead of it is deleted.

    (id, num, out, into, known): every node and end of an edge with a number, its edges out and in, and whether it is a node.
    (a, b, m, ka, kb): numbers of the ends of every distinct edge, how often it is there, and the edges of both ends.
    """
    e = cut_lineage(edges.filter("source is not null and target is not null").groupBy("source", "target").agg(F.count(F.lit(1)).alias("m")))
    zero, parts = F.lit(0).cast("long"), []
    for end, out, into in (("source", F.col("m"), zero), ("target", zero, F.col("m"))):
        parts.append(e.select(F.col(end).alias("id"), out.alias("out"), into.alias("into"), F.lit(False).alias("known")))
    parts.append(nodes.select("id", zero.alias("out"), zero.alias("into"), F.lit(True).alias("known")))
    ends = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id").agg(F.sum("out").alias("out"), F.sum("into").alias("into"), F.max("known").alias("known"))
    ends = cut_lineage(ends.withColumn("num", F.monotonically_increasing_id()))
    for end, c in (("source", "a"), ("target", "b")):
        own = ends.select(F.col("id").alias(end), F.col("num").alias(c), (F.col("out") + F.col("into")).alias(f"k{c}"))
        before, e = e, cut_lineage(e.join(own, end).drop(end))
        release(before)
    return ends, e


def _parts_of(e: DataFrame) -> int:
    """Parts of at most some two million edges, and enough for all cores."""
    return max(2 * e.sparkSession.sparkContext.defaultParallelism, -(-e.count() // PART_EDGES))


def _dealt(e: DataFrame, parts: int) -> DataFrame:
    """(p, u, w, f, down): every edge, f times there, in the part of its end u with fewer edges, so a hub's edges lie in its neighbours' parts."""
    first = F.expr("ka < kb or (ka = kb and a <= b)")
    low, high = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    rows = e.select(low.alias("u"), high.alias("w"), F.col("m").alias("f"), first.alias("down"))
    return rows.withColumn("p", F.pmod(F.xxhash64("u"), F.lit(parts))).repartition(parts, "p").sortWithinPartitions("p", "u", "w")


PACKED = ["p", "low", "high", "m", "down"]


def _packed(batch: pa.Table) -> pa.Table:
    """A part's edges as bytes: places of their ends in the sorted list of its nodes, how often and which way."""
    low, high = batch.column("u").to_numpy(), batch.column("w").to_numpy()
    ids = np.unique(np.concatenate([low, high]))
    step, rows = 1 << 20, []
    for at in range(0, len(low), step):
        own = slice(at, at + step)
        rows.append([np.searchsorted(ids, x[own]).astype(np.int32).tobytes() for x in (low, high)]
                    + [batch.column("f").to_numpy()[own].tobytes(), batch.column("down").to_numpy(zero_copy_only=False)[own].tobytes()])
    columns = [pa.array(x, pa.binary()) for x in zip(*rows)]
    return pa.table([pa.array([batch.column("p")[0].as_py()] * len(rows), pa.int64()), *columns], names=PACKED)


def _flow(directed: bool):
    """What the nodes of a part hand on along its edges: (id, s), one row per node."""
    def run(edges: pa.Table, shares: pa.Table) -> pa.Table:
        if not len(edges):
            return pa.table({"id": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        ids = shares.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, share = ids[order], shares.column("share").to_numpy()[order]
        s = np.zeros(len(ids))
        for row in range(len(edges)):
            low, high, m, down = (np.frombuffer(edges.column(c)[row].as_buffer(), t) for c, t in (("low", np.int32), ("high", np.int32), ("m", np.int64), ("down", np.bool_)))
            for to, by, along in ((high, low, down), (low, high, ~down)):
                s += np.bincount(to, share[by] * (m * along if directed else m), len(s))
        return pa.table({"id": ids, "s": s})
    return run


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85, directed: bool = False) -> DataFrame:
    """Influence of every node, largest 1.

    The default sums over neighbours in both directions but divides by the outgoing degree, as the measure is
    defined; ``directed`` gives the usual PageRank.
    """
    ends, e = _counted(nodes, edges)
    out = _ranked(ends, e, rounds, damping, directed)
    release(e)
    return out


def _ranked(ends: DataFrame, e: DataFrame, rounds: int, damping: float, directed: bool) -> DataFrame:
    """Edges stay packed in the parts of their lesser ends. A round sends each node's share to the parts that hold edges of it, once
    a part and not once an edge, and what a part gathered for a node comes back as one row.
    """
    from ..functions.numbers import rnd
    n = max(ends.filter("known").count(), 1)
    parts = _parts_of(e)
    dealt = cut_lineage(_dealt(e, parts))
    packed = cut_lineage(dealt.groupBy("p").applyInArrow(_packed, "p long, low binary, high binary, m binary, down binary").repartition(parts, "p").sortWithinPartitions("p"))
    # a part asks for every node its edges name; what is no node has no rank and shares nothing
    state = ends.select(F.col("num").alias("id"), F.greatest("out", F.lit(1)).alias("d"), "known").repartition(parts, "id")
    asks = dealt.select("p", F.explode(F.array("u", "w")).alias("id")).distinct()
    asks = cut_lineage(asks.repartition(parts, "id").sortWithinPartitions("id"))
    release(dealt)
    state = cut_lineage(state.sortWithinPartitions("id"))
    base = F.when(F.col("known"), F.lit((1 - damping) / n)).otherwise(0.0)
    rank = state.select("id", "d", F.when(F.col("known"), F.lit(1.0 / n)).otherwise(0.0).alias("r"))
    for i in range(rounds):
        shares = asks.join(rank.select("id", (F.col("r") / F.col("d")).alias("share")), "id")
        sent = packed.groupBy("p").cogroup(shares.groupBy("p")).applyInArrow(_flow(directed), "id long, s double")
        got = sent.repartition(parts, "id").groupBy("id").agg(F.sum("s").alias("s"))
        before, rank = rank, cut_lineage(state.join(got, "id", "left").select("id", "d", (base + F.when(F.col("known"), damping * F.coalesce("s", F.lit(0.0))).otherwise(0.0)).alias("r")))
        if i:
            release(before)
    for df in (packed, asks, state):
        release(df)
    named = ends.filter("known").select(F.col("num"), F.col("id").alias("name")).join(rank.select(F.col("id").alias("num"), "r"), "num")
    before, rank = rank, cut_lineage(named.select(F.col("name").alias("id"), "r"))
    if rounds:
        release(before)
    top = rank.agg(F.max("r")).first()[0] or 1.0
    return rank.select("id", rnd(F.col("r") / F.lit(top), 4).alias("influence_centrality"))


def clustering_betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Local clustering over the multigraph, the betweenness estimate and bridges.

    Triangles are found from the end with fewer edges. Of the two nodes of an edge the one with fewer larger neighbours
    offers them, and each offer is looked up as an edge of the other, so no list of neighbours travels with the edges.
    """
    return _clustered(*_counted(nodes, edges))


def _clustered(ends: DataFrame, e: DataFrame) -> DataFrame:
    """Takes ``e`` over: it is deleted where it is no longer read."""
    from functools import reduce

    from ..functions.numbers import rnd
    n = max(ends.filter("known").count(), 1)
    parts = _parts_of(e)
    first = F.expr("ka < kb or (ka = kb and a <= b)")
    pairs = e.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("w"), "m")
    pairs = cut_lineage(pairs.repartition(parts, "u").groupBy("u", "w").agg(F.sum("m").alias("m")))
    slices = max(1, -(-e.count() // PASS_EDGES))
    release(e)
    ordered = pairs.filter("u <> w")
    # a loop counts twice in its node's degree
    loops = pairs.filter("u = w").select("u", (F.col("m") * 2).alias("loop"))
    ups = cut_lineage(ordered.groupBy("u").agg(F.count(F.lit(1)).alias("k")))
    inside = [df for i in range(slices) for df in _triangles(ordered, ups, parts, i, slices)]
    inside += [ordered.join(loops.select(F.col("u").alias(x), "loop"), x).select(F.col(y).alias("num"), F.col("loop").alias("c")) for x, y in (("u", "w"), ("w", "u"))]
    degree = ends.select("num", "id", "known", (F.col("out") + F.col("into")).alias("d"))
    inside.append(degree.join(loops.withColumnRenamed("u", "num"), "num").select("num", (F.col("d") * 2 - F.col("loop")).alias("c")))
    inside = reduce(DataFrame.unionByName, inside).groupBy("num").agg(F.sum("c").alias("c"))
    j = cut_lineage(degree.filter("known").join(inside, "num", "left").select("id", "d", F.coalesce("c", F.lit(0)).alias("c")))
    for df in (pairs, ups):
        release(df)
    c = F.when(F.col("d") > 0, F.col("c") / F.greatest(F.col("d") * (F.col("d") - 1), F.lit(1)))
    return j.withColumn("cl", c).select(
        "id", F.col("d").alias("degree"), rnd(F.coalesce("cl", F.lit(0.0)), 4).alias("clustering"),
        rnd(F.when(F.col("d") > 0, F.least(F.lit(1.0), (1 - F.col("cl")) * F.col("d") / n)).otherwise(0.0), 4).alias("betweenness_centrality"),
        ((F.col("d") > 3) & (F.col("cl") < 0.2)).alias("is_bridge_node"))


def _triangles(ordered: DataFrame, ups: DataFrame, parts: int, i: int, slices: int) -> list[DataFrame]:
    """(num, c): what the triangles whose least node is in slice ``i`` add to their nodes; offers of one side and slice are on disk at a time."""
    own = ordered.filter(F.pmod(F.xxhash64("u", F.lit(1)), F.lit(slices)) == i)
    # a node without larger neighbours is in the middle of no triangle
    sized = own.withColumnRenamed("m", "uw").join(ups, "u").repartition(parts, "w").join(ups.select(F.col("u").alias("w"), F.col("k").alias("kw")), "w")
    from_u = own.select("u", F.col("w").alias("x"), F.col("m").alias("ux"))
    from_w = ordered.select(F.col("u").alias("w"), F.col("w").alias("x"), F.col("m").alias("wx"))
    by_w = sized.filter("kw <= k").join(from_w, "w").join(from_u, ["u", "x"])
    by_u = sized.filter("kw > k").join(from_u, "u").filter("x <> w").join(from_w, ["w", "x"])
    share = F.explode(F.array(
        F.struct(F.col("u").alias("num"), (2 * F.col("wx")).alias("c")), F.struct(F.col("w").alias("num"), (2 * F.col("ux")).alias("c")),
        F.struct(F.col("x").alias("num"), (2 * F.col("uw")).alias("c"))))
    return [cut_lineage(tri.select(share.alias("s")).select("s.*").groupBy("num").agg(F.sum("c").alias("c"))) for tri in (by_w, by_u)]


def reciprocity_imbalance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    from ..functions.numbers import rnd
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                                          F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    g = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    j = nodes.select("id").distinct().join(g, "id", "left").fillna(0, ["o", "i"])
    return j.select("id", rnd(F.abs(F.col("i") - F.col("o")) / F.greatest(F.col("i") + F.col("o"), F.lit(1)), 3).alias("reciprocity_imbalance"))


def graph_intelligence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Names are counted and left behind once for all measures; each ends before the next begins."""
    from ..functions.numbers import rnd
    ends, e = _counted(nodes, edges)
    n = max(ends.filter("known").count(), 1)
    kind = nodes.groupBy("id").agg(F.min("node_type").alias("entity_type"))
    ranks = _ranked(ends, e, 10, 0.85, False)
    clustering = _clustered(ends, e).drop("degree", "clustering")
    return (kind.join(ranks, "id").join(clustering, "id").join(reciprocity_imbalance(nodes, edges), "id")
            .withColumn("confidence", rnd(F.lit(min(0.85, 0.3 + n * 1e-4)), 4)))
