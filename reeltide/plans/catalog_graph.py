"""Named queries: the knowledge graph."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import adapters as A
from .catalog_comments import with_entities
from .catalog_listing import EDGES, MENT, NODES, graph_edges, mention_rows, nodes
from .models_sql import r, sql


def comment_mentions(s, d):
    from ..operators.comments import entity_mentions
    c = with_entities(s, d)
    return entity_mentions(c).join(c.select(F.col("id").alias("source_id"), "author_id"), "source_id")


def positions(s, d):
    """Mentions of an order numbered by part and line."""
    return A.mentions(s, d).select("source_id", "entity_id").distinct().withColumn("position", F.col("entity_id") % 40)


def co_edges(s, d):
    e = G.co_occurrence(positions(s, d), 5)
    return e.select(F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("target"), F.lit("CO_OCCURS_WITH").alias("edge_type"),
                    F.col("count").cast("double").alias("weight"))


SNAP_TYPES = ["Channel", "Entity", "Topic"]

QUERIES = {
    "build_nodes": lambda s, d: G.build_nodes({
        "Video": (A.videos(s, d), "id", "title"), "Channel": (A.channels(s, d), "id", "name"),
        "Comment": (A.comments(s, d), "id", "text"), "CommentAuthor": (A.comments(s, d), "author_id", "author_id")}),
    "build_edges": lambda s, d: G.build_edges(A.comments(s, d), A.videos(s, d), mention_rows(s, d)),
    "counted_edges": lambda s, d: G.counted_edges(A.comments(s, d), comment_mentions(s, d)),
    "co_occurrence": lambda s, d: G.co_occurrence(positions(s, d), 5),
    "relation_edges": lambda s, d: G.relation_edges(A.comments(s, d), mention_rows(s, d)),
    "audience_overlap": lambda s, d: G.audience_overlap(A.author_channels(s, d), 3),
    "graph_snapshot": lambda s, d: snapshot(s, d),
    "graph_filter": lambda s, d: G.graph_filter(nodes(s, d), graph_edges(s, d), ["CommentAuthor", "Channel"])[1],
    "ego_graph": lambda s, d: G.ego_graph(nodes(s, d), graph_edges(s, d), "s3", 2, 1000000)[0],
    "traverse": lambda s, d: G.traverse(graph_edges(s, d), nodes(s, d).filter("node_type = 'Topic'"), 2, "out"),
    "entity_network": lambda s, d: G.entity_network(co_edges(s, d), "5", 2)[0],
    "topic_timeline": lambda s, d: G.topic_timeline(mention_rows(s, d), "tion"),
    "pagerank": lambda s, d: G.pagerank(nodes(s, d), graph_edges(s, d)),
    "clustering_betweenness": lambda s, d: G.clustering_betweenness(nodes(s, d), mesh(s, d)),
    "reciprocity_imbalance": lambda s, d: G.reciprocity_imbalance(nodes(s, d), graph_edges(s, d)),
    "graph_intelligence": lambda s, d: G.graph_intelligence(nodes(s, d), graph_edges(s, d)),
    "communities": lambda s, d: G.communities(graph_edges(s, d)),
    "ego_graph_edges": lambda s, d: G.ego_graph(nodes(s, d), graph_edges(s, d), "s3", 2, 1000000)[1],
    "entity_network_edges": lambda s, d: G.entity_network(co_edges(s, d), "5", 2)[1],
}


def snapshot(s, d):
    """Size of the sample and of its inner edges; which nodes are drawn is a hash order."""
    n, e, t = G.graph_snapshot(nodes(s, d), graph_edges(s, d), SNAP_TYPES, 120)
    return n.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


def mesh(s, d):
    """The graph with customer to nation and part to nation edges, which close triangles, and a few loops."""
    c = A.table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("s"), F.col("c_nationkey")).alias("target"))
    p = A.table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("s"), F.col("s_nationkey")).alias("target"))
    return graph_edges(s, d).select("source", "target").unionByName(c).unionByName(p)


CM = """cm AS (SELECT lower(trim(w)) AS canonical_name, id AS source_id, author_id, video_id FROM (SELECT id, author_id, video_id,
   unnest(list_distinct(list_filter(list_filter(string_split_regex(text,'\\s+'), lambda w: w<>''), lambda q: length(q)>=8))) AS w FROM comments) WHERE length(trim(w))>=2)"""
POS = "ps AS (SELECT DISTINCT source_id, entity_id, entity_id%40 AS position FROM mentions)"
CO = """co AS (SELECT least(x.entity_id,y.entity_id) AS a, greatest(x.entity_id,y.entity_id) AS b, count(*) AS count, count(DISTINCT x.source_id) AS sources FROM ps x JOIN ps y
   ON x.source_id=y.source_id AND (y.position-x.position BETWEEN 1 AND 4 OR (y.position=x.position AND x.entity_id<y.entity_id)) AND x.entity_id<>y.entity_id GROUP BY 1,2)"""
MESH = """me AS (SELECT source, target FROM edges UNION ALL SELECT 'c' || c_custkey, 's' || c_nationkey FROM customer
   UNION ALL SELECT 's' || s_suppkey, 's' || s_nationkey FROM supplier)"""
PR = """nn AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM nodes), adj AS (SELECT source AS u, target AS w FROM edges UNION ALL SELECT target, source FROM edges),
  od AS (SELECT source AS w, count(*) AS d FROM edges GROUP BY 1), fl AS (SELECT u, w, count(*)/greatest(coalesce(any_value(d),1),1) AS f FROM adj LEFT JOIN od USING (w) GROUP BY 1,2),
  p0 AS (SELECT DISTINCT id, 1/n AS r FROM nodes, nn), """ + ", ".join(
    f"p{i} AS (SELECT p0.id, 0.15/n+0.85*coalesce(s,0) AS r FROM nn, p0 LEFT JOIN (SELECT u AS id, sum(f*r) AS s FROM fl JOIN p{i - 1} q ON q.id=fl.w GROUP BY 1) g USING (id))" for i in range(1, 11))


def clustering(src):
    return f"""ma AS (SELECT source AS u, target AS w FROM {src} UNION ALL SELECT target, source FROM {src}), ms AS (SELECT u, w, count(*) AS m FROM ma GROUP BY 1,2),
  dg AS (SELECT u, CAST(sum(m) AS BIGINT) AS d FROM ms GROUP BY 1), mc AS (SELECT count(DISTINCT id) AS nodes_n FROM nodes),
  ne AS (SELECT a.u AS id, CAST(sum(b.m) AS BIGINT) AS c FROM ms a JOIN ms b ON b.u=a.w JOIN ms c ON c.u=a.u AND c.w=b.w GROUP BY 1),
  cb AS (SELECT x.id, coalesce(d,0) AS degree, CASE WHEN d>0 THEN coalesce(c,0)/greatest(d*(d-1),1) END AS cl, nodes_n FROM (SELECT DISTINCT id FROM nodes) x LEFT JOIN dg ON dg.u=x.id LEFT JOIN ne USING (id), mc)"""


BETWEEN = r("CASE WHEN degree>0 THEN least(1.0,(1-cl)*degree/nodes_n) ELSE 0 END", 4)
BRIDGE = "degree>3 AND coalesce(cl,1)<0.2"
RECIP = """rc AS (SELECT id, abs(i-o)/greatest(i+o,1) AS x FROM (SELECT id, coalesce(o,0) AS o, coalesce(i,0) AS i FROM (SELECT DISTINCT id FROM nodes) LEFT JOIN (SELECT source AS id, count(*) AS o FROM edges GROUP BY 1) USING (id)
   LEFT JOIN (SELECT target AS id, count(*) AS i FROM edges GROUP BY 1) USING (id)))"""


def lk(kind, src, dst, table, where="true"):
    return f"SELECT CAST({src} AS VARCHAR) AS source, CAST({dst} AS VARCHAR) AS target, '{kind}' AS edge_type, 1.0::DOUBLE AS weight FROM {table} WHERE {where}"


ORACLE = {
    "build_nodes": sql("comments videos channels", """SELECT CAST(id AS VARCHAR) AS id, 'Video' AS node_type, substr(title,1,50) AS label FROM videos UNION SELECT CAST(id AS VARCHAR), 'Channel', substr(name,1,50) FROM channels
        UNION SELECT CAST(id AS VARCHAR), 'Comment', substr(text,1,50) FROM comments UNION SELECT author_id, 'CommentAuthor', author_id FROM comments"""),
    "build_edges": sql("comments videos", " UNION ".join([lk("WROTE", "author_id", "id", "comments"), lk("ON", "id", "video_id", "comments"), lk("COMMENTED_ON", "author_id", "video_id", "comments"),
        lk("REPLIES_TO", "id", "parent_comment_id", "comments", "parent_comment_id IS NOT NULL"), lk("UPLOADED", "channel_id", "id", "videos"), lk("MENTIONS", "id", "canonical_name", "ment")]), MENT),
    "counted_edges": sql("comments", """SELECT c.author_id AS source, p.author_id AS target, 'REPLIED_TO' AS edge_type, count(*)::DOUBLE AS weight FROM comments c JOIN comments p ON c.parent_comment_id=p.id
        WHERE c.author_id<>p.author_id GROUP BY 1,2 UNION ALL SELECT author_id, canonical_name, 'DISCUSSES', count(*)::DOUBLE FROM cm GROUP BY 1,2""", CM),
    "co_occurrence": sql("mentions", "SELECT a, b, count, sources FROM co", POS, CO),
    "relation_edges": sql("comments", " UNION ".join([lk("PARTICIPATED_IN", "author_id", "t", "(SELECT author_id, unnest(topic_labels) AS t FROM comments)"), lk("ENGAGED_WITH", "author_id", "channel_id", "comments"),
        lk("MENTIONED_IN", "canonical_name", "source_id", "cm"), lk("APPEARS_IN", "canonical_name", "video_id", "cm"), lk("COVERS", "channel_id", "t", "(SELECT channel_id, unnest(topic_labels) AS t FROM comments)")]), CM),
    "audience_overlap": sql("author_channels", """SELECT x.channel_id AS channel_a, y.channel_id AS channel_b, count(*) AS shared_users FROM (SELECT DISTINCT author_id, channel_id FROM author_channels) x
        JOIN (SELECT DISTINCT author_id, channel_id FROM author_channels) y ON x.author_id=y.author_id AND x.channel_id<y.channel_id GROUP BY 1,2 HAVING count(*)>=3"""),
    "graph_snapshot": f"WITH {NODES} SELECT node_type, least(count(*),40) AS n FROM nodes WHERE node_type IN ('Channel','Entity','Topic') GROUP BY 1",
    "graph_filter": f"WITH {NODES}, {EDGES} SELECT * FROM edges WHERE source[1] IN ('c','s') AND target[1] IN ('c','s')",
    "ego_graph": f"""WITH {NODES}, {EDGES}, u AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges) SELECT id, node_type, min(dist) AS distance FROM nodes JOIN (
        SELECT 's3' AS id, 0::BIGINT AS dist UNION ALL SELECT b, 1 FROM u WHERE a='s3' UNION ALL SELECT y.b, 2 FROM u x JOIN u y ON x.b=y.a WHERE x.a='s3') USING (id) GROUP BY 1,2""",
    "traverse": f"""WITH {EDGES} SELECT origin, id, min(dist) AS distance FROM (SELECT 'n' || n_nationkey AS origin, 'n' || n_nationkey AS id, 0::BIGINT AS dist FROM nation
        UNION ALL SELECT source, target, 1 FROM edges WHERE source[1]='n' UNION ALL SELECT x.source, y.target, 2 FROM edges x JOIN edges y ON x.target=y.source WHERE x.source[1]='n') GROUP BY 1,2""",
    "entity_network": sql("mentions", """SELECT id, min(dist) AS distance FROM (SELECT b AS id, 1::BIGINT AS dist FROM co WHERE a=5 UNION ALL
        SELECT y.b, 2 FROM co x JOIN co y ON x.b=y.a WHERE x.a=5) GROUP BY 1""".replace("SELECT id, min", "SELECT CAST(id AS VARCHAR) AS id, min"), POS, CO),
    "ego_graph_edges": f"""WITH {NODES}, {EDGES}, u AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
        k AS (SELECT id FROM nodes WHERE id IN (SELECT 's3' UNION SELECT b FROM u WHERE a='s3' UNION SELECT y.b FROM u x JOIN u y ON x.b=y.a WHERE x.a='s3'))
        SELECT * FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)""",
    "entity_network_edges": sql("mentions", """SELECT CAST(a AS VARCHAR) AS source, CAST(b AS VARCHAR) AS target, 'CO_OCCURS_WITH' AS edge_type, count::DOUBLE AS weight FROM co
        WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)""", POS, CO, "k AS (SELECT 5 AS id UNION SELECT b FROM co WHERE a=5 UNION SELECT y.b FROM co x JOIN co y ON x.b=y.a WHERE x.a=5)"),
    "topic_timeline": sql("comments", "SELECT CAST(ts AS DATE) AS day, count(*) AS mentions FROM ment WHERE contains(canonical_name,'tion') GROUP BY 1", MENT),
    "pagerank": f"WITH {NODES}, {EDGES}, {PR} SELECT id, {r('r/max(r) OVER ()', 4)} AS influence_centrality FROM p10",
    "clustering_betweenness": f"WITH {NODES}, {EDGES}, {MESH}, {clustering('me')} SELECT id, degree, {r('coalesce(cl,0)', 4)} AS clustering, {BETWEEN} AS betweenness_centrality, {BRIDGE} AS is_bridge_node FROM cb",
    "reciprocity_imbalance": f"WITH {NODES}, {EDGES}, {RECIP} SELECT id, {r('x', 3)} AS reciprocity_imbalance FROM rc",
    "graph_intelligence": f"""WITH {NODES}, {EDGES}, {PR}, {clustering('edges')}, {RECIP} SELECT id, node_type AS entity_type, {r('r/max(r) OVER ()', 4)} AS influence_centrality, {BETWEEN} AS betweenness_centrality,
        {BRIDGE} AS is_bridge_node, {r('x', 3)} AS reciprocity_imbalance, {r('least(0.85, 0.3+nn.n*1e-4)', 4)} AS confidence FROM nodes JOIN p10 USING (id) JOIN cb USING (id) JOIN rc USING (id), nn""",
}
