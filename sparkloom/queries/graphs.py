"""Queries of graph analysis over the supplier - nation - region graph."""

from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import query, table

_EDGES = """SELECT 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst, 'in_nation' AS relation_type, s_suppkey AS chunk_id, (s_suppkey % 10 + 1) / 10.0::DOUBLE AS confidence FROM supplier
    UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'in_region', -n_nationkey, 1.0 FROM nation"""


def _edges(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    a = s.select(tag("S", "s_suppkey").alias("src"), tag("N", "s_nationkey").alias("dst"), F.lit("in_nation").alias("relation_type"), F.col("s_suppkey").alias("chunk_id"), ((F.col("s_suppkey") % 10 + 1) / 10).alias("confidence"))
    b = n.select(tag("N", "n_nationkey").alias("src"), tag("R", "n_regionkey").alias("dst"), F.lit("in_region").alias("relation_type"), (-F.col("n_nationkey")).cast("long").alias("chunk_id"), F.lit(1.0).alias("confidence"))
    return a.unionByName(b)


_BOTH = f"SELECT DISTINCT src, dst FROM (SELECT src, dst FROM ({_EDGES}) UNION ALL SELECT dst, src FROM ({_EDGES})) WHERE src <> dst"


@query(f"SELECT src AS node, round(count(*) / ((SELECT count(DISTINCT src) FROM ({_BOTH})) - 1)::DOUBLE, 6) AS centrality FROM ({_BOTH}) GROUP BY src")
def degree_centrality(spark, d):
    return G.degree_centrality(_edges(spark, d))


@query(f"SELECT relation_type, count(*) AS edges, (SELECT count(DISTINCT src) FROM ({_BOTH})) AS nodes FROM ({_EDGES}) GROUP BY relation_type")
def graph_stats(spark, d):
    return G.graph_stats(_edges(spark, d))


@query(
    f"""WITH RECURSIVE b AS ({_BOTH}), r AS (SELECT 'R0' AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM r JOIN b ON src = node WHERE hops < 8) SELECT 'R0' AS origin, node, min(hops) AS hops FROM r GROUP BY node"""
)
def hops_from_region(spark, d):
    start = spark.createDataFrame([("R0",)], "origin string")
    return G.hops_from(_edges(spark, d), start).select("origin", "node", "hops")


@query(
    f"""WITH RECURSIVE b AS ({_BOTH}), r AS (SELECT src AS node, src AS other FROM b UNION SELECT r.node, dst FROM r JOIN b ON src = other) SELECT node, min(other) AS component FROM r GROUP BY node"""
)
def components(spark, d):
    return G.components(_edges(spark, d))


@query()
def communities(spark, d):
    return G.label_propagation(_edges(spark, d))


@query(
    f"""WITH RECURSIVE b AS ({_BOTH}), r AS (SELECT ['N0'] AS path UNION ALL SELECT list_append(path, dst) FROM r JOIN b ON src = path[-1] WHERE NOT list_contains(path, dst) AND path[-1] <> 'R0' AND len(path) <= 3)
    SELECT array_to_string(path, ' ') AS path FROM r WHERE path[-1] = 'R0'"""
)
def paths_between(spark, d):
    return G.simple_paths(_edges(spark, d), "N0", "R0", 3).select(F.array_join("path", " ").alias("path"))


@query(
    f"""WITH e AS ({_EDGES}), h AS (SELECT chunk_id, confidence AS score FROM e WHERE src = 'N0' OR dst = 'N0'),
    n AS (SELECT src AS x FROM e WHERE dst = 'N0' UNION SELECT dst FROM e WHERE src = 'N0'), t AS (SELECT chunk_id, confidence * 0.5 FROM e WHERE src IN (SELECT x FROM n) OR dst IN (SELECT x FROM n))
    SELECT chunk_id, round(max(score), 6) AS score FROM (SELECT * FROM h UNION ALL SELECT * FROM t) GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 40"""
)
def graph_expansion(spark, d):
    return G.expand_graph(_edges(spark, d), spark.createDataFrame([("N0",)], "entity string"), 40)


@query(
    f"""SELECT 'edges' AS section, '<edge source="' || src || '" target="' || dst || '"><data key="relation">' || relation_type || '</data></edge>' AS line FROM ({_EDGES})
    UNION ALL SELECT DISTINCT 'nodes', '<node id="' || src || '"><data key="type">' || CASE WHEN src LIKE 'N%' THEN 'nation &amp; state' ELSE 'unknown' END || '</data></node>' FROM ({_BOTH})"""
)
def graph_export(spark, d):
    from ..operators.export import graphml

    types = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"), F.lit("nation & state").alias("type"))
    return graphml(_edges(spark, d), types)


@query(
    f"""WITH RECURSIVE b AS ({_BOTH}), t AS (SELECT 'S' || min(s_suppkey) AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0),
    r AS (SELECT ['R0'] AS path UNION ALL SELECT list_append(path, dst) FROM r JOIN b ON src = path[-1] WHERE NOT list_contains(path, dst) AND len(path) <= 4)
    SELECT i - 1 AS step, path[i] AS node FROM (SELECT path, unnest(generate_series(1, len(path))) AS i FROM (SELECT path FROM r, t WHERE path[-1] = node ORDER BY len(path), path LIMIT 1))"""
)
def shortest_path(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation").where("n_regionkey = 0")
    first = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).agg(F.min("s_suppkey").alias("s")).first().s
    return G.path_between(_edges(spark, d), "R0", f"S{first}")
