"""Graph analysis by iterated joins over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once; loops are left out."""
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, centrality): neighbours divided by the other nodes; a lone node has 0."""
    both = undirected(edges)
    degree = both.groupBy("src").agg(F.count("*").alias("degree"))
    n = degree.agg(F.count("*").alias("n"))
    return degree.crossJoin(F.broadcast(n)).select(F.col("src").alias("node"), F.round(F.coalesce(F.try_divide("degree", F.col("n") - 1), F.lit(0.0)), 6).alias("centrality"))


def graph_stats(edges: DataFrame, kind: str = "relation_type") -> DataFrame:
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    by_kind = edges.groupBy(kind).agg(F.count("*").alias("edges"))
    return by_kind.crossJoin(F.broadcast(nodes.agg(F.count("node").alias("nodes"))))


def hops_from(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(origin, node, hops): breadth-first distance from each start (origin), with the path's last step.

    A round is one join of the frontier with the edges and an anti join with the
    frontier and the one before it, as edges go both ways; it ends when the
    frontier is empty, or after ``most`` rounds where that is given.
    """
    both = materialize(undirected(edges), "edges")
    front = materialize(start.select("origin", F.col("origin").alias("node"), F.lit(0).alias("hops"), F.lit(None).cast(dict(both.dtypes)["src"]).alias("before")).distinct(), "frontier")
    reached, latest, last, hop = None, front, front, 0
    while most is None or hop < most:
        hop += 1
        step = front.join(both, front["node"] == both["src"]).groupBy("origin", "dst").agg(F.min("src").alias("before"))
        known = front.select("origin", "node").unionByName(last.select("origin", "node"))
        step = step.select("origin", F.col("dst").alias("node"), F.lit(hop).alias("hops"), "before").join(known, ["origin", "node"], "left_anti")
        last, front = front, materialize(step, "frontier")
        if not front.limit(1).count():
            break
        latest = latest.unionByName(front)
        if hop % 32 == 0:  # so that plans stay short
            latest = materialize(latest, "reached")
            reached = latest if reached is None else reached.unionByName(latest)
            latest = latest.limit(0)
    return latest if reached is None else reached.unionByName(latest)


#: Steps of a path that one plan walks back.
STEPS = 16


def path_between(edges: DataFrame, source, target) -> DataFrame:
    """(step, node): a shortest path, step 0 the source; no rows where there is none.

    The smallest predecessor wins ties. From x to itself the path is x, if x is in
    the graph. The path is walked back by joins of one row, ``STEPS`` in a plan.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    start = undirected(edges).where(F.col("src") == F.lit(source)).select(F.col("src").alias("origin")).distinct()
    reached = materialize(hops_from(edges, start).select("node", "hops", "before"), "reached")
    walk = reached.where(F.col("node") == F.lit(target)).select(F.array("node").alias("path"), F.col("before").alias("at"), "hops")
    walk = materialize(walk, "walk")
    end = walk.first()
    left = end.hops if end else 0
    back = reached.select("node", F.col("before").alias("further"))
    while left > 0:
        for _ in range(min(STEPS, left)):
            walk = walk.join(back, F.col("at") == F.col("node")).select(F.concat(F.array("node"), "path").alias("path"), F.col("further").alias("at"), "hops")
        walk, left = materialize(walk, "walk"), left - STEPS
    return walk.select(F.posexplode("path").alias("step", "node")).select("step", F.col("node").cast(kind).alias("node"))


def shortest_path(edges: DataFrame, source, target) -> list:
    """The nodes of ``path_between``; [] if there is none or a node is unknown."""
    return [r.node for r in path_between(edges, source, target).orderBy("step").collect()]


def simple_paths(edges: DataFrame, source, target, most: int = 5) -> DataFrame:
    """(path): all paths without repeats of at most ``most`` (never above 5) steps."""
    both = undirected(edges)
    spark = edges.sparkSession
    paths = spark.createDataFrame([([source],)], f"path array<{dict(edges.dtypes)['src']}>")
    done = None
    for _ in range(min(most, 5)):
        longer = paths.join(both, F.element_at("path", -1) == both["src"]).where(~F.array_contains("path", F.col("dst")))
        longer = materialize(longer.select(F.concat("path", F.array("dst")).alias("path")), "paths")
        ended = longer.where(F.element_at("path", -1) == F.lit(target))
        done = ended if done is None else done.unionByName(ended)
        paths = longer.where(F.element_at("path", -1) != F.lit(target))
    return done


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component): connected components named by their smallest node.

    Every round a node takes the smallest label of itself and its neighbours, and
    then the label of that label, so that distances shrink by half.
    """
    both = materialize(undirected(edges), "edges")
    labels = materialize(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("component")), "labels")
    done = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy("src").agg(F.min("c").alias("c"))
        step = labels.join(near.withColumnRenamed("src", "node"), "node").select("node", "component", F.least("component", "c").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        step = materialize(step.join(jump, "low", "left").select("node", "component", F.least("low", F.coalesce("far", "low")).alias("next")), "labels")
        changed = step.where("next <> component").limit(1).count()
        labels = step.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
        done += 1
        if most is not None and done >= most:
            raise RuntimeError(f"components have not settled after {most} rounds")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community): synchronous label propagation, ties to the smallest label."""
    both = materialize(undirected(edges), "edges")
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max("n").alias("top"))
        pick = votes.join(best, "src").where("n = top").groupBy("src").agg(F.min("label").alias("new"))
        step = materialize(labels.join(pick.withColumnRenamed("src", "node"), "node").select("node", "label", "new"), "lpa")
        changed = step.where("label <> new").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            break
    # a community is named by its smallest node
    names = labels.groupBy("label").agg(F.min("node").alias("community"))
    return labels.join(names, "label").select("node", "community")


def expand_graph(edges: DataFrame, entities: DataFrame, k: int, depth: int = 2, decay: float = 0.5) -> DataFrame:
    """(chunk_id, score): chunks of edges near the entities; score = confidence * decay ** depth, the best per chunk.

    edges: src, dst, chunk_id, confidence. Breadth first: an entity counts at its
    least depth.
    """
    front, seen, hits = entities.select("entity").distinct(), None, None
    for d in range(depth):
        touching = edges.join(front.withColumnRenamed("entity", "src"), "src", "left_semi").unionByName(edges.join(front.withColumnRenamed("entity", "dst"), "dst", "left_semi").select(*edges.columns))
        scored = touching.select("chunk_id", (F.col("confidence") * decay**d).alias("score"))
        hits = scored if hits is None else hits.unionByName(scored)
        seen = front if seen is None else seen.unionByName(front)
        ends = touching.select(F.col("src").alias("entity")).union(touching.select(F.col("dst").alias("entity"))).distinct()
        front = ends.join(seen, "entity", "left_anti")
    return hits.groupBy("chunk_id").agg(F.round(F.max("score"), 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)
