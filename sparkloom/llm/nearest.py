"""Problem 5: nearest vectors by a hierarchical k-means tree.

The tree has two parts. The upper one routes: its leaves are partitions of about
``partition_rows`` vectors, their number grows with the rows. It is fitted on a
bounded sample (``SAMPLE_ROWS``); partitions that turn out too large are split
further by a level of k-means that is fitted for each of them on the cluster. The
lower part is fitted inside the task that holds a partition, down to leaves of
``LEAF_ROWS`` vectors, so what a vector is compared with does not grow with the
table as it would in leaves of a fixed number.

A query walks either part best bin first: a priority queue holds the nodes seen,
the one whose centre is most similar is taken next, and the walk goes on while
that is within a margin of the first leaf's. The margins, and with them the number
of leaves visited, are widened on samples until the recall asked for is reached.
Every vector is indexed. Vectors meet their visitors in a grid of cells per
partition (blocks of vectors by blocks of visitors), so one that cannot be split
and holds a third of all rows is spread over many tasks. Equal vectors are
searched once and their lists shared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.vector_tree import LEAF_ROWS, PARTITION_ROWS, calibrate_margin, meet, place, routing_tree
from ..plans.materialize import materialize

#: Rows that may be broadcast (three longs each); beyond it a shuffled join runs.
SMALL_ROWS = 50_000


def usable_vectors(table: DataFrame, id_col: str, vector_col: str, dim: int = 64) -> DataFrame:
    """(id, v) of the rows with an id and ``dim`` finite numbers, not all zero."""
    v = F.col(vector_col).cast("array<float>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = table.where(F.col(id_col).isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0))
    return good.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def nearest(
    table: DataFrame, id_col: str, vector_col: str, k: int = 5, least_cosine: float | None = None, recall: float = 0.99,
    queries: DataFrame | None = None, dim: int = 64, partition_rows: int = PARTITION_ROWS, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(id, other, cosine): of every usable vector its k most similar others.

    Cosines are rounded to six places; ties go to the smaller id. With
    ``least_cosine`` only others at least that similar are listed. ``queries``
    (id) restricts for whom lists are made, not what is searched. A vector counts
    if it has ``dim`` finite numbers, not all zero. Each id counts once; should its
    rows hold different vectors, the one with the least hash counts. Equal vectors
    share one search. Only the two named columns are read. Empty tables and those
    without usable vectors give an empty result.
    """
    spark, schema = table.sparkSession, "id long, other long, cosine double"
    vectors = usable_vectors(table, id_col, vector_col, dim)
    total = vectors.count()
    if total == 0:
        return spark.createDataFrame([], schema)
    level = (1 + recall) / 2  # of either part of the tree
    tree, sample = routing_tree(vectors, total, dim, partition_rows)
    margin = calibrate_margin(sample, tree, k, level, least_cosine)
    asks = F.lit(True)
    if queries is not None:  # whoever holds the vector of a query asks, so that copies may stand for it
        wanted = queries.select("id").distinct()
        asked = vectors.join(wanted, "id").select(F.xxhash64("v").alias("key")).distinct().withColumn("asked", F.lit(True))
        vectors = vectors.withColumn("key", F.xxhash64("v")).join(asked, "key", "left")
        asks = F.coalesce("asked", F.lit(False))
    placed = place(vectors.withColumn("asks", asks), tree, margin, dim)
    placed = placed.withColumn("h", F.unhex(F.md5("vec"))).withColumn("row", F.monotonically_increasing_id())
    placed = materialize(placed, "placed")
    # one row stands for each vector; those of the others stay out of the search
    held = placed.groupBy("id").agg(F.min("h").alias("h"))
    reps = held.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    copies = materialize(held.join(reps.where("n > 1"), "h").select("id", "rep"), "copies")
    stand = placed.select("id", "h", "row").join(reps.select(F.col("rep").alias("id"), "h"), ["id", "h"]).groupBy("id").agg(F.min("row").alias("row"))
    spare = materialize(placed.select("row").join(stand.select("row"), "row", "left_anti"), "spare-rows")
    search = placed.select("id", "vec", "asks", "bins", "row").join(F.broadcast(spare) if spare.count() <= SMALL_ROWS else spare, "row", "left_anti")
    met = meet(search, k, least_cosine, level, queries is None, partition_rows, leaf_rows)
    best = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    first_k = lambda df: df.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth")
    lists = materialize(first_k(met), "lists")
    # copies: their smallest ids stand for the group wherever one of it is listed
    by_rep = Window.partitionBy("rep").orderBy("id")
    heads = materialize(copies.withColumn("nth", F.row_number().over(by_rep)).where(F.col("nth") <= k + 1).drop("nth"), "copy-heads")
    listed = lists.join(heads.select(F.col("rep").alias("other"), F.col("id").alias("copy")), "other", "left")
    listed = first_k(listed.select("id", F.coalesce("copy", "other").alias("other"), "cosine"))
    shared = listed.withColumnRenamed("id", "rep").unionByName(heads.select("rep", F.col("id").alias("other"), F.lit(1.0).alias("cosine")))
    mine = first_k(copies.join(shared, "rep").select("id", "other", "cosine").where("id <> other"))
    result = listed.join(copies.select("id"), "id", "left_anti").unionByName(mine)
    if queries is not None:
        result = result.join(queries.select("id").distinct(), "id", "left_semi")
    return result


def similar_pairs(collections: dict[str, tuple[DataFrame, str, str]], least_cosine: float = 0.85, k: int = 5, recall: float = 0.99) -> DataFrame:
    """(collection, id_a, id_b, cosine): pairs where one is among the k of the other."""
    parts = []
    for name, (table, id_col, vector_col) in collections.items():
        lists = nearest(table, id_col, vector_col, k, least_cosine, recall)
        pairs = lists.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "cosine").distinct()
        parts.append(pairs.select(F.lit(name).alias("collection"), "id_a", "id_b", "cosine"))
    return reduce(DataFrame.unionByName, parts)
