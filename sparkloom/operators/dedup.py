"""Near-duplicate vectors through a k-means tree, and maintenance suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..plans.materialize import materialize
from .vector_tree import PARTITION_ROWS, calibrate_margin, meet, place, routing_tree

#: The share of the made-up pairs that the walks are calibrated to; 1 takes them at the bound itself.
RECALL = 1.0


def near_vector_pairs(vectors: DataFrame, id_col: str, vector_col: str, least: float = 0.92, recall: float = RECALL, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(a, b, score), a < b: pairs of different vectors at least ``least`` alike.

    Equal vectors are one node named by its smallest id; ``near_vector_members``
    gives all ids of a node. Pairs are looked for through a hierarchical k-means
    tree whose walks are calibrated to ``recall``, measured and not proven; a pair
    that comes out is exact, and no vector has a cap on its partners. Vectors of different lengths make no
    pair, nor do those with nulls or numbers that are not finite, or all zero.
    """
    own = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vec")).where(F.size("vec") > 0)
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nodes = own.where(finite & F.exists("vec", lambda x: x != 0)).groupBy("vec").agg(F.min("id").alias("name"))
    nodes = materialize(nodes.select("name", "vec", F.monotonically_increasing_id().alias("id")), "vectors")
    kind, parts = dict(nodes.dtypes)["name"], []
    for r in nodes.groupBy(F.size("vec").alias("n")).count().collect():  # one row a length
        same = nodes.where(F.size("vec") == r.n).select("id", F.col("vec").alias("v"))
        tree, sample = routing_tree(same, r["count"], r.n, partition_rows)
        level = (1 + recall) / 2
        margin = calibrate_margin(sample, tree, 1, level, least)
        placed = materialize(place(same.withColumn("asks", F.lit(True)), tree, margin, r.n), "placed")
        parts.append(meet(placed, None, least, level, True, partition_rows).where("id < other"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}, score double")
    met = materialize(reduce(DataFrame.unionByName, parts), "met")
    named = lambda x, s: nodes.select(F.col("id").alias(x), F.col("name").alias(s)).hint("merge")
    pairs = met.join(named("id", "x"), "id").join(named("other", "y"), "other")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("cosine").alias("score"))


def near_vector_members(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, rep): every id that has a vector, and the smallest id with an equal one."""
    own = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).where(F.size("vec") > 0)
    return own.join(own.groupBy("vec").agg(F.min("id").alias("rep")), "vec").select("id", "rep").distinct()


def contradiction_candidates(chunks: DataFrame, vectors: DataFrame, least: float = 0.70, per_doc: int = 3) -> DataFrame:
    """(a, b, score, doc_a, doc_b), a < b: all pairs of alike chunks of different documents, equal vectors included.

    The first ``per_doc`` chunks of each document take part. Links between vectors
    are brought back to all chunks that hold them before documents are compared.
    """
    w = Window.partitionBy("doc_id").orderBy("sequence", "chunk_id")
    first = chunks.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_doc).select("chunk_id", "doc_id")
    some = materialize(vectors.join(first.select("chunk_id"), "chunk_id", "left_semi").dropDuplicates(["chunk_id"]), "first-vectors")
    links = near_vector_pairs(some, "chunk_id", "vector", least).select("a", "b", "score")
    members = near_vector_members(some, "chunk_id", "vector").withColumnRenamed("id", "chunk_id")
    members = materialize(members.join(first, "chunk_id").select("rep", "chunk_id", "doc_id"), "members")
    # the link of a vector to itself stands for the pairs of its copies
    itself = some.select(F.col("chunk_id").alias("a"), F.col("chunk_id").alias("b"), F.round(cosine("vector", "vector"), 6).alias("score"))
    itself = itself.join(members.select(F.col("rep").alias("a")).distinct(), "a", "left_semi").where((F.col("score") >= least) & ~F.isnan("score"))
    x = members.select(F.col("rep").alias("a"), F.col("chunk_id").alias("x"), F.col("doc_id").alias("doc_x"))
    y = members.select(F.col("rep").alias("b"), F.col("chunk_id").alias("y"), F.col("doc_id").alias("doc_y"))
    pairs = links.unionByName(itself.select("a", "b", "score")).join(x, "a").join(y, "b").where("doc_x <> doc_y AND (a <> b OR x < y)")
    ordered = F.col("x") < F.col("y")
    docs = [F.when(ordered, F.col(p)).otherwise(F.col(q)) for p, q in (("doc_x", "doc_y"), ("doc_y", "doc_x"))]
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score", docs[0].alias("doc_a"), docs[1].alias("doc_b"))


def suggestions(documents: DataFrame, near: DataFrame) -> DataFrame:
    """(kind, subject, detail): copies, near copies and large domains worth a look."""
    copies = documents.groupBy("file_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("id")).where("n > 1 AND file_hash <> ''")
    domains = documents.where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n")).where("n >= 10")
    parts = [
        copies.select(F.lit("copies").alias("kind"), F.col("id").cast("string").alias("subject"), F.concat("n", F.lit(" copies")).alias("detail")),
        near.select(F.lit("near copies").alias("kind"), F.col("a").cast("string").alias("subject"), F.concat_ws(" ", F.lit("like"), "b").alias("detail")),
        domains.select(F.lit("domain").alias("kind"), F.col("domain").alias("subject"), F.concat("n", F.lit(" documents")).alias("detail")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
