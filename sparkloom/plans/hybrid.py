"""Hybrid retrieval: vector, keyword and entity lists, fused, with neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import Embedder, embed, hashing_embedder
from ..operators import retrieval as R
from ..operators.extract import entities
from .materialize import materialize

#: Lists are longer than what is asked for by this factor.
OVER = 3


def hybrid_retrieve(chunks: DataFrame, queries: DataFrame, k: int = 8, least: float = 0.35, embedder: Embedder = hashing_embedder, rerank=None) -> DataFrame:
    """(query_id, doc_id, chunk_id, sequence, score) for many queries (query_id, query).

    The best k * 3 by vector, of those what reaches ``least``; the best by BM25;
    the best by mentions of the query's entities; fused to 2k (5k before a ``rerank`` function of (hits) that returns them with
    new scores); each with its neighbours, in document order.
    """
    vectors = embed(chunks, "chunk_id", "content", embedder)
    asked = embed(queries, "query_id", "query", embedder).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    by_vector = R.vector_search(vectors, asked, k * OVER).where(F.col("score") >= least)
    by_word = R.bm25_search(chunks, queries, k * OVER, "chunk_id", "content")
    mentions = chunks.select(F.col("chunk_id").alias("id"), F.explode(entities(F.col("content"))["entity"]).alias("entity"))
    named = queries.select("query_id", F.explode(entities(F.col("query"))["entity"]).alias("entity"))
    by_entity = R.entity_lists(mentions, named, k * OVER)
    fused = R.fuse({"vector": by_vector, "keyword": by_word, "entity": by_entity}, 5 * k if rerank else 2 * k, by=["query_id"])
    if rerank:
        fused = R.ranked(rerank(fused).drop("rank"), ["query_id"], "score", "id", k)
    fused = materialize(fused, "fused")
    w = Window.partitionBy("doc_id").orderBy("sequence", "chunk_id")
    near = F.array_compact(F.array(F.lag("chunk_id").over(w), F.col("chunk_id"), F.lead("chunk_id").over(w)))
    around = chunks.select(F.col("chunk_id").alias("id"), near.alias("near"))
    wide = fused.join(around, "id").select("query_id", F.explode("near").alias("chunk_id"), "score", "rank")
    best = wide.groupBy("query_id", "chunk_id").agg(F.min_by("score", "rank").alias("score"))
    return best.join(chunks.select("doc_id", "chunk_id", "sequence"), "chunk_id").select("query_id", "doc_id", "chunk_id", "sequence", "score")
