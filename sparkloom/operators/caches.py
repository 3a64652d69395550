"""Answer caches by meaning: lookups, invalidation, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import vector_search

# Fixed value: tokens that an answer from the cache saves.
TOKENS_PER_ANSWER = 3700


def semantic_lookup(cache: DataFrame, lookups: DataFrame, least: float, now: int, ttl: int, id_col: str = "cache_id", vector_col: str = "query_embedding") -> DataFrame:
    """(query_id, id, score): of each lookup (query_id, query_vec) the best entry that is alike enough and not expired.

    An entry as old as ``ttl`` still counts. Ties go to the smaller id; lookups
    without a hit have no row. Repeated rows of one id count once each, with the
    same score, so they change nothing.
    """
    alive = cache.where(F.lit(now) - F.col("created_at") <= ttl)
    found = vector_search(alive, lookups, 1, id_col, vector_col, least)
    return found.select("query_id", "id", "score")


def invalidate_by_document(cache: DataFrame, names: DataFrame, sources_col: str = "sources_json") -> DataFrame:
    """The entries whose sources, a JSON text, name none of ``names`` (name), a stated list."""
    wanted = [r.name for r in names.where("name IS NOT NULL").distinct().collect()]
    out = cache
    for name in sorted(wanted):
        quoted = F.lit('"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"')
        out = out.where(~F.coalesce(F.contains(F.col(sources_col), quoted), F.lit(False)))
    return out


def cache_stats(lookups: DataFrame, entries: dict[str, DataFrame]) -> DataFrame:
    """One row: hits of each level, lookups, entries and the tokens saved.

    ``lookups`` has level: exact, semantic, retrieval, or null for a miss. Only
    exact and semantic hits save an answer.
    """
    hit = lambda level: F.count_if(F.col("level") == level).alias(f"{level}_hits")
    counted = lookups.agg(hit("exact"), hit("semantic"), hit("retrieval"), F.count("*").alias("lookups"))
    sizes = [df.agg(F.count("*").alias("n")) for df in entries.values()]
    whole = sizes[0]
    for one in sizes[1:]:
        whole = whole.unionByName(one)
    size = whole.agg(F.sum("n").alias("entries"))  # one row
    saved = (F.col("exact_hits") + F.col("semantic_hits")) * TOKENS_PER_ANSWER
    return counted.join(F.broadcast(size)).withColumn("tokens_saved", saved)
