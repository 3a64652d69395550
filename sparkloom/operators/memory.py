"""Long-term memories: search, promotion, pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_memories(memories: DataFrame, query: str, k: int) -> DataFrame:
    """The k memories for a query: of the 2k most important that hold it, the most important, then last read.

    memories: memory_id, content, importance, last_accessed. Ties go to the smaller id.
    """
    held = memories.where(F.contains(F.lower("content"), F.lit(query.lower())))
    first = held.orderBy(F.desc("importance"), "memory_id").limit(2 * k)
    return first.orderBy(F.desc("importance"), F.desc("last_accessed"), "memory_id").limit(k)


def bump_access(memories: DataFrame, read: DataFrame, now: int) -> DataFrame:
    """Memories after those in ``read`` (memory_id) were read once more."""
    marked = memories.join(read.select("memory_id").distinct().withColumn("read_", F.lit(True)), "memory_id", "left")
    return (
        marked.withColumn("access_count", F.col("access_count") + F.coalesce(F.col("read_").cast("int"), F.lit(0)))
        .withColumn("last_accessed", F.when(F.col("read_"), F.lit(now)).otherwise(F.col("last_accessed")))
        .drop("read_")
    )


def promote(tier: Column, importance: Column) -> tuple[Column, Column]:
    """(tier, importance) one tier up: wing, hall, room; each step is worth 0.1 more, 1 at most. A room stays as it is."""
    up = F.when(tier == "wing", "hall").when(tier == "hall", "room").otherwise(tier)
    return up, F.when(tier == "room", importance).otherwise(F.least(importance + 0.1, F.lit(1.0)))


def pin(memories: DataFrame, ids: list) -> DataFrame:
    """Memories with those of ``ids`` in the room, of the highest importance."""
    pinned = F.col("memory_id").isin(ids)
    return memories.withColumn("tier", F.when(pinned, "room").otherwise(F.col("tier"))).withColumn("importance", F.when(pinned, 1.0).otherwise(F.col("importance")))
