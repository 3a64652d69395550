"""Tables that change: upserts, cascades, sync, retention, memory tiers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins: of each key the row with the highest version, changes before current on ties."""
    every = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return every.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_new", "_nth")


def insert_absent(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` whose key is not there yet, each key once."""
    fresh = changes.join(current.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return current.unionByName(fresh)


def cascade_delete(doomed: DataFrame, key: str, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The child tables without the rows of the doomed keys."""
    return {name: df.join(doomed.select(key).distinct(), key, "left_anti") for name, df in children.items()}


def sync_plan(state: DataFrame, snapshot: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """(path, action): added, updated, deleted or skipped, by path and hash."""
    s = state.select(F.col(path), F.col(digest).alias("old")).withColumn("in_state", F.lit(True))
    n = snapshot.select(F.col(path), F.col(digest).alias("new")).withColumn("in_snapshot", F.lit(True))
    action = (
        F.when(F.col("in_state").isNull(), "added").when(F.col("in_snapshot").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "skipped").otherwise("updated")
    )
    return s.join(n, path, "full").select(path, action.alias("action"))


def import_plan(files: DataFrame, known: DataFrame, digest: str = "hash", path: str = "path") -> DataFrame:
    """Files to import: content not known yet, of equal contents the first path."""
    first = files.groupBy(digest).agg(F.min(path).alias(path))
    return first.join(known.select(digest).distinct(), digest, "left_anti")


def folder_hash(files: DataFrame, folder: str, digest: str = "hash") -> DataFrame:
    """MD5 of a folder's sorted file hashes. A folder's hashes are gathered: 32 bytes a file."""
    return files.groupBy(folder).agg(F.md5(F.array_join(F.array_sort(F.collect_list(digest)), ",")).alias("folder_hash"))


def recover_stuck(documents: DataFrame) -> DataFrame:
    """Documents left in processing become failed."""
    stuck = F.col("status") == "processing"
    return documents.withColumn("status_reason", F.when(stuck, "interrupted").otherwise(F.col("status_reason"))).withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def retain(df: DataFrame, at: str, now: int, seconds: int) -> DataFrame:
    """Rows not older than the retention."""
    return df.where(F.lit(now) - F.col(at) <= seconds)


def add_tag(tags: Column, tag: str) -> Column:
    return F.when(F.array_contains(tags, tag), tags).otherwise(F.array_append(tags, F.lit(tag)))


def remove_tag(tags: Column, tag: str) -> Column:
    return F.array_remove(tags, tag)


def forget_score(importance: Column, access: Column, most_access: Column) -> Column:
    return 0.6 * importance + 0.4 * F.try_divide(access, F.greatest(most_access, F.lit(1)))


def memory_tiers(memories: DataFrame, caps: tuple[int, int, int] = (50, 100, 500)) -> DataFrame:
    """Consolidates tiers: memory_id, tier, importance, access_count.

    A full wing (short term) promotes what is worth 0.6 to the hall, worth 0.1
    more there, and forgets what is below 0.3; a full hall, as it is after that,
    promotes what is worth 0.7 to the room; a full room forgets the least read.
    Counts come from a group-by, not from a window over a tier.
    """
    wing, hall, room = caps

    def counted(df: DataFrame) -> DataFrame:
        sizes = df.groupBy("tier").agg(F.count("*").alias("size"))  # three rows
        return df.drop("size").join(F.broadcast(sizes), "tier")

    m = counted(memories)
    full = (F.col("tier") == "wing") & (F.col("size") > wing)
    m = m.where(~(full & (F.col("importance") < 0.3)))
    up = full & (F.col("importance") >= 0.6)
    m = m.select("memory_id", F.when(up, "hall").otherwise(F.col("tier")).alias("tier"), F.when(up, F.least(F.col("importance") + 0.1, F.lit(1.0))).otherwise(F.col("importance")).alias("importance"), "access_count")
    m = counted(m)
    up = (F.col("tier") == "hall") & (F.col("size") > hall) & (F.col("importance") >= 0.7)
    m = counted(m.select("memory_id", F.when(up, "room").otherwise(F.col("tier")).alias("tier"), "importance", "access_count"))
    over = m.where((F.col("tier") == "room") & (F.col("size") > room))
    # how many go is one number; the least read are found by a top-k, not by a window over the room
    size = m.where("tier = 'room'").agg(F.count("*").alias("n")).first().n
    if size <= room:
        return m.drop("size")
    # the read count at which enough have gone is found on counts; only its ties are put in order
    counts = over.groupBy("access_count").agg(F.count("*").alias("n"))
    up_to = counts.select("access_count", F.sum("n").over(Window.orderBy("access_count")).alias("through"), "n")  # one row a read count
    edge = up_to.where(F.col("through") >= size - room).orderBy("access_count").limit(1).first()
    ties = over.where(F.col("access_count") == edge.access_count).orderBy("memory_id").limit(size - room - (edge.through - edge.n))
    gone = over.where(F.col("access_count") < edge.access_count).select("memory_id").unionByName(ties.select("memory_id"))
    return m.join(gone, "memory_id", "left_anti").drop("size")


def memory_lines(text: Column, most: int = 5) -> Column:
    """array<struct<kind, content>> of lines ``[kind] content``; at most ``most``."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^\s*\[[^\]]+\]\s*\S"))
    parsed = F.transform(lines, lambda s: F.struct(F.lower(F.regexp_extract(s, r"\[([^\]]+)\]", 1)).alias("kind"), F.trim(F.regexp_extract(s, r"\]\s*(.*)$", 1)).alias("content")))
    return F.slice(parsed, 1, most)


def scratch_commands(text: Column) -> Column:
    """array<struct<command, number, content>> of UPDATE n: .., DELETE n, ADD: .. and NONE lines."""
    p = r"^\s*(UPDATE|DELETE|ADD|NONE)\s*([0-9]*)\s*:?\s*(.*)$"
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^\s*(?:UPDATE\s+[0-9]+:|DELETE\s+[0-9]+|ADD:|NONE)"))
    return F.transform(
        lines,
        lambda s: F.struct(
            F.lower(F.regexp_extract(s, p, 1)).alias("command"), F.nullif(F.regexp_extract(s, p, 2), F.lit("")).cast("int").alias("number"), F.trim(F.regexp_extract(s, p, 3)).alias("content")
        ),
    )


def retrieval_memory(records: DataFrame) -> DataFrame:
    """records: query_type, method, score. Hits score above 0.1; the mean is over hits only."""
    hit = F.col("score") > 0.1
    stats = records.groupBy("query_type", "method").agg(F.sum(hit.cast("long")).alias("hits"), F.count("*").alias("total"), F.coalesce(F.avg(F.when(hit, F.col("score"))), F.lit(0.0)).alias("avg_score"))
    return stats.select("query_type", "method", "hits", "total", F.round(F.col("hits") / F.col("total"), 6).alias("hit_rate"), F.round("avg_score", 6).alias("avg_score"))


def best_method(stats: DataFrame, defaults: DataFrame) -> DataFrame:
    """The method of each query type with the best (hit_rate, avg_score); defaults (query_type, fallback) where nothing is known."""
    best = stats.where("total > 0").groupBy("query_type").agg(F.max(F.struct("hit_rate", "avg_score", "method"))["method"].alias("best"))
    return defaults.join(best, "query_type", "left").select("query_type", F.coalesce("best", "fallback").alias("method"))


# What feedback does to a score.
FEEDBACK = {"retry": -0.10, "edit": -0.15, "accepted": 0.05, "up": 0.20, "down": -0.25}


def apply_feedback(start: Column, events: Column) -> Column:
    """Folds ordered feedback into a score, kept between 0 and 1 at every step."""
    delta = lambda e: reduce(lambda out, kv: F.when(e == kv[0], kv[1]).otherwise(out), FEEDBACK.items(), F.lit(0.0))
    return F.aggregate(events, start.cast("double"), lambda s, e: F.least(F.greatest(s + delta(e), F.lit(0.0)), F.lit(1.0)))


def rolling_spend(records: DataFrame, by: str, at: Column, cost: str, window: int = 86400) -> DataFrame:
    """Adds ``spent``: the cost of the group in the last ``window`` seconds up to each record."""
    w = Window.partitionBy(by).orderBy(at).rangeBetween(-(window - 1), 0)
    return records.withColumn("spent", F.sum(cost).over(w))


def admit(records: DataFrame, by: str, at: str, most: int, window: int) -> DataFrame:
    """Sliding-window rate limit: refused requests do not count. Adds ``admitted``.

    Refusals feed back, so no window function can say it. Rows stream by in the
    order of (key, time, id); only the last ``most`` admitted times of one key are
    held, however many requests it has.
    """
    narrow = records.select("event_id", by, at)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, recent = object(), deque()
        for b in batches:
            out = []
            for k, t in zip(b[by], b[at]):
                if k != key and not (pd.isna(k) and key is None):
                    key, recent = None if pd.isna(k) else k, deque()
                while recent and recent[0] <= t - window:
                    recent.popleft()
                out.append(len(recent) < most)
                if out[-1]:
                    recent.append(t)
            yield b.assign(admitted=out)

    ordered = narrow.repartition(by).sortWithinPartitions(by, at, "event_id")
    return ordered.mapInPandas(run, f"event_id long, {by} {dict(narrow.dtypes)[by]}, {at} {dict(narrow.dtypes)[at]}, admitted boolean")


def once_per_key(records: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(at, tie)
    return records.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def burst_sessions(records: DataFrame, by: str, at: Column, gap: int) -> DataFrame:
    """Adds ``session``: a new one after more than ``gap`` quiet seconds."""
    w = Window.partitionBy(by).orderBy(at)
    starts = records.withColumn("_new", (F.coalesce(at - F.lag(at).over(w), F.lit(gap + 1)) > gap).cast("int"))
    return starts.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def last_rule(requests: DataFrame, rules: list[tuple[str, str]], action: str = "action") -> DataFrame:
    """The last rule that matches wins, otherwise deny. Patterns: *, x.*, exact."""
    out = F.lit("deny")
    for pattern, effect in rules:
        a = F.col(action)
        match = F.lit(True) if pattern == "*" else a.startswith(pattern[:-1]) if pattern.endswith(".*") else a == pattern
        out = F.when(match, effect).otherwise(out)
    return requests.withColumn("effect", out)


def layers(nodes: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Topological layers of a workflow; a cycle is an error."""
    need = {n: {a for a, b in edges if b == n} for n in nodes}
    out = []
    while need:
        ready = sorted(n for n, before in need.items() if not before)
        if not ready:
            raise ValueError(f"cycle among {sorted(need)}")
        out.append(ready)
        need = {n: before - set(ready) for n, before in need.items() if n not in ready}
    return out


def screen_agreement(screens: DataFrame) -> DataFrame:
    """One row: how often a shadow screen agrees with the deciding one.

    screens: decision, shadow; null where a screen gave none. The disagree rate is
    over the rows where both gave one, 0 without any.
    """
    both = F.col("decision").isNotNull() & F.col("shadow").isNotNull()
    out = screens.agg(
        F.count_if(both & (F.col("decision") == F.col("shadow"))).alias("agreed"),
        F.count_if(both & (F.col("decision") != F.col("shadow"))).alias("disagreed"),
        F.count_if(~both).alias("unavailable"),
    )
    rate = F.coalesce(F.try_divide("disagreed", F.col("agreed") + F.col("disagreed")), F.lit(0.0))
    return out.withColumn("disagree_rate", F.round(rate, 6))


def draft_stats(drafts: DataFrame) -> DataFrame:
    """One row: drafts, accepted, their rate, the mean likeness and mean seconds saved; 0 where there are none.

    drafts: accepted, alike, seconds_saved.
    """
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return drafts.agg(
        F.count("*").alias("drafts"), F.count_if("accepted").alias("accepted"), mean(F.col("accepted").cast("int")).alias("accept_rate"),
        mean("alike").alias("mean_alike"), mean("seconds_saved").alias("mean_saved"),
    )
