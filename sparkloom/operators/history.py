"""Windows over conversations: budgets, truncation, version chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .ranges import running

# Fixed value: what stands before the summary of a compacted history.
SUMMARY_MARK = "[对话历史摘要] "


def newest_within_budget(messages: DataFrame, by: str, order: list[str], cost: Column, budget: int, least: int = 1) -> DataFrame:
    """The newest messages of each group whose costs fit the budget; at least ``least``.

    Costs are not negative, so the running sum grows and stops at the first
    message that does not fit. Groups may have any size (``ranges``).
    """
    back = running(messages, by, [F.desc(c) for c in order], {"used": cost})
    return back.where((F.col("used") <= budget) | (F.col("nth") <= least)).drop("nth")


def truncate_history(messages: DataFrame, by: str, order: list[str], cost: Column, budget: int, head: int = 2) -> DataFrame:
    """The first ``head`` messages and the newest that fit beside them; short histories stay whole.

    Groups may have any size (``ranges``).
    """
    up = running(messages.withColumn("cost_", cost), by, [F.col(c) for c in order], {"so_far": F.col("cost_")})
    first = F.col("nth") <= head
    heads = F.sum(F.when(first, F.col("cost_")).otherwise(0)).alias("head_cost")
    whole = up.groupBy(F.col(by).alias("by_")).agg(F.sum("cost_").alias("all_cost"), heads)
    joined = up.join(whole.hint("merge"), F.col(by).eqNullSafe(F.col("by_")))
    # what the message and those after it cost
    tail = F.col("all_cost") - F.col("so_far") + F.col("cost_")
    return joined.where(first | (tail + F.col("head_cost") <= budget)).select(*messages.columns)


def compaction_trigger(messages: DataFrame, by: str, cost: Column, limit: int, entries: int = 50) -> DataFrame:
    """Pressure of a conversation: the greater of entries / 50 and tokens / limit."""
    load = messages.groupBy(by).agg(F.count("*").alias("entries"), F.sum(cost).alias("tokens"))
    pressure = F.greatest(F.col("entries") / entries, F.col("tokens") / limit)
    mode = F.when(pressure >= 0.9, "sync").when(pressure >= 0.7, "background").otherwise("none")
    return load.select(by, "entries", "tokens", F.round(pressure, 6).alias("pressure"), mode.alias("mode"))


def version_chain(messages: DataFrame, by: list[str], version: str = "version") -> DataFrame:
    """Distinct versions of each turn with their parent, child and node id."""
    v = messages.select(*by, version).distinct()
    w = Window.partitionBy(*by).orderBy(version)
    return v.select(
        *by, version, F.concat_ws("#", by[-1], version).alias("node"), F.lag(version).over(w).alias("parent"), F.lead(version).over(w).alias("child")
    )


def next_version(messages: DataFrame, by: list[str], version: str = "version") -> DataFrame:
    return messages.groupBy(*by).agg((F.coalesce(F.max(version), F.lit(1)) + 1).alias("next_version"))


def reply_after(messages: DataFrame, by: str, order: list[str], role: str = "role", id_col: str = "message_id") -> DataFrame:
    """The first assistant row after each user row and before the next user row."""
    spoken = messages.where(F.col(role).isin("user", "assistant"))
    w = Window.partitionBy(by).orderBy(*order)
    led = spoken.select(by, id_col, role, F.lead(role).over(w).alias("next_role"), F.lead(id_col).over(w).alias("next_id"))
    return led.where(F.col(role) == "user").select(by, id_col, F.when(F.col("next_role") == "assistant", F.col("next_id")).alias("reply_id"))


def repair_observations(messages: DataFrame, by: str, order: list[str], role: str = "role", content: str = "content") -> DataFrame:
    """Inserts a placeholder after an action that nothing answers."""
    w = Window.partitionBy(by).orderBy(*order)
    led = messages.withColumn("next_", F.lead(content).over(w))
    open_action = (F.col(role) == "assistant") & F.col(content).rlike("Action:") & ~F.col(content).rlike("Final Answer:") & ~F.coalesce(F.ltrim("next_").startswith("Observation:"), F.lit(False))
    placeholder = F.array(F.struct(F.col(role).alias("r"), F.col(content).alias("c"), F.lit(0).alias("part")), F.struct(F.lit("user").alias("r"), F.lit("Observation: (no result recorded)").alias("c"), F.lit(1).alias("part")))
    alone = F.array(F.struct(F.col(role).alias("r"), F.col(content).alias("c"), F.lit(0).alias("part")))
    rows = led.withColumn("x", F.explode(F.when(open_action, placeholder).otherwise(alone)))
    return rows.withColumn(role, F.col("x.r")).withColumn(content, F.col("x.c")).withColumn("part", F.col("x.part")).drop("x", "next_")


def summary_tree(chunks: DataFrame, doc: str, key: str, order: str, text: str, fan: int = 4, levels: int = 2) -> DataFrame:
    """(doc, level, node, content, child_ids): runs of ``fan`` neighbours, level by level.

    Documents with at most ``fan`` chunks have no tree. The summary of a node is
    its children's content joined, a stand-in for a summarizer passed in later.
    """
    n = Window.partitionBy(doc)
    base = chunks.withColumn("n", F.count("*").over(n)).where(F.col("n") > fan)
    base = base.select(doc, F.col(key).cast("string").alias("id"), F.col(text).alias("content"), (F.row_number().over(Window.partitionBy(doc).orderBy(order, key)) - 1).alias("pos"))
    out = None
    for level in range(levels):
        runs = base.withColumn("node", F.floor(F.col("pos") / fan)).groupBy(doc, "node")
        made = runs.agg(F.array_sort(F.collect_list(F.struct("pos", "id", "content"))).alias("kids"))
        made = made.select(
            doc, F.lit(level).alias("level"), "node", F.concat(F.lit("摘要："), F.array_join(F.col("kids.content"), " / ")).alias("content"), F.col("kids.id").alias("child_ids")
        )
        out = made if out is None else out.unionByName(made)
        count = F.count("*").over(Window.partitionBy(doc))
        base = made.withColumn("n", count).where("n > 1").select(doc, F.concat_ws(":", F.lit(f"L{level}"), "node").alias("id"), "content", F.col("node").alias("pos"))
    return out


def expand_summaries(tree: DataFrame, hits: DataFrame) -> DataFrame:
    """(hit, chunk): the chunks below each summary node that was hit.

    tree: node, child_ids; a child that is no node itself is a chunk. hits: node.
    One join a level, until no node is left to open; a node met again below the
    same hit is not opened twice, so a cycle ends.
    """
    edges = materialize(tree.select(F.col("node").alias("parent"), F.explode("child_ids").alias("child")), "summary-edges")
    inner = edges.select(F.col("parent").alias("child")).distinct().withColumn("inner", F.lit(True))
    edges = materialize(edges.join(inner, "child", "left"), "summary-edges")
    open_ = hits.select(F.col("node").alias("hit"), F.col("node").alias("at")).distinct()
    seen, found = open_, None
    while True:
        below = materialize(open_.join(edges, F.col("at") == F.col("parent")).select("hit", F.col("child").alias("at"), "inner").distinct(), "summary-level")
        leaves = below.where("inner IS NULL").select("hit", F.col("at").alias("chunk"))
        found = leaves if found is None else found.unionByName(leaves)
        open_ = below.where("inner").select("hit", "at").join(seen, ["hit", "at"], "left_anti")
        if open_.isEmpty():
            return found.distinct()
        seen = seen.unionByName(open_)


def compact_history(messages: DataFrame, by: str, order: list[str], cost: Column, limit: int, summarize: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(by, part, role, content, ...): histories above ``limit`` as a summary and their newest messages.

    The newest messages within two thirds of the limit stay, the last one in any
    case; those before give way to one system message in front. Histories within the
    limit or of at most two messages stay whole. ``summarize`` gets the old messages
    and returns (by, content); without it the summary says how many were left out.
    """
    m = running(messages.withColumn("cost_", cost), by, [F.desc(c) for c in order], {"used": F.col("cost_")})
    whole = m.groupBy(F.col(by).alias("by_")).agg(F.count("*").alias("n_"), F.sum("cost_").alias("all_"))
    m = m.join(whole.hint("merge"), F.col(by).eqNullSafe(F.col("by_")))
    short = (F.col("n_") <= 2) | (F.col("all_") <= limit)
    stays = short | (F.col("used") <= limit * 2 // 3) | (F.col("nth") == 1)
    narrow = [by, *order, "role", "content"]
    kept = m.where(stays).select(*narrow, F.lit(1).alias("part"))
    old = m.where(~stays)
    if summarize is None:
        told = old.groupBy(by).agg(F.concat(F.lit("(earlier messages left out: "), F.count("*").cast("string"), F.lit(")")).alias("content"))
    else:
        told = summarize(old.select(*narrow)).select(by, F.concat(F.lit(SUMMARY_MARK), "content").alias("content"))
    nulls = [F.lit(None).cast(dict(messages.dtypes)[c]).alias(c) for c in order]
    return told.select(by, *nulls, F.lit("system").alias("role"), "content", F.lit(0).alias("part")).unionByName(kept)
