"""Problem 4: message rows become ordered conversations.

Messages and conversations are nodes. A message points at the one before it, the
first of a conversation at the conversation. Pointer jumping (``operators.paths``)
resolves these links and folds what lies on the path from the root down to each
message: how many messages, who spoke first and last, whether a user was left
without a reply, whether a role was unreadable. The path that ends at the last
message is the conversation; its verdict is read off that fold and off how the path
ends: at a conversation that is not there it is an orphan, a cycle has no end.

Nothing gathers a conversation in one task: rows are put in order by ranges of
(conversation, time, id), which cut a conversation of any size, even one written in
one instant, into runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.paths import fold_paths
from ..plans.materialize import materialize

# Written forms of the speaker roles.
ROLE_NAMES = {
    "user": ("user", "human"),
    "assistant": ("assistant", "ai", "bot", "model"),
    "system": ("system",),
    "tool": ("tool", "function"),
}
USER, ASSISTANT = "user", "assistant"

# What a client writes when nothing came from the speaker.
FAILURE_WORDS = (
    "error", "fail", "abort", "interrupt", "timeout", "timed out", "cancel", "unavailable", "reset", "disconnect",
    "no output", "no response", "no content", "empty", "失败", "错误", "超时", "中断", "取消",
)
#: Longest notice in characters.
NOTICE_CHARS = 200
#: White space, controls and characters of no width.
BLANK = r"[\s\p{Z}\p{Cc}\p{Cf}]"


def role_of(role: Column) -> Column:
    """user, assistant, system or tool; null where the role cannot be read."""
    name = F.regexp_replace(F.lower(role), f"^{BLANK}+|{BLANK}+$", "")
    out = F.lit(None).cast("string")
    for canonical, names in ROLE_NAMES.items():
        out = F.when(name.isin(*names), canonical).otherwise(out)
    return out


def has_words(content: Column, notice_chars: int = NOTICE_CHARS) -> Column:
    """False for null, blank text and a client's notice that nothing came, of ``notice_chars`` at most."""
    text = F.lower(F.regexp_replace(content, f"^{BLANK}+|{BLANK}+$", ""))
    failure = "|".join(FAILURE_WORDS)
    bracketed = text.rlike(rf"^[\[<(（【][^\[\]<>()（）【】]*(?:{failure})[^\[\]<>()（）【】]*[\]>)）】]$")
    marked = text.rlike(rf"^(?:[⚠❌✖!]️?{BLANK}*.*(?:{failure})|\**error\**{BLANK}*:)")
    notice = (F.char_length(text) <= notice_chars) & (bracketed | marked)
    return F.coalesce((text != "") & ~notice, F.lit(False))


def clean_messages(messages: DataFrame, carry: tuple[str, ...] = (), notice_chars: int = NOTICE_CHARS) -> tuple[DataFrame, DataFrame]:
    """(kept, once): the messages that stay, narrow, and each message once with what is carried.

    ``node`` names a message: an odd number made of its message_id or, where that
    is null, of a hash of all it holds; conversations have even ones. A message_id
    counts once (the row ingested last); within a turn_group of a conversation only
    the highest version stays; messages without words are set aside; rows without a
    conversation are left out. Seconds and milliseconds become milliseconds.
    """
    unnamed = F.xxhash64("conversation_id", "role", "content", "created_at", "turn_group", "version")
    rows = messages.where("conversation_id IS NOT NULL").select(
        "conversation_id",
        "message_id",
        (F.shiftleft(F.coalesce("message_id", unnamed), 1) + 1).alias("node"),
        role_of(F.col("role")).alias("speaker"),
        has_words(F.col("content"), notice_chars).alias("said"),
        F.when(F.abs("created_at") < 100_000_000_000, F.col("created_at") * 1000).otherwise(F.col("created_at")).alias("at_ms"),
        F.when(F.length("turn_group") > 0, F.xxhash64("turn_group")).alias("turn"),
        F.coalesce("version", F.lit(-1)).alias("version"),
        "ingested_at",
        *carry,
    )
    latest = Window.partitionBy("node").orderBy(
        F.col("ingested_at").desc_nulls_last(), F.col("version").desc(), "conversation_id", "at_ms", "speaker", F.col("said").desc(), "turn"
    )
    once = rows.withColumn("nth", F.row_number().over(latest)).where("nth = 1").drop("nth", "ingested_at")
    once = materialize(once, "messages")
    narrow = once.drop(*carry)
    reworded = (
        narrow.where("turn IS NOT NULL").groupBy("conversation_id", "turn").agg(F.max("version").alias("top"), F.min("version").alias("low")).where("top > low").drop("low")
    )
    kept = narrow.join(reworded, ["conversation_id", "turn"], "left").where("top IS NULL OR version = top").where("said")
    return kept.select("conversation_id", "message_id", "node", "speaker", "at_ms"), once


def conversation_node(conversation: Column) -> Column:
    return F.shiftleft(conversation, 1)


def parents_by_time(kept: DataFrame) -> DataFrame:
    """Adds ``parent``: the message before in time and id (null times last), or the conversation."""
    order = [F.col("at_ms").asc_nulls_last(), F.col("message_id"), F.col("node")]
    placed = kept.repartitionByRange("conversation_id", *order).withColumn("run", F.spark_partition_id())
    placed = materialize(placed, "runs")
    within = Window.partitionBy("conversation_id", "run").orderBy(*order)
    linked = placed.withColumn("parent", F.lag("node").over(within)).withColumn("last", F.lead("node").over(within).isNull())
    linked = materialize(linked, "linked")
    # a run begins where the run before it ended; only conversations that a cut went through have two
    ends = linked.where("last").select("conversation_id", "run", "node")
    before = F.lag("node").over(Window.partitionBy("conversation_id").orderBy("run"))
    cuts = ends.select("conversation_id", "run", before.alias("before")).where("before IS NOT NULL")
    joined = linked.join(F.broadcast(cuts), ["conversation_id", "run"], "left")  # at most one row a range of the exchange
    parent = F.coalesce("parent", "before", conversation_node(F.col("conversation_id")))
    return joined.select(*kept.columns, parent.alias("parent"))


def follow_paths(nodes: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, verdicts) of messages with their links.

    ``nodes``: node, parent (another node or ``conversation_node``), conversation_id,
    speaker. paths: node, conversation_id, state and position, the number of
    messages above it. verdicts: conversation_id, reason for every conversation
    that is known or has a node; null for a sound one, else ``cycle``, ``unknown``
    (the path ends at a conversation that is not there), ``orphan`` (at a message
    that is not there), ``empty``, ``role`` (an unreadable role), ``start`` (no user
    or assistant, or the first of them is not the user) or ``reply`` (a user message
    not directly followed by the assistant).
    """
    part = F.when(F.col("speaker").isin(USER, ASSISTANT), F.col("speaker"))
    known = conversations.where("conversation_id IS NOT NULL").select("conversation_id").distinct()
    none, no = F.lit(None).cast("string"), F.lit(False)
    zero = F.lit(0).cast("long")
    roots = known.select(
        conversation_node(F.col("conversation_id")).alias("id"), F.lit(None).cast("long").alias("parent"), "conversation_id",
        zero.alias("n"), none.alias("first"), none.alias("final"), no.alias("unanswered"), no.alias("unreadable"),
    )
    messages = nodes.select(
        F.col("node").alias("id"), "parent", "conversation_id", (zero + 1).alias("n"), part.alias("first"), part.alias("final"),
        no.alias("unanswered"), F.col("speaker").isNull().alias("unreadable"),
    )

    def join(up: dict[str, Column], down: dict[str, Column]) -> dict[str, Column]:
        broken = F.coalesce((up["final"] == USER) & (down["first"] != ASSISTANT), no)
        return {
            "n": up["n"] + down["n"],
            "first": F.coalesce(up["first"], down["first"]),
            "final": F.coalesce(down["final"], up["final"]),
            "unanswered": up["unanswered"] | down["unanswered"] | broken,
            "unreadable": up["unreadable"] | down["unreadable"],
        }

    carried = ["n", "first", "final", "unanswered", "unreadable"]
    folded = materialize(fold_paths(roots.unionByName(messages), carried, join, "conversation_id"), "paths")
    # the node farthest from the root closes the path; ids are odd for messages
    ending = F.max_by(F.struct("root", *carried), F.struct("n", "id")).alias("end")
    heads = folded.groupBy(F.col("group").alias("conversation_id")).agg(
        ending, F.max(F.col("state") == "cycle").alias("cycle"), F.max_by("root", F.when(F.col("state") == "orphan", F.abs(F.col("root") % 2))).alias("lost")
    )
    reason = (
        F.when(F.col("cycle"), "cycle")
        .when(F.col("lost") % 2 != 0, "orphan")
        .when(F.col("lost").isNotNull(), "unknown")
        .when(F.col("end.n") == 0, "empty")
        .when(F.col("end.unreadable"), "role")
        .when(F.col("end.first").isNull() | (F.col("end.first") != USER), "start")
        .when(F.col("end.unanswered") | (F.col("end.final") == USER), "reply")
    )
    verdicts = heads.select("conversation_id", reason.alias("reason"))
    paths = folded.where("id % 2 <> 0").select(F.col("id").alias("node"), F.col("group").alias("conversation_id"), "state", (F.col("n") - 1).alias("position"))
    return paths, verdicts


def _threads(messages: DataFrame, conversations: DataFrame, carry: tuple[str, ...], notice_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    kept, once = clean_messages(messages, carry, notice_chars)
    paths, found = follow_paths(parents_by_time(kept), conversations)
    # conversations of which nothing is left and that are not known have no node
    named = messages.where("conversation_id IS NOT NULL").select("conversation_id").distinct()
    missing = named.join(found.select("conversation_id"), "conversation_id", "left_anti").select("conversation_id", F.lit("unknown").alias("reason"))
    return paths, found.unionByName(missing), once


def thread_conversations(messages: DataFrame, conversations: DataFrame, carry: tuple[str, ...] = (), notice_chars: int = NOTICE_CHARS) -> tuple[DataFrame, DataFrame]:
    """(turns, verdicts).

    turns: one row per message left, with conversation_id, position (from 0 in
    the order of time, message_id; null times last), message_id, speaker, at_ms
    and the carried columns. verdicts: conversation_id, reason as in
    ``follow_paths``; every id of either table has one verdict.
    """
    paths, verdicts, once = _threads(messages, conversations, carry, notice_chars)
    turns = paths.select("node", "position").join(once.hint("merge"), "node").select("conversation_id", "position", "message_id", "speaker", "at_ms", *carry)
    return turns, verdicts


def ordered_conversations(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """The turns of the sound conversations, with their content."""
    paths, verdicts, once = _threads(messages, conversations, ("content",), NOTICE_CHARS)
    sound = paths.join(verdicts.where("reason IS NULL").select("conversation_id"), "conversation_id", "left_semi")
    turns = sound.select("node", "position").join(once.hint("merge"), "node")
    return turns.select("conversation_id", "position", "message_id", "speaker", "at_ms", "content")
