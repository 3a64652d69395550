"""Queries of conversation windows, versions, summaries and exports."""

from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import export, history
from .registry import query, table

_ROLE = """CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot') THEN 'assistant' ELSE coalesce(nullif(lower(trim(role)), ''), 'unknown') END"""
_MESSAGES = f"""SELECT DISTINCT message_id, conversation_id, {_ROLE} AS role, content, turn_group, version, CASE WHEN created_at < 100000000000 THEN created_at * 1000 ELSE created_at END AS at_ms FROM messages WHERE conversation_id IS NOT NULL"""
_COST = "coalesce(floor(octet_length(encode(content)) / 4.0), 0)"


def _messages(spark, d):
    role = F.lower(F.trim("role"))
    named = F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "ai", "bot"), "assistant").otherwise(F.coalesce(F.nullif(role, F.lit("")), F.lit("unknown")))
    at = F.when(F.col("created_at") < 100_000_000_000, F.col("created_at") * 1000).otherwise(F.col("created_at"))
    m = table(spark, d, "messages").where("conversation_id IS NOT NULL")
    return m.select("message_id", "conversation_id", named.alias("role"), "content", "turn_group", "version", at.alias("at_ms")).distinct()


def _cost():
    return F.coalesce(token_estimate("content"), F.lit(0))


@query(
    f"""WITH m AS ({_MESSAGES}), w AS (SELECT *, sum({_COST} + 4) OVER (PARTITION BY conversation_id ORDER BY at_ms DESC, message_id DESC ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conversation_id ORDER BY at_ms DESC, message_id DESC) AS back FROM m)
    SELECT conversation_id, message_id, used::BIGINT AS used FROM w WHERE used <= 400 OR back <= 1"""
)
def history_within_budget(spark, d):
    kept = history.newest_within_budget(_messages(spark, d), "conversation_id", ["at_ms", "message_id"], _cost() + 4, 400)
    return kept.select("conversation_id", "message_id", "used")


@query(
    f"""WITH m AS (SELECT *, {_COST} + 4 AS cost FROM ({_MESSAGES})), w AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY at_ms, message_id) AS nth, count(*) OVER (PARTITION BY conversation_id) AS n FROM m),
    x AS (SELECT *, sum(CASE WHEN nth <= 2 THEN cost ELSE 0 END) OVER (PARTITION BY conversation_id) AS head, sum(CASE WHEN nth > 2 THEN cost ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY at_ms DESC, message_id DESC ROWS UNBOUNDED PRECEDING) AS tail FROM w)
    SELECT conversation_id, message_id FROM x WHERE n <= 2 OR nth <= 2 OR head + tail <= 500"""
)
def history_truncated(spark, d):
    return history.truncate_history(_messages(spark, d), "conversation_id", ["at_ms", "message_id"], _cost() + 4, 500).select("conversation_id", "message_id")


@query(
    f"""WITH l AS (SELECT conversation_id, count(*) AS entries, sum({_COST})::BIGINT AS tokens FROM ({_MESSAGES}) GROUP BY 1), p AS (SELECT *, greatest(entries / 50.0, tokens / 1000.0)::DOUBLE AS p FROM l)
    SELECT conversation_id, entries, tokens, round(p, 6) AS pressure, CASE WHEN p >= 0.9 THEN 'sync' WHEN p >= 0.7 THEN 'background' ELSE 'none' END AS mode FROM p"""
)
def compaction_needed(spark, d):
    return history.compaction_trigger(_messages(spark, d), "conversation_id", _cost(), 1000)


@query(
    f"""WITH v AS (SELECT DISTINCT conversation_id, turn_group, version FROM ({_MESSAGES}) WHERE turn_group <> '')
    SELECT conversation_id, turn_group, version, turn_group || '#' || version AS node, lag(version) OVER w AS parent, lead(version) OVER w AS child FROM v WINDOW w AS (PARTITION BY conversation_id, turn_group ORDER BY version)"""
)
def version_chains(spark, d):
    return history.version_chain(_messages(spark, d).where("turn_group <> ''"), ["conversation_id", "turn_group"])


@query(f"SELECT conversation_id, turn_group, coalesce(max(version), 1) + 1 AS next_version FROM ({_MESSAGES}) WHERE turn_group <> '' GROUP BY 1, 2")
def next_versions(spark, d):
    return history.next_version(_messages(spark, d).where("turn_group <> ''"), ["conversation_id", "turn_group"])


@query(
    f"""WITH s AS (SELECT *, lead(role) OVER w AS next_role, lead(message_id) OVER w AS next_id FROM ({_MESSAGES}) WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conversation_id ORDER BY at_ms, message_id))
    SELECT conversation_id, message_id, CASE WHEN next_role = 'assistant' THEN next_id END AS reply_id FROM s WHERE role = 'user'"""
)
def first_replies(spark, d):
    return history.reply_after(_messages(spark, d), "conversation_id", ["at_ms", "message_id"])


@query(
    f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY at_ms, message_id) AS position FROM ({_MESSAGES})),
    b AS (SELECT conversation_id, string_agg(CASE role WHEN 'user' THEN '## 🧑 User' WHEN 'assistant' THEN '## 🤖 Assistant' ELSE '## ' || role END || chr(10) || chr(10) || coalesce(content, '') || chr(10) || chr(10), '' ORDER BY position) AS body FROM m WHERE role <> 'system' GROUP BY 1)
    SELECT conversation_id, md5('# ' || coalesce(title, '') || chr(10) || chr(10) || '> **Created at** ' || strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' UTC' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || body || '---' || chr(10) || chr(10)) AS digest FROM b JOIN conversations USING (conversation_id)"""
)
def conversation_exports(spark, d):
    from pyspark.sql import Window

    m = _messages(spark, d).withColumn("position", F.row_number().over(Window.partitionBy("conversation_id").orderBy("at_ms", "message_id")))
    done = export.conversation_markdown(m, table(spark, d, "conversations"))
    return done.select("conversation_id", F.md5("markdown").alias("digest"))


@query(
    """WITH c AS (SELECT chunk_id, min(doc_id) AS doc_id, min(sequence) AS sequence, min(content) AS content FROM chunks GROUP BY chunk_id), b AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY sequence, chunk_id) - 1 AS pos FROM c),
    l0 AS (SELECT doc_id, pos // 4 AS node, '摘要：' || string_agg(content, ' / ' ORDER BY pos) AS content, string_agg(chunk_id::VARCHAR, ',' ORDER BY pos) AS kids FROM b WHERE n > 4 GROUP BY 1, 2),
    m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l0), l1 AS (SELECT doc_id, node // 4 AS up, '摘要：' || string_agg(content, ' / ' ORDER BY node) AS content, string_agg('L0:' || node, ',' ORDER BY node) AS kids FROM m WHERE n > 1 GROUP BY 1, 2)
    SELECT doc_id, 0 AS level, node, md5(content) AS digest, kids FROM l0 UNION ALL SELECT doc_id, 1, up, md5(content), kids FROM l1"""
)
def summary_trees(spark, d):
    c = table(spark, d, "chunks").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min("sequence").alias("sequence"), F.min("content").alias("content"))
    tree = history.summary_tree(c, "doc_id", "chunk_id", "sequence", "content")
    return tree.select("doc_id", "level", "node", F.md5("content").alias("digest"), F.array_join("child_ids", ",").alias("kids"))
