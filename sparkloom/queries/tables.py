"""Queries of table operators: filters, joins, aggregates, upserts, sync, budgets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import DOMAINS
from ..operators import maintenance as M
from .registry import query, table


@query("SELECT md5(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    g = table(spark, d, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return g.where("copies > 1")


@query("SELECT doc_id, file_path FROM documents WHERE starts_with(file_path, 'library/lab') ORDER BY doc_id")
def path_prefix(spark, d):
    return table(spark, d, "documents").where(F.col("file_path").startswith("library/lab")).select("doc_id", "file_path").orderBy("doc_id")


@query("SELECT conversation_id, title FROM conversations WHERE title ILIKE '%where do%'")
def title_search(spark, d):
    return table(spark, d, "conversations").where(F.col("title").ilike("%where do%")).select("conversation_id", "title")


@query("SELECT o_orderkey, o_orderdate::VARCHAR[:10] AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50".replace("o_orderdate::VARCHAR[:10]", "strftime(o_orderdate, '%Y-%m-%d')"))
def page_newest_first(spark, d):
    o = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(50).limit(25)
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, event_type FROM events WHERE value IS NOT NULL ORDER BY CASE WHEN event_type = 'click' THEN 0 ELSE 1 END, ts, event_id LIMIT 40")
def pending_order(spark, d):
    first = F.when(F.col("event_type") == "click", 0).otherwise(1)
    return table(spark, d, "events").where("value IS NOT NULL").orderBy(first, "ts", "event_id").limit(40).select("event_id", "event_type")


@query("SELECT workspace_id, count(*) AS conversations FROM conversations GROUP BY workspace_id")
def conversations_per_workspace(spark, d):
    return table(spark, d, "conversations").groupBy("workspace_id").agg(F.count("*").alias("conversations"))


@query("SELECT c.doc_id, count(*) AS chunks, max(status) AS status FROM (SELECT DISTINCT chunk_id, doc_id FROM chunks) c JOIN documents USING (doc_id) GROUP BY c.doc_id")
def chunks_per_document(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "doc_id").distinct().groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return c.join(table(spark, d, "documents").groupBy("doc_id").agg(F.max("status").alias("status")), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks WHERE doc_id IS NOT NULL)")
def documents_without_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "chunks").select("doc_id"), "doc_id", "left_anti")


@query(
    """SELECT c.chunk_id, e.chunk_id IS NOT NULL AS cached FROM (SELECT DISTINCT chunk_id FROM chunks) c LEFT JOIN (SELECT DISTINCT chunk_id FROM chunk_vectors WHERE vector IS NOT NULL) e USING (chunk_id)"""
)
def vector_cache_hits(spark, d):
    have = table(spark, d, "chunk_vectors").where("vector IS NOT NULL").select("chunk_id").distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "chunks").select("chunk_id").distinct().join(have, "chunk_id", "left").select("chunk_id", F.coalesce("hit", F.lit(False)).alias("cached"))


@query("SELECT coalesce(domain, 'none') AS domain, count(*) AS documents FROM documents GROUP BY 1 HAVING count(*) >= 10")
def large_domains(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce("domain", F.lit("none")).alias("domain")).agg(F.count("*").alias("documents")).where("documents >= 10")


@query(f"SELECT doc_id, coalesce(domain IN ({', '.join(repr(x) for x in DOMAINS)}), false) AS valid FROM documents")
def domain_validity(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.col("domain").isin(*DOMAINS), F.lit(False)).alias("valid"))


@query(
    """WITH s AS (SELECT file_path AS path, file_hash AS hash FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT file_path AS path, CASE WHEN doc_id % 5 = 0 THEN md5(text || 'x') ELSE file_hash END AS hash FROM documents WHERE doc_id % 11 <> 0),
    ss AS (SELECT path, min(hash) AS hash FROM s GROUP BY path), nn AS (SELECT path, min(hash) AS hash FROM n GROUP BY path)
    SELECT coalesce(ss.path, nn.path) AS path, CASE WHEN ss.path IS NULL THEN 'added' WHEN nn.path IS NULL THEN 'deleted' WHEN ss.hash IS NOT DISTINCT FROM nn.hash THEN 'skipped' ELSE 'updated' END AS action FROM ss FULL JOIN nn ON ss.path = nn.path"""
)
def sync_actions(spark, d):
    docs = table(spark, d, "documents")
    first = lambda df: df.groupBy("path").agg(F.min("hash").alias("hash"))
    state = first(docs.where("doc_id % 7 <> 0").select(F.col("file_path").alias("path"), F.col("file_hash").alias("hash")))
    changed = F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.col("file_hash"))
    return M.sync_plan(state, first(docs.where("doc_id % 11 <> 0").select(F.col("file_path").alias("path"), changed.alias("hash"))))


@query(
    """SELECT md5(text) AS hash, min(file_path) AS path FROM documents WHERE created_at >= 1715000000 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE created_at < 1715000000) GROUP BY 1"""
)
def new_imports(spark, d):
    docs = table(spark, d, "documents").select("created_at", F.col("file_path").alias("path"), F.md5("text").alias("hash"))
    return M.import_plan(docs.where("created_at >= 1715000000"), docs.where("created_at < 1715000000"))


@query(
    r"""SELECT folder, md5(string_agg(h, ',' ORDER BY h)) AS folder_hash FROM (SELECT regexp_extract(file_path, '^(.*)/', 1) AS folder, md5(text) AS h FROM documents) GROUP BY folder"""
)
def folder_hashes(spark, d):
    files = table(spark, d, "documents").select(F.regexp_extract("file_path", "^(.*)/", 1).alias("folder"), F.md5("text").alias("hash"))
    return M.folder_hash(files, "folder")


@query("SELECT doc_id, CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'processing' THEN 'interrupted' ELSE status_reason END AS status_reason FROM documents")
def stuck_documents(spark, d):
    return M.recover_stuck(table(spark, d, "documents")).select("doc_id", "status", "status_reason")


@query(
    """WITH gone AS (SELECT doc_id FROM documents WHERE status = 'failed'), c AS (SELECT DISTINCT chunk_id, doc_id FROM chunks)
    SELECT 'chunks' AS child, count(*) AS kept FROM c WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL
    SELECT 'vectors', count(*) FROM (SELECT DISTINCT chunk_id FROM chunk_vectors) WHERE chunk_id NOT IN (SELECT chunk_id FROM c WHERE doc_id IN (SELECT doc_id FROM gone))"""
)
def cascade_deleted(spark, d):
    gone = table(spark, d, "documents").where("status = 'failed'")
    c = table(spark, d, "chunks").select("chunk_id", "doc_id").distinct()
    lost = c.join(gone.select("doc_id"), "doc_id", "left_semi")
    kept = M.cascade_delete(gone, "doc_id", {"chunks": c}) | M.cascade_delete(lost, "chunk_id", {"vectors": table(spark, d, "chunk_vectors").select("chunk_id").distinct()})
    count = lambda n: kept[n].agg(F.count("*").alias("kept")).select(F.lit(n).alias("child"), "kept")
    return count("chunks").unionByName(count("vectors"))


@query(
    """SELECT cache_id, hit_count, created_at FROM (SELECT *, row_number() OVER (PARTITION BY cache_id ORDER BY created_at DESC, isnew DESC) AS n FROM
    (SELECT DISTINCT cache_id, hit_count, created_at, 0 AS isnew FROM semantic_cache UNION ALL SELECT DISTINCT cache_id, hit_count + 1, created_at, 1 FROM semantic_cache WHERE cache_id % 3 = 0)) WHERE n = 1"""
)
def cache_upsert(spark, d):
    c = table(spark, d, "semantic_cache").select("cache_id", "hit_count", "created_at").distinct()
    return M.upsert(c, c.where("cache_id % 3 = 0").withColumn("hit_count", F.col("hit_count") + 1), ["cache_id"], "created_at")


@query("SELECT cache_id FROM (SELECT DISTINCT cache_id FROM semantic_cache WHERE cache_id % 2 = 0 UNION SELECT DISTINCT cache_id FROM semantic_cache WHERE cache_id % 3 = 0)")
def insert_if_absent(spark, d):
    c = table(spark, d, "semantic_cache").select("cache_id").distinct()
    return M.insert_absent(c.where("cache_id % 2 = 0"), c.where("cache_id % 3 = 0"), ["cache_id"])


@query("SELECT message_id FROM messages WHERE 1736000000 - CASE WHEN created_at > 100000000000 THEN created_at // 1000 ELSE created_at END <= 14 * 86400")
def retained_messages(spark, d):
    at = F.when(F.col("created_at") > 100_000_000_000, F.floor(F.col("created_at") / 1000)).otherwise(F.col("created_at"))
    return M.retain(table(spark, d, "messages").withColumn("at", at), "at", 1736000000, 14 * 86400).select("message_id")


_TS = "epoch_us(ts) // 1000000"


@query(f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY {_TS} RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW), 4) AS spent FROM events")
def budget_rolling_day(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_timestamp("ts"))
    return M.rolling_spend(e, "user_id", F.col("at"), "value").select("event_id", F.round("spent", 4).alias("spent"))


@query(
    f"""WITH g AS (SELECT user_id, event_id, {_TS} AS sec, coalesce(({_TS} - lag({_TS}) OVER w > 3600)::INT, 1) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {_TS}, event_id)),
    s AS (SELECT user_id, sec, sum(fresh) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS events, min(sec) AS begins FROM s GROUP BY 1, 2"""
)
def burst_sessions(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("at"))
    return M.burst_sessions(e, "user_id", F.col("at"), 3600).groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("at").alias("begins"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events),
    r AS (SELECT event_id, user_id, sec, n, true AS admitted, [sec] AS recent FROM e WHERE n = 1
      UNION ALL SELECT event_id, user_id, sec, n, len(still) < 3, CASE WHEN len(still) < 3 THEN list_append(still, sec) ELSE still END
      FROM (SELECT e.event_id, e.user_id, e.sec, e.n, list_filter(r.recent, lambda t: t > e.sec - 86400) AS still FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT event_id, user_id, sec AS "at", admitted FROM r"""
)
def rate_limited(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("at"))
    return M.admit(e, "user_id", "at", 3, 86400)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def once_per_key(spark, d):
    e = table(spark, d, "events").withColumn("key", F.struct("user_id", "event_type"))
    return M.once_per_key(e, "key", "ts", "event_id").select("event_id")


_RECORDS = "SELECT event_type AS query_type, 'm' || user_id % 3 AS method, value % 100 / 100.0 AS score FROM events"
_STATS = f"""SELECT query_type, method, count(*) FILTER (score > 0.1) AS hits, count(*) AS total, round(count(*) FILTER (score > 0.1) / count(*)::DOUBLE, 6) AS hit_rate,
    round(coalesce(avg(score) FILTER (score > 0.1), 0), 6) AS avg_score FROM ({_RECORDS}) GROUP BY 1, 2"""


def _stats(spark, d):
    e = table(spark, d, "events")
    return M.retrieval_memory(e.select(F.col("event_type").alias("query_type"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("method"), (F.col("value") % 100 / 100.0).alias("score")))


@query(_STATS)
def retrieval_memory_stats(spark, d):
    return _stats(spark, d)


@query(
    f"""SELECT k.query_type, coalesce(method, 'vector') AS method FROM (SELECT DISTINCT event_type AS query_type FROM events UNION ALL SELECT 'never') k LEFT JOIN
    (SELECT query_type, method, row_number() OVER (PARTITION BY query_type ORDER BY hit_rate DESC, avg_score DESC, method DESC) AS n FROM ({_STATS})) b ON b.query_type = k.query_type AND n = 1"""
)
def best_methods(spark, d):
    kinds = table(spark, d, "events").select(F.col("event_type").alias("query_type")).distinct().union(spark.createDataFrame([("never",)], "query_type string"))
    return M.best_method(_stats(spark, d), kinds.withColumn("fallback", F.lit("vector")))


@query(
    """SELECT user_id, round(list_reduce(list_concat([0.5::DOUBLE], list([-0.10, -0.15, 0.05, 0.20, -0.25][event_id % 5 + 1]::DOUBLE ORDER BY ts, event_id)), lambda s, x: least(greatest(s + x, 0), 1)), 6) AS score FROM events GROUP BY user_id"""
)
def feedback_scores(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in M.FEEDBACK]), (F.col("event_id") % len(M.FEEDBACK) + 1).cast("int"))
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id", kind.alias("f")).alias("x")).groupBy("user_id").agg(F.array_sort(F.collect_list("x"))["f"].alias("f"))
    return e.select("user_id", F.round(M.apply_feedback(F.lit(0.5), F.col("f")), 6).alias("score"))


@query(
    """WITH m AS (SELECT DISTINCT message_id AS memory_id, CASE message_id % 3 WHEN 0 THEN 'wing' WHEN 1 THEN 'hall' ELSE 'room' END AS tier, message_id * 37 % 101 / 100.0 AS importance, message_id % 13 AS access_count FROM messages WHERE message_id IS NOT NULL),
    a AS (SELECT *, count(*) OVER (PARTITION BY tier) AS size FROM m), b AS (SELECT memory_id, CASE WHEN tier = 'wing' AND size > 50 AND importance >= 0.6 THEN 'hall' ELSE tier END AS tier,
      CASE WHEN tier = 'wing' AND size > 50 AND importance >= 0.6 THEN least(importance + 0.1, 1) ELSE importance END AS importance, access_count FROM a WHERE NOT (tier = 'wing' AND size > 50 AND importance < 0.3)),
    c AS (SELECT *, count(*) OVER (PARTITION BY tier) AS size FROM b), e AS (SELECT memory_id, CASE WHEN tier = 'hall' AND size > 100 AND importance >= 0.7 THEN 'room' ELSE tier END AS tier, importance, access_count FROM c),
    f AS (SELECT *, count(*) OVER (PARTITION BY tier) AS size, row_number() OVER (PARTITION BY tier ORDER BY access_count, memory_id) AS n FROM e)
    SELECT memory_id, tier, round(importance, 4)::DOUBLE AS importance FROM f WHERE NOT (tier = 'room' AND size > 500 AND n <= size - 500)"""
)
def memory_consolidated(spark, d):
    i = F.col("message_id")
    tier = F.when(i % 3 == 0, "wing").when(i % 3 == 1, "hall").otherwise("room")
    m = table(spark, d, "messages").where("message_id IS NOT NULL").select(i.alias("memory_id"), tier.alias("tier"), (i * 37 % 101 / 100.0).alias("importance"), (i % 13).alias("access_count")).distinct()
    return M.memory_tiers(m).select("memory_id", "tier", F.round("importance", 4).alias("importance"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'deny' WHEN event_type = 'view' THEN 'allow' ELSE 'ask' END AS effect FROM events")
def permission_effects(spark, d):
    rules = [("*", "ask"), ("view", "allow"), ("purchase", "deny")]
    return M.last_rule(table(spark, d, "events"), rules, "event_type").select("event_id", "effect")


@query("SELECT event_type, max(value) FILTER (n <= ceil(0.95 * c)) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events) GROUP BY event_type")
def value_p95(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("SELECT conversation_id, sum(floor(octet_length(encode(content)) / 4.0))::BIGINT AS tokens, round(sum(floor(octet_length(encode(content)) / 4.0)) / 1e6 * 5.0, 8) AS cost FROM (SELECT DISTINCT message_id, conversation_id, content FROM messages) GROUP BY 1")
def token_costs(spark, d):
    m = table(spark, d, "messages").select("message_id", "conversation_id", "content").distinct()
    t = m.groupBy("conversation_id").agg(F.sum(F.floor(F.octet_length("content") / 4)).alias("tokens"))
    return t.select("conversation_id", "tokens", F.round(F.col("tokens") / 1e6 * 5.0, 8).alias("cost"))


@query("SELECT doc_id, sequence, gap FROM (SELECT doc_id, sequence, sequence - lag(sequence) OVER (PARTITION BY doc_id ORDER BY sequence) AS gap FROM (SELECT DISTINCT doc_id, sequence FROM chunks)) WHERE gap > 1")
def sequence_gaps(spark, d):
    c = table(spark, d, "chunks").select("doc_id", "sequence").distinct()
    return c.withColumn("gap", F.col("sequence") - F.lag("sequence").over(Window.partitionBy("doc_id").orderBy("sequence"))).where("gap > 1")


@query(
    """SELECT r_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
)
def revenue_by_region(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    per_order = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    j = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.sum("n").alias("orders"), F.round(F.sum("amount"), 2).alias("revenue"))
