"""Queries of lookups, caches, memories, symbols, links, summaries, reports and the index pipeline."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import caches, export, extract, history, links, memory, symbols
from ..operators import maintenance as M
from ..operators import retrieval as R
from .registry import query, table

_CHUNKS = "SELECT chunk_id, min(doc_id) AS doc_id, min(sequence) AS sequence FROM chunks GROUP BY chunk_id"


def _chunks(spark, d):
    return table(spark, d, "chunks").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min("sequence").alias("sequence"))


@query(
    """SELECT q.doc_id AS asked, min(x.doc_id) AS by_hash, min(y.doc_id) AS by_path FROM documents q
    LEFT JOIN documents x ON x.file_hash = q.file_hash AND q.file_hash <> '' LEFT JOIN documents y ON y.original_path = q.original_path WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id"""
)
def point_lookups(spark, d):
    docs = table(spark, d, "documents")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("asked"), "file_hash", "original_path")
    first = lambda key, name: docs.where(F.col(key) != "").groupBy(key).agg(F.min("doc_id").alias(name))
    return asked.join(first("file_hash", "by_hash"), "file_hash", "left").join(first("original_path", "by_path"), "original_path", "left").select("asked", "by_hash", "by_path")


@query("SELECT status, count(*) AS n, count(*) FILTER (WHERE status IN ('failed', 'processing')) AS unfinished FROM documents GROUP BY status")
def status_counts(spark, d):
    unfinished = F.count_if(F.col("status").isin("failed", "processing"))
    return table(spark, d, "documents").groupBy("status").agg(F.count("*").alias("n"), unfinished.alias("unfinished"))


@query(
    f"""SELECT DISTINCT c.doc_id, c.sequence, v.chunk_id, d.file_path, len(v.vector) AS dim FROM chunk_vectors v JOIN ({_CHUNKS}) c USING (chunk_id) JOIN documents d ON d.doc_id = c.doc_id"""
)
def vectors_of_documents(spark, d):
    v = table(spark, d, "chunk_vectors").select("chunk_id", F.size("vector").cast("long").alias("dim")).distinct()
    joined = v.join(_chunks(spark, d), "chunk_id").join(table(spark, d, "documents").select("doc_id", "file_path"), "doc_id")
    return joined.select("doc_id", "sequence", "chunk_id", "file_path", "dim").orderBy("doc_id", "sequence", "chunk_id")


_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in extract.STOPWORDS) + ")"


@query(
    f"""SELECT d.doc_id, e.entity, count(*) AS mentions FROM (SELECT DISTINCT chunk_id, content, unnest(regexp_extract_all(content, '[A-Za-z]+')) AS entity FROM (SELECT DISTINCT chunk_id, content FROM chunks)) e
    JOIN ({_CHUNKS}) c USING (chunk_id) JOIN documents d ON d.doc_id = c.doc_id
    WHERE regexp_matches(entity, '^[A-Z].') AND NOT regexp_matches(entity, '^[A-Z]{{3,}}$') AND NOT regexp_matches(entity, '^[A-Z][a-z]+[A-Z]') AND entity NOT IN {_STOP_SQL} GROUP BY ALL"""
)
def entities_of_documents(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "content").distinct()
    found = c.select("chunk_id", F.explode(extract.proper_nouns(F.col("content"))).alias("entity"))
    docs = table(spark, d, "documents").select("doc_id")
    return found.join(_chunks(spark, d), "chunk_id").join(docs, "doc_id").groupBy("doc_id", "entity").agg(F.count("*").alias("mentions"))


@query(
    f"""SELECT person, count(*) AS texts FROM (SELECT DISTINCT chunk_id, content, unnest(list_distinct(regexp_extract_all(content, '(?s)([{extract.SURNAMES}][一-鿿]).?', 1))) AS person
    FROM (SELECT DISTINCT chunk_id, content FROM chunks)) GROUP BY person"""
)
def persons_named(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "content").distinct()
    return c.select(F.explode(extract.persons(F.col("content"))).alias("person")).groupBy("person").agg(F.count("*").alias("texts"))


_USABLE = "len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"


def _usable(df, column):
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where((F.size(column) == 64) & finite & F.exists(column, lambda x: x != 0))


@query(
    f"""WITH c AS (SELECT DISTINCT cache_id, query_embedding::DOUBLE[] AS v FROM semantic_cache WHERE {_USABLE.format("query_embedding")} AND 1736000000 - created_at <= 20000000),
    q AS (SELECT chunk_id AS query_id, min(vector)::DOUBLE[] AS v FROM chunk_vectors WHERE chunk_id % 50 = 0 AND {_USABLE.format("vector")} GROUP BY chunk_id),
    s AS (SELECT query_id, cache_id AS id, round(list_cosine_similarity(c.v, q.v), 6) AS score FROM c, q)
    SELECT query_id, id, score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1"""
)
def semantic_cache_hits(spark, d):
    cache = _usable(table(spark, d, "semantic_cache"), "query_embedding")
    asked = _usable(table(spark, d, "chunk_vectors").where("chunk_id % 50 = 0"), "vector")
    asked = asked.groupBy(F.col("chunk_id").alias("query_id")).agg(F.min("vector").alias("query_vec"))
    return caches.semantic_lookup(cache, asked, 0.3, 1_736_000_000, 20_000_000)


@query("SELECT cache_id, conversation_id FROM semantic_cache WHERE conversation_id % 20 NOT IN (3, 7) OR conversation_id IS NULL")
def cache_invalidated(spark, d):
    named = F.concat(F.lit('[{"doc": "doc'), (F.col("conversation_id") % 20).cast("string"), F.lit('"}]'))
    cache = table(spark, d, "semantic_cache").select("cache_id", "conversation_id", named.alias("sources_json"))
    return caches.invalidate_by_document(cache, spark.createDataFrame([("doc3",), ("doc7",)], "name string")).select("cache_id", "conversation_id")


@query(
    """SELECT count(*) FILTER (WHERE cache_id % 4 = 1) AS exact_hits, count(*) FILTER (WHERE cache_id % 4 = 2) AS semantic_hits, count(*) FILTER (WHERE cache_id % 4 = 3) AS retrieval_hits,
    count(*) AS lookups, 2 * count(*) AS entries, count(*) FILTER (WHERE cache_id % 4 IN (1, 2)) * 3700 AS tokens_saved FROM semantic_cache"""
)
def cache_counters(spark, d):
    cache = table(spark, d, "semantic_cache")
    level = F.when(F.col("cache_id") % 4 == 1, "exact").when(F.col("cache_id") % 4 == 2, "semantic").when(F.col("cache_id") % 4 == 3, "retrieval")
    return caches.cache_stats(cache.select(level.alias("level")), {"semantic": cache, "retrieval": cache})


_MEMORIES = "SELECT cache_id AS memory_id, min(query_text) AS content, cache_id * 37 % 101 / 100.0::DOUBLE AS importance, min(created_at) AS last_accessed FROM semantic_cache GROUP BY cache_id"


def _memories(spark, d):
    cache = table(spark, d, "semantic_cache").groupBy(F.col("cache_id").alias("memory_id"))
    found = cache.agg(F.min("query_text").alias("content"), F.min("created_at").alias("last_accessed"))
    return found.withColumn("importance", F.col("memory_id") * 37 % 101 / 100.0)


@query(
    f"""SELECT memory_id, importance, last_accessed FROM (SELECT * FROM ({_MEMORIES}) WHERE contains(lower(content), 'what') ORDER BY importance DESC, memory_id LIMIT 24)
    ORDER BY importance DESC, last_accessed DESC, memory_id LIMIT 12"""
)
def memories_found(spark, d):
    return memory.search_memories(_memories(spark, d), "What", 12).select("memory_id", "importance", "last_accessed")


@query(
    f"""SELECT memory_id, CASE memory_id % 3 WHEN 0 THEN 'hall' ELSE 'room' END AS tier, CASE WHEN memory_id % 10 = 0 THEN 1 WHEN memory_id % 3 = 2 THEN round(importance, 6) ELSE round(least(importance + 0.1, 1), 6) END AS importance FROM ({_MEMORIES})
    """.replace("CASE memory_id % 3 WHEN 0", "CASE WHEN memory_id % 10 = 0 THEN 'room' WHEN memory_id % 3 = 0")
)
def memories_promoted(spark, d):
    kind = F.when(F.col("memory_id") % 3 == 0, "wing").when(F.col("memory_id") % 3 == 1, "hall").otherwise("room")
    m = _memories(spark, d).withColumn("tier", kind)
    tier, importance = memory.promote(F.col("tier"), F.col("importance"))
    up = m.select("memory_id", tier.alias("tier"), F.round(importance, 6).alias("importance"))
    pinned = up.withColumn("importance", F.when(F.col("memory_id") % 10 == 0, 1.0).otherwise(F.col("importance")))
    return pinned.withColumn("tier", F.when(F.col("memory_id") % 10 == 0, "room").otherwise(F.col("tier")))


_FN = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"
_SYMBOLS = f"SELECT chunk_id AS id, unnest(regexp_extract_all(content, '{_FN}', 1)) AS name FROM (SELECT DISTINCT chunk_id, content FROM chunks WHERE contains(content, '```rust'))"


def _symbols(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "content").distinct()
    return symbols.symbols_of_texts(c, "chunk_id", "content")


@query(f"SELECT name, count(*) AS n, min(id) AS first_id FROM ({_SYMBOLS}) GROUP BY name")
def symbols_in_code(spark, d):
    return _symbols(spark, d).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_WANTED = f"SELECT id AS query_id, min(name) AS query FROM ({_SYMBOLS}) GROUP BY id UNION ALL SELECT -1, 'Gorm'"


@query(
    f"""WITH s AS (SELECT DISTINCT id, name FROM ({_SYMBOLS})), q AS ({_WANTED}),
    h AS (SELECT query_id, id, max(CASE WHEN name = query AND (contains(query, '_') OR regexp_matches(query, '^[A-Z]') OR regexp_matches(query, '[A-Z]') AND regexp_matches(query, '[a-z]')) THEN 1.0 ELSE 0.8 END)::DOUBLE AS score
      FROM s, q WHERE name = query OR contains(lower(name), lower(query)) GROUP BY ALL)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20"""
)
def symbol_hits(spark, d):
    found = _symbols(spark, d)
    q = found.groupBy(F.col("id").alias("query_id")).agg(F.min("name").alias("query"))
    q = q.unionByName(spark.createDataFrame([(-1, "Gorm")], q.schema))
    return symbols.symbol_search(found, q, 20)


@query(f"SELECT id, name FROM ({_SYMBOLS}) WHERE contains(lower(name), 'gorm') ORDER BY name, id LIMIT 20")
def symbols_by_name(spark, d):
    return symbols.symbols_named(_symbols(spark, d), "Gorm").select("id", "name")


@query(
    r"""SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(flatten(list_transform(regexp_split_to_array(query_text, '\s+'), lambda w: string_split(w, '::'))), lambda w: regexp_replace(w, '[^\p{L}\p{N}_]', '', 'g')))) AS word FROM semantic_cache)
    WHERE octet_length(encode(word)) >= 2 AND (contains(word, '_') OR (regexp_matches(word, '\p{Lu}') AND regexp_matches(word, '\p{Ll}')) OR regexp_matches(word, '^\p{Lu}')) GROUP BY word"""
)
def identifier_words(spark, d):
    words = table(spark, d, "semantic_cache").select(F.explode(symbols.identifier_names(F.col("query_text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


_LINKS = r"SELECT doc_id AS source, regexp_extract(file_path, '[^/\\]*$') || CASE WHEN doc_id % 3 = 0 THEN ' (Copy)' ELSE '' END AS target FROM documents WHERE file_path IS NOT NULL"


def _links(spark, d):
    name = F.concat(T.base_name("file_path"), F.when(F.col("doc_id") % 3 == 0, " (Copy)").otherwise(""))
    return table(spark, d, "documents").where("file_path IS NOT NULL").select(F.col("doc_id").alias("source"), name.alias("target"))


@query(
    rf"""WITH n AS (SELECT DISTINCT regexp_extract(file_path, '[^/\\]*$') AS name FROM documents WHERE doc_id % 50 = 0 AND file_path IS NOT NULL)
    SELECT DISTINCT name, source, target FROM ({_LINKS}) l JOIN n ON contains(lower(target), lower(name)) WHERE name <> ''"""
)
def backlinks(spark, d):
    names = table(spark, d, "documents").where("doc_id % 50 = 0 AND file_path IS NOT NULL").select(T.base_name("file_path").alias("name")).distinct()
    return links.backlinks(_links(spark, d), names)


@query(f"SELECT source, target FROM ({_LINKS}) WHERE source % 50 = 0")
def forward_links(spark, d):
    asked = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("source"))
    return links.forward_links(_links(spark, d), asked)


@query(
    f"""WITH b AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY sequence, chunk_id) - 1 AS pos FROM ({_CHUNKS}))
    SELECT doc_id || ':L1:0' AS hit, chunk_id::VARCHAR AS chunk FROM b WHERE n > 4 AND pos // 16 = 0"""
)
def summaries_expanded(spark, d):
    c = _chunks(spark, d).withColumn("content", F.lit(""))
    tree = history.summary_tree(c, "doc_id", "chunk_id", "sequence", "content")
    named = F.concat_ws(":", "doc_id", F.concat(F.lit("L"), "level"), "node")
    kids = F.transform("child_ids", lambda x: F.when(x.startswith("L"), F.concat_ws(":", "doc_id", x)).otherwise(x))
    tree = tree.select("doc_id", "level", "node", named.alias("id"), kids.alias("child_ids"))
    # documents of one level only are hit there
    top = tree.where("node = 0").groupBy("doc_id").agg(F.max("level").alias("level"))
    hits = top.select(F.concat_ws(":", "doc_id", F.concat(F.lit("L"), "level"), F.lit("0")).alias("node"))
    found = history.expand_summaries(tree.select(F.col("id").alias("node"), "child_ids"), hits)
    return found.select(F.concat(F.substring_index("hit", ":", 1), F.lit(":L1:0")).alias("hit"), "chunk")


_SAID = "SELECT message_id, conversation_id, min(role) AS role, min(coalesce(content, '')) AS content FROM messages WHERE conversation_id IS NOT NULL GROUP BY ALL"


@query(
    f"""WITH m AS (SELECT *, octet_length(encode(content)) // 4 AS cost FROM ({_SAID})), w AS (SELECT *, count(*) OVER c AS n, sum(cost) OVER c AS total, row_number() OVER b AS back, sum(cost) OVER (b ROWS UNBOUNDED PRECEDING) AS used
      FROM m WINDOW c AS (PARTITION BY conversation_id), b AS (PARTITION BY conversation_id ORDER BY message_id DESC)),
    k AS (SELECT *, n <= 2 OR total <= 300 OR used <= 200 OR back = 1 AS stays FROM w)
    SELECT conversation_id, message_id, 1 AS part, role, md5(content) AS digest FROM k WHERE stays
    UNION ALL SELECT conversation_id, NULL, 0, 'system', md5('(earlier messages left out: ' || count(*) || ')') FROM k WHERE NOT stays GROUP BY conversation_id"""
)
def history_compacted(spark, d):
    m = table(spark, d, "messages").where("conversation_id IS NOT NULL").groupBy("message_id", "conversation_id")
    m = m.agg(F.min("role").alias("role"), F.min(F.coalesce("content", F.lit(""))).alias("content"))
    out = history.compact_history(m, "conversation_id", ["message_id"], T.token_estimate("content"), 300)
    return out.select("conversation_id", "message_id", "part", "role", F.md5("content").alias("digest"))


@query(
    r"""WITH p AS (SELECT conversation_id, string_agg('### ' || CASE message_id % 3 WHEN 0 THEN '🔴' WHEN 1 THEN '🟡' ELSE '🟢' END || ' ' || nth || '. ' || pair_id || chr(10) || '- A: a' || chr(10) || '- B: b' || chr(10) || '- why', chr(10) || chr(10) ORDER BY pair_id) AS body, count(*) AS n
      FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY pair_id) AS nth FROM (SELECT DISTINCT conversation_id, message_id, 'P' || lpad(message_id::VARCHAR, 8, '0') AS pair_id FROM messages WHERE message_id % 7 = 0)) GROUP BY conversation_id)
    SELECT c.conversation_id AS report_id, md5('## Audit: ' || coalesce(title, '') || chr(10) || chr(10) || '- chunks: 1' || chr(10) || '- claims: 2' || chr(10) || '- contradictions: ' || coalesce(n, 0) || chr(10) || chr(10) || coalesce(body, 'No contradictions found.')) AS digest
    FROM conversations c LEFT JOIN p ON p.conversation_id = c.conversation_id"""
)
def audit_reports(spark, d):
    c = table(spark, d, "conversations")
    reports = c.select(F.col("conversation_id").alias("report_id"), F.coalesce("title", F.lit("")).alias("doc_name"), F.lit(1).alias("chunks"), F.lit(2).alias("claims"))
    m = table(spark, d, "messages").select("conversation_id", "message_id").distinct()
    third = F.col("message_id") % 3
    pairs = m.select(
        F.col("conversation_id").alias("report_id"), F.concat(F.lit("P"), F.lpad(F.col("message_id").cast("string"), 8, "0")).alias("pair_id"),
        F.when(F.col("message_id") % 7 == 0, "contradiction").otherwise("consistent").alias("verdict"),
        F.when(third == 0, "high").when(third == 1, "medium").otherwise("low").alias("severity"), F.lit("a").alias("claim_a"), F.lit("b").alias("claim_b"), F.lit("why").alias("explanation"),
    )
    return export.audit_markdown(reports, pairs).select("report_id", F.md5("markdown").alias("digest"))


@query(
    r"""SELECT conversation_id, coalesce(regexp_matches(lower(replace(title, ' ', '_')), '^[a-z0-9_]{1,32}$'), false) AS valid, coalesce(contains(title || CASE WHEN conversation_id % 2 = 0 THEN ' {query}' ELSE '' END, '{query}'), false) AS asks FROM conversations"""
)
def template_names(spark, d):
    name = F.lower(F.replace("title", F.lit(" "), F.lit("_")))
    template = F.concat("title", F.when(F.col("conversation_id") % 2 == 0, " {query}").otherwise(""))
    return table(spark, d, "conversations").select("conversation_id", T.template_name_is_valid(name).alias("valid"), T.has_query_placeholder(template).alias("asks"))


@query(
    """SELECT o_orderkey, 1 + i AS number, CASE i WHEN 0 THEN 'search' ELSE 'read' END AS tool, o_orderkey || CASE i WHEN 0 THEN ' a' ELSE ' b' END AS input, 'done ' || o_orderkey AS answer FROM orders, (SELECT unnest([0, 1]) AS i)"""
)
def agent_actions(spark, d):
    key = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("Thought: x\nAction 1: search\nAction Input 1: "), key, F.lit(" a\nAction 2: read\nAction Input 2: "), key, F.lit(" b\nFinal Answer: done "), key)
    o = table(spark, d, "orders").select("o_orderkey", text.alias("t"))
    return o.select("o_orderkey", F.inline(T.react_actions("t")), T.final_answer("t").alias("answer")).select("o_orderkey", "number", "tool", "input", "answer")


@query(
    """WITH s AS (SELECT CASE WHEN event_id % 5 > 0 THEN event_id % 2 END AS d, CASE WHEN event_id % 7 > 0 THEN event_id % 3 % 2 END AS s FROM events)
    SELECT count(*) FILTER (WHERE d = s) AS agreed, count(*) FILTER (WHERE d <> s) AS disagreed, count(*) FILTER (WHERE d IS NULL OR s IS NULL) AS unavailable, round(count(*) FILTER (WHERE d <> s) / count(*) FILTER (WHERE d IS NOT NULL AND s IS NOT NULL)::DOUBLE, 6) AS disagree_rate FROM s"""
)
def screen_agreement(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(F.when(i % 5 > 0, i % 2).alias("decision"), F.when(i % 7 > 0, i % 3 % 2).alias("shadow"))
    return M.screen_agreement(e)


@query("SELECT count(*) AS drafts, count(*) FILTER (WHERE value > 50) AS accepted, round(avg((value > 50)::INT), 6) AS accept_rate, round(avg(value / 100), 6) AS mean_alike, round(avg(event_id % 9), 6) AS mean_saved FROM events WHERE value IS NOT NULL")
def draft_rates(spark, d):
    e = table(spark, d, "events").where("value IS NOT NULL")
    return M.draft_stats(e.select((F.col("value") > 50).alias("accepted"), (F.col("value") / 100).alias("alike"), (F.col("event_id") % 9).alias("seconds_saved")))


@query(
    """SELECT gram, count(*) AS texts, sum(tf)::BIGINT AS n FROM (SELECT cache_id, gram, count(*) AS tf FROM (SELECT cache_id, substr(low, i::BIGINT, 3) AS gram FROM (SELECT DISTINCT cache_id, lower(query_text) AS low FROM semantic_cache WHERE length(query_text) >= 3), LATERAL (SELECT unnest(generate_series(1, length(low) - 2)) AS i)) GROUP BY ALL) GROUP BY gram"""
)
def gram_counts(spark, d):
    c = table(spark, d, "semantic_cache").select("cache_id", "query_text").distinct()
    return R.postings(c, "cache_id", "query_text").groupBy("gram").agg(F.count("*").alias("texts"), F.sum("tf").alias("n"))


@query(
    """WITH t AS (SELECT DISTINCT cache_id, lower(query_text) AS low FROM semantic_cache WHERE query_text IS NOT NULL), q AS (SELECT unnest(['what', 'vaccines', 'contos', 'the']) AS term)
    SELECT term, cache_id AS id FROM t, q WHERE contains(low, term)"""
)
def texts_with_token(spark, d):
    c = table(spark, d, "semantic_cache").where("query_text IS NOT NULL").select(F.col("cache_id").alias("id"), "query_text").distinct()
    # the index says where to look, the text decides; every third text is written anew
    index = R.refresh_postings(R.postings(c, "id", "query_text"), c.where("id % 3 = 0"), text_col="query_text")
    asked = spark.createDataFrame([("what",), ("vaccines",), ("contos",), ("the",)], "term string")
    maybe = R.texts_with(index, asked)
    return maybe.join(c, "id").where(F.contains(F.lower("query_text"), F.col("term"))).select("term", "id")


@query(
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unchanged' WHEN text IS NULL OR regexp_full_match(text, '\\s*') THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN doc_id % 5 > 0 AND (text IS NULL OR regexp_full_match(text, '\\s*')) THEN 'no text' END AS status_reason FROM documents"
)
def index_status(spark, d):
    from ..plans.index import index_documents

    docs = table(spark, d, "documents").select("doc_id", "text")
    done = docs.where("doc_id % 5 = 0").select("doc_id", F.md5("text").alias("file_hash"))
    return index_documents(docs, done=done)["status"]


@query(
    """SELECT doc_id, array_to_string(list_concat(list_filter(from_json(tags, '["VARCHAR"]'), lambda t: t <> 'important' AND t <> 'new'), ['new']), ',') AS tags FROM documents WHERE json_valid(tags)"""
)
def tags_changed(spark, d):
    docs = table(spark, d, "documents").where(F.from_json("tags", "array<string>").isNotNull())
    changed = M.add_tag(M.remove_tag(M.remove_tag(T.json_strings("tags"), "important"), "new"), "new")
    return docs.select("doc_id", F.array_join(changed, ",").alias("tags"))


@query(f"SELECT memory_id, round(0.6 * importance + 0.4 * (memory_id % 13) / 12, 6) AS score FROM ({_MEMORIES})")
def forget_scores(spark, d):
    m = _memories(spark, d)
    return m.select("memory_id", F.round(M.forget_score(F.col("importance"), F.col("memory_id") % 13, F.lit(12)), 6).alias("score"))


@query(r"SELECT c.chunk_id, md5('文档《' || regexp_extract(d.file_path, '[^/\\]*$') || '》：' || chr(10) || c.content) AS digest FROM (SELECT DISTINCT chunk_id, doc_id, content FROM chunks) c JOIN documents d USING (doc_id)")
def contextual_texts(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "content").distinct()
    named = c.join(table(spark, d, "documents").select("doc_id", "file_path"), "doc_id")
    return named.select("chunk_id", F.md5(export.contextual_text(T.base_name("file_path"), F.col("content"))).alias("digest"))


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id IN (50, 100)),
    t AS (SELECT id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20) SELECT id, max(score) AS score FROM t GROUP BY id ORDER BY score DESC, id LIMIT 15"""
)
def merged_scores(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id IN (50, 100)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    lists = R.vector_search(e, asked, 20, "vec_id", "embedding")
    return R.merge_scores(lists.where("query_id = 50"), lists.where("query_id = 100"), 15)
