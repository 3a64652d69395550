"""Queries of scalar functions, extraction, splitting and privacy."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, privacy, splitters
from .registry import query, table


def _alt(words):
    return "|".join(w.replace(".", r"\.") for w in words)


@query(
    r"""SELECT cache_id, trim(lower(regexp_replace(query_text, '\s+', ' ', 'g'))) AS normal,
    sha256(trim(lower(regexp_replace(query_text, '\s+', ' ', 'g')))) AS digest FROM semantic_cache"""
)
def query_normalise_hash(spark, d):
    return table(spark, d, "semantic_cache").select("cache_id", T.normalize_query("query_text").alias("normal"), T.query_key("query_text").alias("digest"))


_TYPE_SQL = f"""CASE WHEN regexp_matches(lower(content), '{_alt(T.CODE_WORDS)}') THEN 'code' WHEN regexp_matches(lower(content), '{_alt(T.ANALYTICAL_WORDS)}') THEN 'analytical'
    WHEN regexp_matches(lower(content), '{_alt(T.FACTUAL_WORDS)}') THEN 'factual' ELSE 'conversational' END"""


@query(
    f"""SELECT {_TYPE_SQL} AS query_type, CASE WHEN regexp_matches(lower(content), '{_alt(T.GLOBAL_WORDS)}') THEN 'global' ELSE 'local' END AS level, count(*) AS n
    FROM messages WHERE lower(trim(role)) IN ('user', 'human') GROUP BY ALL"""
)
def query_types(spark, d):
    m = table(spark, d, "messages").where("lower(trim(role)) IN ('user', 'human')")
    return m.groupBy(T.query_type("content").alias("query_type"), T.query_level("content").alias("level")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT message_id, coalesce(regexp_matches(lower(content), '{_alt(T.INSUFFICIENT_WORDS)}'), false) AS lacking,
    CASE WHEN regexp_matches(content, '{_alt(T.AUTH_MARKS)}') THEN 'AUTH' WHEN regexp_matches(content, '{_alt(T.NETWORK_MARKS)}') THEN 'NETWORK' ELSE 'LLM' END AS error_class
    FROM messages"""
)
def answer_flags(spark, d):
    return table(spark, d, "messages").select("message_id", T.lacks_information("content").alias("lacking"), T.error_class("content").alias("error_class"))


@query("SELECT file_hash = md5(text) AS fresh, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY ALL")
def stored_hashes(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy((F.col("file_hash") == F.md5("text")).alias("fresh")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query(
    """SELECT CASE WHEN n_chars * 100000 > 1000000000 THEN 2048 WHEN n_chars * 100000 > 200000000 THEN 1024 WHEN n_chars * 100000 > 50000000 THEN 512 ELSE 256 END AS chunk_tokens,
    count(*) AS n FROM documents GROUP BY ALL"""
)
def chunk_windows(spark, d):
    return table(spark, d, "documents").groupBy(T.chunk_window(F.col("n_chars") * 100000).alias("chunk_tokens")).agg(F.count("*").alias("n"))


@query(
    r"""SELECT conversation_id, CASE WHEN length(title) > 24 THEN left(title, 24) || '…' ELSE title END AS preview,
    coalesce(nullif(regexp_replace(trim(regexp_replace(title, '[/\\:*?"<>|]', '_', 'g')), '^\.+|\.+$', '', 'g'), ''), 'conversation') AS file_name,
    strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' UTC' AS created FROM conversations"""
)
def conversation_titles(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conversation_id", T.preview("title", 24).alias("preview"), T.safe_file_name("title").alias("file_name"), T.epoch_text("created_at").alias("created"))


@query(
    r"""SELECT doc_id, regexp_extract(file_path, '[^/\\]*$') AS base, lower(regexp_extract(regexp_extract(file_path, '[^/\\]*$'), '\.([^.]+)$', 1)) AS extension FROM documents"""
)
def path_parts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.base_name("file_path").alias("base"), T.extension("file_path").alias("extension"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(from_json(tags, '[\"VARCHAR\"]')) AS tag FROM documents) GROUP BY tag")
def tag_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(T.json_strings("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, round(1 - levenshtein(left(p_name, 200), left(p_type, 200)) / greatest(length(left(p_name, 200)), length(left(p_type, 200)))::DOUBLE, 6) AS alike FROM part")
def levenshtein_similarity(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(T.similarity("p_name", "p_type"), 6).alias("alike"))


@query(
    """SELECT o_orderkey, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN card[i]::INT ELSE card[i]::INT * 2 - CASE WHEN card[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0 AS valid
    FROM (SELECT o_orderkey, '4' || lpad(o_orderkey::VARCHAR, 15, '0') AS card FROM orders)"""
)
def card_checks(spark, d):
    card = F.concat(F.lit("4"), F.lpad(F.col("o_orderkey").cast("string"), 15, "0"))
    return table(spark, d, "orders").select("o_orderkey", T.card_is_valid(card).alias("valid"))


@query("SELECT doc_id, sum(floor(octet_length(encode(content)) / 4.0))::BIGINT AS tokens FROM chunks GROUP BY doc_id")
def token_estimates(spark, d):
    return table(spark, d, "chunks").groupBy("doc_id").agg(F.sum(T.token_estimate("content")).alias("tokens"))


_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in extract.STOPWORDS) + ")"


@query(
    f"""SELECT word, count(*) AS texts FROM (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(content, '[A-Za-z]+')) AS word FROM (SELECT DISTINCT chunk_id, content FROM chunks))
    WHERE regexp_matches(word, '^[A-Z].') AND NOT regexp_matches(word, '^[A-Z]{{3,}}$') AND NOT regexp_matches(word, '^[A-Z][a-z]+[A-Z]') AND word NOT IN {_STOP_SQL} GROUP BY word"""
)
def proper_noun_counts(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "content").distinct()
    return c.select(F.explode(extract.proper_nouns(F.col("content"))).alias("word")).groupBy("word").agg(F.count("*").alias("texts"))


@query()
def entities_by_type(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "content").distinct()
    return c.select(F.explode(extract.entities(F.col("content"))).alias("e")).groupBy("e.type").agg(F.count("*").alias("mentions"), F.count_distinct("e.entity").alias("entities"))


@query()
def entity_relations(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "content").distinct().withColumn("entities", extract.entities(F.col("content")))
    return extract.relations(c).groupBy("relation_type", "confidence").agg(F.count("*").alias("n"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails,
    len(regexp_extract_all(text, '1[3-9][0-9]{9}')) AS phones, len(regexp_extract_all(text, '[0-9]{16,19}')) AS long_numbers, len(regexp_extract_all(text, '\+[0-9]{7,15}')) AS intl_phones FROM documents"""
)
def pii_counts(spark, d):
    kinds = (("email", "emails"), ("phone", "phones"), ("bank_card", "long_numbers"), ("intl_phone", "intl_phones"))
    return table(spark, d, "documents").select("doc_id", *[privacy.pattern_count(F.col("text"), k).cast("long").alias(n) for k, n in kinds])


@query()
def pii_redacted(spark, d):
    done = privacy.redacted(table(spark, d, "messages"), "message_id", "content")
    return done.select(F.col("id").alias("message_id"), F.md5("text").alias("digest"), "detections", "kinds")


@query()
def semantic_chunks(spark, d):
    return splitters.split_texts(table(spark, d, "documents"), "semantic", "doc_id", "text")


@query()
def section_chunks(spark, d):
    return splitters.split_texts(table(spark, d, "documents"), "section", "doc_id", "text")


@query(
    """SELECT cache_id, i AS slice, substr(answer_text, (i * 40 + 1)::BIGINT, 40) AS part FROM (SELECT DISTINCT cache_id, answer_text, unnest(range(0, ((length(answer_text) + 39) // 40)::BIGINT)) AS i FROM semantic_cache
    WHERE answer_text IS NOT NULL)"""
)
def answer_slices(spark, d):
    c = table(spark, d, "semantic_cache").where("answer_text IS NOT NULL").select("cache_id", "answer_text").distinct()
    return c.select("cache_id", F.posexplode(splitters.answer_slices(F.col("answer_text"))).alias("slice", "part"))


@query(
    r"""WITH w AS (SELECT cache_id, query_text, list_filter(list_transform(regexp_split_to_array(query_text, '\s+'), lambda x: regexp_replace(x, '[^\p{L}\p{N}_-]', '', 'g')), lambda x: x <> '') AS every FROM semantic_cache),
    o AS (SELECT cache_id, query_text, list_filter(every, lambda x, i: list_position(every, x) = i) AS words FROM w),
    t AS (SELECT cache_id, query_text, CASE WHEN len(words) = 1 AND length(words[1]) > 3 AND regexp_matches(words[1], '[一-鿿]') THEN list_transform(generate_series(1, greatest(length(words[1]) - 2, 1)), lambda i: substr(words[1], i::BIGINT, 3)) ELSE words END AS every FROM o)
    SELECT cache_id, array_to_string(list_transform(list_filter(every, lambda x, i: list_position(every, x) = i), lambda x: '"' || x || '"'), ' OR ') AS expression FROM t"""
)
def search_expressions(spark, d):
    return table(spark, d, "semantic_cache").select("cache_id", T.fts_query("query_text").alias("expression"))


@query()
def compressed_answers(spark, d):
    from ..operators.compress import compressed

    c = table(spark, d, "semantic_cache").select("cache_id", "answer_text", "query_text").distinct()
    return compressed(c, "cache_id", "answer_text", "query_text", 2.0)


@query()
def propositions_of_chunks(spark, d):
    import re

    import pandas as pd

    first_name = lambda s: next(iter(re.findall(r"\b[A-Z][a-z]{3,}\b", s)), None)

    def run(batches):
        for b in batches:
            rows = [(k, i, p) for k, t in zip(b.chunk_id, b.content) for i, p in enumerate(extract.propositions(t or "", first_name))]
            yield pd.DataFrame(rows, columns=["chunk_id", "sequence", "content"])

    c = table(spark, d, "chunks").select("chunk_id", "content").distinct()
    return c.mapInPandas(run, "chunk_id long, sequence int, content string")


@query()
def wiki_link_targets(spark, d):
    from pyspark.sql.types import ArrayType, StringType

    links = F.pandas_udf(lambda s: s.map(lambda t: extract.wiki_links(t or "")), ArrayType(StringType()))
    linked = F.concat("text", F.lit("\n[["), T.base_name("file_path"), F.lit("|file]] and `[[code]]`"))
    return table(spark, d, "documents").select("doc_id", F.explode(links(linked)).alias("target"))
