"""Queries of vector, keyword and hybrid retrieval."""

from pyspark.sql import functions as F

from ..functions.text import normalize_query, query_key
from ..functions.vectors import cosine, norm
from ..operators import retrieval as R
from .registry import query, table

_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]), 6)"
_TOPK = f"""SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM
    (SELECT q.query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e, (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0) q)"""


def _queries(e):
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def _lists(spark, d, k):
    e = table(spark, d, "embeddings")
    return R.vector_search(e, _queries(e), k, "vec_id", "embedding")


@query(
    """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q
    ORDER BY score DESC, vec_id LIMIT 10"""
)
def vector_topk_exact(spark, d):
    e = table(spark, d, "embeddings")
    q = e.agg(F.min_by("embedding", "vec_id").alias("v"))  # one row
    scored = e.crossJoin(F.broadcast(q)).select("vec_id", F.round(cosine("embedding", "v"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"SELECT query_id, id, score, rank FROM ({_TOPK}) WHERE rank < 8")
def vector_topk_batch(spark, d):
    return _lists(spark, d, 8)


@query(f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM ({_TOPK}) WHERE query_id <> id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 8")
def vector_index_topk(spark, d):
    from ..operators.vector_tree import index_topk

    e = table(spark, d, "embeddings")
    return index_topk(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id")), 8, "vec_id", "embedding", recall=1.0)


@query(f"SELECT query_id, id, score FROM ({_TOPK}) WHERE rank < 24 AND score >= 0.35")
def vector_threshold(spark, d):
    return _lists(spark, d, 24).where("score >= 0.35").select("query_id", "id", "score")


@query(
    """SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY ALL"""
)
def centroids_by_label(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(
    """WITH c AS (SELECT label, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label),
    s AS (SELECT vec_id, c.label AS nearest, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, c)
    SELECT vec_id, nearest, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, nearest) AS n FROM s) WHERE n = 1"""
)
def nearest_centroid(spark, d):
    e = table(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m")))["m"].alias("v"))  # one row a label
    scored = e.select("vec_id", "embedding").crossJoin(F.broadcast(centroids)).select("vec_id", F.col("label").alias("nearest"), F.round(cosine("embedding", "v"), 6).alias("score"))
    return R.ranked(scored, ["vec_id"], "score", "nearest", 1).select("vec_id", "nearest", "score")


@query("SELECT chunk_id, len(vector) AS dim, round(sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM chunk_vectors WHERE len(list_filter(vector, lambda x: NOT isfinite(x))) = 0")
def vector_norms(spark, d):
    v = table(spark, d, "chunk_vectors").where(~F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    return v.select("chunk_id", F.size("vector").cast("long").alias("dim"), F.round(norm("vector"), 4).alias("norm"))


_FUSED = f"""WITH l AS ({_TOPK}), v AS (SELECT id, score, rank FROM l WHERE query_id = 50 AND rank < 24), k AS (SELECT id, score, rank FROM l WHERE query_id = 100 AND rank < 24), e AS (SELECT id, score, rank FROM l WHERE query_id = 150 AND rank < 24),
    u AS (SELECT id, score, 1.0 / (61 + rank) AS w, 0 AS src FROM v UNION ALL SELECT id, score, 0.8 / (61 + rank), 1 FROM k UNION ALL SELECT id, score, 0.6 / (61 + rank), 2 FROM e),
    f AS (SELECT id, round(sum(w), 9) AS fused, arg_min(score, src) AS score FROM u GROUP BY id)
    SELECT id, fused, score, row_number() OVER (ORDER BY fused DESC, id) - 1 AS rank FROM f ORDER BY fused DESC, id LIMIT 16"""


@query(_FUSED)
def rrf_three_way(spark, d):
    lists = _lists(spark, d, 24)
    part = lambda q: lists.where(F.col("query_id") == q).select("id", "score", "rank")
    return R.fuse({"vector": part(50), "keyword": part(100), "entity": part(150)}, 16)


@query(
    """WITH c AS (SELECT chunk_id, min(doc_id) AS doc_id, min(sequence) AS sequence FROM chunks GROUP BY chunk_id),
    p AS (SELECT *, lag(chunk_id) OVER w AS before, lead(chunk_id) OVER w AS after FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY sequence, chunk_id)),
    h AS (SELECT chunk_id, round(1.0 / (1 + chunk_id % 97), 6) AS score, row_number() OVER (ORDER BY chunk_id) - 1 AS rank FROM c WHERE chunk_id % 50 = 0),
    w AS (SELECT unnest([before, p.chunk_id, after]) AS chunk_id, score, rank FROM h JOIN p USING (chunk_id)),
    b AS (SELECT chunk_id, arg_min(score, rank) AS score FROM w WHERE chunk_id IS NOT NULL GROUP BY chunk_id) SELECT doc_id, chunk_id, sequence, score FROM b JOIN c USING (chunk_id)"""
)
def neighbours_expanded(spark, d):
    c = table(spark, d, "chunks").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min("sequence").alias("sequence"))
    # ids ascend, so the id itself ranks the hits as their row number would
    hits = c.where("chunk_id % 50 = 0").select("chunk_id", F.round(1.0 / (1 + F.col("chunk_id") % 97), 6).alias("score"), F.col("chunk_id").alias("rank"))
    return R.expand_neighbours(hits, c)


def _bm25_sql(texts, queries, k):
    return f"""WITH t AS ({texts}), q AS ({queries}),
    tok AS (SELECT DISTINCT query_id, lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}_-]', '', 'g')) AS term FROM (SELECT query_id, unnest(regexp_split_to_array(query, '\\s+')) AS w FROM q)),
    h AS (SELECT id, term, ((length(low) - length(replace(low, term, ''))) // length(term)) AS tf, greatest(length(low) - 2, 0) AS len FROM (SELECT id, lower(text) AS low FROM t), (SELECT DISTINCT term FROM tok WHERE length(term) >= 3) WHERE contains(low, term)),
    g AS (SELECT count(*) AS n, avg(greatest(length(text) - 2, 0)) AS al FROM t), f AS (SELECT term, greatest(1e-6, ln((n - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM h, g GROUP BY term, n),
    s AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM h JOIN f USING (term) JOIN tok USING (term), g GROUP BY query_id, id)
    SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s) WHERE rank < {k}"""


@query(_bm25_sql("SELECT doc_id AS id, text FROM documents", "SELECT subject AS query_id, description AS query FROM subject_areas", 10))
def bm25_topk(spark, d):
    q = table(spark, d, "subject_areas").select(F.col("subject").alias("query_id"), F.col("description").alias("query"))
    return R.bm25_search(table(spark, d, "documents"), q, 10, "doc_id", "text")


@query(
    f"""SELECT s.*, coalesce(c.title, '') AS title FROM ({_bm25_sql("SELECT DISTINCT message_id AS id, content AS text FROM messages WHERE content IS NOT NULL", "SELECT lang_code AS query_id, 'reports and ' || lang_name AS query FROM lang_codes", 20)}) s
    JOIN (SELECT DISTINCT message_id, conversation_id FROM messages) m ON m.message_id = s.id LEFT JOIN conversations c USING (conversation_id)""".replace("s.*", "s.query_id, s.id, s.score, s.rank")
)
def message_search(spark, d):
    m = table(spark, d, "messages").where("content IS NOT NULL").select(F.col("message_id").alias("id"), "content", "conversation_id").distinct()
    q = table(spark, d, "lang_codes").select(F.col("lang_code").alias("query_id"), F.concat(F.lit("reports and "), "lang_name").alias("query"))
    hits = R.bm25_search(m, q, 20, "id", "content").join(m.select("id", "conversation_id"), "id")
    titled = hits.join(table(spark, d, "conversations").select("conversation_id", "title"), "conversation_id", "left")
    return titled.select("query_id", "id", "score", "rank", F.coalesce("title", F.lit("")).alias("title"))


@query("SELECT doc_id AS id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'xt') ORDER BY doc_id LIMIT 20")
def short_query(spark, d):
    return R.short_query_hits(table(spark, d, "documents"), "XT", 20, "doc_id", "text")


@query(
    """SELECT id, count(*) AS score FROM (SELECT chunk_id AS id, unnest(regexp_extract_all(content, '([A-Z]{3,5})-[0-9]+', 1)) AS entity FROM (SELECT DISTINCT chunk_id, content FROM chunks))
    WHERE entity IN ('DURG', 'SKEL', 'NAX', 'WIX') GROUP BY id ORDER BY score DESC, id LIMIT 50"""
)
def entity_search_hits(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "content").distinct()
    mentions = c.select(F.col("chunk_id").alias("id"), F.explode(F.regexp_extract_all("content", F.lit("([A-Z]{3,5})-[0-9]+"), F.lit(1))).alias("entity"))
    return R.entity_search(mentions, ["DURG", "SKEL", "NAX", "WIX"], 50)


@query(
    f"""WITH l AS (SELECT query_id, score, rank, label FROM ({_TOPK}) JOIN embeddings ON id = vec_id WHERE rank < 8), a AS (SELECT query_id, least(greatest(arg_min(score, rank) / 0.3, 0), 2) AS c, count(DISTINCT label) / count(*)::DOUBLE AS v, stddev_pop(score) AS s FROM l GROUP BY query_id)
    SELECT query_id, round(c, 6) AS coverage, round(v, 6) AS diversity, round(s, 6) AS spread, round(0.4 * c + 0.3 * v + 0.3 * s, 6) AS weighted, round(0.4 * c + 0.3 * v + 0.3 * s, 6) >= 0.6 AS passed FROM a"""
)
def gate_score(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("doc_name"))
    return R.gate_scores(_lists(spark, d, 8).join(e, "id"), "query_id")


@query(f"SELECT query_id, arg_min(score, rank) < 0.3 AS search_web FROM ({_TOPK}) GROUP BY query_id")
def web_trigger(spark, d):
    return R.needs_web_search(_lists(spark, d, 1), "query_id")


@query(
    f"SELECT label, max(score) AS score FROM ({_TOPK}) JOIN embeddings ON id = vec_id WHERE query_id = 50 GROUP BY label ORDER BY score DESC, label LIMIT 5"
)
def best_label(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 50").select(F.col("embedding").alias("v"))
    scored = e.crossJoin(F.broadcast(q)).select("label", F.round(cosine("embedding", "v"), 6).alias("score"))
    return R.best_per_group(scored, "label", 5)


_NORMAL = r"trim(lower(regexp_replace(query_text, '\s+', ' ', 'g')))"


@query(
    f"""WITH c AS (SELECT DISTINCT sha256({_NORMAL}) AS key, created_at, cache_id FROM semantic_cache WHERE query_text IS NOT NULL), n AS (SELECT key, max({{'at': created_at, 'id': cache_id}}) AS r FROM c GROUP BY key)
    SELECT l.key, CASE WHEN m.now - r['at'] <= 20000000 THEN r['at'] END AS created_at, CASE WHEN m.now - r['at'] <= 20000000 THEN r['id'] END AS cache_id FROM (SELECT DISTINCT key FROM c) l LEFT JOIN n USING (key), (SELECT 1736000000 AS now) m"""
)
def exact_cache(spark, d):
    c = table(spark, d, "semantic_cache").where("query_text IS NOT NULL").select(query_key("query_text").alias("key"), "created_at", "cache_id").distinct()
    return R.cache_lookup(c, c.select("key").distinct(), "key", "cache_id", 1736000000, 20_000_000)


@query()
def hybrid_search(spark, d):
    from ..plans.hybrid import hybrid_retrieve

    q = table(spark, d, "subject_areas").select(F.col("subject").alias("query_id"), normalize_query("description").alias("query"))
    first = F.min(F.struct("doc_id", "sequence", "content")).alias("r")
    chunks = table(spark, d, "chunks").groupBy("chunk_id").agg(first).select("chunk_id", "r.*")
    return hybrid_retrieve(chunks, q, 8)


_COSINE_OF = "round(list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 6)"
_VECTORS = "SELECT chunk_id, min(vector) AS v FROM chunk_vectors WHERE len(vector) = 64 GROUP BY chunk_id"
_SOUND = "len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"


def _vectors(spark, d):
    return table(spark, d, "chunk_vectors").where("size(vector) = 64").groupBy("chunk_id").agg(F.min("vector").alias("vector"))


@query(
    f"""WITH n AS (SELECT min(chunk_id) AS id, v FROM ({_VECTORS}) WHERE {_SOUND} GROUP BY v)
    SELECT x.id AS a, y.id AS b, {_COSINE_OF.format("x.v", "y.v")} AS score FROM n x JOIN n y ON x.id < y.id WHERE {_COSINE_OF.format("x.v", "y.v")} >= 0.92"""
)
def near_vector_pairs(spark, d):
    from ..operators.dedup import near_vector_pairs as pairs

    return pairs(_vectors(spark, d), "chunk_id", "vector")


@query(f"SELECT chunk_id AS id, min(chunk_id) OVER (PARTITION BY v) AS rep FROM ({_VECTORS})")
def near_vector_members(spark, d):
    from ..operators.dedup import near_vector_members as members

    return members(_vectors(spark, d), "chunk_id", "vector")


@query(
    f"""WITH f AS (SELECT chunk_id, doc_id FROM (SELECT chunk_id, min(doc_id) AS doc_id, min(sequence) AS sequence FROM chunks GROUP BY chunk_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sequence, chunk_id) <= 3),
    n AS (SELECT chunk_id, doc_id, v FROM f JOIN ({_VECTORS}) USING (chunk_id) WHERE {_SOUND})
    SELECT x.chunk_id AS a, y.chunk_id AS b, {_COSINE_OF.format("x.v", "y.v")} AS score, x.doc_id AS doc_a, y.doc_id AS doc_b FROM n x JOIN n y ON x.chunk_id < y.chunk_id AND x.doc_id <> y.doc_id WHERE {_COSINE_OF.format("x.v", "y.v")} >= 0.70"""
)
def contradiction_candidates(spark, d):
    from ..operators.dedup import contradiction_candidates as candidates

    c = table(spark, d, "chunks").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min("sequence").alias("sequence"))
    return candidates(c, _vectors(spark, d))
