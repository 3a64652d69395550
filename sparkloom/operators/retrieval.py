"""Ranked retrieval: exact and keyword search, fusion, expansion, caches.

All operators take many queries at once. Query sets are stated inputs; they are
taken in blocks of ``QUERY_ROWS``, each against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fts_tokens
from ..functions.vectors import cosine
from ..plans.materialize import materialize

#: Queries in one pass over the data.
QUERY_ROWS = 512
#: Weights of vector, keyword, entity, graph and web lists in a fusion, and its constant.
WEIGHTS = {"vector": 1.0, "keyword": 0.8, "entity": 0.6, "graph": 0.5, "web": 0.4}
RRF_K = 60
#: BM25 constants.
K1, B = 1.2, 0.75


def ranked(df: DataFrame, by: list[str], score: str, tie: str, k: int | None = None, name: str = "rank") -> DataFrame:
    """Adds the 0-based rank within ``by``; with ``k`` keeps the first k (pruned before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    out = df.withColumn(name, F.row_number().over(w) - 1)
    return out if k is None else out.where(F.col(name) < k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vec", least: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): exact cosine top k of each query (query_id, query_vec).

    Queries are taken in blocks of ``QUERY_ROWS``, each a matrix that an Arrow
    batch of vectors is multiplied with; a batch hands on its k best per query.
    Ties go to the smaller id. Vectors of another length or without a norm score 0.
    """
    data = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).where("id IS NOT NULL")
    id_type, q_type = dict(data.dtypes)["id"], dict(queries.dtypes)["query_id"]
    schema = f"query_id {q_type}, id {id_type}, score double"
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    parts = []
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "query_vec").collect()
        by_length: dict[int, tuple[list, np.ndarray]] = {}
        for n in {len(r.query_vec) for r in block}:
            same = [r for r in block if len(r.query_vec) == n]
            by_length[n] = [r.query_id for r in same], _units(np.array([r.query_vec for r in same], float).reshape(len(same), n))
        names = pa.array([r.query_id for r in block])

        def run(batches: Iterator[pa.RecordBatch], by_length=by_length, names=names) -> Iterator[pa.RecordBatch]:
            place = {q: i for i, q in enumerate(names.to_pylist())}
            for batch in batches:
                vecs = batch.column("vec").to_pylist()
                lengths = np.array([len(v) if v is not None else -1 for v in vecs])
                scores = np.zeros((len(place), batch.num_rows))
                for n, (ids, q) in by_length.items():
                    rows = np.flatnonzero(lengths == n)
                    if len(rows) and n:
                        x = _units(np.array([vecs[i] for i in rows], float))
                        scores[np.ix_([place[i] for i in ids], rows)] = np.round(np.nan_to_num(q @ x.T), 6)
                order = np.argsort(np.array(batch.column("id").to_pylist()), kind="stable")
                best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
                q, row = np.repeat(np.arange(len(place)), best.shape[1]), best.ravel()
                out = pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column("id").take(pa.array(row)), pa.array(scores[q, row] + 0.0)], names=["query_id", "id", "score"])
                yield out

        if block:
            parts.append(data.mapInArrow(run, schema))
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    scored = reduce(DataFrame.unionByName, parts)
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return ranked(scored, ["query_id"], "score", "id", k)


def _units(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True)) if x.size else x
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def keyword_hits(texts: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, len, hits): each text's number of trigrams and how often the terms stand in it, ignoring case.

    One scan with one automaton for all terms; hits is an array of (term, tf), empty
    where none is found. Occurrences of a term do not overlap each other. Terms
    shorter than three characters match nothing; null texts have no row.
    """
    import ahocorasick

    some = [t.lower() for t in dict.fromkeys(terms) if len(t) >= 3]
    source = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for t in some:
            automaton.add_word(t, t)
        automaton.make_automaton()
        kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
        for batch in batches:
            lengths, hits = [], []
            for low in batch.column("low").to_pylist():
                free: dict[str, int] = {}
                tf: dict[str, int] = {}
                for end, t in automaton.iter(low) if some else ():
                    if end - len(t) + 1 >= free.get(t, 0):
                        tf[t], free[t] = tf.get(t, 0) + 1, end + 1
                lengths.append(max(0, len(low) - 2))
                hits.append([{"term": t, "tf": n} for t, n in tf.items()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lengths, pa.int32()), pa.array(hits, kind)], names=["id", "len", "hits"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, len int, hits array<struct<term:string,tf:int>>")


def bm25_search(texts: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, query) over trigram-indexed texts.

    Quoted tokens are substrings whatever their case; length is the number of
    trigrams. A token found in more than half of the texts gets the least weight.
    Texts are read once; what they are counted by is written narrow.
    """
    tokens = queries.select("query_id", F.explode(F.transform(fts_tokens("query"), lambda t: F.lower(t))).alias("term")).distinct()
    terms = sorted({r.term for r in tokens.select("term").distinct().collect()})  # a stated query set
    counted = materialize(keyword_hits(texts, terms, id_col, text_col), "keyword-hits")
    whole = counted.agg(F.count("*").alias("n_texts"), F.avg("len").alias("avg_len"))
    hits = counted.where(F.size("hits") > 0).select("id", "len", F.inline("hits"))
    found = hits.groupBy("term").agg(F.count("*").alias("df"))
    weight = found.crossJoin(F.broadcast(whole)).select(
        "term", "avg_len", F.greatest(F.lit(1e-6), F.log((F.col("n_texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf")
    )
    scored = hits.join(F.broadcast(weight), "term")  # one row a term of the query set
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    total = scored.select("id", "term", part.alias("part")).join(F.broadcast(tokens), "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return ranked(total, ["query_id"], "score", "id", k)


def postings(texts: DataFrame, id_col: str = "id", text_col: str = "text", gram: int = 3) -> DataFrame:
    """(gram, id, tf): the trigram index of the texts, whatever their case.

    A text's grams are counted in its own row, so no text is gathered from others.
    Texts shorter than a gram and null texts give no rows.
    """
    low = F.lower(F.col(text_col))
    grams = F.transform(F.sequence(F.lit(1), F.char_length("low") - gram + 1), lambda i: F.substring(F.col("low"), i, F.lit(gram)))
    source = texts.select(F.col(id_col).alias("id"), low.alias("low")).where(F.char_length("low") >= gram)
    each = source.select("id", F.explode(grams).alias("gram"))
    return each.groupBy("gram", "id").agg(F.count("*").cast("int").alias("tf"))


def refresh_postings(index: DataFrame, changed: DataFrame, gone: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The index after ``changed`` texts were written anew and those of ``gone`` (id) deleted."""
    stale = changed.select(F.col(id_col).alias("id"))
    stale = stale if gone is None else stale.unionByName(gone.select("id"))
    return index.join(stale.distinct(), "id", "left_anti").unionByName(postings(changed, id_col, text_col))


def texts_with(index: DataFrame, tokens: DataFrame, gram: int = 3) -> DataFrame:
    """(term, id): texts that hold all grams of a token (term), from the index alone.

    These are all texts with the token and a few without it, to be checked on the
    text. The query set is stated; tokens shorter than a gram give no rows.
    """
    low = F.lower("term")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - gram + 1), lambda i: F.substring(low, i, F.lit(gram))))
    asked = tokens.where(F.char_length("term") >= gram).select("term", grams.alias("grams")).distinct()
    asked = asked.select("term", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    met = index.join(F.broadcast(asked), "gram").groupBy("term", "n", "id").count()
    return met.where(F.col("count") == F.col("n")).select("term", "id")


def short_query_hits(texts: DataFrame, query: str, k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Queries under three characters: texts that contain them, score 1."""
    hits = texts.where(F.contains(F.lower(F.col(text_col)), F.lit(query.lower())))
    return hits.select(F.col(id_col).alias("id"), F.lit(1.0).alias("score")).orderBy("id").limit(k)


def entity_search(mentions: DataFrame, entities: list[str], k: int) -> DataFrame:
    """(id, score): texts by how many mentions of the entities they have. mentions: id, entity."""
    hits = mentions.where(F.col("entity").isin(entities)).groupBy("id").agg(F.count("*").alias("score"))
    return hits.orderBy(F.desc("score"), "id").limit(k)


def entity_lists(mentions: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): for each query of (query_id, entity) the texts by how many mentions they have."""
    hits = mentions.join(F.broadcast(asked.distinct()), "entity").groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score"))
    return ranked(hits, ["query_id"], "score", "id", k)


def fuse(lists: dict[str, DataFrame], k: int, by: list[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of lists (by..., id, score, rank with the best 0).

    Output: by..., id, fused, score, rank; score is the one of the first list, in
    the order given, that has the item.
    """
    by, weights = by or [], weights or WEIGHTS
    parts = [
        df.select(*by, "id", F.col("score").cast("double").alias("score"), (F.lit(float(weights[name])) / (RRF_K + 1 + F.col("rank"))).alias("w"), F.lit(i).alias("src"))
        for i, (name, df) in enumerate(lists.items())
    ]
    every = reduce(DataFrame.unionByName, parts)
    fused = every.groupBy(*by, "id").agg(F.round(F.sum("w"), 9).alias("fused"), F.min_by("score", "src").alias("score"))
    if by:
        return ranked(fused, by, "fused", "id", k)
    top = fused.orderBy(F.desc("fused"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fused"), "id")) - 1)


def expand_neighbours(hits: DataFrame, chunks: DataFrame, doc: str = "doc_id", key: str = "chunk_id", order: str = "sequence", span: int = 1) -> DataFrame:
    """Each hit with the chunks next to it by position; a chunk keeps the score of its best ranked hit.

    hits: key, score, rank. Output (doc, key, order, score). The position is taken with lead and lag, so no pairs of a document are made.
    """
    w = Window.partitionBy(doc).orderBy(order, key)
    near = [F.lag(key, i).over(w) for i in range(span, 0, -1)] + [F.col(key)] + [F.lead(key, i).over(w) for i in range(1, span + 1)]
    around = chunks.select(F.col(key), F.array_compact(F.array(*near)).alias("near"))
    wide = hits.join(around, key).select(F.explode("near").alias(key), "score", "rank")
    best = wide.groupBy(key).agg(F.min_by("score", "rank").alias("score"))
    return best.join(chunks.select(doc, key, order), key).select(doc, key, order, "score")


def late_interaction(query: Column | str, document: Column | str) -> Column:
    """Sum over the query's vectors of the best cosine in the document, at least 0 each."""
    q, d = (F.col(c) if isinstance(c, str) else c for c in (query, document))
    best = F.transform(q, lambda a: F.coalesce(F.array_max(F.transform(d, lambda b: F.greatest(F.lit(0.0), cosine(a, b)))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def best_per_group(scored: DataFrame, group: str, k: int) -> DataFrame:
    """Parts (propositions) vote for their group with their best score; top k groups."""
    return scored.groupBy(group).agg(F.max("score").alias("score")).orderBy(F.desc("score"), group).limit(k)


def merge_scores(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Union of (id, score) lists with the higher score, top k."""
    return a.select("id", "score").unionByName(b.select("id", "score")).groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def gate_scores(hits: DataFrame, by: str, doc: str = "doc_name", score: str = "score", rank: str = "rank") -> DataFrame:
    """Retrieval quality: coverage of the first hit, diversity of documents, spread of scores."""
    top = F.least(F.greatest(F.min_by(score, rank) / 0.3, F.lit(0.0)), F.lit(2.0))
    out = hits.groupBy(by).agg(top.alias("coverage"), (F.count_distinct(doc) / F.count("*")).alias("diversity"), F.stddev_pop(score).alias("spread"))
    weighted = F.round(0.4 * F.col("coverage") + 0.3 * F.col("diversity") + 0.3 * F.col("spread"), 6)
    return out.select(by, F.round("coverage", 6).alias("coverage"), F.round("diversity", 6).alias("diversity"), F.round("spread", 6).alias("spread"), weighted.alias("weighted"), (weighted >= 0.6).alias("passed"))


def needs_web_search(hits: DataFrame, by: str, score: str = "score", rank: str = "rank") -> DataFrame:
    return hits.groupBy(by).agg((F.min_by(score, rank) < 0.3).alias("search_web"))


def cache_lookup(cache: DataFrame, lookups: DataFrame, key: str, value: str, now: int, ttl: int) -> DataFrame:
    """Newest row of each key that has not expired (age above ``ttl`` is expired).

    Only the newest row is looked at, as an older one would be overwritten.
    """
    newest = cache.groupBy(key).agg(F.max(F.struct("created_at", value)).alias("r")).select(key, "r.*")
    alive = newest.where(F.lit(now) - F.col("created_at") <= ttl)
    return lookups.join(alive, key, "left")
