"""The index pipeline: texts to chunks, entities, relations, propositions and links, with a status for each document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract
from ..operators.splitters import split_texts
from .materialize import materialize


def _per_text(source: DataFrame, make, schema: str, columns: list[str]) -> DataFrame:
    """Rows that ``make(text)`` gives for each (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, i, x) for key, text in zip(b.id, b.text) for i, x in enumerate(make(text or ""))]
            yield pd.DataFrame(rows, columns=columns)

    return source.mapInPandas(run, schema)


def index_documents(documents: DataFrame, kind: str = "section", window: int = 256, overlap: int = 32, done: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables chunks, entities, relations, propositions, links and status of documents (doc_id, text).

    Only doc_id and text are read; rows with a null doc_id are left out, of repeated
    ids the row with the least text hash counts. ``done`` (doc_id, file_hash) names
    documents whose text was indexed before; unchanged ones are passed over. status:
    doc_id, status, status_reason: ``indexed``, ``unchanged``, or ``failed`` for
    texts that are null or blank or gave no chunk. Every table is a plan of its own
    over the chunks, which are written once.
    """
    one = documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(F.md5("text").alias("file_hash"), "text")).alias("r"))
    one = one.select("doc_id", "r.file_hash", "r.text")
    fresh = one if done is None else one.join(done.select("doc_id", "file_hash").distinct(), ["doc_id", "file_hash"], "left_anti")
    parts = split_texts(fresh, kind, "doc_id", "text", window, overlap)
    chunks = parts.select(F.col("id").alias("doc_id"), F.concat_ws(":", "id", "sequence").alias("chunk_id"), "sequence", "content", "token_count")
    chunks = materialize(chunks, "index-chunks")
    found = materialize(chunks.select("chunk_id", "content", extract.entities(F.col("content")).alias("entities")), "index-entities")
    entities = found.select("chunk_id", F.inline("entities"))
    relations = extract.relations(found).withColumnRenamed("id", "chunk_id")
    text = chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    propositions = _per_text(text, lambda t: extract.propositions(t, _first_name), "chunk_id string, sequence int, content string", ["chunk_id", "sequence", "content"])
    whole = fresh.select(F.col("doc_id").alias("id"), "text")
    links = _per_text(whole, extract.wiki_links, f"doc_id {dict(documents.dtypes)['doc_id']}, sequence int, target string", ["doc_id", "sequence", "target"])
    with_chunks = chunks.select("doc_id").distinct().withColumn("chunked", F.lit(True))
    known = fresh.select("doc_id", F.lit(True).alias("fresh"))
    blank = F.coalesce(F.col("text").rlike(r"^\s*\z"), F.lit(True))
    joined = one.select("doc_id", blank.alias("blank")).join(known, "doc_id", "left").join(with_chunks, "doc_id", "left")
    status = F.when(F.col("fresh").isNull(), "unchanged").when(F.col("chunked"), "indexed").otherwise("failed")
    reason = F.when(status == "failed", F.when(F.col("blank"), "no text").otherwise("no chunk"))
    return {
        "chunks": chunks, "entities": entities, "relations": relations, "propositions": propositions, "links": links,
        "status": joined.select("doc_id", status.alias("status"), reason.alias("status_reason")),
    }


def _first_name(sentence: str) -> str | None:
    """The first capitalised word of four letters or more that is no stop word."""
    words = (w.strip(".,;:!?()[]\"'") for w in sentence.split())
    return next((w for w in words if len(w) > 3 and w[0].isupper() and w.isalpha() and w not in extract.STOPWORDS), None)
