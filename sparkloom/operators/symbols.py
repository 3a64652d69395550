"""Code symbols of texts and their search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import code_symbols

_BLOCK = re.compile(r"^(```|~~~)[ \t]*(\w*)[^\n]*\n(.*?)(?:^\1|\Z)", re.M | re.S)
# Names of languages as they stand after a fence.
LANGUAGES = {"rust": "rust", "rs": "rust", "python": "python", "py": "python", "typescript": "typescript", "ts": "typescript", "javascript": "typescript", "js": "typescript", "go": "go"}
EXACT_SCORE, FUZZY_SCORE = 1.0, 0.8


def symbols_of_texts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, kind, first_line, last_line, signature) of the fenced code in each text.

    Lines count within a block. Blocks without a known language, null and empty
    texts give no rows.
    """
    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"(?m)^(?:```|~~~)"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (key, *symbol)
                for key, text in zip(b.id, b.text)
                for _, language, code in _BLOCK.findall(text)
                if language.lower() in LANGUAGES
                for symbol in code_symbols(code, LANGUAGES[language.lower()])
            ]
            yield pd.DataFrame(rows, columns=["id", "name", "kind", "first_line", "last_line", "signature"])

    return source.mapInPandas(run, f"id {dict(source.dtypes)['id']}, name string, kind string, first_line int, last_line int, signature string")


def identifier_names(query: Column) -> Column:
    """Words of a query that look like identifiers: with an underscore, of mixed case or with a capital in front."""
    parts = F.flatten(F.transform(F.split(query, r"\s+"), lambda w: F.split(w, "::")))
    clean = F.transform(parts, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    alike = lambda w: F.contains(w, F.lit("_")) | (w.rlike(r"\p{Lu}") & w.rlike(r"\p{Ll}")) | w.rlike(r"^\p{Lu}")
    return F.array_distinct(F.filter(clean, lambda w: (F.octet_length(w) >= 2) & alike(w)))


def symbol_search(symbols: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): texts by the symbols a query (query_id, query) names.

    A text with a symbol of exactly that name scores 1; one with a symbol whose name
    holds the whole query, whatever its case, 0.8. Each text counts once, with its
    better score; ties go to the smaller id. Queries are a stated set.
    """
    owned = symbols.select("id", "name").distinct()
    named = queries.select("query_id", F.explode(identifier_names(F.col("query"))).alias("name"))
    exact = owned.join(F.broadcast(named), "name").select("query_id", "id", F.lit(EXACT_SCORE).alias("score"))
    whole = queries.select("query_id", F.lower(F.trim("query")).alias("asked")).where("asked <> ''")
    fuzzy = owned.join(F.broadcast(whole), F.contains(F.lower("name"), F.col("asked"))).select("query_id", "id", F.lit(FUZZY_SCORE).alias("score"))
    best = exact.unionByName(fuzzy).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def symbols_named(symbols: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Symbols of exactly that name, then those whose name holds the query; k at most, in the order of name and id."""
    exact = F.col("name") == query
    held = symbols.where(exact | F.contains(F.lower("name"), F.lit(query.lower()))).withColumn("exact", exact)
    return held.orderBy(F.desc("exact"), "name", "id", "first_line").limit(k)
