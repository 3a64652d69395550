"""Links between documents, forward and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def forward_links(links: DataFrame, sources: DataFrame) -> DataFrame:
    """The links (source, target, ...) of the documents in ``sources`` (source)."""
    return links.join(sources.select("source").distinct(), "source", "left_semi")


def backlinks(links: DataFrame, names: DataFrame) -> DataFrame:
    """(name, source, target): links whose target holds a name of ``names``, whatever its case.

    Every distinct target is cut to all its parts of the lengths that names have,
    and those meet the names by an equi-join: no target is held against every name.
    """
    wanted = names.select("name", F.lower("name").alias("low")).where("low <> ''").distinct()
    lengths = sorted(r.n for r in wanted.select(F.char_length("low").alias("n")).distinct().collect())  # at most as many as a name has characters
    targets = links.select("target", F.lower("target").alias("whole")).where("target IS NOT NULL").distinct()
    if not lengths:
        return links.select(F.lit("").alias("name"), "source", "target").where("false")
    size = F.char_length("whole")

    def parts_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
        return F.when(size >= n, F.transform(starts, lambda i: F.substring(F.col("whole"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    cut = targets.select("target", F.explode(F.array_distinct(F.concat(*map(parts_of, lengths)))).alias("low"))
    return links.join(cut.join(wanted, "low").select("name", "target"), "target").select("name", "source", "target").distinct()
