"""Row numbers and running sums of groups of any size.

A window puts a whole group in order in one task. Here rows are first put in order
by ranges of (group, order), which cut a large group into runs; windows work within
runs, and the totals of the runs before are added. Only groups that a cut went
through have more than one run, so the totals that move are at most one for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize


def running(df: DataFrame, by: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with ``nth`` (from 1 in the order of the group) and running sums of ``sums``, the row itself included.

    ``order`` must tell the rows of a group apart, otherwise ties fall at random. Null
    summands count as 0; a null group is a group of its own.
    """
    named = df.withColumns({f"sum_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    placed = named.repartitionByRange(F.col(by), *order).withColumn("run_", F.spark_partition_id())
    placed = materialize(placed, "runs")
    within = Window.partitionBy(by, "run_").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    here = placed.withColumns({"nth": F.row_number().over(within).cast("long"), **{n: F.sum(f"sum_{n}").over(so_far) for n in sums}})
    totals = placed.groupBy(by, "run_").agg(F.count("*").alias("before_nth"), *[F.sum(f"sum_{n}").alias(f"before_{n}") for n in sums])
    earlier = Window.partitionBy(by).orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)
    names = ["nth", *sums]
    offsets = totals.select(F.col(by).alias("by_"), F.col("run_").alias("of_run"), *[F.sum(f"before_{n}").over(earlier).alias(f"before_{n}") for n in names])
    offsets = offsets.where("before_nth IS NOT NULL")
    joined = here.join(F.broadcast(offsets), F.col(by).eqNullSafe(F.col("by_")) & (F.col("run_") == F.col("of_run")), "left")
    added = joined.withColumns({n: F.col(n) + F.coalesce(f"before_{n}", F.lit(0)) for n in names})
    return added.select(*df.columns, *names)
