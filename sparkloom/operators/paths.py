"""Pointer jumping over parent links.

``fold_paths`` resolves a forest given as (id, parent) rows: for every node its
root, whether its chain ends well, and a fold of what the nodes from the root down
to it carry. Each round joins the still open nodes to what they point at, puts the
two stretches together and so doubles the distance covered: a chain of length L
needs about log2(L) rounds. Only open nodes take part, and of the finished ones
only those of groups that still have open nodes; every round is written to the
shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize

#: Puts the stretch above (first) and the one below together, column by column.
Join = Callable[[dict[str, Column], dict[str, Column]], dict[str, Column]]


def fold_paths(nodes: DataFrame, carried: list[str], join: Join, group_col: str | None = None) -> DataFrame:
    """Columns: id, group, root, state and the carried ones, folded from the root to the node.

    ``nodes`` has id (unique, not null), parent and the carried columns of the node
    alone. state is ``ok`` (the chain ends at a node without a parent), ``orphan``
    (it ends at a parent that does not exist; root is that missing id) or ``cycle``
    (it never ends; root is null and the fold has no meaning). ``join`` must be
    associative. ``group_col`` names a column that all nodes of a chain share; it
    only spares work. An empty table gives an empty result.
    """
    group = F.col(group_col) if group_col else F.lit(0)
    base = materialize(nodes.select("id", "parent", group.alias("group"), *carried), "path-nodes")
    types = dict(base.dtypes)
    # merge joins: compressed files say too little about the size of what they hold
    here = base.where("parent IS NULL").select("id", "group", F.col("id").alias("ptr"), F.lit("ok").alias("state"), *carried)
    pointing = base.where("parent IS NOT NULL")
    known = base.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    linked = pointing.join(known.hint("merge"), "parent", "left").select(
        "id", "group", F.col("parent").alias("ptr"), F.when(F.col("there").isNull(), "orphan").alias("state"), *carried
    )
    # an open node covers itself down from what it points at, a finished one all from its root
    table = materialize(here.unionByName(linked), "path-round")
    done, active = table.where("state IS NOT NULL"), table.where("state IS NULL")
    open_nodes, total, covered = active.count(), table.count(), 1
    while open_nodes and covered <= 2 * total:
        ends = done
        if group_col:
            ends = done.join(active.select("group").distinct(), "group", "left_semi")
        above = ends.unionByName(active).select(
            F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("state").alias("found"), *[F.col(c).alias(f"above_{c}") for c in carried]
        )
        both = join({c: F.col(f"above_{c}") for c in carried}, {c: F.col(c) for c in carried})
        step = active.drop("state").join(above.hint("merge"), "ptr").select(
            "id", "group", F.col("next").alias("ptr"), F.col("found").alias("state"), *[both[c].cast(types[c]).alias(c) for c in carried]
        )
        step = materialize(step, "path-round")
        done, active = done.unionByName(step.where("state IS NOT NULL")), step.where("state IS NULL")
        open_nodes, covered = active.count(), covered * 2
    looped = active.select("id", "group", F.lit(None).cast(types["id"]).alias("ptr"), F.lit("cycle").alias("state"), *carried)
    return done.unionByName(looped).withColumnRenamed("ptr", "root")


def resolve_paths(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", weight_col: str | None = None) -> DataFrame:
    """Columns: id, root, before (weight of all ancestors), state, as in ``fold_paths``.

    Rows with a null id are left out; of repeated ids the smallest parent counts.
    """
    weight = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    base = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.coalesce(weight, F.lit(0).cast("long")).alias("weight"))
    base = base.where("id IS NOT NULL").groupBy("id").agg(F.min("parent").alias("parent"), F.max("weight").alias("weight"))
    own = base.withColumn("own", F.col("weight"))
    sums = fold_paths(own, ["weight", "own"], lambda up, down: {"weight": up["weight"] + down["weight"], "own": down["own"]})
    return sums.select("id", "root", (F.col("weight") - F.col("own")).alias("before"), "state")
