"""Problem 7: sources are mixed to target shares of all tokens.

Every source gets as many tokens as its share of the mix asks for, as far as its
texts, repeated at most ``max_repeats`` times, go. A document's expected number of
copies is the same within a source; its whole part is certain, its fraction is
rounded by the pivotal method: two fractions trade mass at random, tokens for
tokens, until one of them is 0 or 1. That keeps the tokens of the source at what
was asked, whatever is chosen. Buckets of documents do this on their own and hand
up one undecided document each; those are combined in a reduction tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize

#: Documents of a bucket, about, and undecided ones combined at a node of the tree.
BUCKET, FAN_IN = 4096, 256


def source_name(source: Column) -> Column:
    """Lower case, trimmed, with inner white space and underscores as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s\p{Z}_]+", "-")


def plan_shares(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens that each source gives to a mix of ``total`` tokens.

    No source gives more than its text times its repeats. What one cannot give is
    asked of the others in proportion to their shares, until all is placed or
    every source is used up. Without ``total`` the mix is as large as the text
    there is in the sources that have a share.
    """
    caps = {s: available.get(s, 0) * max(0, repeats) for s, (_, repeats) in targets.items()}
    want = float(sum(available.get(s, 0) for s, (share, _) in targets.items() if share > 0) if total is None else total)
    given, rest = dict.fromkeys(targets, 0.0), want
    active = {s for s, (share, _) in targets.items() if share > 0 and caps[s] > 0}
    while active and rest > 1e-9 * max(1.0, want):
        weight = sum(targets[s][0] for s in active)
        asked = {s: rest * targets[s][0] / weight for s in sorted(active)}
        full = {s for s in active if given[s] + asked[s] >= caps[s]}
        if not full:
            for s in active:
                given[s] += asked[s]
            break
        for s in full:
            rest -= caps[s] - given[s]
            given[s] = float(caps[s])
        active -= full
    return given


def pivot(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds fractions so that sum(p * sizes) stays; at most one is left between 0 and 1.

    Every fraction keeps its expectation.
    """
    p, draws, i = p.astype(float).copy(), rng.random(len(p)), -1
    for j in range(len(p)):
        if p[j] <= 1e-12 or p[j] >= 1 - 1e-12:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        a, b = sizes[i], sizes[j]
        # how much mass may flow from j to i, and from i to j
        up, down = min((1 - p[i]) * a, p[j] * b), min(p[i] * a, (1 - p[j]) * b)
        if draws[j] * (up + down) < down:
            p[i], p[j] = p[i] + up / a, p[j] - up / b
        else:
            p[i], p[j] = p[i] - down / a, p[j] + down / b
        done_i, done_j = p[i] <= 1e-9 or p[i] >= 1 - 1e-9, p[j] <= 1e-9 or p[j] >= 1 - 1e-9
        if done_i:
            p[i] = round(p[i])
        if done_j:
            p[j] = round(p[j])
        i = (j if not done_j else -1) if done_i else i
    return p


def _pivot_group(seed: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        rng = np.random.default_rng(xxhash.xxh64_intdigest("|".join(map(str, key)), seed=seed))
        p = pivot(rows.p.to_numpy(), rows.tokens.to_numpy(), rng)
        if last:
            p = np.where((p > 0) & (p < 1), rng.random(len(p)) < p, p)
        return rows.assign(p=p)

    return run


def mix_sources(counts: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document is used.

    ``counts`` has doc_id, source and tokens. Sources are compared by their cleaned
    names; documents without a source, of a source without a target, and without
    tokens get no copies. Each doc_id counts once (its largest row). No document is
    used more often than its source allows. The result is the same for the same
    rows and seed.
    """
    wanted = {}
    for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s IS NOT NULL").collect():
        wanted[r.s] = (max(0.0, r.target_share or 0.0), max(0, r.max_repeats or 0))
    texts = counts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct(F.coalesce("tokens", F.lit(0)).alias("tokens"), source_name(F.col("source")).alias("source"))).alias("r"))
    texts = materialize(texts.select("doc_id", "r.source", F.col("r.tokens").cast("long").alias("tokens")), "sizes")
    named = F.col("source").isin(*wanted) if wanted else F.lit(False)
    sums = texts.where(named).groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()  # one row a target
    given = plan_shares({r.source: r.t for r in sums}, wanted, total)
    rows = [(r.source, given[r.source] / r.t if r.t else 0.0, max(1, r.n // BUCKET)) for r in sums]
    plan = counts.sparkSession.createDataFrame(rows, "source string, copies_each double, buckets long")
    used = texts.where(F.col("tokens") > 0).join(F.broadcast(plan), "source")
    whole = F.floor(F.col("copies_each") + 1e-12)
    # a cap on copies is met exactly by sources that are used up: no fraction is left there
    used = used.select("doc_id", "source", "tokens", whole.alias("whole"), (F.col("copies_each") - whole).alias("p"), F.pmod(F.xxhash64("doc_id"), "buckets").alias("node"))
    used = materialize(used, "copies")
    schema = "doc_id long, source string, tokens long, p double, node long"
    level = used.select("doc_id", "source", "tokens", F.greatest("p", F.lit(0.0)).alias("p"), "node")
    decided, depth, nodes = [], 0, max([1, *(b for _, _, b in rows)])
    while True:
        last = nodes <= 1
        out = materialize(level.groupBy("source", "node").applyInPandas(_pivot_group(seed + depth, last), schema), "pivot")
        if last:
            decided.append(out)
            break
        open_p = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(out.where(~open_p))
        level = out.where(open_p).withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
        nodes, depth = -(-nodes // FAN_IN), depth + 1
    settled = decided[0]
    for part in decided[1:]:
        settled = settled.unionByName(part)
    extra = settled.select("doc_id", F.col("p").cast("long").alias("extra"))
    picked = used.join(extra, "doc_id").select("doc_id", (F.col("whole") + F.col("extra")).alias("copies"))
    return texts.join(picked, "doc_id", "left").select("doc_id", "source", "tokens", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: documents, tokens there are, tokens used, the share wanted and reached, the most copies."""
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    by = mixed.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies")
    )
    whole = mixed.agg(F.sum(F.col("tokens") * F.col("copies")).alias("all_used"))
    joined = wanted.join(by, "source", "left").crossJoin(F.broadcast(whole))
    zero = F.lit(0).cast("long")
    return joined.select(
        "source", "target_share", "max_repeats", F.coalesce("documents", zero).alias("documents"), F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("used_tokens", zero).alias("used_tokens"), F.coalesce("most_copies", zero).alias("most_copies"),
        F.round(F.coalesce(F.try_divide("used_tokens", "all_used"), F.lit(0.0)), 6).alias("actual_share"),
    )
