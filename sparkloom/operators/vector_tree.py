"""A hierarchical k-means tree over vectors, walked best bin first.

The upper part routes rows to partitions of about ``partition_rows`` vectors, whose
number grows with the rows; it is fitted on a bounded sample (``SAMPLE_ROWS``), and
partitions that turn out too large are split further by a level of k-means that is
fitted for each of them on the cluster. The lower part is fitted inside the task that
holds a partition, down to leaves of ``LEAF_ROWS`` vectors. How far a walk goes is
calibrated on samples to a recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize

#: Vectors of a partition, about; the least partitions, for the sake of parallel
#: work; vectors of a leaf inside a partition.
PARTITION_ROWS, LEAST_PARTITIONS, LEAF_ROWS = 131_072, 16, 512
#: Vectors the routing tree is fitted on: this many per partition, between these
#: bounds; those that the lower part, or a further split, of a partition is fitted on.
PER_PARTITION, SAMPLE_ROWS, LOCAL_ROWS = 64, (8192, 65_536), 16_384
#: Nodes of the routing tree, which all executors hold (about 330 bytes each);
#: partitions are not split beyond that and become grids.
MOST_NODES = 262_144
PLACES = 6


@dataclass
class Tree:
    """Nodes as arrays; node 0 is the root. ``children`` is padded with -1."""

    centers: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    leaves: int


def unit_of(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centers)
    return (x @ centers.T).argmax(axis=1)


def fit_tree(sample: np.ndarray, branching: int = 16, leaf_rows: float = 128, seed: int = 7) -> Tree:
    """Hierarchical spherical k-means: nodes with more than ``leaf_rows`` are split."""
    rng = np.random.default_rng(seed)
    x = unit_of(sample).astype(np.float32)
    centers, children, leaf, leaves = [], [], [], 0
    queue = [(-1, 0, np.arange(len(x)))]
    while queue:
        parent, slot, rows = queue.pop(0)
        node = len(centers)
        mean = x[rows].mean(axis=0)
        centers.append(mean / max(float(np.linalg.norm(mean)), 1e-9))
        children.append([-1] * branching)
        leaf.append(-1)
        if parent >= 0:
            children[parent][slot] = node
        parts = []
        if len(rows) > leaf_rows:
            label = _kmeans(x[rows], min(branching, max(2, int(len(rows) // leaf_rows))), rng)
            parts = [rows[label == j] for j in np.unique(label)]
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
        else:
            queue += [(node, j, p) for j, p in enumerate(parts)]
    return Tree(np.array(centers, np.float32), np.array(children, np.int32), np.array(leaf, np.int32), leaves)


def graft(tree: Tree, parts: dict[int, Tree]) -> Tree:
    """The tree with leaves replaced by trees of their own; leaves are numbered anew."""
    centers, children, leaf = [tree.centers], [tree.children.copy()], [tree.leaf.copy()]
    at, n = {int(tree.leaf[i]): i for i in np.flatnonzero(tree.leaf >= 0)}, len(tree.centers)
    for number, part in sorted(parts.items()):
        if part.leaves > 1:
            # the part's root stands where the leaf was, its other nodes follow
            below = np.where(part.children > 0, part.children + n - 1, -1)
            children[0][at[number]], leaf[0][at[number]] = below[0], -1
            centers.append(part.centers[1:])
            children.append(below[1:])
            leaf.append(part.leaf[1:])
            n += len(part.centers) - 1
    leaf = np.concatenate(leaf)
    ends = leaf >= 0
    leaf[ends] = np.arange(ends.sum())
    return Tree(np.concatenate(centers), np.concatenate(children), leaf.astype(np.int32), int(ends.sum()))


def best_bins(unit: np.ndarray, tree: Tree, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every visit; the visits of a row are in order, all rows walk in step."""
    step = max(64, min(4096, 2**23 // len(tree.centers)))
    if len(unit) > step:
        parts = [best_bins(unit[i : i + step], tree, margin) for i in range(0, len(unit), step)]
        return np.concatenate([r + i * step for i, (r, _) in enumerate(parts)]), np.concatenate([v for _, v in parts])
    n = len(unit)
    scores = unit.astype(np.float32) @ tree.centers.T
    rows, stop = np.arange(n), np.full(n, -np.inf, np.float32)
    low = np.full(n, np.inf, np.float32)
    # the queue: what each row has in each slot; a taken slot scores -inf
    queue, score = np.zeros((n, 1), np.int32), np.zeros((n, 1), np.float32)
    out_rows, out_leaves = [], []
    first = True
    while len(rows):
        best, at = score.argmax(axis=1), np.arange(len(rows))
        top = score[at, best]
        go = (top >= stop[rows]) & (top > -np.inf)
        if not go.all():
            rows, queue, score, best, top = rows[go], queue[go], score[go], best[go], top[go]
            if not len(rows):
                break
            at = np.arange(len(rows))
        node = queue[at, best]
        score[at, best] = -np.inf
        if not first:
            low[rows] = np.minimum(low[rows], top)
        first = False
        hit = tree.leaf[node] >= 0
        out_rows.append(rows[hit])
        out_leaves.append(tree.leaf[node[hit]])
        fresh = rows[hit][np.isneginf(stop[rows[hit]])]
        stop[fresh] = np.where(np.isinf(low[fresh]), 0, low[fresh]) - np.float32(margin)
        if not hit.all():
            new = tree.children[node]
            worth = np.where(new >= 0, scores[rows[:, None], np.maximum(new, 0)], -np.inf)
            worth[hit] = -np.inf
            queue, score = np.hstack([queue, new]), np.hstack([score, worth.astype(np.float32)])
    r, v = np.concatenate(out_rows), np.concatenate(out_leaves)
    order = np.argsort(r, kind="stable")
    return r[order], v[order]


def home_of(unit: np.ndarray, tree: Tree) -> np.ndarray:
    r, v = best_bins(unit, tree, 0.0)
    return v[np.r_[True, r[1:] != r[:-1]]] if len(r) else v


def _depths(unit: np.ndarray, tree: Tree) -> np.ndarray:
    """How far below the first leaf each leaf lies in a row's walk."""
    scores = unit.astype(np.float32) @ tree.centers.T
    least = np.full_like(scores, np.inf)
    for node in range(len(tree.centers)):
        for child in tree.children[node]:
            if child >= 0:
                least[:, child] = np.minimum(least[:, node], scores[:, child])
    leaves = np.flatnonzero(tree.leaf >= 0)
    by_leaf = np.empty((len(unit), tree.leaves), np.float32)
    by_leaf[:, tree.leaf[leaves]] = least[:, leaves]
    return by_leaf.max(axis=1, keepdims=True) - by_leaf


def calibrate_margin(
    sample: np.ndarray, tree: Tree, k: int, recall: float, least_cosine: float | None, queries: int = 1024, either: bool = True, seed: int = 11
) -> float:
    """The margin that reaches ``recall`` on the sample.

    Without a least cosine the k nearest in the sample are searched for; they lie
    farther than the k nearest of all rows, so the answer is on the safe side.
    With one, partners are made, spread evenly from that cosine to one, and a pair
    counts as found when the one visits the other, or with ``either`` one of the two.
    A recall of 1 makes all partners at the least cosine, where they are hardest to
    find, and takes the largest margin that any of them needs, and a fifth more.
    """
    if tree.leaves < 2:
        return 0.0
    rng = np.random.default_rng(seed)
    x = unit_of(sample)
    whole = recall >= 1
    queries = max(queries, 4096) if whole else queries
    q = x[rng.choice(len(x), min(queries, len(x)), replace=False)]
    at, deep = np.arange(len(q)), _depths(q, tree)
    if least_cosine is None:
        near = np.argsort(-(q @ x.T), axis=1)[:, 1 : k + 1]
        need = deep[at[:, None], home_of(x, tree)[near]].ravel()
    else:
        c = rng.uniform(least_cosine, least_cosine if whole else 1, (len(q), 1))
        noise = rng.standard_normal(q.shape)
        noise -= (noise * q).sum(axis=1, keepdims=True) * q
        partner = c * q + np.sqrt(1 - c**2) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        need = deep[at, home_of(partner, tree)]
        if either:
            need = np.minimum(need, _depths(partner, tree)[at, home_of(q, tree)])
    return float(np.quantile(need, min(1.0, recall), method="higher")) * (1.2 if whole else 1.0) + 1e-6 if len(need) else 0.0


def first_k(ids: np.ndarray, other: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each id: highest value, then smaller other; repeated pairs count once."""
    order = np.lexsort((other, -value, ids))
    ids, other, value = ids[order], other[order], value[order]
    fresh = np.r_[True, (ids[1:] != ids[:-1]) | (other[1:] != other[:-1])][: len(ids)]
    ids, other, value = ids[fresh], other[fresh], value[fresh]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][: len(ids)])
    keep = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)])) < k
    return ids[keep], other[keep], value[keep]


def _close(s: np.ndarray, own: np.ndarray, other: np.ndarray, k: int, least: float, both_ways: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) that may be among the k best of a row, or with ``both_ways`` of a column.

    ``s`` holds cosines in single precision. Where few reach ``least`` all of them are returned.
    """
    worth = s >= np.float32(least - 1e-4)
    if np.count_nonzero(worth) > 4 * k * max(s.shape):
        keep = np.zeros_like(worth)
        worth &= own[:, None] != other[None, :]
        held = np.where(worth, s, np.float32(-3))
        for axis in (1, 0) if both_ways else (1,):
            at = max(0, s.shape[axis] - k)
            edge = np.take(np.partition(held, at, axis=axis), [at], axis=axis)
            keep |= s >= edge - np.float32(1e-5)
        worth &= keep
    i, j = np.divmod(np.flatnonzero(worth), s.shape[1])
    different = own[i] != other[j]
    return i[different], j[different]


def cell_matches(
    data: np.ndarray, data_ids: np.ndarray, asking: np.ndarray, asking_ids: np.ndarray,
    k: int | None, least_cosine: float | None, recall: float, both_ways: bool, leaf_rows: int = LEAF_ROWS,
) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, other, cosine): what the askers find in a cell's data, through a tree of its own.

    The k best of each or, without k, all that reach ``least_cosine``, each pair
    possibly more than once. With ``both_ways`` the data find their askers, too.
    Candidates in single precision are computed again in double precision and rounded.
    """
    if not len(data) or not len(asking):
        return
    least = -2.0 if least_cosine is None else least_cosine
    d, q = unit_of(data).astype(np.float32), unit_of(asking).astype(np.float32)
    sample = data[np.random.default_rng(5).choice(len(data), min(len(data), LOCAL_ROWS), replace=False)]
    tree = fit_tree(sample, leaf_rows=max(4.0, leaf_rows * len(sample) / len(data)))
    margin = calibrate_margin(sample, tree, k or 5, recall, least_cosine, 512, either=False)
    home = home_of(d, tree)
    row, leaf = best_bins(q, tree, margin)
    by_home, by_leaf = np.argsort(home, kind="stable"), np.argsort(leaf, kind="stable")
    home_at, leaf_at = (np.searchsorted(x, np.arange(tree.leaves + 1)) for x in (home[by_home], leaf[by_leaf]))
    held, size = [], 0
    for bin_ in range(tree.leaves):
        c, visitors = by_home[home_at[bin_] : home_at[bin_ + 1]], row[by_leaf[leaf_at[bin_] : leaf_at[bin_ + 1]]]
        for start in range(0, len(visitors) if len(c) else 0, 2048):
            r = visitors[start : start + 2048]
            for at in range(0, len(c), 8192):
                cc = c[at : at + 8192]
                s = q[r] @ d[cc].T
                i, j = _close(s, asking_ids[r], data_ids[cc], k or len(data), least, both_ways)
                for x in range(0, len(i), 65536):
                    a, b = r[i[x : x + 65536]], cc[j[x : x + 65536]]
                    v = np.round(np.einsum("ij,ij->i", unit_of(asking[a]), unit_of(data[b])), PLACES)
                    a, b, v = asking_ids[a[v >= least]], data_ids[b[v >= least]], v[v >= least]
                    held.append((a, b, v))
                    size += len(a)
                    if both_ways:
                        held.append((b, a, v))
                        size += len(a)
                if size > 2**21:
                    held, size = [tuple(np.concatenate(x) for x in zip(*held))], 0
                    if k is None:
                        yield held.pop()
                    else:
                        held = [first_k(*held[0], k)]
    if held:
        whole = tuple(np.concatenate(x) for x in zip(*held))
        yield whole if k is None else first_k(*whole, k)


def decode(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1)


def flat(column: pa.Array, dim: int) -> np.ndarray:
    rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype="<f4").reshape(-1, dim)
    return np.ascontiguousarray(rows + np.float32(0))  # -0.0 and 0.0 are one number


def routing_tree(vectors: DataFrame, total: int, dim: int, partition_rows: int) -> tuple[Tree, np.ndarray]:
    """(tree, sample): a tree whose leaves hold about ``partition_rows`` of ``vectors`` (id, v).

    Leaves that hold more than one and a half times as many are split further by
    trees that the cluster fits, each on a bounded sample of the leaf's own rows,
    until none is left, none can be split or the tree has ``MOST_NODES``.
    """
    partitions = max(LEAST_PARTITIONS, -(-total // partition_rows))
    wanted = min(SAMPLE_ROWS[1], max(SAMPLE_ROWS[0], PER_PARTITION * partitions))

    def some_of(df: DataFrame, step: int) -> np.ndarray:
        rows = df.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("v").limit(4 * wanted).toArrow()
        return flat((rows if rows.num_rows else df.select("v").limit(1).toArrow()).column("v").combine_chunks(), dim)

    sample = some_of(vectors, max(1, total // wanted))
    tree = fit_tree(sample, leaf_rows=max(PER_PARTITION / 4, len(sample) / partitions))
    tried: set[bytes] = set()
    while total > LEAST_PARTITIONS * partition_rows and len(tree.centers) < MOST_NODES:
        now = tree

        def homes(batches: Iterator[pa.RecordBatch], now: Tree = now) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = home_of(unit_of(flat(b.column("v"), dim)), now) if b.num_rows else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(leaf.astype(np.int32))], names=["id", "v", "leaf"])

        housed = vectors.mapInArrow(homes, "id long, v array<float>, leaf int")
        counts = {r["leaf"]: r["count"] for r in housed.groupBy("leaf").count().collect()}  # at most one row a node
        where = {int(now.leaf[i]): now.centers[i].tobytes() for i in np.flatnonzero(now.leaf >= 0)}
        large = {leaf: n for leaf, n in counts.items() if n > partition_rows * 3 // 2 and where[leaf] not in tried}
        if not large:
            break
        tried |= {where[leaf] for leaf in large}

        def fit(batches: Iterator[pa.RecordBatch], large: dict[int, int] = large) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(list(batches))
            leaf, x = t.column("leaf")[0].as_py(), flat(t.column("v").combine_chunks(), dim)
            part = fit_tree(x, leaf_rows=max(4.0, len(x) * partition_rows / large[leaf]))
            arrays = [pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in ((part.centers, "<f4"), (part.children, "<i4"), (part.leaf, "<i4"))]
            yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int32()), *arrays], names=["leaf", "centers", "children", "ends"])

        steps = vectors.sparkSession.createDataFrame([(leaf, max(1, n // LOCAL_ROWS)) for leaf, n in large.items()], "leaf int, step long")
        # at most one row a node of the tree
        drawn = housed.join(F.broadcast(steps), "leaf").where(F.pmod(F.xxhash64("id"), "step") == 0).select("leaf", "v")
        fitted = drawn.groupBy("leaf").applyInArrow(fit, "leaf int, centers binary, children binary, ends binary").collect()
        parts = {}
        for r in fitted:
            ends = np.frombuffer(r.ends, "<i4")
            parts[r.leaf] = Tree(np.frombuffer(r.centers, "<f4").reshape(len(ends), -1), np.frombuffer(r.children, "<i4").reshape(len(ends), -1), ends, int((ends >= 0).sum()))
        tree = graft(tree, parts)
    return tree, sample


def place(vectors: DataFrame, tree: Tree, margin: float, dim: int) -> DataFrame:
    """(id, vec, asks, bins) of ``vectors`` (id, v, asks): home leaf first, then those an asker visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                raw = flat(b.column("v"), dim)
                unit = unit_of(raw)
                asked = b.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                bins = [[x] for x in home_of(unit, tree).tolist()]
                if asked.any():
                    r, v = best_bins(unit[asked], tree, margin)
                    cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
                    for i, leaves in zip(np.flatnonzero(asked), np.split(v, cuts)):
                        bins[i] = leaves.tolist()
                vec = pa.array([x.tobytes() for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), vec, b.column("asks"), pa.array(bins, pa.list_(pa.int32()))], names=["id", "vec", "asks", "bins"]
                )

    return vectors.select("id", "v", "asks").mapInArrow(run, "id long, vec binary, asks boolean, bins array<int>")


def meet(search: DataFrame, k: int | None, least_cosine: float | None, recall: float, both_ways: bool, partition_rows: int = PARTITION_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id, other, cosine): what the askers of ``search`` (id, vec, asks, bins) find, each pair once.

    Vectors meet their visitors in a grid of cells per partition (blocks of vectors by
    blocks of visitors), so a partition that cannot be split is spread over many tasks.
    """
    spark = search.sparkSession
    cell_rows = max(1, partition_rows * 3 // 2)
    visit = search.select("id", "vec", "asks", F.posexplode("bins").alias("nth", "leaf"))
    load = search.select("asks", F.posexplode("bins").alias("nth", "leaf")).groupBy("leaf")
    load = load.agg(F.sum(F.when(F.col("nth") == 0, 1).otherwise(0)).alias("d"), F.sum(F.col("asks").cast("int")).alias("q"))
    load = load.select("leaf", F.ceil(F.col("d") / cell_rows).alias("db"), F.ceil(F.col("q") / cell_rows).alias("qb")).where("db > 1 OR qb > 1")
    # one row a partition, and those are no more than the nodes of the tree: a proven bound
    grid = [(r.leaf, r.db, r.qb) for r in load.collect()]
    grid = spark.createDataFrame(grid, "leaf int, db long, qb long")
    visit = visit.join(F.broadcast(grid), "leaf", "left")
    home, one = F.col("nth") == 0, F.lit(1).cast("long")
    db, qb = F.greatest(F.coalesce("db", one), one), F.greatest(F.coalesce("qb", one), one)
    pick = lambda n: F.pmod(F.xxhash64("id"), n)
    span = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda x, y, role: F.struct(x.alias("x"), y.alias("y"), F.lit(role).alias("role"))
    none = F.array().cast("array<struct<x:bigint,y:bigint,role:int>>")
    single = F.when(home & F.col("asks"), F.array(cell(one - 1, one - 1, 3))).when(home, F.array(cell(one - 1, one - 1, 1))).otherwise(F.array(cell(one - 1, one - 1, 2)))
    as_data = F.when(home, F.transform(span(qb), lambda y: cell(pick(db), y, 1))).otherwise(none)
    as_query = F.when(F.col("asks"), F.transform(span(db), lambda x: cell(x, pick(qb), 2))).otherwise(none)
    cells = F.when((db == 1) & (qb == 1), single).otherwise(F.concat(as_data, as_query))
    rows = visit.select("id", "vec", "leaf", F.explode(cells).alias("c")).select("id", "vec", "leaf", "c.x", "c.y", "c.role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks().sort_by("id")
        ids, role = t.column("id").to_numpy(), t.column("role").to_numpy()
        raw = decode(t.column("vec").combine_chunks())
        del t
        d, q = (role & 1) > 0, (role & 2) > 0
        for a, b, v in cell_matches(raw[d], ids[d], raw[q], ids[q], k, least_cosine, recall, both_ways, leaf_rows):
            for at in range(0, len(a), 65536):
                part = slice(at, at + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(b[part]), pa.array(v[part])], names=["id", "other", "cosine"])

    return rows.groupBy("leaf", "x", "y").applyInArrow(run, "id long, other long, cosine double").distinct()


def index_topk(vectors: DataFrame, asked: DataFrame, k: int, id_col: str = "id", vector_col: str = "vec", recall: float = 0.99, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(query_id, id, score, rank): for the rows of ``asked`` (id) their k most similar others, by the tree.

    Approximate: walks are calibrated to ``recall`` on a sample. Ids are whole numbers
    and unique; vectors of another length than the commonest, with nulls or numbers
    that are not finite, or all zero are left out. Ties go to the smaller id.
    """
    v = F.col(vector_col).cast("array<float>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, id long, score double, rank int"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    same = good.where(F.size("v") == sizes.n)
    tree, sample = routing_tree(same, sizes["count"], sizes.n, partition_rows)
    level = (1 + recall) / 2
    margin = calibrate_margin(sample, tree, k, level, None)
    marked = same.join(asked.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left").withColumn("asks", F.coalesce("asked", F.lit(False)))
    met = meet(materialize(place(marked, tree, margin, sizes.n), "placed"), k, None, level, False, partition_rows)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    named = met.select(F.col("id").alias("query_id"), F.col("other").alias("id"), F.col("cosine").alias("score"))
    return named.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)
