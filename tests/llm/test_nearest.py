import numpy as np

from sparkloom.llm import nearest as nn
from sparkloom.operators import vector_tree as vt

SCHEMA = "id long, v array<float>, other long, cosine double"


def table(spark, ids, x):
    return spark.createDataFrame([(i, None if r is None else [float(a) for a in r], 7, None) for i, r in zip(ids, x)], SCHEMA)


def brute(ids, x, k=5, least=-2.0):
    u = np.asarray(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = {}
    for i in range(len(ids)):
        order = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= least)[:k]
        out[ids[i]] = [j for _, j in order]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("id", "cosine", "other").collect():
        out.setdefault(r.id, []).append((-r.cosine, r.other))
    return {i: [j for _, j in sorted(x)] for i, x in out.items()}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base + 0.15 * rng.standard_normal(base.shape) for _ in range(8)]).astype(np.float32)
    ids = list(range(1, len(x) + 1))
    got = lists(nn.nearest(table(spark, ids, x), "id", "v", dim=16, leaf_rows=16, least_cosine=0.85))
    want = brute(ids, x, least=0.85)
    hits = sum(len(set(want[i]) & set(got.get(i, []))) for i in ids)
    assert hits >= 0.97 * sum(map(len, want.values()))
    asked = spark.createDataFrame([(i,) for i in ids if i % 50 == 0], "id long")
    got = lists(nn.nearest(table(spark, ids, x), "id", "v", dim=16, leaf_rows=16, recall=0.95, queries=asked))
    want = brute(ids, x)
    assert set(got) == {i for i in ids if i % 50 == 0}
    assert sum(len(set(want[i]) & set(got[i])) for i in got) >= 0.9 * 5 * len(got)


def test_copies_share_their_lists(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((12, 8)).astype(np.float32)
    x[3:11] = x[2]
    ids = list(range(10, 22))
    got = lists(nn.nearest(table(spark, ids, x), "id", "v", dim=8))
    assert got == brute(ids, x)
    asked = spark.createDataFrame([(20,)], "id long")
    assert lists(nn.nearest(table(spark, ids, x), "id", "v", dim=8, queries=asked)) == {20: brute(ids, x)[20]}


def test_cells_of_a_split_leaf_give_the_same(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal(8) + 0.05 * rng.standard_normal((90, 8))).astype(np.float32)
    ids = list(range(1, 91))
    assert lists(nn.nearest(table(spark, ids, x), "id", "v", dim=8, partition_rows=10, leaf_rows=100, recall=1.0)) == brute(ids, x)


def test_partitions_stay_bounded_however_many_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8))
    x = np.concatenate([base + 0.2 * rng.standard_normal(base.shape) for _ in range(80)]).astype(np.float32)
    df = table(spark, list(range(len(x))), x)
    vectors = nn.usable_vectors(df, "id", "v", 8).cache()
    for rows in (16, 64):
        tree, _ = vt.routing_tree(vectors, len(x), 8, rows)
        homes = np.bincount(vt.home_of(vt.unit_of(x), tree), minlength=tree.leaves)
        assert homes.sum() == len(x)
        assert np.quantile(homes, 0.99) <= 1.5 * rows
        assert len(x) / rows / 2 <= tree.leaves <= 12 * len(x) / rows


def test_a_third_in_one_place_through_a_deep_tree(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((200, 8))
    near = rng.standard_normal(8) + 1e-3 * rng.standard_normal((200, 8))
    x = np.concatenate([base, base + 0.1 * rng.standard_normal(base.shape), near]).astype(np.float32)
    ids = list(range(1, len(x) + 1))
    got = lists(nn.nearest(table(spark, ids, x), "id", "v", dim=8, partition_rows=20, leaf_rows=8, least_cosine=0.9, recall=0.995))
    want = brute(ids, x, least=0.9)
    hits = sum(len(set(want[i]) & set(got.get(i, []))) for i in ids)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_recall_on_the_pairs_of_the_data(spark, small):
    table_ = spark.read.parquet(f"{small.replace('0.001', '0.01')}/chunk_vectors.parquet")
    rows = nn.usable_vectors(table_, "chunk_id", "vector").groupBy("id").agg({"v": "min"}).collect()
    by_id = {r[0]: r[1] for r in rows}
    ids = sorted(by_id)
    want = {(min(i, j), max(i, j)) for i, js in brute(ids, [by_id[i] for i in ids], least=0.85).items() for j in js}
    got = {(r.id_a, r.id_b) for r in nn.similar_pairs({"c": (table_, "chunk_id", "vector")}).collect()}
    assert len(want) > 100
    assert len(want & got) >= 0.95 * len(want)


def test_unusable_repeated_and_empty(spark):
    x = [[1, 0], None, [0, 0], [float("nan"), 1], [float("inf"), 1], [1, 0, 0], [1, 0.1], [1, 0]]
    df = table(spark, [1, 2, 3, 4, 5, 6, 7, 1], x).union(table(spark, [None], [[1, 1]]))
    assert lists(nn.nearest(df, "id", "v", dim=2)) == {1: [7], 7: [1]}
    assert nn.nearest(table(spark, [], []), "id", "v", dim=2).count() == 0
    assert nn.nearest(table(spark, [1], [[0, 0]]), "id", "v", dim=2).count() == 0
