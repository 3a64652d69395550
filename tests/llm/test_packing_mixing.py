from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import mixing, packing


def test_plan_holds_every_item_once():
    rng = np.random.default_rng(0)
    histogram = dict(Counter(rng.integers(1, 2049, 3000).tolist()))
    plan = packing.plan_containers(histogram, rounds=40)
    held = Counter()
    for configuration, n in plan:
        assert sum(a * b for a, b in configuration) <= 2048
        for length, many in configuration:
            held[length] += many * n
    assert held == Counter(histogram)
    tokens = sum(a * b for a, b in histogram.items())
    above_half = sum(n for length, n in histogram.items() if length > 1024)
    assert sum(n for _, n in plan) <= 1.01 * max(tokens / 2048, above_half) + 1


def test_the_program_places_most(monkeypatch):
    rng = np.random.default_rng(1)
    for n in (1000, 20_000):
        histogram = dict(Counter(np.clip(rng.lognormal(6.2, 1.0, n).astype(int), 1, 2048).tolist()))
        plan, program = packing.plan_with_share(histogram)
        containers, tokens = sum(x for _, x in plan), sum(a * b for a, b in histogram.items())
        assert program > containers / 2
        assert containers <= 1.01 * tokens / 2048 + 1


def test_plan_is_best_where_brute_force_knows():
    assert sum(n for _, n in packing.plan_containers({6: 4, 4: 4, 3: 2}, capacity=10)) == 5
    assert packing.plan_containers({}, 10) == []


def test_pack_whole_tables(spark):
    schema = "doc_id long, tokens long, container long"
    rows = [(i, 700, 0) for i in range(1, 400)] + [(500, 5000, 0), (501, 0, 0), (502, None, 0), (503, -4, 0), (504, 2048, 0), (504, 2048, 1), (None, 9, 0)]
    got = packing.pack(spark.createDataFrame(rows, schema)).collect()
    filled = Counter()
    for r in got:
        filled[r.container] += r.tokens
    assert max(filled.values()) <= 2048
    assert len(got) == len({(r.doc_id, r.piece) for r in got}) == 399 + 3 + 3 + 1
    assert sorted(r.tokens for r in got if r.doc_id == 500) == [904, 2048, 2048]
    assert {r.container for r in got if r.tokens == 700} and len({r.container for r in got if r.tokens == 700}) == 200
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], schema), capacity=0)


def test_token_counts_take_whole_texts(spark):
    df = spark.createDataFrame([(1, "hello world " * 2000), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in packing.token_counts(df).collect()}
    assert got[2] == got[3] == 0 and got[1] >= 4000 and got[4] > 1


def test_pivot_keeps_the_total_and_the_expectations():
    rng = np.random.default_rng(3)
    p, sizes = rng.random(30), rng.integers(1, 100, 30).astype(float)
    mean = np.zeros(30)
    for k in range(3000):
        out = mixing.pivot(p, sizes, np.random.default_rng(k))
        assert abs((out * sizes).sum() - (p * sizes).sum()) < 1e-6
        assert ((out > 0) & (out < 1)).sum() <= 1
        mean += out / 3000
    assert np.abs(mean - p).max() < 0.05


def test_plan_shares_passes_on_what_a_source_lacks():
    targets = {"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 2)}
    given = mixing.plan_shares({"a": 1000, "b": 1000, "c": 10}, targets)
    assert given["c"] == 20 and given["a"] == 1000
    assert abs(sum(given.values()) - 2010) < 1e-6
    assert mixing.plan_shares({"a": 1000, "b": 1000}, {"a": (0.5, 1), "b": (0.5, 1)}, total=100) == {"a": 50, "b": 50}


def test_mix_keeps_caps_and_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rows = [(i, "Big Box " if i % 2 else "big-box", 10 + i % 90, 1) for i in range(600)]
    rows += [(1000 + i, "small", 50, 1) for i in range(10)] + [(2000, None, 5, 1), (2001, "none", 5, 1), (2002, "small", None, 1), (None, "small", 5, 1), (1000, "small", 50, 1)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, tokens long, copies int")
    targets = spark.createDataFrame([("big-box", 0.9, 1), ("small", 0.1, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix_sources(counts, targets)
    got = {r.doc_id: r for r in mixed.collect()}
    assert len(got) == 613
    assert all(r.copies <= {"big-box": 1, "small": 3}.get(r.source, 0) for r in got.values())
    report = {r.source: r for r in mixing.mix_report(mixed, targets).collect()}
    assert report["small"].used_tokens == 1500 and report["absent"].used_tokens == 0
    again = {r.doc_id: r.copies for r in mixing.mix_sources(counts, targets).collect()}
    assert again == {k: r.copies for k, r in got.items()}
    small = mixing.mix_report(mixing.mix_sources(counts, targets, total=4000), targets).collect()
    assert abs({r.source: r.actual_share for r in small}["small"] - 0.1) < 0.03
    assert mixing.mix_sources(counts.where("false"), targets).count() == 0
