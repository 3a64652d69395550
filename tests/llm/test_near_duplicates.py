import random
from itertools import combinations

import regex

from sparkloom.llm import near_duplicates as nd

SCHEMA = "chunk_id long, content string, rep long, sig string"


def letters(text):
    return regex.sub(r"[^\p{L}\p{N}]", "", text.lower())


def brute(rows, least=0.65):
    texts = {}
    for i, t, *_ in rows:
        if i is not None and t is not None and len(letters(t)) >= 200:
            texts[i] = letters(t)
    return {(a, b) for a, b in combinations(sorted(texts), 2) if nd.alikeness(texts[a], texts[b]) >= least}


def edited(text, share, rng):
    words = text.split()
    for _ in range(int(len(words) * share)):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_all_pairs_above_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        base = " ".join(f"term{rng.randrange(4000)}" for _ in range(80))
        rows += [(100 * i + k, edited(base, s, rng)) for k, s in enumerate((0, 0.02, 0.05, 0.1, 0.15))]
    rows += [(9001, rows[0][1]), (9002, rows[0][1].upper() + "!")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = {(r.chunk_id_a, r.chunk_id_b) for r in nd.near_duplicate_pairs(df).collect()}
    want = brute(rows)
    assert not got - want
    # beyond the guaranteed distance a pair is found with a probability that falls with its alikeness
    clear = brute(rows, 0.75)
    assert len(clear - got) <= 0.01 * len(clear)
    assert len(want - got) <= 0.05 * len(want)


def test_pigeonhole_guarantee():
    """Signatures within chunks * (errors + 1) - 1 symbols share a key."""
    rng = random.Random(3)
    most = nd.CHUNKS * (nd.ERRORS + 1) - 1
    for _ in range(200):
        a = [rng.randrange(65536) for _ in range(nd.SYMBOLS)]
        b = list(a)
        for i in rng.sample(range(nd.SYMBOLS), most):
            b[i] ^= 1 + rng.randrange(65535)
        shared = False
        for c in range(nd.CHUNKS):
            part = range(c * nd.PER_CHUNK, (c + 1) * nd.PER_CHUNK)
            shared |= sum(a[i] != b[i] for i in part) <= nd.ERRORS
        assert shared


def test_nulls_short_and_repeated_rows(spark):
    long = "The quick brown fox jumps over the lazy dog number. " * 8
    rows = [(1, long, 0, ""), (1, long, 5, None), (2, long, 0, ""), (3, None, 0, ""), (None, long, 0, ""), (4, "", 0, ""), (5, "short", 0, "")]
    got = nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.chunk_id_a, r.chunk_id_b) for r in got] == [(1, 2)]
    assert nd.near_duplicate_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(1)
    big = " ".join(str(rng.random()) for _ in range(40000))
    df = spark.createDataFrame([(1, big, 0, ""), (2, big + " tail", 0, "")], SCHEMA)
    assert [(r.chunk_id_a, r.chunk_id_b) for r in nd.near_duplicate_pairs(df).collect()] == [(1, 2)]


def test_all_pairs_within_the_accepted_distance(spark):
    """Every pair of 30 wrong symbols of 56 is met, however they lie; so is every alike pair but 1 %."""
    rng = random.Random(7)
    rows = []
    for i in range(0, 1000, 2):
        a = [rng.randrange(65536) for _ in range(nd.SYMBOLS)]
        b = list(a)
        for k in rng.sample(range(nd.SYMBOLS), 30):
            b[k] ^= 1 + rng.randrange(65535)
        rows += [(i + n, b"".join(x.to_bytes(2, "big") for x in s)) for n, s in enumerate((a, b))]
    got = {(r.a, r.b) for r in nd.hamming_pairs(spark.createDataFrame(rows, "rep long, sig binary"), 30).collect()}
    assert got == {(i, i + 1) for i in range(0, 1000, 2)}

    rng, texts = random.Random(5), []
    for i in range(60):
        base = " ".join(f"term{rng.randrange(4000)}" for _ in range(80))
        texts += [(100 * i + k, edited(base, s, rng), 1, "x") for k, s in enumerate((0, 0.02, 0.05, 0.1, 0.15))]
    found = {(r.chunk_id_a, r.chunk_id_b) for r in nd.near_duplicate_pairs(spark.createDataFrame(texts, SCHEMA)).collect()}
    want = brute(texts)
    assert not found - want and len(want - found) <= 0.01 * len(want)


def test_texts_of_one_template_meet_only_where_they_are_near(spark, monkeypatch):
    """A key that all share is split by a third symbol; no pair within the distance is lost."""
    monkeypatch.setattr(nd, "GROUP_ROWS", 30)
    rng = random.Random(11)
    template = [rng.randrange(65536) for _ in range(nd.SYMBOLS)]
    held, rows = set(rng.sample(range(nd.SYMBOLS), 20)), []
    for i in range(0, 600, 2):
        a = [template[k] if k in held else rng.randrange(65536) for k in range(nd.SYMBOLS)]
        b = list(a)
        for k in rng.sample(range(nd.SYMBOLS), 30):
            b[k] ^= 1 + rng.randrange(65535)
        rows += [(i + n, b"".join(x.to_bytes(2, "big") for x in s)) for n, s in enumerate((a, b))]
    signed = spark.createDataFrame(rows, "rep long, sig binary")
    got = {(r.a, r.b) for r in nd.hamming_pairs(signed, 30).collect()}
    tokens = {i: [s[2 * k : 2 * k + 2] for k in range(nd.SYMBOLS)] for i, s in rows}
    want = {(a, b) for a, b in combinations(sorted(tokens), 2) if sum(x != y for x, y in zip(tokens[a], tokens[b])) <= 30}
    assert got == want and len(want) >= 300
    sizes = [r["count"] for r in nd.index_keys(signed, 30).groupBy("key").count().collect()]
    monkeypatch.setattr(nd, "GROUP_ROWS", 10_000)
    whole = [r["count"] for r in nd.index_keys(signed, 30).groupBy("key").count().collect()]
    assert max(sizes) <= max(whole) / 3, (max(sizes), max(whole))


def test_recall_by_band_of_alikeness(spark):
    rng, rows = random.Random(13), []
    for i in range(500):
        base = " ".join(f"term{rng.randrange(4000)}" for _ in range(80))
        rows += [(10 * i, base, 1, ""), (10 * i + 1, edited(base, rng.uniform(0.1, 0.2), rng), 1, "")]
    got = {(r.chunk_id_a, r.chunk_id_b) for r in nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    texts = {i: letters(t) for i, t, *_ in rows}
    alike = {(10 * i, 10 * i + 1): nd.alikeness(texts[10 * i], texts[10 * i + 1]) for i in range(500)}
    for low, high, least in ((0.65, 0.70, 0.95), (0.70, 0.75, 0.98), (0.75, 1.01, 1.0)):
        band = [p for p, a in alike.items() if low <= a < high]
        assert len(band) >= 30 and sum(p in got for p in band) >= least * len(band), (low, len(band), sum(p in got for p in band))
