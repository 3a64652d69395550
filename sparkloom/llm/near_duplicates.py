"""Problem 3: near-duplicate chunks by a multi-index Hamming join.

Every text gets a signature of ``SYMBOLS`` min-wise symbols of 16 bits over its
runs of five letters or digits; two texts agree in a symbol with a probability
equal to their alikeness. The signature is split into chunks. By the pigeonhole
principle two signatures that differ in at most ``chunks * (errors + 1) - 1``
symbols have a chunk that differs in at most ``errors`` symbols. Such chunks share
at least ``PER_CHUNK - errors`` symbols, and of those the two rarest are among the
``RAREST`` rarest of either chunk, whatever order stands for rarity, as long as it
is one for all rows. So each chunk is indexed by every two of these: all pairs
under that distance meet in at least one index. A key that many texts share, as
texts made from one template do, is not one group: two texts that share a chunk but
for the errors share a third and a fourth of its symbols, so whoever holds such a
key is indexed by it with each further symbol that may be the next one they share.
A key of four that many share is joined with one of the rarest symbols of all
others, as many as make sure that two texts under the distance share one (prefix
filtering). Distance counts symbols, not single
bits: at an alikeness of 0.65 a sixth of single bits differ, and a chunk of bits
would have to allow so many errors that each probe met percents of all rows.
Pairs that meet are held against the signature distance, then against the
exact alikeness of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..plans.materialize import materialize

#: Length of the character runs, and the fewest letters or digits of a text.
RUN, LEAST_CHARS = 5, 200
#: The signature: chunks of symbols of two bytes, and errors allowed in a chunk.
CHUNKS, PER_CHUNK, ERRORS = 8, 7, 3
SYMBOLS = CHUNKS * PER_CHUNK
#: Symbols of a chunk that are indexed in twos, and signatures that rarity is counted on.
RAREST, SAMPLE = ERRORS + 2, 10_000
#: A key that about so many rows share, as the sample says, is shared by many.
GROUP_ROWS = 1000
#: Numbers that ids are hashed to when texts without links are left out early.
BUCKETS = 2**20


def normalized(content: Column) -> Column:
    """Lower case, letters and digits (Unicode classes L and N) only."""
    return F.regexp_replace(F.lower(content), r"[^\p{L}\p{N}]+", "")


def _run_hashes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < RUN:
        return np.empty(0, np.uint64)
    h = np.zeros(len(points) - RUN + 1, np.uint64)
    for k in range(RUN):
        h = h * np.uint64(0x100000001B3) + points[k : len(points) - RUN + 1 + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def signature(text: str, symbols: int = SYMBOLS) -> bytes:
    """Min-wise symbols by one permutation: the least hash of each bin.

    A bin without any run borrows from the next filled one, re-hashed with the
    distance, so short texts keep comparable signatures.
    """
    h = _run_hashes(text)
    bins = ((h >> np.uint64(32)) * np.uint64(symbols)) >> np.uint64(32)
    least = np.full(symbols, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bins.astype(np.intp), h & np.uint64(0xFFFFFFFF))
    empty = least == np.iinfo(np.uint64).max
    if empty.any() and not empty.all():
        filled = np.flatnonzero(~empty)
        for i in np.flatnonzero(empty):
            j = filled[np.searchsorted(filled, i) % len(filled)]
            least[i] = least[j] + np.uint64(((j - i) % symbols) * 0x9E3779B1)
    mixed = least * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype(">u2").tobytes()


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch = batch[[t is not None and len(t) >= LEAST_CHARS for t in batch.text]]
        hashes = [hashlib.md5(t.encode()).digest() for t in batch.text]
        yield pd.DataFrame({"chunk_id": batch.chunk_id, "text_hash": hashes, "sig": [signature(t) for t in batch.text]})


def signatures(chunks: DataFrame) -> DataFrame:
    """chunk_id, text_hash (of the normalized text) and sig of the texts that count.

    The text is normalized once; what depends on it is made where the signature is.
    """
    texts = chunks.where("chunk_id IS NOT NULL").select("chunk_id", normalized(F.col("content")).alias("text"))
    return texts.mapInPandas(_sign, "chunk_id long, text_hash binary, sig binary")


def _symbol(i: int, sig: str = "sig") -> Column:
    return F.substring(sig, 2 * i + 1, 2)


def _tokens(sigs) -> np.ndarray:
    """Symbols with their places, one number each; a row for each signature."""
    return np.frombuffer(b"".join(sigs), ">u2").reshape(-1, SYMBOLS).astype(np.int64) + (np.arange(SYMBOLS) << 16)


def _mixed(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _ranked(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The tokens of each chunk by rarity, the rarest first."""
    order = (common[tokens].astype(np.int64) << 22) | tokens
    return np.sort(order.reshape(len(tokens), CHUNKS, PER_CHUNK), axis=2) & ((1 << 22) - 1)


#: Ranks in a chunk whose symbols make a key of two, three and four, and which key
#: of the level before each one continues. Of ``PER_CHUNK - ERRORS`` shared symbols
#: the first two are among the rarest RAREST, the third among one more, and so on.
_LEVELS = [list(combinations(range(RAREST + n - 2), n)) for n in range(2, PER_CHUNK - ERRORS + 1)]
_LEVELS = [[c for c in level if c[1] < RAREST and all(r < RAREST + i - 1 for i, r in enumerate(c) if i > 1)] for level in _LEVELS]
_BEFORE = [[level.index(c[:-1]) for c in after] for level, after in zip(_LEVELS, _LEVELS[1:])]


def _keys(ranked: np.ndarray, level: int) -> np.ndarray:
    """(signature, chunk, combination): the keys of a level, as mixed numbers."""
    h = np.zeros((*ranked.shape[:2], len(_LEVELS[level])), np.uint64)
    for ranks in zip(*_LEVELS[level]):
        h = _mixed(h ^ ranked[:, :, list(ranks)].astype(np.uint64))
    return h.view(np.int64)


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``some``."""
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x if len(some) else np.zeros(x.shape, bool)


def index_keys(signed: DataFrame, most_distant: int) -> DataFrame:
    """(rep, q0...q3, key): every two of the rarest symbols of every chunk, shared ones with more.

    What is rare and what is shared by many is counted on a sample drawn by hash;
    that decides how many pairs meet by chance, not which pairs are sure to. q0 to
    q3 hold the last four bits of each symbol.
    """
    total = signed.count()
    drawn = signed.where(F.pmod(F.xxhash64("rep"), F.lit(max(1, total // SAMPLE))) == 0).select("sig").limit(4 * SAMPLE)
    tokens = _tokens([bytes(r.sig) for r in drawn.collect()])  # bounded by the sample
    common = np.minimum(np.bincount(tokens.ravel(), minlength=SYMBOLS << 16), 65535).astype(np.uint16)
    least, many = max(3, GROUP_ROWS * len(tokens) // max(1, total)), []
    for level in range(len(_LEVELS)):
        keys, counts = np.unique(_keys(_ranked(tokens, common), level), return_counts=True)
        many.append(keys[counts >= least])
    # one number for each possible symbol and place; the shared keys are bounded by the sample
    shared = signed.sparkSession.sparkContext.broadcast((common, many))
    # two texts agree in SYMBOLS - most_distant places at least, ``known`` of them in the longest key
    known = PER_CHUNK - ERRORS
    rest = SYMBOLS - known
    prefix = min(rest, rest - (SYMBOLS - most_distant - known) + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, many = shared.value
        for batch in (whole.iloc[i : i + 2048] for whole in batches for i in range(0, len(whole), 2048)):
            t = _tokens(batch.sig)
            ranked = _ranked(t, common)
            rows, out, open_ = [], [], None
            for level, some in enumerate(many):
                keys = _keys(ranked, level)
                held = np.ones(keys.shape, bool) if open_ is None else open_[:, :, _BEFORE[level - 1]]
                open_ = held & _among(keys, some)
                row, chunk, at = np.nonzero(held & ~open_)
                rows.append(row)
                out.append(keys[row, chunk, at])
                if not open_.any():
                    break
            else:
                row, chunk, at = np.nonzero(open_)
                by_rarity = np.sort((common[t].astype(np.int64) << 22) | t, axis=1) & ((1 << 22) - 1)
                for start in range(0, len(row), 8192):
                    r, c, k = (x[start : start + 8192] for x in (row, chunk, at))
                    inside = np.take_along_axis(ranked[r, c], np.array(_LEVELS[-1])[k], axis=1)
                    others = (by_rarity[r][:, :, None] != inside[:, None, :]).all(axis=2)
                    further = by_rarity[r][others].reshape(len(r), rest)[:, :prefix]
                    rows.append(np.repeat(r, prefix))
                    out.append(_mixed(keys[r, c, k][:, None].view(np.uint64) ^ further.astype(np.uint64)).ravel().view(np.int64))
            rows, out = np.concatenate(rows), np.concatenate(out)
            order = np.argsort(rows, kind="stable")
            cuts = np.searchsorted(rows[order], np.arange(1, len(t)))
            bits = np.zeros((len(t), 64), np.uint64)
            bits[:, :SYMBOLS] = t & 15
            quads = (bits.reshape(len(t), 4, 16) << (4 * np.arange(16, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"rep": batch.rep, **{f"q{i}": quads[:, i] for i in range(4)}, "keys": np.split(out[order], cuts)})

    rep = dict(signed.dtypes)["rep"]
    keyed = signed.select("rep", "sig").mapInPandas(run, f"rep {rep}, q0 long, q1 long, q2 long, q3 long, keys array<long>")
    return keyed.select("rep", "q0", "q1", "q2", "q3", F.explode("keys").alias("key"))


def _quads_differ() -> Column:
    """How many symbols differ in their last four bits: never more than differ at all."""
    total = F.lit(0)
    for i in range(4):
        x = F.col(f"qa{i}").bitwiseXOR(F.col(f"qb{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _maybe_among(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among ``ids``, and few others, without moving the rest.

    Keys are hashed to ``BUCKETS`` numbers, so what is broadcast is bounded.
    """
    number = lambda: F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")
    return table.select("*", number()).join(F.broadcast(ids.select(number()).distinct()), "bucket", "left_semi").drop("bucket")


def hamming_pairs(signed: DataFrame, most_distant: int) -> DataFrame:
    """(a, b), a < b: all pairs of ``signed`` (rep, sig) within ``most_distant`` symbols."""
    if most_distant >= CHUNKS * (ERRORS + 1):
        raise ValueError(f"pairs beyond {CHUNKS * (ERRORS + 1) - 1} wrong symbols are not sure to meet")
    keyed = index_keys(signed, most_distant)
    x, y = (keyed.select(F.col("rep").alias(s), "key", *[F.col(f"q{i}").alias(f"q{s}{i}") for i in range(4)]) for s in "ab")
    met = x.join(y, "key").where((F.col("a") < F.col("b")) & (_quads_differ() <= most_distant)).select("a", "b").distinct()
    met = materialize(met, "met")
    some = _maybe_among(signed.select("rep", "sig"), "rep", met.select(F.explode(F.array("a", "b")).alias("rep")))
    left = some.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")).hint("merge")
    right = some.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")).hint("merge")
    differs = reduce(lambda x, y: x + y, [(_symbol(i, "sig_a") != _symbol(i, "sig_b")).cast("int") for i in range(SYMBOLS)])
    return met.join(left, "a").join(right, "b").where(differs <= most_distant).select("a", "b")


def alikeness(a: str, b: str) -> float:
    """Shared distinct runs divided by those that at least one text has."""
    x = {a[i : i + RUN] for i in range(len(a) - RUN + 1)}
    y = {b[i : i + RUN] for i in range(len(b) - RUN + 1)}
    return len(x & y) / len(x | y) if x or y else 0.0


@F.pandas_udf(DoubleType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alikeness(x, y) for x, y in zip(a, b)])


def representative_pairs(chunks: DataFrame, least: float = 0.65, slack: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(links, members): links between different texts, and who holds each text.

    links: a, b, alike with a < b, each the smallest chunk_id that holds its
    text. members: chunk_id, rep. Pairs whose signatures differ in more symbols
    than ``slack`` standard deviations above what an alikeness of ``least`` gives
    are not held against the texts.

    Texts with fewer than ``LEAST_CHARS`` letters and digits, null texts and null
    ids take no part. Repeated rows of one chunk_id count once; should their
    contents differ, the one with the least hash counts. Other columns are not
    read. An empty table gives empty results.
    """
    signed = materialize(signatures(chunks), "signatures")
    # who stands for whom is found on narrow rows; then the signatures move once
    members = signed.groupBy("chunk_id").agg(F.min("text_hash").alias("text_hash"))
    reps = materialize(members.groupBy("text_hash").agg(F.min("chunk_id").alias("rep")), "representatives")
    own = reps.select(F.col("rep").alias("chunk_id"), F.col("text_hash").alias("own")).hint("merge")
    texts = signed.join(own, "chunk_id").where("text_hash = own").dropDuplicates(["chunk_id"])
    texts = materialize(texts.select(F.col("chunk_id").alias("rep"), "text_hash", "sig"), "texts")
    share = 1 - least
    most = min(SYMBOLS, int(SYMBOLS * share + slack * (SYMBOLS * share * least) ** 0.5))
    near = materialize(hamming_pairs(texts.select("rep", "sig"), most), "hamming-pairs")
    wanted = near.select(F.col("a").alias("rep")).union(near.select(F.col("b").alias("rep"))).distinct()
    held = texts.select("rep", "text_hash").join(wanted, "rep").select(F.col("rep").alias("chunk_id"), "text_hash")
    source = chunks.select("chunk_id", "content").where("chunk_id IS NOT NULL")
    source = _maybe_among(source, "chunk_id", held).join(held.hint("merge"), "chunk_id")
    source = source.select(F.col("chunk_id").alias("rep"), normalized(F.col("content")).alias("text"), "text_hash")
    source = source.where(F.unhex(F.md5("text")) == F.col("text_hash")).dropDuplicates(["rep"]).select("rep", "text")
    source = materialize(source, "near-texts")
    both = near.join(source.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(source.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    links = both.select("a", "b", _alike("text_a", "text_b").alias("alike")).where(F.col("alike") >= least)
    return links, members.join(reps.hint("merge"), "text_hash").select("chunk_id", "rep")


def near_duplicate_pairs(chunks: DataFrame, least: float = 0.65) -> DataFrame:
    """(chunk_id_a, chunk_id_b, alike), a < b: all pairs of ids, copies included."""
    links, members = representative_pairs(chunks, least)
    links, members = materialize(links, "links"), materialize(members, "members")
    x = members.select(F.col("rep").alias("a"), F.col("chunk_id").alias("x"))
    y = members.select(F.col("rep").alias("b"), F.col("chunk_id").alias("y"))
    across = links.join(x, "a").join(y, "b").select("x", "y", "alike")
    copies = x.join(y, F.col("a") == F.col("b")).where("x < y").select("x", "y", F.lit(1.0).alias("alike"))
    pairs = across.unionByName(copies)
    return pairs.select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b"), "alike")
