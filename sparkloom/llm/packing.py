"""Problem 6: texts are packed into containers of a fixed number of tokens.

Only the histogram of lengths is needed to plan: it has at most ``capacity``
entries however many texts there are. On it the configuration linear program
(how often each way to fill a container is used) is solved by multiplicative
weights: lengths that are covered too little get a higher price, the best
container at these prices is found by a knapsack dynamic program. The solution is
rounded at random: every configuration is used as often as the program says, rounded
up or down by chance, as long as its texts last. What rounding leaves over is a
smaller histogram, for which the program is solved again, until little is left; that
rest is placed largest first, each with the others that fill its container best.
Texts then find their container by their rank among the texts of their length.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize

#: Where the public tokenizers are, and the vocabulary that is used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
CAPACITY = 2048
#: Rounds of multiplicative weights, and their step.
ROUNDS, STEP = 800, 0.2
#: The share of the rounds that only settles the prices.
BURN_IN = 0.5
#: Lengths fall in so many classes of one price; of each class the length that is
#: covered least so far is offered to a knapsack.
CLASSES = 128
#: The program is solved again while more than this share of the tokens is unplaced
#: and at least ``LEAST_GAIN`` of what was unplaced found its place.
REST_SHARE, LEAST_GAIN = 0.3, 0.1
#: Blocks of ranks that the texts of one length fall in when they look for their container.
BLOCKS = 32


def load_tokenizer(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The byte-level BPE of a rank file; special strings are ordinary text."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(folder, "__init__.py"))
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, tokens) and the carried string columns; a null text has no tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_tokenizer(folder, vocabulary).encode_ordinary
        for batch in batches:
            out = batch[["doc_id", *carry]].copy()
            out["tokens"] = [len(encode(t)) if t else 0 for t in batch.text]
            yield out

    schema = ", ".join(["doc_id long", *[f"{c} string" for c in carry], "tokens long"])
    return documents.select("doc_id", "text", *carry).mapInPandas(count, schema)


def best_container(prices: np.ndarray, lengths: np.ndarray, stock: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length the dearest container holds; at most what is in stock.

    Knapsack by dynamic programming over the capacity. Lengths of the same price
    per token compete by price alone; each is offered in one vectorised step, with
    multiples in powers of two, so that stock is kept.
    """
    value = np.zeros(capacity + 1)
    steps: list[tuple[int, int, np.ndarray]] = []
    for i in np.flatnonzero(stock > 0):
        size, left, many = int(lengths[i]), int(min(stock[i], capacity // lengths[i])), 1
        while left > 0:
            many = min(many, left)
            w = size * many
            with_it = value[:-w] + prices[i] * many
            better = with_it > value[w:] + 1e-15
            if better.any():
                value[w:] = np.where(better, with_it, value[w:])
                steps.append((int(i), many, better))
            left -= many
            many *= 2
    take, at = np.zeros(len(lengths), np.int64), int(value.argmax())
    for i, many, better in reversed(steps):
        w = int(lengths[i]) * many
        if at >= w and better[at - w]:
            take[i] += many
            at -= w
    return take


def fullest_container(lengths: np.ndarray, stock: np.ndarray, capacity: int) -> np.ndarray:
    """The largest item left and the others that leave the least space beside it.

    ``lengths`` descends. Sums that can be reached are kept as bits of an integer,
    one for every step, so that the way back to the items is known.
    """
    held = np.flatnonzero(stock > 0)
    take = np.zeros(len(lengths), np.int64)
    take[held[0]] = 1
    space = capacity - int(lengths[held[0]])
    mask, reached, steps = (1 << (space + 1)) - 1, 1, []
    for i in held.tolist():
        size = int(lengths[i])
        count, many = min(int(stock[i]) - int(i == held[0]), space // size), 1
        while count > 0:
            many = min(many, count)
            steps.append((i, many, size * many, reached))
            reached |= (reached << (size * many)) & mask
            count -= many
            many *= 2
        if reached >> space:  # the space can be filled up
            break
    at = reached.bit_length() - 1
    for i, many, size, before in reversed(steps):
        if not before >> at & 1:
            take[i] += many
            at -= size
    return take


def solve_program(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, step: float) -> list[tuple[np.ndarray, float]]:
    """[(configuration, containers)]: a fractional solution of the configuration program.

    Multiplicative weights with knapsack pricing, on classes of lengths. Prices start
    at the sizes, which is the dual solution where every container can be filled.
    """
    classes = np.minimum((lengths - 1) * CLASSES // capacity, CLASSES - 1)
    starts = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])  # lengths descend, so do classes
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(lengths)]))
    wanted = np.add.reduceat(demand, starts).astype(float)
    log_price = np.log(np.add.reduceat(lengths * demand, starts) / wanted)
    used = np.zeros(len(lengths))
    use: Counter = Counter()
    for turn in range(rounds):
        # of each class the length that is covered least; at first the largest
        share = used / demand
        offered = np.flatnonzero(share <= np.repeat(np.minimum.reduceat(share, starts), np.diff(np.r_[starts, len(lengths)])))
        offered = offered[np.r_[True, of[offered[1:]] != of[offered[:-1]]]]
        price = np.exp(log_price - log_price.max()) * lengths[offered] / np.maximum.reduceat(lengths, starts)
        few = best_container(price, lengths[offered], demand[offered], capacity)
        kinds = np.flatnonzero(few)
        held, few = offered[kinds], few[kinds]
        if turn >= rounds * BURN_IN:
            use[tuple(zip(held.tolist(), few.tolist()))] += 1
            used[held] += few
        cover = few / wanted[kinds]
        log_price[kinds] -= step * cover / cover.max()
    # so many containers that all is covered on average
    placed = sum(n * sum(int(lengths[i]) * c for i, c in take) for take, n in use.items())
    scale = float((lengths * demand).sum()) / max(1, placed)
    return [(take, n * scale) for take, n in sorted(use.items(), key=lambda x: (-x[1], x[0]))]


def plan_with_share(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = STEP, seed: int = 23) -> tuple[list, int]:
    """(plan, containers of the program): as ``plan_containers``, with how many the program placed."""
    lengths = np.array(sorted((n for n, c in histogram.items() if 0 < n <= capacity and c > 0), reverse=True), np.int64)
    if not len(lengths):
        return [], 0
    rest = np.array([histogram[int(n)] for n in lengths], np.int64)
    rng, whole, plan = np.random.default_rng(seed), float((lengths * rest).sum()), Counter()
    while (before := float((lengths * rest).sum())) > REST_SHARE * whole:
        held = np.flatnonzero(rest)
        for take, n in solve_program(lengths[held], rest[held], capacity, rounds, step):
            i, c = held[[k for k, _ in take]], np.array([m for _, m in take])
            times = int(min(np.floor(n) + (rng.random() < n % 1), (rest[i] // c).min()))
            if times > 0:
                plan[tuple(zip(i.tolist(), c.tolist()))] += times
                rest[i] -= c * times
        if before - float((lengths * rest).sum()) < LEAST_GAIN * before:
            break
    program = plan.total()
    while rest.sum() > 0:
        take = fullest_container(lengths, rest, capacity)
        held = np.flatnonzero(take)
        times = int((rest[held] // take[held]).min())
        plan[tuple(zip(held.tolist(), take[held].tolist()))] += times
        rest -= take * times
    named = [(tuple((int(lengths[i]), int(c)) for i, c in take), n) for take, n in plan.items()]
    return sorted(named, reverse=True), program


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = STEP) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(configuration, containers)] that hold every item of ``histogram`` exactly.

    A configuration is ((length, how many), ...), longest first. The plan does not
    depend on anything but the histogram.
    """
    return plan_with_share(histogram, capacity, rounds, step)[0]


def pieces_of(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, first_token, tokens): whole texts; longer ones cut at the capacity."""
    pieces = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("tokens") / capacity))
    cut = counts.select("doc_id", F.col("tokens").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    first = F.col("piece") * capacity
    return cut.select("doc_id", "piece", first.alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("whole") - first).alias("tokens"))


def pack(counts: DataFrame, capacity: int = CAPACITY, spread: int = 16) -> DataFrame:
    """(doc_id, piece, first_token, tokens, container): every piece with its container.

    ``counts`` has doc_id and tokens. Repeated rows of one doc_id with the same
    size are one text; with different sizes each is one. Null ids are left out,
    null or negative sizes count as 0. Pieces of no tokens need no room and go to
    container 0. Ranks are two-level: within ``spread`` hash buckets of a length,
    which are then offset, so one length may have any share of the rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = counts.sparkSession
    texts = counts.where("doc_id IS NOT NULL").select("doc_id", F.greatest(F.lit(0).cast("long"), F.coalesce("tokens", F.lit(0).cast("long"))).alias("tokens"))
    pieces = pieces_of(texts.distinct(), capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)).cast("int"))
    pieces = materialize(pieces, "pieces")
    sizes = pieces.groupBy("tokens", "bucket").count()
    before = Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("tokens", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    histogram = {r.tokens: r["n"] for r in sizes.groupBy("tokens").agg(F.sum("count").alias("n")).collect()}  # at most capacity + 1 rows
    slots, first, used = [], 0, Counter()

    def slot(length: int, low: int, high: int, many: int, first: int) -> None:
        # a row for each block of ranks that the slot touches, so that a rank meets few slots
        width = -(-histogram[length] // BLOCKS)
        slots.extend((length, block, low, high, many, first) for block in range(low // width, (high - 1) // width + 1))

    for configuration, containers in plan_containers(histogram, capacity):
        for length, many in configuration:
            slot(length, used[length], used[length] + many * containers, many, first)
            used[length] += many * containers
        first += containers
    if histogram.get(0):
        slot(0, 0, histogram[0], histogram[0], 0)
    # bounded whatever the table: configurations times the lengths in one, and BLOCKS for each length
    slots = spark.createDataFrame(slots, "tokens long, block long, low long, high long, many long, first long")
    widths = spark.createDataFrame([(n, -(-c // BLOCKS)) for n, c in histogram.items()], "tokens long, width long")
    offsets = offsets.join(F.broadcast(widths), "tokens")
    within = Window.partitionBy("tokens", "bucket").orderBy("doc_id", "piece", "first_token")
    # at most (capacity + 1) * spread rows are broadcast here, and the plan after that
    ranked = pieces.withColumn("nth", F.row_number().over(within)).join(F.broadcast(offsets), ["tokens", "bucket"])
    rank = F.col("offset") + F.col("nth") - 1
    ranked = ranked.select("doc_id", "piece", "first_token", "tokens", rank.alias("rank"), F.floor(rank / F.col("width")).alias("block"))
    placed = ranked.join(F.broadcast(slots), ["tokens", "block"]).where("rank >= low AND rank < high")
    container = F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("many"))
    return placed.select("doc_id", "piece", "first_token", "tokens", container.alias("container"))


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, containers, the least possible number, and the share unused."""
    filled = packed.where("tokens > 0").groupBy("container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    return filled.agg(
        F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count("*").alias("containers"),
        F.ceil(F.sum("tokens") / capacity).alias("least_containers"), F.max("tokens").alias("fullest"),
        F.round(1 - F.sum("tokens") / (F.count("*") * capacity), 6).alias("unused_share"),
    )
