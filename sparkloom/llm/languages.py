"""Problem 8: document languages by compression.

A sentence belongs to the language whose dictionary, raw text of that language,
makes zstandard need the fewest bytes for it. The dictionaries are fitted on a
bounded sample of labelled documents; labels are dirty, so parts of the sample
judge the others and only sentences whose own label wins stay. Sentences whose
margin is narrow, or that no dictionary helps with, are left undecided.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import zip_longest
from statistics import median

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .prose import paragraphs, sentences

# Other ways to write a language code (ISO 639-2 and own names).
OTHER_NAMES = {
    "en": ("eng", "english"),
    "zh": ("zho", "chi", "cmn", "chinese", "中文", "汉语", "mandarin"),
    "de": ("deu", "ger", "german", "deutsch"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "it": ("ita", "italian", "italiano"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
}

#: Documents per label in the sample, the characters one of them has, bytes of a
#: dictionary, compression level.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, LEVEL = 150, (100, 20_000), 131072, 3
#: The least lead of the best language over the next, in bytes per character of
#: the sentence, and the most bytes per byte that count as language at all.
MARGIN, MOST_RATIO = 0.06, 0.8
#: Names, numbers and references tell nothing about a language.
_NOISE = re.compile(r"[A-Za-z]*[0-9][A-Za-z0-9-]*|[A-Z]{2,}-")
_MAY_HOLD_NOISE = re.compile(r"[0-9]|[A-Z]{2}-")


def label_code(label: Column, codes: list[str], names: dict[str, str]) -> Column:
    """The code a stored label names; null where it names none of ``codes``."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^[\p{L}]+", 0)
    out = F.lit(None).cast("string")
    for code in codes:
        known = {code, *OTHER_NAMES.get(code, ()), (names.get(code) or code).lower()}
        out = F.when(first.isin(*sorted(known)), code).otherwise(out)
    return out


def _canon(sentence: str) -> bytes:
    if _MAY_HOLD_NOISE.search(sentence):
        sentence = _NOISE.sub("", sentence)
    return sentence.lower().encode("utf-8", "replace")


def _compressors(dictionaries: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for code, content in dictionaries.items():
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        out[code] = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)
    return out


def judge(sentence: str, compressors: dict[str, zstandard.ZstdCompressor]) -> tuple[str | None, float]:
    """(language, confidence) of a sentence; language is null if undecided.

    Every dictionary is tried. The confidence is the lead of the best over the
    next, as a share of the next.
    """
    data = _canon(sentence)
    sizes = sorted((len(c.compress(data)), code) for code, c in compressors.items())
    if not data or not sizes:
        return None, 0.0
    best, code = sizes[0]
    lead = (sizes[1][0] if len(sizes) > 1 else len(data)) - best
    sure = lead >= MARGIN * len(data) and best <= MOST_RATIO * len(data)
    return (code if sure else None), lead / max(1, lead + best)


def _fill(texts: list[str], most: int) -> bytes:
    out, size = [], 0
    for t in dict.fromkeys(texts):
        b = _canon(t)
        if size + len(b) > most:
            break
        out.append(b)
        size += len(b) + 1
    return b"\n".join(out)


def _judge_by_shards(data: bytes, shards: dict[str, list[zstandard.ZstdCompressor]], without: int) -> str | None:
    """The language whose median size over its other shards is least, by a clear margin."""
    sizes = sorted((median(len(c.compress(data)) for i, c in enumerate(own) if i != without), code) for code, own in shards.items())
    if len(sizes) > 1 and sizes[1][0] - sizes[0][0] < MARGIN * len(data):
        return None
    return sizes[0][1]


Sentence = tuple[str, int, str]  # label, shard, text


def winners(sentences: Iterable[Sentence], judges: dict[str, list[bytes]]) -> list[bool]:
    """Whether the label of each sentence wins among the other shards' dictionaries."""
    shards = {code: [_compressors({code: b})[code] for b in own] for code, own in judges.items()}
    return [_judge_by_shards(_canon(t), shards, i) == code for code, i, t in sentences]


def winners_on_cluster(spark: SparkSession) -> Callable[[list[Sentence], dict[str, list[bytes]]], list[bool]]:
    """``winners``, spread over the executors; the sentences are those of the bounded sample."""

    def run(sentences: list[Sentence], judges: dict[str, list[bytes]]) -> list[bool]:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"at": b["at"], "won": winners(zip(b.code, b.shard, b.text), judges)})

        rows = pd.DataFrame(sentences, columns=["code", "shard", "text"]).rename_axis("at").reset_index()
        parts = max(1, min(2 * spark.sparkContext.defaultParallelism, len(rows) // 256))
        df = spark.createDataFrame(rows, "at long, code string, shard int, text string").repartition(parts, "at")
        won = df.mapInPandas(part, "at long, won boolean").toPandas()
        return won.sort_values("at").won.tolist()

    return run


def fit_dictionaries(labelled: list[tuple[str, str]], rounds: int = 3, shards: int = 6, judged: Callable = winners) -> dict[str, bytes]:
    """Dictionaries from (code, text) pairs, some of them with wrong labels.

    The texts of each label are dealt to shards with a dictionary each. A sentence
    is judged by the median of the other shards, so that texts with a wrong label,
    being in few of them, cannot vouch for themselves; it stays if its own label
    wins. A sentence found under several labels (a notice that stands in many
    texts) belongs to the one with most of them, or to none. The dictionaries that
    come out hold the sentences that stayed.
    """
    dealt: list[Sentence] = []
    nth: Counter = Counter()
    for code, text in labelled:
        dealt += [(code, nth[code] % shards, s) for p in paragraphs(text) for s in sentences(p)]
        nth[code] += 1
    labels: dict[bytes, Counter] = defaultdict(Counter)
    for code, _, t in dealt:
        labels[_canon(t)][code] += 1
    dealt = [(code, i, t) for code, i, t in dealt if 2 * labels[_canon(t)][code] > labels[_canon(t)].total()]
    kept = dealt
    for _ in range(rounds if dealt else 0):
        by_shard = _by_shard(kept, shards)
        judges = {code: [_fill(p, DICT_BYTES // 4) for p in parts] for code, parts in by_shard.items()}
        kept = [s for s, won in zip(dealt, judged(dealt, judges)) if won]
    joined = {code: [t for row in zip_longest(*parts) for t in row if t] for code, parts in _by_shard(kept, shards).items()}
    return {code: _fill(t, DICT_BYTES) for code, t in sorted(joined.items())}


def _by_shard(sentences: list[Sentence], shards: int) -> dict[str, list[list[str]]]:
    out: dict[str, list[list[str]]] = defaultdict(lambda: [[] for _ in range(shards)])
    for code, i, t in sentences:
        out[code][i].append(t)
    return out


def dictionaries_of(documents: DataFrame, codes: list[str], names: dict[str, str], sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Fit on at most ``sample_docs`` documents of ``SAMPLE_CHARS`` characters for each label, chosen by hash."""
    coded = documents.where(F.length("text").between(*SAMPLE_CHARS)).select("doc_id", label_code(F.col("lang"), codes, names).alias("code"), "text").where("code IS NOT NULL")
    counts = {r["code"]: r["count"] for r in coded.groupBy("code").count().collect()}  # one row a language
    if not counts:
        return {}
    step = reduce(lambda out, c: F.when(F.col("code") == c, max(1, counts[c] // (2 * sample_docs))).otherwise(out), counts, F.lit(1))
    rows = coded.where(F.pmod(F.xxhash64("doc_id"), step) == 0).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(8 * sample_docs * len(counts))
    taken: Counter = Counter()
    sample = []
    for r in rows.select("code", "text").toLocalIterator():
        if taken[r.code] < sample_docs:
            taken[r.code] += 1
            sample.append((r.code, r.text))
    return fit_dictionaries(sample, judged=winners_on_cluster(documents.sparkSession))


def segments_of(text: str, compressors: dict[str, zstandard.ZstdCompressor]) -> list[tuple[int, str, int, float]]:
    """(para_no, language, characters, mean confidence) of each paragraph's languages."""
    out = []
    for no, paragraph in enumerate(paragraphs(text), 1):
        found: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for s in sentences(paragraph):
            code, sure = judge(s, compressors)
            if code is not None:
                found[code].append((len(s), sure))
        for code, parts in found.items():
            n = sum(x for x, _ in parts)
            out.append((no, code, n, sum(x * c for x, c in parts) / n))
    return out


def language_segments(documents: DataFrame, lang_codes: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, labelled, para_no, lang_code, chars, confidence) of every paragraph's languages.

    ``labelled`` is the code that the stored label names, or null. Texts without a
    sentence in any language, null texts and empty ones have no rows. Only doc_id,
    lang and text are read; rows are not merged by doc_id.
    """
    named = {r.lang_code: r.lang_name for r in lang_codes.where("lang_code IS NOT NULL").collect()}
    codes = sorted(named)
    dictionaries = dictionaries_of(documents, codes, {k: v or k for k, v in named.items()}, sample_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(dictionaries)
        for batch in batches:
            rows = [
                (doc_id, labelled, *segment)
                for doc_id, labelled, text in zip(batch.doc_id, batch.labelled, batch.text)
                for segment in segments_of(text, compressors)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "labelled", "para_no", "lang_code", "chars", "confidence"])

    texts = documents.select("doc_id", label_code(F.col("lang"), codes, named).alias("labelled"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    return texts.mapInPandas(run, "doc_id long, labelled string, para_no long, lang_code string, chars long, confidence double")


def document_languages(segments: DataFrame) -> DataFrame:
    """(doc_id, labelled, lang_code, confidence, mixed): the main language of each document."""
    by_code = segments.groupBy("doc_id", "lang_code").agg(
        F.max("labelled").alias("labelled"), F.sum("chars").alias("chars"), F.sum(F.col("chars") * F.col("confidence")).alias("weight")
    )
    return by_code.groupBy("doc_id").agg(
        F.max("labelled").alias("labelled"),
        F.max_by("lang_code", F.struct("chars", "lang_code")).alias("lang_code"),
        F.round(F.max_by("weight", F.struct("chars", "lang_code")) / F.sum("chars"), 4).alias("confidence"),
        (F.count("*") > 1).alias("mixed"),
    )


def language_findings(segments: DataFrame) -> DataFrame:
    """(doc_id, para_no, lang_code): each segment of mixed texts; para_no 0 for a missing or wrong label."""
    documents = document_languages(segments)
    mixed = segments.join(documents.where("mixed").select("doc_id"), "doc_id", "left_semi").select("doc_id", "para_no", "lang_code").distinct()
    wrong = documents.where("NOT mixed AND (labelled IS NULL OR labelled <> lang_code)")
    return mixed.unionByName(wrong.select("doc_id", F.lit(0).cast("long").alias("para_no"), "lang_code"))
