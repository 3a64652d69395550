"""Prompt compression by rules and the dataflow around an answer."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lacks_information, similarity
from .splitters import code_segments

# English words that carry little.
FILLERS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "can", "of", "in", "on", "at", "to", "for", "with", "by", "from", "as", "into", "onto", "upon", "about",
    "through", "during", "before", "after", "above", "below", "between", "within", "without", "against", "and", "or", "but", "nor", "so", "yet",
    "both", "either", "neither", "each", "every", "all", "any", "some", "such", "no", "not", "only", "own", "same", "than", "too", "very", "just",
    "also", "now", "then", "here", "there", "when", "where", "why", "how", "what", "which", "who", "whom", "this", "that", "these", "those", "i",
    "you", "he", "she", "it", "we", "they", "them", "their", "theirs", "our", "ours", "your", "yours", "his", "her", "hers", "its", "my", "mine",
    "me", "him", "us", "myself", "yourself", "himself", "herself", "itself", "ourselves", "yourselves", "themselves",
)
# Chinese words that carry little.
FILLERS_ZH = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有",
    "看", "好", "自己", "这", "那", "这个", "那个", "这些", "那些", "什么", "怎么", "为什么", "可以", "能", "把", "被", "让", "使", "给", "对", "从", "向",
    "为", "以", "于", "与", "及", "或", "但", "而", "且", "则", "才", "再", "又", "还", "已", "正", "正在", "应该", "可能", "也许", "或许", "大概", "大约",
    "左右", "上下", "因为", "所以", "如果", "虽然", "但是", "然而", "不过", "除了", "除非", "即使", "尽管", "无论", "不管", "只要", "只有", "才", "就", "便",
    "即", "然后", "后来", "接着", "首先", "其次", "最后", "终于",
)
_SMALL_WORDS = frozenset((*FILLERS, *FILLERS_ZH))
_HAN = re.compile(r"[一-鿿]")


def collapse(text: str) -> str:
    """Runs of blanks to one, runs of line ends to one, nothing at the ends."""
    text = re.sub(r"[^\S\n]+", " ", text)
    return re.sub(r" ?\n[\n ]*", "\n", text).strip()


def strip_comments(code: str) -> str:
    return re.sub(r"/\*.*?(?:\*/|\Z)", "", re.sub(r"//[^\n]*", "", code), flags=re.S)


def strip_marks(text: str) -> str:
    """Emphasis, strike-through and heading marks of Markdown."""
    text = re.sub(r"(\*\*|__|~~)(.+?)\1", r"\2", text)
    text = re.sub(r"(?<!\w)([*_])(?=\S)(.+?)\1(?!\w)", r"\2", text)
    return re.sub(r"(?m)^#{1,6}\s+", "", text)


def sentence_score(sentence: str, query: str) -> float:
    """1, and more for words and characters of the query, names, acronyms, digits and Chinese."""
    words = set(re.findall(r"[a-z0-9_]+", query.lower()))
    score = 1.0 + sum(1.0 for w in re.findall(r"[a-z0-9_]+", sentence.lower()) if w in words)
    asked = set(_HAN.findall(query))
    score += sum(0.5 for c in _HAN.findall(sentence) if c in asked)
    for w in re.findall(r"[A-Za-z]+", sentence):
        if len(w) >= 2 and w.isupper():
            score += 2
        elif w[0].isupper():
            score += 2
    return score + len(re.findall(r"[0-9]", sentence)) + 0.5 * len(_HAN.findall(sentence))


def without_fillers(sentence: str) -> str:
    """The sentence without small words; of Chinese words the characters that are no small words stay.

    Marks around a word do not count when it is looked up; marks alone stay.
    """
    out = []
    for word in sentence.split():
        marks = re.match(r"([\W_]*)(.*?)([\W_]*)\Z", word, re.S)
        before, core, after = marks.groups()
        if core and _HAN.search(core):
            core = "".join(c for c in core if c not in _SMALL_WORDS)
            if core:
                out.append(before + core + after)
        elif not core or core.lower() not in _SMALL_WORDS:
            out.append(word)
    return " ".join(out)


def keep_count(n: int, ratio: float) -> int:
    return max(math.ceil(n / ratio), math.ceil(n / math.sqrt(ratio)))


def compress(text: str, query: str, ratio: float, score: Callable[[str, str], float] = sentence_score) -> str:
    """Code without comments; of prose the best sentences in their order, without fillers. A ratio of 1 or less changes nothing."""
    if ratio <= 1 or not text.strip():
        return text
    out = []
    for kind, part in code_segments(text):
        if kind == "code":
            out.append("```\n" + collapse(strip_comments(part)) + "\n```")
            continue
        sentences = [s for s in re.split(r"(?<=[。！？.!?])\s*|\n+", strip_marks(part)) if s and s.strip()]
        if not sentences:
            continue
        order = sorted(range(len(sentences)), key=lambda i: (-score(sentences[i], query), i))[: keep_count(len(sentences), ratio)]
        kept = (without_fillers(sentences[i]) for i in sorted(order))
        out.append(collapse(" ".join(k for k in kept if k)))
    return "\n".join(out)


def embedding_score(embedder: Callable[[list[str]], np.ndarray]) -> Callable[[str, str], float]:
    """Scores sentences by their similarity to the query under an injected embedder."""

    def score(sentence: str, query: str) -> float:
        a, b = embedder([sentence, query])
        return float(a @ b)

    return score


def compressed(texts: DataFrame, id_col: str, text_col: str, query_col: str, ratio: float) -> DataFrame:
    """(id, compressed, ratio): texts made shorter for their query, and how much of the bytes stayed."""
    source = texts.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(query_col, F.lit("")).alias("query"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            short = [compress(t, q, ratio) for t, q in zip(b.text, b["query"])]
            kept = [len(s.encode()) / max(1, len(t.encode())) for s, t in zip(short, b.text)]
            yield pd.DataFrame({"id": b.id, "compressed": short, "kept": kept})

    return source.mapInPandas(run, f"id {dict(source.dtypes)['id']}, compressed string, kept double")


def split_sources(hits: DataFrame, first: int, answer_col: str | None = None) -> DataFrame:
    """Adds ``round``: 0 for the first sources, then one more each round; with an answer only if it lacks information."""
    later = F.greatest(F.col("rank") - first + 1, F.lit(0))
    if answer_col:
        return hits.withColumn("round", later).where((F.col("round") == 0) | lacks_information(answer_col))
    return hits.withColumn("round", later)


def accept_drafts(drafts: DataFrame, least: float = 0.85) -> DataFrame:
    """Speculative answers: a draft stands if it is alike enough to the check."""
    alike = similarity("draft", "verified")
    return drafts.withColumn("alike", F.round(alike, 6)).withColumn("accepted", alike >= least)


def bounded_output(text: str, most_lines: int = 500, most_bytes: int = 65536) -> str:
    """First and last half of what is too long, with a mark between."""
    lines = text.split("\n")
    if len(lines) > most_lines:
        half = most_lines // 2
        return "\n".join([*lines[:half], f"... {len(lines) - 2 * half} lines left out ...", *lines[-half:]])
    raw = text.encode()
    if len(raw) <= most_bytes:
        return text
    half = most_bytes // 2
    return raw[:half].decode("utf-8", "ignore") + f"\n... {len(raw) - 2 * half} bytes left out ...\n" + raw[-half:].decode("utf-8", "ignore")


def cut_bytes(text: str, most: int) -> str:
    return text.encode()[:most].decode("utf-8", "ignore")
