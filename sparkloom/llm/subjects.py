"""Problem 1: subject areas by label propagation over a similarity graph.

Documents are linked through the passages (sentences) and topical terms they
share. Going through terms keeps the graph linear in the text: documents of one
subject form a clique whose pairs are never listed. A link counts only if it is
verified: on a bounded sample of labelled documents the term must lean to one
subject by a clear margin. Labels then flow passage - term - passage by iterated
joins; passages of documents whose hand labels can be trusted are clamped to
those subjects. A document keeps every subject that at least a sixth of its prose
treats.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .prose import paragraphs, sentences

#: Labelled documents per subject that the verification of terms looks at.
SAMPLE_DOCS = 800
#: A term is verified if it stands in this many of a subject's documents, this many
#: standard deviations above chance and this often its share. Documents are
#: counted, not sentences, as those of one document do not speak independently;
#: only what is typical of texts without a subject shows in sentences alone.
LEAST_DOCS, LEAST_Z, LEAST_LIFT = 3, 5.0, 2.0
#: The share of the prose from which a subject counts.
LEAST_SHARE = 1 / 6
ROUNDS = 4
#: The least share of a passage's score that must lie on the subjects it is clamped to;
#: where the passage speaks that clearly against a label, the label does not hold it.
LEAST_CLAMPED = 0.02
#: Terms that may be broadcast with their labels; beyond it joins are shuffled.
SMALL_TERMS = 100_000
NEUTRAL = "general"
_WORD = re.compile(r"[^\W\d_]+")
_HAN_RUN = re.compile(r"[㐀-䶿一-鿿豈-﫿]+")


def terms(sentence: str) -> set[str]:
    """Words of three letters or more; of Chinese, pairs of characters."""
    found = set()
    for w in _WORD.findall(sentence.lower()):
        if w[0] < "⺀" and w[-1] < "⺀":
            if len(w) > 2:
                found.add(w)
            continue
        for run in _HAN_RUN.findall(w):
            found.update(run[i : i + 2] for i in range(len(run) - 1))
        found.update(x for x in _HAN_RUN.split(w) if len(x) > 2)
    return found


def text_sentences(text: str | None) -> list[str]:
    return [s for p in paragraphs(text or "") for s in sentences(p)]


def seed_labels(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, subjects, trusted): what is said of a document's subjects.

    Hand labels come first and are trusted unless the stored domain contradicts
    them and no two labellers agree; a stored domain that is the name of a subject
    stands in where there are none.
    """
    named = F.lower(F.trim("subject"))
    votes = labels.where("doc_id IS NOT NULL").select("doc_id", named.alias("subject"), "labeller").where(F.col("subject").isin(subjects)).distinct()
    votes = votes.groupBy("doc_id", "subject").count().groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("hand"), F.max("count").alias("agree"))
    stored = documents.where("doc_id IS NOT NULL").select("doc_id", F.lower(F.trim("domain")).alias("domain"))
    stored = stored.where(F.col("domain").isin(subjects)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    both = stored.join(votes, "doc_id", "full")
    free = F.col("domain").isNull() | (F.col("domain") == NEUTRAL)
    trusted = F.col("hand").isNotNull() & (free | F.array_contains("hand", F.col("domain")) | (F.col("agree") > 1))
    return both.select("doc_id", F.coalesce("hand", F.array("domain")).alias("subjects"), trusted.alias("trusted"))


def _hash_sample(seeded: DataFrame, per_subject: int) -> DataFrame:
    counts = {r["s"]: r["count"] for r in seeded.select(F.explode("subjects").alias("s")).groupBy("s").count().collect()}  # one row a subject
    steps = F.create_map(*[x for s, n in counts.items() for x in (F.lit(s), F.lit(max(1, n // per_subject)))]) if counts else None
    if steps is None:
        return seeded.where("false")
    step = F.array_min(F.transform("subjects", lambda s: F.element_at(steps, s)))
    return seeded.where(F.pmod(F.xxhash64("doc_id"), step) == 0)


def verified_terms(documents: DataFrame, seeds: DataFrame, subjects: list[str], per_subject: int = SAMPLE_DOCS) -> dict[str, list[float]]:
    """Topical terms with their lean to each subject, from a bounded labelled sample."""
    sample = _hash_sample(seeds, per_subject).select("doc_id", "subjects")
    texts = documents.select("doc_id", "text").join(sample, "doc_id")
    width = len(subjects)
    index = {s: i for i, s in enumerate(subjects)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, docs = defaultdict(Counter), defaultdict(Counter)
            for text, said in zip(batch.text, batch.subjects):
                own = [index[s] for s in said]
                here = Counter()
                for sentence in text_sentences(text):
                    here.update(terms(sentence))
                    here[""] += 1
                for t, x in here.items():
                    for k in own:
                        n[t][k] += x / len(own)
                        docs[t][k] += 1 / len(own)
            rows = [(t, k, x, docs[t][k]) for t, by in n.items() for k, x in by.items()]
            yield pd.DataFrame(rows, columns=["term", "k", "n", "docs"])

    counted = texts.mapInPandas(count, "term string, k int, n double, docs double").groupBy("term", "k").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = materialize(counted, "term-counts")
    totals = {r.k: (r.n, r.docs) for r in counted.where("term = ''").collect()}  # one row a subject
    if not totals:
        return {}

    def above_chance(count: str, whole: str, which: int) -> Column:
        every = sum(t[which] for t in totals.values())
        share = F.create_map(*[x for k in range(width) for x in (F.lit(k), F.lit(totals.get(k, (0.0, 0.0))[which] / every))])
        p = F.element_at(share, F.col("k"))
        z = (F.col(count) - F.col(whole) * p) / F.sqrt(F.col(whole) * p * (1 - p) + 1e-9)
        return (z > LEAST_Z) & (F.col(count) > LEAST_LIFT * p * F.col(whole))

    wholes = counted.where("term <> ''").groupBy("term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("all_docs")).where(F.col("all_docs") >= LEAST_DOCS)
    lean = counted.join(wholes, "term").where(F.col("docs") >= LEAST_DOCS)
    good = F.when(F.col("k") == index[NEUTRAL], above_chance("n", "all_n", 0)).otherwise(above_chance("docs", "all_docs", 1))
    kept = counted.join(lean.where(good).select("term").distinct(), "term", "left_semi")
    out: dict[str, list[float]] = {}
    for r in kept.collect():  # bounded by the sample: its terms, one row a subject
        out.setdefault(r.term, [0.0] * width)[r.k] = r.n / max(totals[r.k][0], 1e-9)
    return {t: [x / sum(v) for x in v] for t, v in out.items()}


def passages(documents: DataFrame, vocabulary: set[str]) -> DataFrame:
    """(doc_id, signature, n, chars): a document's sentences by their topical terms.

    The prose of the text counts, that of the summary where the text has none.
    Every document has a row; without any prose one of no characters.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, summary in zip(batch.doc_id, batch.text, batch.summary):
                n, chars = Counter(), Counter()
                for sentence in text_sentences(text) or text_sentences(summary):
                    key = " ".join(sorted(terms(sentence) & vocabulary))
                    n[key] += 1
                    chars[key] += len(sentence)
                rows += [(doc_id, k, n[k], chars[k]) for k in n] or [(doc_id, "", 0, 0)]
            yield pd.DataFrame(rows, columns=["doc_id", "signature", "n", "chars"])

    source = documents.where("doc_id IS NOT NULL").select("doc_id", "text", "summary")
    return source.mapInPandas(read, "doc_id long, signature string, n long, chars long")


def _scored(edges: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(gid, s0, s1, ...): the score of every passage, on the subjects it is clamped to."""
    cols = [f"s{k}" for k in range(len(subjects))]
    scored = edges.join(labels, "term").groupBy("gid").agg(F.max("allowed").alias("allowed"), *[F.sum(c).alias(c) for c in cols])
    inside = lambda k: F.col("allowed").isNull() | F.array_contains("allowed", subjects[k]) | F.lit(subjects[k] == NEUTRAL)
    clamped = [F.when(inside(k), F.col(c)).otherwise(0.0).alias(f"c{k}") for k, c in enumerate(cols)]
    scored = scored.select("gid", *cols, *clamped)
    whole, kept = (reduce(lambda a, b: a + b, [F.col(f"{x}{k}") for k in range(len(cols))]) for x in "sc")
    # a column of its own, so that the sums are not repeated in every expression made of it
    scored = scored.withColumn("holds", kept >= LEAST_CLAMPED * whole)
    return scored.select("gid", *[F.when(F.col("holds"), F.col(f"c{k}")).otherwise(F.col(c)).alias(c) for k, c in enumerate(cols)])


def propagate(edges: DataFrame, start: DataFrame, subjects: list[str], rounds: int = ROUNDS) -> DataFrame:
    """Labels of the terms after ``rounds`` of passage - term - passage.

    edges: gid (a kind of passage), allowed (subjects a clamped one may take, else
    null), n, term. start: term and a column s0, s1, ... for each subject.
    """
    cols = [f"s{k}" for k in range(len(subjects))]
    small = start.count() <= SMALL_TERMS  # labels never get more terms than there are at the start
    labels = start
    for _ in range(rounds):
        scored = _scored(edges, F.broadcast(labels) if small else labels, subjects)
        sharp = [F.pow(F.col(c), 2).alias(c) for c in cols]
        scored = scored.select("gid", *sharp).select("gid", *_normal(cols))
        back = edges.select("gid", "term", "n").join(scored, "gid").groupBy("term").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in cols])
        labels = materialize(back.select("term", *_normal(cols)), "term-labels")
    return F.broadcast(labels) if small else labels


def _normal(cols: list[str]) -> list[Column]:
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    return [F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)).alias(c) for c in cols]


def document_subjects(documents: DataFrame, areas: DataFrame, labels: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, subject, share, chars): every document's subjects.

    share is the part of the prose that treats the subject, chars its length; a
    document of which no subject reaches ``least_share`` is ``general`` with the
    rest. Documents without prose in text and summary, or with nulls in both, are
    ``general``. Rows of one doc_id are taken together; null ids are left out.
    Columns besides doc_id, text, summary and domain are not read. Without any
    labels everything is ``general``.
    """
    spark = documents.sparkSession
    subjects = sorted({r.subject.strip().lower() for r in areas.select("subject").collect() if r.subject} | {NEUTRAL})
    seeds = materialize(seed_labels(documents, labels, subjects), "seeds")
    vocabulary = verified_terms(documents, seeds, subjects)
    found = materialize(passages(documents, set(vocabulary)), "passages")
    totals = found.groupBy("doc_id").agg(F.sum("chars").alias("total"))
    topical = found.where("signature <> ''")
    clamps = seeds.where("trusted").select("doc_id", F.col("subjects").alias("allowed"))
    topical = topical.join(clamps, "doc_id", "left").withColumn("gid", F.xxhash64("signature", "allowed"))
    groups = topical.groupBy("gid").agg(F.max("signature").alias("signature"), F.max("allowed").alias("allowed"), F.sum("n").alias("n"))
    edges = materialize(groups.select("gid", "allowed", "n", F.explode(F.split("signature", " ")).alias("term")), "edges")
    cols = [f"s{k}" for k in range(len(subjects))]
    start = spark.createDataFrame([(t, *v) for t, v in vocabulary.items()], ", ".join(["term string", *[f"{c} double" for c in cols]]))
    # written, as a filter on expressions of so many columns would be planned for minutes
    scored = materialize(_scored(edges, propagate(edges, start, subjects), subjects), "passage-scores")
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("w"), F.lit(s).alias("s")) for c, s in zip(cols, subjects)]))["s"]
    scored = scored.select("gid", best.alias("subject")).where(F.col("subject") != NEUTRAL)
    parts = topical.join(scored, "gid").groupBy("doc_id", "subject").agg(F.sum("chars").alias("chars"))
    shares = parts.join(totals, "doc_id").select("doc_id", "subject", (F.col("chars") / F.col("total")).alias("share"), "chars")
    counted = materialize(shares.where(F.col("share") >= least_share - 1e-12), "shares")
    rest = totals.join(counted, "doc_id", "left_anti").select("doc_id", F.lit(NEUTRAL).alias("subject"), F.lit(1.0).alias("share"), F.col("total").alias("chars"))
    return counted.unionByName(rest)


def subject_shares(found: DataFrame) -> DataFrame:
    """(subject, documents, chars, share): the composition of the corpus."""
    by = found.groupBy("subject").agg(F.count_distinct("doc_id").alias("documents"), F.sum("chars").alias("chars"))
    whole = by.agg(F.sum("chars").alias("all_chars"))
    return by.crossJoin(F.broadcast(whole)).select("subject", "documents", "chars", F.round(F.try_divide("chars", "all_chars"), 6).alias("share"))
