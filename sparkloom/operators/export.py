"""Exports: conversations as Markdown, graphs as GraphML and JSON-LD, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import epoch_text, xml_escape


def conversation_markdown(messages: DataFrame, conversations: DataFrame, by: str = "conversation_id") -> DataFrame:
    """(by, markdown): title, time and one section per message; system messages are left out.

    messages: by, position, role, content; conversations: by, title, created_at.
    """
    head = F.when(F.col("role") == "user", "## 🧑 User").when(F.col("role") == "assistant", "## 🤖 Assistant").otherwise(F.concat(F.lit("## "), F.col("role")))
    parts = messages.where("role <> 'system'").select(by, F.struct("position", F.concat(head, F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n")).alias("s")).alias("p"))
    body = parts.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("p"))["s"], "").alias("body"))
    top = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n> **Created at** "), epoch_text("created_at"), F.lit("\n\n---\n\n"))
    return conversations.join(body, by).select(by, F.concat(top, "body", F.lit("---\n\n")).alias("markdown"))


def citations(hits: DataFrame, by: str) -> DataFrame:
    line = F.format_string("%d. **%s** (chunk #%d, score: %.2f)\n", F.col("rank") + 1, "doc_name", "sequence", "score")
    return hits.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", line.alias("s"))))["s"], "").alias("citations"))


def graphml(edges: DataFrame, types: DataFrame) -> DataFrame:
    """(section, line): lines of a GraphML file, nodes before edges; unknown node types are ``unknown``."""
    names = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    nodes = names.join(types.groupBy("node").agg(F.max("type").alias("type")), "node", "left")
    node = F.concat(F.lit('<node id="'), xml_escape("node"), F.lit('"><data key="type">'), xml_escape(F.coalesce("type", F.lit("unknown"))), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), xml_escape("src"), F.lit('" target="'), xml_escape("dst"), F.lit('"><data key="relation">'), xml_escape("relation_type"), F.lit("</data></edge>"))
    return nodes.select(F.lit("nodes").alias("section"), node.alias("line")).unionByName(edges.select(F.lit("edges").alias("section"), edge.alias("line")))


def jsonld(edges: DataFrame) -> DataFrame:
    """(line): one JSON object per subject for the @graph."""
    link = F.struct(F.col("relation_type").alias("relation"), F.struct(F.col("dst").alias("@id")).alias("object"))
    return edges.groupBy("src").agg(F.to_json(F.struct(F.first("src").alias("@id"), F.array_sort(F.collect_list(link)).alias("relations"))).alias("line")).select("line")


def contextual_text(name, content):
    return F.concat(F.lit("文档《"), name, F.lit("》：\n"), content)


def rag_prompt(hits: DataFrame, by: str) -> DataFrame:
    """(by, prompt): sources numbered from 1 in rank order."""
    part = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] 来源《"), F.col("doc_name"), F.lit("》：\n"), F.col("content"), F.lit("\n\n"))
    return hits.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", part.alias("s"))))["s"], "").alias("prompt"))


# Marks of severities in a report.
SEVERITY_MARKS = {"high": "🔴", "medium": "🟡", "low": "🟢"}


def audit_markdown(reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """(report_id, markdown): audit reports with their contradictions, numbered in the order of pair_id.

    reports: report_id, doc_name, chunks, claims. pairs: report_id, pair_id, verdict,
    severity, claim_a, claim_b, explanation; only contradictions are listed.
    """
    mark = F.lit("")
    for severity, sign in SEVERITY_MARKS.items():
        mark = F.when(F.col("severity") == severity, sign).otherwise(mark)
    body = F.concat_ws("\n", F.concat(F.lit("- A: "), "claim_a"), F.concat(F.lit("- B: "), "claim_b"), F.concat(F.lit("- "), "explanation"))
    listed = pairs.where("verdict = 'contradiction'").select("report_id", F.struct("pair_id", mark.alias("mark"), body.alias("body")).alias("p"))
    # the pairs of one report, which a reader is to read
    gathered = listed.groupBy("report_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    joined = reports.join(gathered, "report_id", "left")
    found = F.coalesce(F.size("p"), F.lit(0))
    items = F.transform("p", lambda x, i: F.concat(F.lit("### "), x["mark"], F.lit(" "), (i + 1).cast("string"), F.lit(". "), x["pair_id"], F.lit("\n"), x["body"]))
    head = F.concat(
        F.lit("## Audit: "), "doc_name", F.lit("\n\n- chunks: "), F.col("chunks").cast("string"), F.lit("\n- claims: "), F.col("claims").cast("string"),
        F.lit("\n- contradictions: "), F.greatest(found, F.lit(0)).cast("string"), F.lit("\n\n"),
    )
    text = F.when(F.col("p").isNull(), "No contradictions found.").otherwise(F.array_join(items, "\n\n"))
    return joined.select("report_id", F.concat(head, text).alias("markdown"))
