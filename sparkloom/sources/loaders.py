"""Readers of files: text, Markdown, HTML, CSV and office archives, one row per file.

Files are read with Spark's ``binaryFile`` source and turned into text in Arrow
batches. A file that cannot be read gives a row with its error, never a failure.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def collapse(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def markdown_text(raw: bytes) -> str:
    """Plain text of Markdown: marks go, code stays."""
    out, fenced = [], False
    for line in decode(raw).split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
            out.append("")
            continue
        if not fenced:
            line = re.sub(r"^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)", "", line)
            line = re.sub(r"!\[([^\]]*)\]\([^)]*\)|\[([^\]]*)\]\([^)]*\)", lambda m: m.group(1) or m.group(2) or "", line)
            line = re.sub(r"(\*\*|__|~~|\*|`)(.+?)\1", r"\2", line)
        out.append(line)
    return collapse("\n".join(out))


def html_text(raw: bytes) -> str:
    """Text of HTML: page furniture dropped, headings as ATX, lists with hyphens."""
    t = decode(raw)
    t = re.sub(r"(?is)<(nav|header|footer|aside|script|style)\b.*?</\1\s*>", "", t)
    for n in range(6, 0, -1):
        strip = lambda m, n=n: f"\n\n{'#' * n} {re.sub(r'<[^>]+>', '', m.group(1)).strip()}\n\n"
        t = re.sub(rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}\s*>", strip, t)
    t = re.sub(r"(?i)<li\b[^>]*>\s*", "\n- ", t)
    t = re.sub(r"(?i)<br\s*/?>", "\n", t)
    t = re.sub(r"(?i)</?(?:p|div|ul|ol|table|tr|section|article|body|html|head)\b[^>]*>", "\n\n", t)
    t = re.sub(r"(?i)</t[dh]>", "\t", t)
    t = unescape(re.sub(r"<[^>]+>", "", t))
    t = collapse("\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in t.split("\n")))
    if not t:
        raise ValueError("no text")
    return t


def table_markdown(rows: list[list[str]]) -> str:
    """A Markdown table; the first row is the head, others are padded or cut to it."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    width = len(rows[0])
    cell = lambda c: c.replace("|", "\\|").replace("\n", " ")
    line = lambda r: "| " + " | ".join(cell(c) for c in (r + [""] * width)[:width]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def csv_text(raw: bytes) -> str:
    """CSV as a Markdown table; ; or tab only where strictly most frequent in the first line."""
    t = decode(raw)
    first = t.split("\n", 1)[0]
    n = {d: first.count(d) for d in ",;\t"}
    sep = next((d for d in ";\t" if all(n[d] > n[o] for o in n if o != d)), ",")
    return table_markdown(list(csv.reader(io.StringIO(t), delimiter=sep)))


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def docx_text(raw: bytes) -> str:
    """Paragraphs and tables of a document, drawings as a mark."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))

    def run(e) -> str:
        kind = _tag(e)
        if kind == "t":
            return e.text or ""
        if kind in ("delText", "pPr", "rPr"):
            return ""
        return {"tab": "\t", "br": "\n", "drawing": "[图片]"}.get(kind) or "".join(map(run, e))

    blocks = []
    for e in next(x for x in root if _tag(x) == "body"):
        if _tag(e) == "p":
            blocks.append(run(e))
        elif _tag(e) == "tbl":
            rows = [[" ".join(run(p) for p in c if _tag(p) == "p") for c in r if _tag(c) == "tc"] for r in e if _tag(r) == "tr"]
            blocks.append(table_markdown(rows))
    return "\n\n".join(b for b in blocks if b.strip())


def _number(name: str) -> int:
    return int((re.findall(r"\d+", name) or ["0"])[-1])


def pptx_text(raw: bytes) -> str:
    """Slides in order with their notes."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    out = []
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number):
        text = lambda n: "\n".join("".join(t.text or "" for t in p.iter() if _tag(t) == "t") for p in ElementTree.fromstring(z.read(n)).iter() if _tag(p) == "p")
        notes = f"ppt/notesSlides/notesSlide{_number(name)}.xml"
        out.append(collapse(f"## Slide {_number(name)}\n\n{text(name)}" + (f"\n\n> {text(notes)}" if notes in z.namelist() else "")))
    return "\n\n".join(out)


def epub_text(raw: bytes) -> str:
    """Chapters in the order of the spine."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    opf = next(n for n in z.namelist() if n.endswith(".opf"))
    root, base = ElementTree.fromstring(z.read(opf)), opf.rpartition("/")[0]
    items = {e.get("id"): e.get("href") for e in root.iter() if _tag(e) == "item"}
    paths = ["/".join(x for x in (base, items[e.get("idref")]) if x) for e in root.iter() if _tag(e) == "itemref"]
    return "\n\n---\n\n".join(html_text(z.read(p)) for p in paths)


def xlsx_text(raw: bytes) -> str:
    """Every filled sheet as a named Markdown table; whole numbers without decimals."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(si) == "si"]
    names = [e.get("name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"]
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number)
    out = []
    for name, path in zip(names, sheets):
        rows = []
        for r in (e for e in ElementTree.fromstring(z.read(path)).iter() if _tag(e) == "row"):
            cells: list[str] = []
            for c in (x for x in r if _tag(x) == "c"):
                letters = re.match(r"[A-Z]*", c.get("r") or "").group()
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (max(at, 1) - 1 - len(cells))
                v = next((x.text or "" for x in c.iter() if _tag(x) in ("v", "t")), "")
                kind = c.get("t")
                v = shared[int(v)] if kind == "s" and v else {"1": "true", "0": "false"}.get(v, v) if kind == "b" else v
                cells.append(re.sub(r"^(-?\d+)\.0+$", r"\1", v) if kind in (None, "n") else v)
            rows.append(cells)
        if table := table_markdown(rows):
            out.append(f"## {name}\n\n{table}")
    return "\n\n---\n\n".join(out)


LOADERS: dict[str, Callable[[bytes], str]] = {
    "txt": decode, "md": markdown_text, "markdown": markdown_text, "html": html_text, "htm": html_text, "csv": csv_text, "docx": docx_text,
    "pptx": pptx_text, "epub": epub_text, "xlsx": xlsx_text,
}


def scan_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md", "txt", "pdf")) -> DataFrame:
    """Files below a folder by extension, without hidden names, with content and MD5."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    inside = F.replace(F.col("path"), F.lit(folder.rstrip("/")))
    return files.where(kind.isin(*extensions) & ~inside.rlike(r"/\.")).select("path", kind.alias("kind"), "length", "content", F.md5("content").alias("hash"))


def checked_paths(paths: DataFrame, allowed: tuple[str, ...] = tuple(LOADERS)) -> DataFrame:
    """Adds ``error``: paths that leave their folder or have an extension that is not known."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    error = F.when(F.col("path").rlike(r"(^|/)\.\.(/|$)"), "leaves its folder").when(~kind.isin(*allowed), "unknown extension")
    return paths.withColumn("error", error)


def load_files(files: DataFrame, extra: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, text, error) of files (path, kind, content). ``extra`` plugs in other kinds, such as pdf."""
    loaders = LOADERS | (extra or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, kind, content in zip(b.path, b.kind, b.content):
                try:
                    rows.append((path, loaders[kind](bytes(content)), None))
                except Exception as e:  # one bad file must not end the job
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "kind", "content").mapInPandas(run, "path string, text string, error string")


def web_results(answers: DataFrame, json_col: str = "body") -> DataFrame:
    """(position, title, url, text) of instant answers with nested topics."""
    topic = "Text string, FirstURL string"
    schema = f"AbstractText string, AbstractURL string, Heading string, RelatedTopics array<struct<{topic}, Topics array<struct<{topic}>>>>"
    j = answers.select(F.from_json(json_col, schema).alias("j"))
    flat = F.flatten(F.transform("j.RelatedTopics", lambda t: F.coalesce(t["Topics"], F.array(F.struct(t["Text"].alias("Text"), t["FirstURL"].alias("FirstURL"))))))
    head = F.when(F.length("j.AbstractText") > 0, F.array(F.struct(F.col("j.AbstractText").alias("Text"), F.col("j.AbstractURL").alias("FirstURL")))).otherwise(F.array().cast("array<struct<Text:string,FirstURL:string>>"))
    every = F.filter(F.concat(head, F.coalesce(flat, F.array().cast("array<struct<Text:string,FirstURL:string>>"))), lambda t: F.length(t["Text"]) > 0)
    rows = j.select(F.posexplode(every).alias("position", "t"))
    return rows.select("position", F.element_at(F.split("t.Text", " - "), 1).alias("title"), F.col("t.FirstURL").alias("url"), F.col("t.Text").alias("text"))


def sse_events(stream: bytes) -> list[str]:
    """Data of server-sent events; however the bytes are cut, the events are the same."""
    out = []
    for block in decode(stream).replace("\r\n", "\n").split("\n\n"):
        data = [x[5:].removeprefix(" ") for x in block.split("\n") if x.startswith("data:")]
        if data:
            out.append("\n".join(data))
    return out


def front_matter(text: str) -> dict[str, str]:
    """Keys of a ``---`` head; {} without one."""
    m = re.match(r"---\n(.*?)\n---(?:\n|$)", text, re.S)
    return dict(re.findall(r"(?m)^(\w+):\s*(.*?)\s*$", m.group(1))) if m else {}
