"""Text splitters: one text to many chunks, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Count = Callable[[str], int]


def estimate(text: str) -> int:
    """Tokens where no vocabulary is given: bytes / 4, rounded up."""
    return -(-len(text.encode()) // 4)


def window_split(text: str, window: int, overlap: int) -> list[str]:
    """Windows of 4-byte tokens, each ``window - overlap`` after the one before; the tail is always given."""
    if window < 1 or not 0 <= overlap < window:
        raise ValueError("window must be positive and overlap below it")
    raw, step = text.encode(), (window - overlap) * 4
    return [raw[i : i + window * 4].decode("utf-8", "replace") for i in range(0, len(raw), step)]


def paragraph_split(text: str, window: int = 256, overlap: int = 32, count: Count = estimate) -> list[str]:
    """Paragraphs packed while they fit; one that is too long is cut in windows."""
    if not text.strip():
        return []
    if count(text) <= window:
        return [text]
    parts = [p for p in text.split("\n\n") if p.strip()]
    if len(parts) <= 1:
        return window_split(text, window, overlap)
    out, held, size = [], [], 0
    for p in parts:
        n = count(p)
        if held and size + n > window:
            out.append("\n\n".join(held))
            held, size = [], 0
        if n > window:
            out += window_split(p, window, overlap)
        else:
            held, size = [*held, p], size + n
    return out + (["\n\n".join(held)] if held else [])


def _blocks(text: str) -> list[str]:
    """Paragraphs; a fenced block of code is never cut."""
    out, held, fenced = [], [], False
    for line in text.splitlines(keepends=True):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        if not line.strip() and not fenced:
            if held:
                out.append("".join(held))
            held = []
        else:
            held.append(line)
    return out + (["".join(held)] if held else [])


def _pack(parts: list[str], target: int, join: str, count: Count) -> list[str]:
    out, held, size = [], "", 0
    for p in parts:
        n = count(p)
        if held and size + n > target:
            out.append(held)
            held, size = "", 0
        held, size = (held + join + p if held else p), size + n
    return out + ([held] if held else [])


def _shrink(block: str, target: int, overlap: int, count: Count) -> list[str]:
    if "```" in block or "~~~" in block:
        return [block] if count(block) <= 3 * target else window_split(block, 3 * target, overlap)
    for ends in ("。！？.!?", "，；,;"):
        parts = [p for p in re.split(f"(?<=[{ends}])", block) if p.strip()]
        if len(parts) > 1:
            return _pack(parts, target, "", count)
    return window_split(block, target, overlap)


def semantic_split(text: str, target: int = 256, overlap: int = 32, count: Count = estimate) -> list[str]:
    """Blocks packed to the target; long ones by sentences, then clauses, then windows."""
    if target < 1 or not 0 <= overlap < target:
        raise ValueError("target must be positive and overlap below it")
    out, run = [], []
    for b in _blocks(text):
        if count(b) <= target:
            run.append(b)
            continue
        out += _pack(run, target, "\n", count) + _shrink(b, target, overlap, count)
        run = []
    return [c.strip("\n") for c in out + _pack(run, target, "\n", count) if c.strip()]


def sections(text: str) -> list[tuple[str, str]]:
    """(path of headings joined by ' > ', content) of ATX and setext Markdown."""
    lines, out, path, held, fenced = text.split("\n"), [], [], [], False

    def close():
        if "\n".join(held).strip():
            out.append((" > ".join(t for _, t in path), "\n".join(held).strip("\n")))
        held.clear()

    for i, line in enumerate(lines):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)
        level = len(m.group(1)) if m else 0
        title = m.group(2) if m else None
        if not m and not fenced and re.fullmatch(r"=+|-{2,}", line.strip()) and held and held[-1].strip():
            level, title = (1 if line.strip()[0] == "=" else 2), held.pop().strip()
        if title is None:
            held.append(line)
            continue
        close()
        path[:] = [p for p in path if p[0] < level] + [(level, title)]
        held.append(title)
    close()
    return out


def section_split(text: str, target: int = 256, overlap: int = 32, count: Count = estimate) -> list[str]:
    """Every section split on its own, with ``[path] `` in front."""
    found = sections(text)
    if not any(p for p, _ in found):
        return semantic_split(text, target, overlap, count)
    return [f"[{p}] {c}" if p else c for p, body in found for c in semantic_split(body, target, overlap, count)]


def code_segments(text: str) -> list[tuple[str, str]]:
    """('code' | 'prose', part) by fences; an open fence runs to the end."""
    out = []
    for i, part in enumerate(re.split(r"(?m)^(?:```|~~~)[^\n]*\n?", text)):
        if part:
            out.append(("code" if i % 2 else "prose", part))
    return out


def symbol_split(code: str, symbols: list[tuple[str, str, int, int, str]], most_bytes: int = 4096) -> list[str]:
    """Each top-level symbol with a line that names it; what stands before the first is a chunk of its own."""
    lines, out, at = code.split("\n"), [], 0
    for name, kind, a, b, _ in symbols:
        if a - 1 < at:
            continue
        if "\n".join(lines[at : a - 1]).strip():
            out.append("\n".join(lines[at : a - 1]))
        body, head = lines[a - 1 : b], f"// Symbol: {name} ({kind})\n"
        piece: list[str] = []
        for line in body:
            if piece and len(head.encode()) + sum(len(x.encode()) + 1 for x in piece) + len(line.encode()) > most_bytes:
                out.append(head + "\n".join(piece))
                piece = []
            piece.append(line)
        out.append(head + "\n".join(piece))
        at = b
    if "\n".join(lines[at:]).strip():
        out.append("\n".join(lines[at:]))
    return out


SPLITTERS = {"paragraph": paragraph_split, "window": lambda t, w, o: window_split(t, w, o), "semantic": semantic_split, "section": section_split}


def split_texts(texts: DataFrame, kind: str, id_col: str, text_col: str, window: int = 256, overlap: int = 32) -> DataFrame:
    """(id, sequence, content, token_count): all chunks of all texts; blank texts give none."""
    split = SPLITTERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c, estimate(c)) for k, t in zip(b.id, b.text) if t and t.strip() for i, c in enumerate(split(t, window, overlap))]
            yield pd.DataFrame(rows, columns=["id", "sequence", "content", "token_count"])

    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, f"id {dict(source.dtypes)['id']}, sequence int, content string, token_count int")


def answer_slices(text):
    """A stored answer in pieces of 40 characters."""
    return F.regexp_extract_all(text, F.lit(r"(?s).{1,40}"), F.lit(0))
