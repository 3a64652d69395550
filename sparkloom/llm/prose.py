"""Paragraphs and sentences of dirty texts.

Paragraphs are the non-blank pieces between blank lines, numbered from 1.
Headings, tables, fenced or indented code, log lines and raw strings are no
prose and yield no sentences; list marks and quote marks are taken off. Lines of
one paragraph are joined, as texts may be wrapped anywhere.
"""

from __future__ import annotations

import re

_BREAK = re.compile(r"\r?\n[^\S\n]*\r?\n\s*")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_SKIP = re.compile(r"^\s*(?:#{1,6}\s|\||\+[-=+]+\+|={3,}|-{3,}|\*{3,})")
_LOG = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|^\s*\[?\d\d:\d\d:\d\d")
_MARK = re.compile(r"^\s*(?:(?:[-*+•>]|\d{1,3}[.)])\s+)+")
#: A sentence ends at a full stop, question or exclamation mark before white
#: space or the end, or at a Chinese one anywhere.
_END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])\s*")
_LETTER_RUN = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_CODE = re.compile(r"[{}=<>\\|;_]|0x[0-9a-f]|\(\)|::|->")


def paragraphs(text: str) -> list[str]:
    return [p for p in _BREAK.split(text.strip()) if p.strip()]


def prose_lines(paragraph: str) -> str:
    """The lines of a paragraph that may be prose, joined to one."""
    kept, fenced = [], False
    for line in paragraph.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and not _SKIP.match(line) and not _LOG.match(line):
            kept.append(_MARK.sub("", line).strip())
    return " ".join(x for x in kept if x)


def is_prose(piece: str, least_words: int = 4, least_han: int = 6) -> bool:
    """Whether a piece reads like a sentence: enough words, mostly letters."""
    han = len(_HAN.findall(piece))
    if han >= least_han:
        return True
    words = _LETTER_RUN.findall(piece)
    if len(words) < least_words:
        return False
    letters = sum(map(len, words))
    filled = len(piece) - piece.count(" ")
    if letters < 0.6 * filled or letters > 14 * len(words):
        return False
    return len(_CODE.findall(piece)) * 12 <= len(words)


def sentences(paragraph: str) -> list[str]:
    return [s.strip() for s in _END.split(prose_lines(paragraph)) if s and is_prose(s)]
