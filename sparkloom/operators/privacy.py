"""Personal data: detection with positions, masking, counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in the order that breaks ties of position.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone", r"1[3-9][0-9]{9}"),
    ("id_card", r"[0-9]{17}[0-9Xx]"),
    ("bank_card", r"[0-9]{16,19}"),
    ("ip", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("intl_phone", r"\+[0-9]{7,15}"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("passport", r"\b[EGeg][0-9]{8}\b"),
)
_COMPILED = {k: re.compile(p) for k, p in PATTERNS}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "bank_card":
        return s[0] != "0" and (len(s) != 16 or luhn(s))
    if kind == "ip":
        return all(int(x) < 256 for x in s.split("."))
    if kind == "ssn":
        return s[:3] not in ("000", "666") and s[0] != "9"
    return True


def mask(kind: str, s: str) -> str:
    """What stands for a match: its ends, with stars between."""
    if kind == "email":
        name, _, domain = s.partition("@")
        return f"{name[0] if len(name) > 1 else ''}***@{domain}"
    if kind == "ip":
        return ".".join(s.split(".")[:2]) + ".**.**"
    if kind == "ssn":
        return f"{s[:3]}-**-{s[7:]}"
    head, stars = {"phone": (3, 4), "id_card": (3, 14), "bank_card": (4, 4), "intl_phone": (3, 4), "passport": (1, 4)}[kind]
    return s[:head] + "*" * stars + s[-4:]


def detect(text: str) -> list[tuple[str, str, str, int, int]]:
    """(kind, match, masked, first byte, end byte) by position, then kind."""
    out = []
    for kind, p in _COMPILED.items():
        for m in p.finditer(text):
            if _valid(kind, m.group()):
                at = len(text[: m.start()].encode())
                out.append((kind, m.group(), mask(kind, m.group()), at, at + len(m.group().encode())))
    return sorted(out, key=lambda d: d[3])


def redact(text: str) -> str:
    """Left to right; a match that begins inside the one before is skipped."""
    raw, parts, last = text.encode(), [], 0
    for _, _, masked, a, b in detect(text):
        if a >= last:
            parts += [raw[last:a], masked.encode()]
            last = b
    return b"".join([*parts, raw[last:]]).decode()


def redacted(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, detections, kinds): masked texts with an audit of what was found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [detect(t or "") for t in b.text]
            yield pd.DataFrame({"id": b.id, "text": [t and redact(t) for t in b.text], "detections": [len(f) for f in found], "kinds": [sorted({d[0] for d in f}) for f in found]})

    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, f"id {dict(source.dtypes)['id']}, text string, detections long, kinds array<string>")


def pattern_count(text: Column, kind: str) -> Column:
    """Matches of a kind's pattern, without the further checks, in SQL."""
    return F.regexp_count(text, F.lit(dict(PATTERNS)[kind]))


def masked_emails(text: Column) -> Column:
    out = F.regexp_replace(text, r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***@$2")
    return F.regexp_replace(out, r"(^|[^A-Za-z0-9._%+*-])[A-Za-z0-9._%+-]@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***@$2")
