"""Entities, relations, links, propositions and code symbols of texts."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Capitalised words that are no proper nouns.
STOPWORDS = (
    "The", "A", "An", "This", "That", "These", "Those", "It", "He", "She", "We", "They", "You", "I", "But", "And", "Or", "If", "When",
    "Where", "What", "Who", "How", "Why", "Which", "There", "Here", "Now", "Then", "Today", "Yesterday", "Tomorrow", "Some", "Any", "All",
    "Each", "Every", "Both", "Neither", "Either", "Such", "So", "Too", "Very", "Also", "Just", "Only", "Even", "Still", "Yet", "Already",
    "However", "Therefore", "Thus", "Hence", "Meanwhile", "Finally", "Actually", "In", "On", "At", "To", "For", "Of", "With", "By", "From",
    "About", "Into", "Onto", "Upon", "Over", "Under", "Through", "Between", "Among", "During", "Before", "After", "Since", "Until", "Within",
    "Without", "Against", "Toward", "Towards", "Is", "Are", "Was", "Were", "Be", "Been", "Being", "Have", "Has", "Had", "Do", "Does", "Did",
    "Will", "Would", "Shall", "Should", "May", "Might", "Must", "Can", "Could", "Ought", "Not", "No", "Yes", "More", "Most", "Much", "Many",
    "Few", "Little", "Less", "Least", "Other", "Another", "Same", "Different", "New", "Old", "Good", "Great", "First", "Last", "Next",
    "Previous", "Main", "Note", "Important",
)
# Relation types with the phrases that state them, and the confidence of each kind.
EXACT = (
    ("defined_as", ("is defined as",)), ("part_of", ("is part of",)), ("depends_on", ("depends on",)), ("uses", (" uses ",)),
    ("implements", (" implements ",)), ("extends", (" extends ",)), ("references", (" references ",)),
)
LOOSE = (
    ("defined_as", ("defines", "definition of", "defined by")), ("part_of", ("part of", "component of", "belongs to")),
    ("depends_on", ("requires", "relies on", "based on")), ("uses", ("utilizes", "employs", "leverages")),
    ("implements", ("implementation of", "realizes")), ("extends", ("inherits from", "subclasses", "derived from")),
    ("references", ("refers to", "mentions", "cites")),
)
EXACT_ZH = (
    ("defined_as", "定义为"), ("part_of", "是.*的一部分"), ("depends_on", "依赖"), ("uses", "使用"), ("implements", "实现"),
    ("extends", "继承"), ("references", "引用"),
)
SURE, LIKELY, TOGETHER, NEAR_BYTES = 1.0, 0.7, 0.5, 80
# Pronouns and conjunctions that point at the sentence before.
PRONOUNS_ZH = ("他", "她", "它")
PRONOUNS_EN = ("he", "she", "they", "it", "He", "She", "They", "It")
CONJUNCTIONS_ZH = ("因此", "所以", "然后", "但是", "不过", "而且", "并且", "从而", "于是", "由此")
CONJUNCTIONS_EN = ("Therefore", "So", "Then", "But", "However", "And", "Thus", "Hence", "Moreover", "Furthermore")

# The commonest Chinese surnames of one character. A fuller list is a parameter.
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳鲍史唐"
    "费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康"
)
# Words that begin like a name and are none.
NOT_NAMES = (
    "中国", "中华", "中文", "中关", "中心", "之后", "之前", "之中", "其中", "这个", "这些", "这样", "这里", "这是", "这种", "那个", "那些", "那样",
    "那里", "什么", "怎么", "为什么", "那么", "可以", "可能", "应该", "需要", "已经", "正在", "曾经", "将会", "因为", "所以", "但是", "虽然", "然而",
    "使用", "实现", "通过", "进行", "包括", "包含", "我们", "他们", "你们", "自己", "它们",
)

# Patterns of technical terms, identifiers and dates. Digits and word
# characters are ASCII here, as in Java's patterns without flags.
PASCAL = r"\b[A-Z][a-z]+[A-Z][a-z]*\w*"
CAMEL = r"\b[a-z]+[A-Z]\w*"
SNAKE = r"\b[A-Z][A-Z_]{2,}[A-Z]\b"
ACRONYM = r"\b[A-Z]{3,}\b"
VERSION = r"\bv?[0-9]+\.[0-9]+\.[0-9]+(?:-\w+)?"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
CODE = r"\b[0-9]{3,4}\b"
DATE = r"\b[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}\b"
DATE_ZH = r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def proper_nouns(text: Column) -> Column:
    """Capitalised words that are no stop words, all-caps words of 3 or more, or PascalCase."""
    words = _found(text, r"[A-Za-z]+")
    fine = lambda w: w.rlike("^[A-Z].") & ~w.rlike("^[A-Z]{3,}$") & ~w.rlike("^[A-Z][a-z]+[A-Z]") & ~w.isin(*STOPWORDS)
    return F.array_distinct(F.filter(words, fine))


def tech_terms(text: Column) -> Column:
    return F.array_distinct(F.concat(*[_found(text, p) for p in (PASCAL, CAMEL, SNAKE, ACRONYM)]))


def identifiers(text: Column) -> Column:
    """Versions, IPv4 addresses and codes of 3 or 4 digits that are no years."""
    codes = F.filter(_found(text, CODE), lambda c: ~c.cast("int").between(1900, 2099))
    return F.array_distinct(F.concat(_found(text, VERSION), _found(text, IPV4), codes))


def dates(text: Column) -> Column:
    return F.array_distinct(F.concat(_found(text, DATE), _found(text, DATE_ZH)))


def persons(text: Column, surnames: str = SURNAMES, not_names: tuple[str, ...] = NOT_NAMES) -> Column:
    """Chinese names: a surname and one more character, two or three more where the shorter word is no name.

    The character after a name is skipped, so that it begins no other.
    """
    if not surnames:
        return F.array().cast("array<string>")
    # only words that begin with a surname can be taken for a name; a longer name needs a shorter word that is none
    alike = [w for w in not_names if w[0] in surnames]
    kinds = []
    for n in (2, 3, 4):
        stops = "|".join(w for w in alike if len(w) == n)
        no_word = f"(?!{stops})" if stops else ""
        kinds.append(rf"(?=[{surnames}]){no_word}[一-鿿]{{{n}}}")
        if not stops:
            break
    found = F.regexp_extract_all(text, F.lit(rf"(?s)({'|'.join(kinds)}).?"), F.lit(1))
    return F.array_distinct(found)


def entities(text: Column, surnames: str = SURNAMES) -> Column:
    """array<struct<entity, type>>: all kinds in order, persons first; of equal texts the first kind counts."""
    kinds = {"person": persons(text, surnames), "proper_noun": proper_nouns(text), "tech_term": tech_terms(text), "identifier": identifiers(text), "date": dates(text)}

    def named(found: Column) -> Column:
        def one(e: Column) -> Column:
            kind = F.lit("date")
            for name in ("identifier", "tech_term", "proper_noun", "person"):
                kind = F.when(F.array_contains(found[name], e), name).otherwise(kind)
            return F.struct(e.alias("entity"), kind.alias("type"))

        return F.transform(F.array_distinct(F.concat(*[found[k] for k in kinds])), one)

    # the kinds are found once, as the only element of an array
    found = F.struct(*[v.alias(k) for k, v in kinds.items()])
    return F.element_at(F.transform(F.array(found), named), 1)


def _rules_in(sentence: str) -> list[tuple[str, float, str, bool]]:
    """(type, confidence, phrase, is a pattern) of the rules whose words the sentence has, surest first."""
    out = []
    for rules, sure in ((EXACT, SURE), (LOOSE, LIKELY)):
        out += [(kind, sure, phrase, False) for kind, phrases in rules for phrase in phrases if phrase in sentence]
    zh = [(kind, p) for kind, p in EXACT_ZH if all(x in sentence for x in p.split(".*"))]
    out += [(kind, SURE, rf"\s*{p}\s*", True) for kind, p in zh]
    return out + [(kind, LIKELY, f".*{p}.*", True) for kind, p in zh]


def _follows(rule: tuple[str, float, str, bool], sentence: str, subject: str, obj: str) -> bool:
    _, _, phrase, pattern = rule
    if pattern:
        return re.search(re.escape(subject) + phrase + re.escape(obj), sentence) is not None
    s, o = sentence.find(subject), sentence.rfind(obj)
    return s < sentence.find(phrase, s + len(subject) - 1) < o


def sentence_relations(sentence: str, names: list[str]) -> Iterator[tuple[str, str, str, float]]:
    """(subject, type, object, confidence) of ordered pairs of names in a sentence.

    The first rule that holds counts; without one, names within reach of each
    other in bytes are related. Pairs out of reach are only looked at where the
    sentence has the words of some rule.
    """
    raw = sentence.encode()
    here = sorted((raw.find(n.encode()), n) for n in names if n in sentence)
    rules = _rules_in(sentence)
    longest = max((len(n.encode()) for _, n in here), default=0)
    for at, subject in here:
        start = 0 if rules else bisect_left(here, (at - 2 * longest - NEAR_BYTES, ""))
        for pos, obj in here[start:]:
            reach = len(subject.encode()) + len(obj.encode()) + NEAR_BYTES
            if not rules and pos > at + 2 * longest + NEAR_BYTES:
                break
            if obj == subject:
                continue
            rule = next((r for r in rules if _follows(r, sentence, subject, obj)), None)
            if rule:
                yield subject, rule[0], obj, rule[1]
            elif abs(at - pos) <= reach:
                yield subject, "related_to", obj, TOGETHER


def relation_of(sentence: str, subject: str, obj: str) -> tuple[str, float] | None:
    """What links two names in a sentence."""
    found = {(s, o): (kind, sure) for s, kind, o, sure in sentence_relations(sentence, [subject, obj])}
    return found.get((subject, obj))


def relations(texts: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(id, src, relation_type, dst, confidence): each relation of a text once."""
    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.transform("entities", lambda e: e["entity"]).alias("names"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, names in zip(batch.id, batch.text, batch.names):
                seen = {}
                for sentence in re.split(r"[。？！.?!\n]", text or ""):
                    for s, kind, o, sure in sentence_relations(sentence, [] if names is None else list(names)):
                        seen.setdefault((s, kind, o), sure)
                rows += [(key, s, kind, o, sure) for (s, kind, o), sure in seen.items()]
            yield pd.DataFrame(rows, columns=["id", "src", "relation_type", "dst", "confidence"])

    return source.mapInPandas(run, f"id {dict(source.dtypes)['id']}, src string, relation_type string, dst string, confidence double")


def split_sentences(text: str) -> list[str]:
    """At Chinese ends, at . ! ? ; before white space, the end or another mark, and at blank lines."""
    return [s.strip() for s in re.split(r"(?<=[。！？；])|(?<=[.!?;])(?=\s|$)|\n\n", text) if s and s.strip()]


def propositions(text: str, first_entity) -> list[str]:
    """Sentences that stand alone: pronouns give way to the entity of the sentence before, conjunctions get it in front."""
    out, before = [], None
    for sentence in split_sentences(text):
        made = sentence
        if before:
            for p in PRONOUNS_ZH:
                made = made.replace(p, before)
            made = re.sub(rf"\b(?:{'|'.join(PRONOUNS_EN)})\b", lambda m: before, made)
            if made == sentence:
                if sentence.startswith(CONJUNCTIONS_ZH):
                    made = before + sentence
                elif re.match(rf"(?:{'|'.join(CONJUNCTIONS_EN)})\b", sentence):
                    made = f"{before}: {sentence}"
        out.append(made)
        before = first_entity(sentence) or before
    return out


_FENCE = re.compile(r"^(```|~~~)")


def wiki_links(text: str) -> list[str]:
    """Targets of [[target|alias]] and [[target#part]] outside code, each once."""
    clean, closing = [], None
    for line in text.split("\n"):
        mark = _FENCE.match(line.lstrip())
        if closing:
            if mark and mark.group(1) == closing:
                closing = None
            continue
        if mark:
            closing = mark.group(1)
            continue
        clean.append(re.sub(r"`[^`]*`", " ", line))
    found = (re.split(r"[|#]", m, maxsplit=1)[0].strip() for m in re.findall(r"\[\[([^\[\]]+)\]\]", "\n".join(clean).split("`")[0]))
    return list(dict.fromkeys(t for t in found if t))


_KINDS = {
    "rust": ((r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "function"), (r"^\s*(?:pub\s+)?struct\s+(\w+)", "struct"), (r"^\s*(?:pub\s+)?enum\s+(\w+)", "enum"), (r"^\s*(?:pub\s+)?trait\s+(\w+)", "trait")),
    "typescript": ((r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"), (r"^\s*(?:export\s+)?class\s+(\w+)", "class"), (r"^\s*(?:export\s+)?interface\s+(\w+)", "interface")),
    "go": ((r"^func\s+\([^)]*\)\s*(\w+)", "method"), (r"^func\s+(\w+)", "function"), (r"^type\s+(\w+)\s+struct", "struct"), (r"^type\s+(\w+)\s+interface", "interface")),
}


def code_symbols(code: str, language: str) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, first line, last line, signature). Python by its syntax tree, others by line patterns."""
    lines = code.split("\n")
    if language == "python":
        try:
            tree = ast.parse(code)
        except SyntaxError:
            return []
        out = []

        def walk(node, inside):
            for x in ast.iter_child_nodes(node):
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    kind = "class" if isinstance(x, ast.ClassDef) else "method" if inside else "function"
                    out.append((x.name, kind, x.lineno, x.end_lineno, lines[x.lineno - 1].strip().rstrip(":")))
                    walk(x, isinstance(x, ast.ClassDef))

        walk(tree, False)
        return out
    hits = []
    for i, line in enumerate(lines, 1):
        for pattern, kind in _KINDS.get(language, ()):
            m = re.match(pattern, line)
            if m:
                hits.append((m.group(1), kind, i, line.strip().rstrip("{ ")))
                break
    return [(n, k, i, (hits[j + 1][2] - 1 if j + 1 < len(hits) else len(lines)), s) for j, (n, k, i, s) in enumerate(hits)]
