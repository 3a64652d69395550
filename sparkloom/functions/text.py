"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Keywords of the query types, tried in this order.
CODE_WORDS = (
    "代码", "函数", "方法", "接口", "api", "类", "编译", "报错", "错误", "异常", "调试", "实现", "code", "function", "method", "class",
    "compile", "error", "exception", "debug", "implement", "stack", "trace", "runtime", "thread", "async", "await", "promise", "callback",
)
ANALYTICAL_WORDS = (
    "比较", "对比", "分析", "优缺点", "区别", "差异", "优势", "劣势", "权衡", "总结", "综述", "compare", "contrast", "analyze", "analysis",
    "difference", "advantage", "disadvantage", "pros", "cons", "tradeoff", "trade-off", "summary", "summarize",
)
FACTUAL_WORDS = (
    "是什么", "什么是", "定义", "含义", "意思", "指的是", "全称", "缩写", "who", "what", "when", "where", "define", "definition", "meaning",
)
# Words that ask about a whole collection.
GLOBAL_WORDS = ("概述", "总结", "主题", "全局", "全部", "整体", "综述", "overview", "summary", "theme", "global", "all", "overall", "outline")
# Words of an answer that lacks information.
INSUFFICIENT_WORDS = (
    "不确定", "没有找到", "未找到", "无法确定", "不清楚", "无法回答", "信息不足", "不相关", "未能找到", "无法确认", "找不到", "无相关",
    "知识库中未找到", "insufficient", "not found", "unclear", "cannot determine", "not enough", "no relevant", "unable to", "not sure",
    "no information", "no mention", "does not contain", "not covered",
)
# What marks an authentication or network error, and the prefixes of classified errors.
AUTH_MARKS = ("HTTP 401", "HTTP 403")
NETWORK_MARKS = ("请求发送失败", "无法连接", "timeout", "超时", "SSE 流", "connection", "connect", "Connection refused", "dns", "DNS")
# The document domains.
DOMAINS = (
    "technology", "legal", "medical", "finance", "science", "education", "business", "engineering", "literature", "government",
    "marketing", "hr", "design", "data", "security", "general",
)


def any_of(words: tuple[str, ...]) -> str:
    """A regex that matches where one of the words stands."""
    return "|".join(w.replace(".", r"\.") for w in words)


def normalize_query(q: Column | str) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.trim(F.lower(F.regexp_replace(_col(q), r"\s+", " ")))


def query_key(q: Column | str) -> Column:
    return F.sha2(normalize_query(q), 256)


def step_key(tool: Column | str, argument: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", _col(tool), _col(argument)), 256)


def query_type(q: Column | str) -> Column:
    low = F.lower(_col(q))
    return (
        F.when(low.rlike(any_of(CODE_WORDS)), "code")
        .when(low.rlike(any_of(ANALYTICAL_WORDS)), "analytical")
        .when(low.rlike(any_of(FACTUAL_WORDS)), "factual")
        .otherwise("conversational")
    )


def query_level(q: Column | str) -> Column:
    return F.when(F.lower(_col(q)).rlike(any_of(GLOBAL_WORDS)), "global").otherwise("local")


def lacks_information(answer: Column | str) -> Column:
    return F.coalesce(F.lower(_col(answer)).rlike(any_of(INSUFFICIENT_WORDS)), F.lit(False))


def error_class(message: Column | str) -> Column:
    m = _col(message)
    return F.when(m.rlike(any_of(AUTH_MARKS)), "AUTH").when(m.rlike(any_of(NETWORK_MARKS)), "NETWORK").otherwise("LLM")


def has_error_prefix(message: Column | str) -> Column:
    return _col(message).rlike("^(?:LIMIT_REACHED|PRO_REQUIRED|NETWORK|AUTH|PARSE|EMBED|LLM|STORAGE|VALIDATION|UNKNOWN):")


def similarity(a: Column | str, b: Column | str, most: int = 200) -> Column:
    """Levenshtein similarity of the first ``most`` characters; both empty 1, one empty 0."""
    x, y = F.left(_col(a), F.lit(most)), F.left(_col(b), F.lit(most))
    longer = F.greatest(F.char_length(x), F.char_length(y))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longer)


def card_is_valid(digits: Column | str) -> Column:
    """13 to 19 digits, not starting with 0; 16 digits must also pass the Luhn check."""
    d = _col(digits)
    shape = d.rlike("^[1-9][0-9]{12,18}$")
    return shape & ((F.char_length(d) != 16) | F.coalesce(F.call_function("luhn_check", F.when(shape, d)), F.lit(False)))


def ssn_is_valid(s: Column | str) -> Column:
    return _col(s).rlike("^(?!000|666|9)[0-9]{3}-[0-9]{2}-[0-9]{4}$")


def xml_escape(s: Column | str) -> Column:
    out = _col(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "[/\\\\]"), -1)


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def preview(s: Column | str, most: int) -> Column:
    return F.when(F.char_length(_col(s)) > most, F.concat(F.left(_col(s), F.lit(most)), F.lit("…"))).otherwise(_col(s))


def token_estimate(s: Column | str, per_message: int = 0) -> Column:
    """A token for every four bytes, rounded down, plus a constant per message."""
    return F.floor(F.octet_length(_col(s)) / 4) + per_message


def epoch_text(seconds: Column | str) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(_col(seconds)), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def chunk_window(size: Column | str) -> Column:
    """Tokens per chunk by file size in bytes."""
    s = _col(size)
    return F.when(s > 1_000_000_000, 2048).when(s > 200_000_000, 1024).when(s > 50_000_000, 512).otherwise(256)


def json_strings(s: Column | str) -> Column:
    """A JSON list of strings; empty if it cannot be read."""
    return F.coalesce(F.from_json(_col(s), "array<string>"), F.array().cast("array<string>"))


def safe_file_name(s: Column | str) -> Column:
    """Nine characters that paths cannot hold become underscores; never empty."""
    clean = F.regexp_replace(_col(s), r'[/\\:*?"<>|]', "_")
    clean = F.regexp_replace(F.trim(clean), r"^\.+|\.+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("conversation"))


def condition_holds(condition: str, text: Column | str) -> Column:
    """Workflow predicates: true, nonempty, contains:word, length>N, length<N (bytes)."""
    t = _col(text)
    kind, _, arg = condition.strip().partition(":")
    if condition.strip() == "true":
        return F.lit(True)
    if condition.strip() == "nonempty":
        return F.trim(t) != ""
    if kind == "contains":
        return F.contains(F.lower(t), F.lit(arg.lower()))
    for sign, test in ((">", lambda n: F.octet_length(t) > n), ("<", lambda n: F.octet_length(t) < n)):
        head, found, n = condition.partition(sign)
        if found and head.strip() == "length" and n.strip().isdigit():
            return test(int(n))
    return F.lit(False)


def fts_tokens(q: Column | str) -> Column:
    """Search tokens: letters, digits, _ and - of each word; a lone long Chinese word gives its triples."""
    words = F.filter(F.transform(F.split(_col(q), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_-]", "")), lambda w: w != "")
    words = F.array_distinct(words)
    only = F.element_at(words, 1)
    n = F.char_length(only)
    triples = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(only, i, F.lit(3))))
    return F.when((F.size(words) == 1) & (n > 3) & only.rlike(r"[一-鿿]"), triples).otherwise(words)


def fts_query(q: Column | str) -> Column:
    return F.array_join(F.transform(fts_tokens(q), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def template_name_is_valid(name: Column | str) -> Column:
    """1 to 32 small letters, digits or underscores."""
    return F.coalesce(_col(name).rlike(r"^[a-z0-9_]{1,32}\z"), F.lit(False))


def has_query_placeholder(template: Column | str) -> Column:
    return F.coalesce(F.contains(_col(template), F.lit("{query}")), F.lit(False))


def react_actions(text: Column | str) -> Column:
    """array<struct<number, tool, input>>: the numbered or single actions of an agent's turn with their inputs."""
    t = _col(text)
    line = r"(?im)^[ \t]*Action(?:[ \t]+(\d+))?[ \t]*:[ \t]*([^\n]*)(?:\n[ \t]*Action Input(?:[ \t]+\d+)?[ \t]*:[ \t]*([^\n]*))?"
    number, tool, given = (F.regexp_extract_all(t, F.lit(line), F.lit(i)) for i in (1, 2, 3))
    zipped = F.arrays_zip(number.alias("number"), tool.alias("tool"), given.alias("input"))
    return F.transform(zipped, lambda z: F.struct(F.nullif(z["number"], F.lit("")).cast("int").alias("number"), F.trim(z["tool"]).alias("tool"), F.trim(z["input"]).alias("input")))


def final_answer(text: Column | str) -> Column:
    """What follows the last ``Final Answer:``; null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(_col(text), r"(?is)^.*Final Answer:(.*)\z", 1)), F.lit(""))
