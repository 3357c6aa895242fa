"""Text functions as Spark expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns.
HASH_TOKEN = r"[\u3400-\u9fff]|[a-z0-9_./-]+"
INDEX_TOKEN = r"[\p{L}\p{N}\p{Co}]+"
ENTITY = r"[A-Za-z]+[-_.]?[A-Za-z0-9]*|[\u4e00-\u9fff]{2,8}"
PROCEDURE = r"怎么|如何|步骤|安装|配置"
FACT = r"多少|几|统计"
EXACT = r"[A-Z]{2,}[-_]?\d+|\b\d{3,}\b"
TABULAR = r"表格|字段|列|行|统计|数量"
REFUSAL = r"无法回答|不能回答|未找到|没有找到|证据不足|无法确认|无法确定|不知道"
EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
MOBILE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
CREDENTIAL = r"(?i)(?:api[_-]?key|password|token)\s*[:=]\s*\S+"
SECRET_VALUE = r"(?i)(api[_-]?key|password|secret|token|authorization)\s*[:=]\s*[^\s,;]+"
CONNECTION = r"(?i)(postgres(?:ql)?|mysql|mongodb)://[^\s]+"
#: Texts of an extractive answer.
NO_EVIDENCE = "当前知识版本中没有找到能够直接支持该问题的证据，因此无法回答。"
BY_EVIDENCE = "根据当前知识版本中的证据："
#: Fixed value: the locator of what has no finer place.
WHOLE_DOCUMENT = "文档内容"

#: White space beyond what the JVM's \s knows.
_MORE_SPACE = r"\x0b\x1c-\x1f\x85\p{Z}"


def wide(pattern: str) -> str:
    """A pattern whose word characters and white space are those of all scripts, in a form that Java and RE2 share."""
    out = pattern.replace(r"[\w", r"[\p{L}\p{N}_").replace(r"[^\s", r"[^\s" + _MORE_SPACE)
    return out.replace(r"\s*", rf"[\s{_MORE_SPACE}]*").replace(r"\S", rf"[^\s{_MORE_SPACE}]")


def folding() -> tuple[str, str]:
    """Latin letters with diacritics and their bases, from Unicode's decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Without diacritics; ASCII text passes unread."""
    source, target = folding()
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, source, target)).otherwise(text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def hash_tokens(text: Column) -> Column:
    """Lower-case tokens of the hash embedding, duplicates kept."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("\u3000"), F.lit(" ")), F.lit(HASH_TOKEN), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, not yet folded."""
    return F.regexp_extract_all(F.lower(text), F.lit(INDEX_TOKEN), F.lit(0))


def entities(text: Column) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))), 1, 12)


def language(text: Column) -> Column:
    return F.when(text.rlike(r"[\u4e00-\u9fff]"), "zh-CN").otherwise("und")


def intent(text: Column) -> Column:
    return F.when(text.rlike(PROCEDURE), "procedure").when(text.rlike(FACT), "fact").otherwise("knowledge_query")


def parse_plan(text: Column, strict: Column) -> Column:
    """The plan of a question: normalised text, entities, language, intent, whether to ask back, and the evidence policy."""
    t = collapse(text)
    return F.struct(
        t.alias("normalised"), entities(t).alias("entities"), language(t).alias("language"), intent(t).alias("intent"),
        (F.length(t) < 2).alias("needs_clarification"), F.when(strict, "strict_evidence").otherwise("evidence_preferred").alias("policy"),
    )


def full_text_weight(text: Column) -> Column:
    return F.when(text.rlike(EXACT), 1.4).otherwise(1.0)


def vector_weight(text: Column) -> Column:
    return F.when(text.rlike(TABULAR), 0.9).otherwise(1.0)


def strategy(full_text: Column, vector: Column) -> Column:
    """hybrid with both channels, the name of the only one, or none."""
    return F.when(full_text & vector, "hybrid").when(full_text, "full_text").when(vector, "vector").otherwise("none")


def refuses(text: Column) -> Column:
    return text.rlike(REFUSAL)


def clean_controls(text: Column) -> Column:
    """Newlines unified; control characters but tab and newline removed."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def token_estimate(text: Column, rounding: str = "parser") -> Column:
    """max(1, 0.7 per CJK character + 1.3 per word), rounded up; parsers add 0.999999 and truncate, revisions take the ceiling."""
    cjk = F.regexp_count(text, F.lit(r"[\u3400-\u9fff]")).cast("double")
    words = F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+")).cast("double")
    raw = cjk * F.lit(0.7).cast("double") + words * F.lit(1.3).cast("double")
    whole = (raw + F.lit(0.999999).cast("double")).cast("long") if rounding == "parser" else F.ceil(raw)
    return F.greatest(F.lit(1).cast("long"), whole)


def first_sentence(text: Column, limit: int = 280) -> Column:
    """The first sentence that isn't empty, cut to ``limit`` characters; a full stop is added where none ends it."""
    parts = F.filter(F.split(text, wide(r"(?<=[。！？.!?])\s*")), lambda s: s != "")
    cut = F.substring(F.coalesce(F.get(parts, F.lit(0)), text), 1, limit)
    return F.when(cut.rlike(r"[。！？.!?]\z"), cut).otherwise(F.concat(cut, F.lit("。")))


def share_found(terms: Column, low: Column) -> Column:
    """Share of the terms that occur in a text as substrings; 0 without terms."""
    hits = F.size(F.filter(terms, lambda t: F.instr(low, t) > 0))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(0.0)


def lexical_score(query: Column, content: Column) -> Column:
    """Share of the query's distinct terms that occur in the content."""
    return share_found(F.array_distinct(hash_tokens(query)), F.lower(content))


def mask_sensitive(text: Column) -> Column:
    """E-mail addresses, then mobile numbers, then credentials."""
    out = F.regexp_replace(text, wide(EMAIL), "[EMAIL]")
    out = F.regexp_replace(out, MOBILE, "[PHONE]")
    return F.regexp_replace(out, wide(CREDENTIAL), "[CREDENTIAL]")


def redact(text: Column) -> Column:
    """For logs: the values of secrets, of which the names stay, and connection strings."""
    return F.regexp_replace(F.regexp_replace(text, wide(SECRET_VALUE), "$1=[REDACTED]"), wide(CONNECTION), "[REDACTED_CONNECTION]")


def scan_sensitive(text: Column) -> Column:
    """array<struct<kind, value>> of all finds."""
    one = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.concat(one("email", wide(EMAIL)), one("phone", MOBILE), one("credential", wide(CREDENTIAL)))


def safe_filename(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]+', "_"), 1, 180)


def mask_secret(secret: Column) -> Column:
    return F.concat(F.lit("••••"), F.right(secret, F.lit(4)))


def human_size(n: Column) -> Column:
    """Kilobytes below a megabyte, else megabytes, to two places; ties go to the even digit."""
    mib = 1 << 20
    return F.when(n < mib, F.format_string("%.2f KB", F.bround(n / 1024.0, 2))).otherwise(F.format_string("%.2f MB", F.bround(n / float(mib), 2)))


def csv_cell(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)


def citations(answer: Column) -> Column:
    """Distinct ordinals of [n] marks, rising."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))


def clamp(value: Column, low: float, high: float) -> Column:
    """A number within limits; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def locator(loc: Column) -> Column:
    """Page, slide, rows of a sheet, lines, or the document as a whole, whichever a struct (page, slide, sheet, start, end) has first."""
    n = lambda f, other: F.coalesce(loc[f].cast("string"), other)
    return F.coalesce(
        F.concat(F.lit("第 "), loc["page"].cast("string"), F.lit(" 页")), F.concat(F.lit("幻灯片 "), loc["slide"].cast("string")),
        F.concat(loc["sheet"], F.lit(" 第 "), n("start", F.lit("1")), F.lit("-"), n("end", F.lit("?")), F.lit(" 行")),
        F.concat(F.lit("第 "), loc["start"].cast("string"), F.lit("-"), n("end", loc["start"].cast("string")), F.lit(" 行")), F.lit(WHOLE_DOCUMENT),
    )


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case without a default port; null where it is no http(s) URL."""
    scheme, host = F.lower(F.regexp_extract(url, r"^(?i)(https?)://", 1)), F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    port = F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?[^/?#:]+:(\d+)", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.when((scheme == "") | (host == ""), F.lit(None)).when(default, F.concat(scheme, F.lit("://"), host)).otherwise(F.concat(scheme, F.lit("://"), host, F.lit(":"), port))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def stable_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null where it can't be read."""
    return F.to_json(F.try_parse_json(text))
