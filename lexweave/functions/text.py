"""Column functions on text, all JVM-side.

Blank means Unicode white space as Python's str.strip() sees it; it is spelled out so that other engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, numerals of article labels, and heading patterns of statutes.
WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANKS = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NUM = "[一二三四五六七八九十百千零〇0-9]+"
PART, CHAPTER, SECTION = (f"^第{NUM}{c}" for c in "编章节")
ARTICLE = f"第{NUM}[{WS}]*条"
ARTICLE_LINE = f"^{ARTICLE}[{WS}]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+\\z", "")


def unix_lines(c: Column) -> Column:
    """CRLF to LF; a lone CR is no line break."""
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def body_start(c: Column) -> Column:
    """The text from its first part heading, else from its first article, that follows a line break."""
    part, art = f"\\n(第{NUM}编.*)\\z", f"\\n({ARTICLE}.*)\\z"
    return F.coalesce(F.when(F.regexp_like(c, F.lit(f"\\n第{NUM}编")), F.regexp_extract(c, f"(?s){part}", 1)), F.when(F.regexp_like(c, F.lit(f"\\n{ARTICLE}")), F.regexp_extract(c, f"(?s){art}", 1)), c)


def lines(c: Column) -> Column:
    """Stripped lines that are not blank, as an array."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def is_noise(line: Column, titles: tuple[str, ...]) -> Column:
    out = line.rlike(f"^目[{WS}]*录[{WS}]*\\z") | line.rlike("^（[^\\n]*?）\\z")
    for t in titles:
        out = out | line.rlike(f"^\\Q{t}\\E[{WS}]*\\z")
    return out


def line_kind(line: Column) -> Column:
    """p, c, s, a or t: part, chapter or section heading (by prefix), article line, other text."""
    return F.when(line.rlike(PART), "p").when(line.rlike(CHAPTER), "c").when(line.rlike(SECTION), "s").when(line.rlike(ARTICLE_LINE), "a").otherwise("t")


def break_articles(c: Column) -> Column:
    """A line break before every article label that a blank follows, unless one is there."""
    return F.regexp_replace(c, f"(?<!\\n)({ARTICLE})(?=[{WS}])", "\n$1")


def all_matches(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), strip)


def last_match(c: Column, pattern: str) -> Column:
    return F.try_element_at(all_matches(c, pattern), F.lit(-1))


def heading_lines(kind: str) -> str:
    """A heading in a longer text; a bare one also takes the line after it."""
    return f"(?m)^第{NUM}{kind}[{WS}]*[^\\n]*$"


def char_tokens(c: Column) -> Column:
    """One token per character that is not blank."""
    solid = F.regexp_replace(c, f"[{WS}]+", "")
    return F.when(solid == "", F.array().cast("array<string>")).otherwise(F.split(solid, ""))


def md5_hex(c: Column) -> Column:
    return F.md5(F.encode(c, "UTF-8"))


def message_tokens(content: Column) -> Column:
    """Estimate of a message's tokens: half its characters, 1 at least, plus 6."""
    return F.greatest(F.floor(F.length(F.coalesce(content, F.lit(""))) / 2), F.lit(1)) + 6


def is_summary(kind: Column, content: Column, tag: str) -> Column:
    return F.coalesce((kind == "system") & F.startswith(content, F.lit(tag)), F.lit(False))


def without_tag(content: Column, tag: str) -> Column:
    return strip(F.substring(content, F.lit(len(tag) + 1), F.length(content)))


def canonical_type(kind: Column) -> Column:
    return F.when(kind == "user", "human").when(kind == "assistant", "ai").otherwise(kind)


def role_label(kind: Column) -> Column:
    return F.when(kind == "human", "用户").when(kind == "ai", "助手").otherwise("系统")


def ui_role(kind: Column) -> Column:
    return F.when(kind == "human", "user").otherwise("assistant")


def new_session_id() -> Column:
    return F.concat(F.lit("chat_"), F.left(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), F.lit(12)))


VALID_SESSION_ID = "^chat_[0-9a-f]{12}$"
