"""Column functions on text.  Patterns use (?U), so that blanks and digits are Unicode's."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
H1 = r"(?U)^\s*第\s*[一二三四五六七八九十百千零0-9]+\s*[章节節条].*"
H2 = r"(?U)^\s*[一二三四五六七八九十]+\s*[、.\s].{0,40}$"
H3 = r"(?U)^\s*\d+(\.\d+)*\s+\S.{0,40}$"
CHAPTER_LENGTH = 60
NOT_VALID = r'[^\p{L}\p{N}，。、；："（）《》【】—…· \t\n]'
HIGHLIGHT = '<span style="background:#ffd;padding:1px 4px;border-radius:3px"><b>{}</b></span>'

_BLANK = r"[\s\x1c-\x1f]"
# The same characters, one by one.
_SPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_BREAK = r"\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(_SPACE))


def first_line(c: Column) -> Column:
    """The first line that is not blank, stripped; empty if there is none."""
    return strip(F.regexp_extract(c, rf"(?U)^{_BLANK}*([^{_BREAK}]*)", 1))


def detect_chapter(c: Column) -> Column:
    """The first line that is not blank, cut to 60 characters, if it is a heading; else null."""
    line = first_line(c)
    may = c.rlike(rf"(?U)^{_BLANK}*+[第一二三四五六七八九十\d]")  # headings begin with nothing else
    return F.when(may & line.rlike(f"{H1}|{H2}|{H3}"), F.substring(line, 1, CHAPTER_LENGTH))


def is_garbled(c: Column) -> Column:
    """Whether under a quarter of at least 20 characters are letters, digits or common marks."""
    valid = F.length(F.regexp_replace(c, NOT_VALID, ""))
    return F.coalesce((F.length(strip(c)) >= 20) & (valid / F.length(c) < 0.25), F.lit(False))


def count_of(c: Column, word: str) -> Column:
    """Occurrences of a word, from left to right, not overlapping."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("long")


def score(c: Column, words: list[str]) -> Column:
    """Occurrences of all words; a word inside another counts for both."""
    out = F.lit(0).cast("long")
    for w in words:
        out = out + count_of(c, w)
    return out


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _quote(word: str) -> str:
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def highlight(c: Column, words: list[str]) -> Column:
    """Marks words one after another, also where they stand in ``**``; later words may hit earlier marks."""
    for w in words:
        mark = HIGHLIGHT.format(w)
        c = F.replace(c, F.lit(f"**{w}**"), F.lit(mark))
        c = F.regexp_replace(c, f"(?<!<b>){_quote(w)}(?!</b></span>)", mark.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def highlight_safe(c: Column, words: list[str]) -> Column:
    """Marks all words in one pass, longest first, on text whose HTML is escaped."""
    for found, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(found), F.lit(put))
    if not words:
        return c
    every = "|".join(_quote(html.escape(w, quote=False)) for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(c, rf"(?:\*\*)?({every})(?:\*\*)?", HIGHLIGHT.format("$1"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
