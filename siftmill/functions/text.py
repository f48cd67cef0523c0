"""Text expressions: all native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and limits that decide results (fixed values).
PAGE_MARKER = r"(?i)^\s*(?:page\s*\d+(?:\s*of\s*\d+)?|\d+\s*/\s*\d+|\d+\s+of\s+\d+|\d{1,4})\s*$"
HEADING = r"^(#{1,6})\s+(.+)$"
LIST_HEAD = r"^(?:\d{1,3}[.)]\s+|\*|-|•\s)"


def strip(text: Column) -> Column:
    """Without white space at either end, all kinds of it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normal_space(text: Column) -> Column:
    """Words with single spaces between them."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_html(text: Column) -> Column:
    """Script and style blocks, then tags, as a space each; text without both < and > stays."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style).*?</\1>", " "), r"(?is)<[^>]+>", " ")
    return F.when(F.contains(text, F.lit("<")) & F.contains(text, F.lit(">")), bare).otherwise(text)


def normal_text(text: Column, kind: Column | None = None) -> Column:
    """Without byte order marks at its head, HTML only for the kinds html and htm, line ends as \\n."""
    clean = F.regexp_replace(text, "^﻿+", "")
    if kind is not None:
        clean = F.when(F.lower(kind).isin("html", "htm"), strip_html(clean)).otherwise(clean)
    return F.regexp_replace(clean, r"\r\n?", "\n")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), 1))


def paragraph_count(text: Column) -> Column:
    """Blocks with anything in them, between blank lines."""
    return F.size(F.filter(F.split(text, r"(?U)\n\s*\n"), lambda b: strip(b) != ""))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for none."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4.0)


def is_plain_heading(line: Column) -> Column:
    """A stripped line that looks like a heading: 2 to 90 characters, no long sentence, and a list mark
    or at least four fifths of its letters upper case."""
    letters = F.length(F.regexp_replace(line, r"\P{L}", ""))
    upper = F.length(F.regexp_replace(line, r"\P{Lu}", ""))
    sentence = line.endswith(".") & (word_count(line) > 6)
    return F.length(line).between(2, 90) & ~sentence & (line.rlike(LIST_HEAD) | ((letters > 0) & (upper >= 0.8 * letters)))


def outside_quotes(line: Column, mark: str) -> Column:
    """How many of a delimiter stand outside double quotes; a quote that isn't closed hides the rest."""
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*(?:"|$)', "")
    return F.length(bare) - F.length(F.translate(bare, mark, ""))


def clip(text: Column, most: int) -> Column:
    """The first characters, with an ellipsis if there were more."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)
