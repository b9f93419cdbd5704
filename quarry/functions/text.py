"""Text rules as Spark column expressions.

Python's ``str.strip``/``str.splitlines`` and its Unicode ``\\s`` are the
semantics the corpus rules were written against; Spark's ``trim`` only
removes U+0020 and Java's ``\\s`` is ASCII, so the character sets are
built here from the same rule Python uses (``str.isspace``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point Python treats as whitespace (str.isspace); this is the
# set str.strip() removes and the set re's Unicode \s matches.
PY_WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())

# Line boundaries of str.splitlines ("\r\n" is handled as one boundary).
SPLITLINES_CHARS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def _class(chars: str) -> str:
    """A regex character class using \\x{..} escapes (Java and RE2 agree)."""
    return "[" + "".join("\\x{%x}" % ord(c) for c in chars) + "]"


# Regex fragments shared with the DuckDB oracles.
WS_CLASS = _class(PY_WHITESPACE)
SPLITLINES_PATTERN = "\\r\\n|" + _class(SPLITLINES_CHARS)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: both ends, full Unicode whitespace set."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def split_newlines(c) -> Column:
    """Python ``s.split("\\n")``: keeps empty pieces, "" -> [""]."""
    return F.split(col_(c), "\n", -1)


def splitlines(c) -> Column:
    """Python ``s.splitlines()``: all line boundaries, no trailing empty piece."""
    parts = F.split(col_(c), SPLITLINES_PATTERN, -1)
    ends_with_break = col_(c).rlike("(" + SPLITLINES_PATTERN + ")$") | (F.length(col_(c)) == 0)
    return F.when(ends_with_break, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def last_segment(c, sep: str) -> Column:
    """``s.split(sep)[-1]`` (whole string when sep is absent)."""
    return F.substring_index(col_(c), sep, -1)


def first_segment(c, sep: str) -> Column:
    """``s.split(sep)[0]``."""
    return F.substring_index(col_(c), sep, 1)


def function_name(header) -> Column:
    """Name rule: text after the last "function ", up to the first "(".

    Applied to prompts' header lines and to function headers alike.
    """
    return first_segment(last_segment(header, "function "), "(")


def has_ascii_letter(c) -> Column:
    return col_(c).rlike("[a-zA-Z]")
