"""Completion repair and formatting as per-row Spark expressions.

Each rule walks the lines of one text with a small state (block depth,
function/end counters).  The walk is a higher-order ``aggregate`` over
slices of the line array (see ``walk.py``), so it runs inside the task
that read the row: no explode, no shuffle, and time linear in the lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import WS_CLASS, col_, py_strip, split_newlines, splitlines
from quarry.functions.walk import sliced_walk

# Keyword lists of the block rules.
# clean_output: a line opens a function / closes a block when it matches
FUNCTION_LINE = "^" + WS_CLASS + "*function\\b"
END_LINE = "^" + WS_CLASS + "*end\\b"
# format_code: inline one-line blocks, and the keywords that move indentation
INLINE_KEYWORDS = ["if", "for", "while", "function", "try", "let", "struct"]
INCREASE_KEYWORDS = ["function", "if", "for", "while", "begin", "try", "let", "struct",
                     "mutable struct"]
DECREASE_KEYWORDS = ["end", "else", "elseif", "catch", "finally"]
INDENT_SIZE = 4
# fix_block_ends: prefixes counted as block openers
FIX_OPENERS = ["if", "for", "while"]

INLINE_BLOCK = "\\b(" + "|".join(INLINE_KEYWORDS) + ")\\b.*\\bend\\b"
INCREASE_PREFIX = "^(" + "|".join(INCREASE_KEYWORDS) + ")"
DECREASE_PREFIX = "^(" + "|".join(DECREASE_KEYWORDS) + ")"

# Spacing rewrites applied to the whole formatted text, in this order:
# operators, commas, open and close parentheses.  Each pattern is
# "whitespace* X whitespace*"; see _linear() for how it is run.
SPACING_RULES = [
    ("([=+\\-*/<>|&!])", " $1 "),
    (",", ", "),
    ("\\(", "("),
    ("\\)", ")"),
]


def _linear(core: str) -> str:
    """``ws* core ws*`` in a form Java's regex engine runs in linear time.

    A leftmost match of ``ws* core ws*`` starts either where the previous
    match ended (``\\G``) or at a character not preceded by whitespace, so
    restricting starts to those positions changes no match; the possessive
    ``*+`` never gives back whitespace, which ``core`` cannot match anyway.
    Without this, each start inside a long indentation run rescans the run.
    """
    return "(?:\\G|(?<!" + WS_CLASS + "))" + WS_CLASS + "*+" + core + WS_CLASS + "*+"


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def _starts_with_any(s: Column, prefixes) -> Column:
    cond = None
    for p in prefixes:
        c = s.startswith(p)
        cond = c if cond is None else (cond | c)
    return cond


def clean_output(text) -> Column:
    """Keep lines up to the first one where the counts of lines opening
    with ``function`` and with ``end`` are equal and positive; then strip."""
    lines = splitlines(text)
    # each regex runs once per line; the walk below only adds flags
    flags = F.transform(lines, lambda l: F.struct(
        l.rlike(FUNCTION_LINE).cast("int").alias("f"), l.rlike(END_LINE).cast("int").alias("e")))
    init = F.struct(F.lit(0).alias("f"), F.lit(0).alias("e"), F.lit(0).alias("i"),
                    F.lit(None).cast("int").alias("cut"))

    def step(acc, x):
        f, e, i = acc["f"] + x["f"], acc["e"] + x["e"], acc["i"] + 1
        cut = F.when(acc["cut"].isNull() & (f == e) & (f > 0), i).otherwise(acc["cut"])
        return F.struct(f.alias("f"), e.alias("e"), i.alias("i"), cut.alias("cut"))

    cut = F.aggregate(flags, init, step)["cut"]
    kept = F.slice(lines, 1, F.coalesce(cut, F.size(lines)))
    return py_strip(F.array_join(kept, "\n"))


def fix_block_ends(text) -> Column:
    """Drop ``end`` lines that close nothing; append one ``end`` per
    ``if``/``for``/``while`` block left open."""
    lines = split_newlines(text)
    stripped = F.transform(lines, lambda l: F.struct(l.alias("line"), py_strip(l).alias("s")))
    marked = F.transform(stripped, lambda x: F.struct(
        x["line"].alias("line"),
        _starts_with_any(x["s"], FIX_OPENERS).alias("opener"),
        (x["s"] == "end").alias("is_end")))
    def step(acc, x):
        d = (F.when(x["opener"], acc["d"] + 1)
             .when(x["is_end"] & (acc["d"] > 0), acc["d"] - 1)
             .otherwise(acc["d"]))
        keep = ~x["is_end"] | (acc["d"] > 0)
        return F.struct(d.alias("d")), F.when(keep, F.array(x["line"])).otherwise(_empty_strings())

    def finish(acc, out):
        return F.array_join(F.concat(out, F.array_repeat(F.lit("end"), acc["d"])), "\n")

    return sliced_walk(marked, F.struct(F.lit(0).alias("d")), step, "string", finish)


def close_first_completion(completions) -> Column:
    """Completion 0 becomes ``fix_block_ends(c) + "\\nend"``; others unchanged."""
    return F.transform(
        col_(completions),
        lambda x, i: F.when(i == 0, F.concat(fix_block_ends(x), F.lit("\nend"))).otherwise(x))


def format_code(text) -> Column:
    """E5: re-indent by block keywords, close open blocks, fix spacing.

    Stack depth and indent level move together in the rule, so one
    clamped counter ``d`` is the whole state.
    """
    lines = splitlines(text)
    stripped = F.transform(lines, py_strip)
    marked = F.transform(stripped, lambda s: F.struct(
        s.alias("s"), (s == "").alias("empty"), s.rlike(INLINE_BLOCK).alias("inline"),
        s.rlike(DECREASE_PREFIX).alias("dec"), s.rlike(INCREASE_PREFIX).alias("inc")))
    def step(acc, x):
        same = x["empty"] | x["inline"]
        d_before = F.when(same, acc["d"]).when(x["dec"], F.greatest(acc["d"] - 1, F.lit(0))) \
            .otherwise(acc["d"])
        rendered = F.when(x["empty"], F.lit("")).otherwise(
            F.concat(F.repeat(F.lit(" "), d_before * INDENT_SIZE), x["s"]))
        d = F.when(same, acc["d"]).otherwise(d_before + x["inc"].cast("int"))
        return F.struct(d.alias("d")), F.array(rendered)

    def finish(acc, out):
        d = acc["d"]
        closing = F.transform(
            F.array_repeat(F.lit(0), d),
            lambda _x, i: F.concat(F.repeat(F.lit(" "), (d - 1 - i) * INDENT_SIZE), F.lit("end")))
        return F.array_join(F.concat(out, closing), "\n")

    out = sliced_walk(marked, F.struct(F.lit(0).alias("d")), step, "string", finish)
    for core, replacement in SPACING_RULES:
        out = F.regexp_replace(out, _linear(core), replacement)
    return out


def postprocess_prediction(text, original_output=False) -> Column:
    """Clean then format, unless the original output is requested."""
    if isinstance(original_output, bool):
        return col_(text) if original_output else format_code(clean_output(text))
    return F.when(col_(original_output), col_(text)).otherwise(format_code(clean_output(text)))


def drop_log_lines(text) -> Column:
    """Drop lines that start with ``#`` (generator log lines)."""
    return F.array_join(F.filter(split_newlines(text), lambda l: ~l.startswith("#")), "\n")


def to_markdown(text, language: str = "julia") -> Column:
    """Wrap a reply in a fenced code block."""
    return F.concat(F.lit("```" + language + "\n"), col_(text), F.lit("\n```"))
