"""Function extraction from Julia source files.

Extraction is re-aimed from a syntax-tree library to a walk over block
tokens: every line is blanked (strings, comments), its block keywords and
brackets are listed, and one walk over the lines keeps a stack of what is
open, the previous sibling line (for docs) and a header that spans lines.
The walk runs inside the task that read the file and takes time linear in
its lines; the corpus text is never shuffled.

Supported subset (documented in the README):
  * a block opens with its keyword anywhere in a line's code (``x = if``,
    ``return function (y)``, ``map(function (x)``, ``a && try``, ``do``) and
    closes with ``end``; symbols (``:end``) and fields (``x.end``) are names;
  * directly inside brackets, ``for`` and ``if`` are clauses, ``end`` is an
    index, and inside ``[`` so is ``begin``;
  * strings are blanked and trailing comments removed before a line is
    read; triple-quoted strings and ``#= =#`` comments are skipped;
  * docs: a line comment, a string literal (one line or triple-quoted),
    or a macro containing ``@doc`` directly before the header; any other
    macro gives an empty doc, and so does a function inside a line;
  * a header whose parameter list spans lines is joined with its
    continuation lines; the body starts after the closing bracket;
  * a body is the lines between header and ``end``; a function that ends on
    its header line has an empty body;
  * ``@doc "text" function f(x)`` on one line documents ``f`` with that string;
  * ``#= =#`` block comments are neither line comments nor code, in bodies too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import py_strip, split_newlines
from quarry.functions.walk import let, sliced_walk

# A quoted string; possessive, so the regex engine keeps no way back for each character.
QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# The block keywords and the macros treated as constraints.
MACRO_PREFIX = r'^([\w.]*@[\w.!]+\s+(\w*""\s+)?)*'    # on the code part: strings are blanked
OPENERS = ("function|if|for|while|begin|try|let|struct|module|baremodule|macro|quote|do|"
           r"(?:abstract|primitive)\s+type")
BLOCK_TOKENS = rf"[\[\](){{}}]|(?<![\w.:@!])(?:{OPENERS}|end)\b(?![!\w])"
FUNCTION_START = MACRO_PREFIX + r"function\b"
CONSTRAINT_MACROS = ["@debug", "@info", "@variable", "@constraint", "@objective"]
# the same prefix on the raw line, where a macro may take one string argument
MACRO_PREFIX_RAW = rf"^([\w.]*@[\w.!]+\s+(\w*{QUOTED}\s+)?)*"
# "@doc "text" function ..." documents the function on its own line
INLINE_DOC = rf"^@doc\s+(\w*{QUOTED})\s+function\s"

SPLIT_BYTES = 8 << 20     # files from this size on are extracted in chunks, where no limit leaves them out

WHOLE_COMMENT = r"\A#.*\z"
TRIPLE_QUOTE = '"""'
CHAR_LITERAL = r"'(?:[^'\\]|\\.)'"

# What is open, outermost first: a bracket as itself, b a block, f a function.
BRACKETS = {"(": ")", "[": "]", "{": "}"}
_OPENED = "struct<level:int,line:int,token:int,doc:string,header:string,body_start:int,end:int>"


def _count(s: Column, token: str) -> Column:
    """Non-overlapping occurrences of ``token`` in ``s`` (no regex, no array)."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(token), F.lit("")))) / len(token)).cast("int")


def code_part(t: Column) -> Column:
    """A stripped line with string and char literals blanked and the comment removed."""
    blanked = F.regexp_replace(F.regexp_replace(t, QUOTED, '""'), CHAR_LITERAL, "''")
    return F.when(t.rlike(WHOLE_COMMENT), "").otherwise(py_strip(F.regexp_replace(blanked, "#.*$", "")))


def classify_lines(lines: Column) -> Column:
    """Per line: its text, block tokens, and every flag the walks read."""
    def classify(line: Column) -> Column:
        def flags(x: Column) -> Column:
            t, code = x["t"], x["code"]
            macro = F.lit(False)
            for m in CONSTRAINT_MACROS:
                macro = macro | t.startswith(m)
            comment_open = t.startswith("#=") & ~t.contains("=#")
            kind = (F.when(t.startswith("#"), F.lit("comment")).when(t.startswith('"'), F.lit("string"))
                    .when(t.startswith("@"), F.lit("macro")).otherwise(F.lit("code")))
            return F.struct(
                line.alias("line"), t.alias("t"), code.alias("code"),
                F.regexp_extract_all(code, F.lit(BLOCK_TOKENS), F.lit(0)).alias("tokens"),
                code.rlike(FUNCTION_START).alias("starts_function"),
                ((_count(t, TRIPLE_QUOTE) % 2) == 1).alias("odd_q"), (t == "").alias("blank"),
                comment_open.alias("cmt_open"), t.contains("=#").alias("cmt_close"),
                (t.startswith("#") & ~t.startswith("#=")).alias("comment"), macro.alias("constraint"), kind.alias("kind"))

        return let(py_strip(line), lambda t: let(F.struct(t.alias("t"), code_part(t).alias("code")), flags))

    return F.transform(lines, classify)


def _after_token(stack: Column, token: Column) -> Column:
    """The stack after one block token."""
    top = F.right(stack, F.lit(1))
    in_brackets = top.isin(*BRACKETS)
    popped = F.left(stack, F.length(stack) - 1)
    name = (token == "for") | (token == "if")
    return (F.when(token.isin(*BRACKETS), F.concat(stack, token))
            .when(token.isin(*BRACKETS.values()), F.when(in_brackets, popped).otherwise(stack))
            .when(token == "end", F.when(top.isin("b", "f"), popped).otherwise(stack))
            .when((name & in_brackets) | ((token == "begin") & (top == "[")), stack)
            .otherwise(F.concat(stack, F.when(token == "function", F.lit("f")).otherwise(F.lit("b")))))


def _after_line(stack: Column, tokens: Column) -> Column:
    return F.when(F.size(tokens) == 0, stack).otherwise(F.aggregate(tokens, stack, _after_token))


def _blocks(stack: Column) -> Column:
    """How many blocks (not brackets) are open."""
    return F.length(F.translate(stack, "([{", ""))


def _parameters(rest: Column) -> Column:
    """The parameter list at the first bracket of ``rest``: up to the bracket that closes it, or to
    the end where none does.  Brackets in strings do not count."""
    def step(acc: Column, c: Column) -> Column:
        code = ~acc["quoted"]
        depth = acc["depth"] + F.when(code & (c == "("), 1).when(code & (c == ")"), -1).otherwise(0)
        return F.struct((acc["i"] + 1).alias("i"), depth.alias("depth"),
                        F.when(c == '"', code).otherwise(acc["quoted"]).alias("quoted"),
                        F.when(acc["end"].isNull() & code & (c == ")") & (depth == 0), acc["i"] + 1).otherwise(acc["end"]).alias("end"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(None).cast("int").alias("end"))
    def cut(open_part: Column) -> Column:
        end = F.aggregate(F.split(open_part, ""), start, step)["end"]
        return let(end, lambda e: F.when(e.isNull(), F.rtrim(open_part)).otherwise(F.left(open_part, e)))

    at = F.instr(rest, "(")
    return F.when(at > 0, let(F.substring(rest, at, 1 << 30), cut)).otherwise(F.lit(""))


def function_header(t: Column) -> Column:
    """B3: "function " + name + parameter list of a line that starts with a function.

    With unclosed brackets the list runs to the end of the line (the
    continuation lines are appended by the walk).
    """
    return let(F.regexp_replace(t, MACRO_PREFIX_RAW + r"function\b", ""), _header_of)


def _header_of(rest: Column) -> Column:
    """The header from what follows the keyword."""
    return F.concat(F.lit("function "), py_strip(F.substring_index(rest, "(", 1)), _parameters(rest))


def _inner_header(c: Column, number: Column) -> Column:
    """The header of the ``number``-th function keyword of a line (1-based), inside the line.

    Taken from the raw line where the keyword occurs in it once, else from the blanked code.
    """
    word = r"(?<![\w.:@!])function\b"
    raw, code = F.split(c["t"], word), F.split(c["code"], word)
    return let(F.when(F.size(raw) == 2, raw[1]).otherwise(F.array_join(F.slice(code, number + 1, F.size(code)), "function")), _header_of)


def _line_events(c: Column, line: Column, before: Column, doc: Column) -> Column:
    """Functions that open (end null) or close (header null) on a line, from its tokens in order."""
    def step(acc: Column, token: Column) -> Column:
        after = _after_token(acc["stack"], token)
        opens = token == "function"
        closes = (token == "end") & (F.right(acc["stack"], F.lit(1)) == "f")
        number = acc["number"] + opens.cast("int")
        first = c["starts_function"] & (number == 1)
        event = F.struct(
            _blocks(F.when(closes, after).otherwise(acc["stack"])).alias("level"), line.alias("line"), acc["k"].alias("token"),
            F.when(opens, F.when(first, doc).otherwise(F.lit(""))).alias("doc"),
            F.when(opens, F.when(first, function_header(c["t"])).otherwise(_inner_header(c, number))).alias("header"),
            F.when(opens, line + 1).alias("body_start"), F.when(closes, line).alias("end"))
        return F.struct(after.alias("stack"), (acc["k"] + 1).alias("k"), number.alias("number"),
                        F.when(opens | closes, F.concat(acc["events"], F.array(event))).otherwise(acc["events"]).alias("events"))

    start = F.struct(before.alias("stack"), F.lit(0).alias("k"), F.lit(0).alias("number"), F.array().cast(f"array<{_OPENED}>").alias("events"))
    return F.aggregate(c["tokens"], start, step, lambda acc: acc["events"])


def find_functions(cls: Column, stack: Column | None = None) -> Column:
    """B1 + B2 + B3: ``array<struct<hdr,end,level,doc,header,body_start>>`` for one file.

    ``cls`` is ``classify_lines(lines)``; ``stack`` holds what is open before the first
    line (nothing, unless the lines are a part of a file).  ``hdr``/``end``/``body_start``
    are 1-based line numbers; ``level`` is the number of blocks open
    around the header.  The walk emits an event where a function opens and
    one where it closes; in the order of (level, place) each opening is
    followed by its own closing, so no function is kept in the state.
    """
    nothing = F.array().cast(f"array<{_OPENED}>")
    no_event = F.lit(None).cast(_OPENED)
    init = F.struct(
        F.lit(0).alias("i"), (F.lit("") if stack is None else stack).alias("stack"),
        F.lit(False).alias("in_str"), F.lit(False).alias("in_cmt"),
        F.lit(0).alias("str_start"), F.lit("").alias("str_kind"),
        F.lit("none").alias("prev_kind"), F.lit("").alias("prev_text"),
        no_event.alias("pending"), F.lit(0).alias("height"))

    def step(acc, c):
        i = acc["i"] + 1
        in_str, in_cmt = acc["in_str"], acc["in_cmt"]
        code = ~in_str & ~in_cmt
        before = acc["stack"]
        after = F.when(code, _after_line(before, c["tokens"])).otherwise(before)
        inline_doc = F.regexp_extract(c["t"], INLINE_DOC, 1)
        doc = F.when(inline_doc != "", inline_doc).otherwise(
            F.when(acc["prev_kind"].isin("comment", "string"), acc["prev_text"])
            .when((acc["prev_kind"] == "macro") & acc["prev_text"].contains("@doc"), acc["prev_text"])
            .otherwise(F.lit("")))
        has_function = code & (F.exists(c["tokens"], lambda x: x == "function") | ((F.size(c["tokens"]) > 0) & before.contains("f")))
        events = F.when(has_function, _line_events(c, i, before, doc)).otherwise(nothing)

        def go_on(x):
            after, events = x["after"], x["events"]
            # a header whose first bracket is still open at the end of its line waits for the rest
            last = F.try_element_at(events, F.lit(-1))
            at = F.length(after) - F.length(F.regexp_extract(after, r"f\([^bf]*$", 0))  # place of that f
            waits = acc["pending"].isNull() & last["end"].isNull() & after.rlike(r"f\([^bf]*$") & (_blocks(F.left(after, at)) == last["level"])
            continued = acc["pending"].isNotNull() & code
            done = continued & (F.length(after) <= acc["height"])
            piece = F.when(done, F.regexp_extract(F.rtrim(c["line"]), r"^(.*\))", 1)).otherwise(F.rtrim(c["line"]))
            grown = acc["pending"].withField("header", F.concat(acc["pending"]["header"], F.lit("\n"), piece)) \
                .withField("body_start", i + 1)
            pending = F.when(waits, last).when(done, no_event).when(continued, grown).otherwise(acc["pending"])
            out = F.concat(F.when(done, F.array(grown)).otherwise(nothing),
                           F.when(waits, F.slice(events, F.lit(1), F.size(events) - 1)).otherwise(events))

            # strings and block comments spanning lines
            str_opens, str_closes = code & c["odd_q"], in_str & c["odd_q"]
            cmt_opens, cmt_closes = code & c["cmt_open"], in_cmt & c["cmt_close"]
            str_start = F.when(str_opens, i).otherwise(acc["str_start"])
            joined = py_strip(F.array_join(F.transform(
                F.slice(cls, acc["str_start"], i - acc["str_start"] + 1), lambda x: x["line"]), "\n"))
            keep_prev = c["blank"] & code
            inside = F.right(before, F.lit(1)).isin(*BRACKETS)
            prev_kind = (F.when(keep_prev, acc["prev_kind"])
                         .when(str_closes, acc["str_kind"])
                         .when(in_str | in_cmt | cmt_opens | str_opens, F.lit("other"))
                         .when((after != before) | (F.size(events) > 0) | continued | inside, F.lit("code"))
                         .otherwise(c["kind"]))
            prev_text = F.when(keep_prev, acc["prev_text"]).when(str_closes, joined).otherwise(c["t"])
            state = F.struct(
                i.alias("i"), after.alias("stack"),
                F.when(str_opens, F.lit(True)).when(str_closes, F.lit(False)).otherwise(in_str).alias("in_str"),
                F.when(cmt_opens, F.lit(True)).when(cmt_closes, F.lit(False)).otherwise(in_cmt).alias("in_cmt"),
                str_start.alias("str_start"), F.when(str_opens, c["kind"]).otherwise(acc["str_kind"]).alias("str_kind"),
                prev_kind.alias("prev_kind"), prev_text.alias("prev_text"), pending.alias("pending"),
                F.when(waits, at + 1).otherwise(acc["height"]).alias("height"))
            return F.struct(state.alias("state"), out.alias("out"))

        both = let(F.struct(after.alias("after"), events.alias("events")), go_on)
        return both["state"], both["out"]

    def pair(events):
        """Openings with the closing that follows them in the order of (level, line, token)."""
        def found(ordered):
            matched = F.transform(ordered, lambda e, j: F.struct(
                e["line"].alias("hdr"), F.get(ordered, j + 1)["end"].alias("end"), e["level"].alias("level"), e["doc"].alias("doc"),
                e["header"].alias("header"), e["body_start"].alias("body_start"),
                (F.get(ordered, j + 1)["level"] == e["level"]).alias("same")))
            return F.filter(matched, lambda f: f["header"].isNotNull() & f["end"].isNotNull() & f["same"])

        return let(F.sort_array(events), found)

    return sliced_walk(cls, init, step, _OPENED, lambda _state, events: pair(events))


def body_parts(body: Column, keep_comments: bool, keep_constraints: bool) -> Column:
    """B4 + B5 + B6: strip top-level comments / constraint macros; set both flags.

    ``body`` is the slice of ``classify_lines`` between header and ``end``.
    Returns ``struct<body:string, has_internal_comments:boolean, has_constraints:boolean>``.
    A line is top level when no block or bracket of the body is open.  A
    dropped macro that opens blocks or brackets is dropped through its end.
    """
    init = F.struct(F.lit("").alias("stack"), F.lit(False).alias("in_str"), F.lit(False).alias("in_cmt"),
                    F.lit(False).alias("dropping"), F.lit(False).alias("hc"), F.lit(False).alias("hk"))

    def step(acc, c):
        in_str, in_cmt = acc["in_str"], acc["in_cmt"]
        code = ~in_str & ~in_cmt
        cmt_opens = code & c["cmt_open"]
        top = code & (acc["stack"] == "")
        is_comment = top & c["comment"] & ~cmt_opens
        is_macro = top & c["constraint"]
        drops = acc["dropping"] | (is_macro & F.lit(not keep_constraints))
        keep = ~((is_comment & F.lit(not keep_comments)) | drops)
        stack = F.when(code & ~cmt_opens, _after_line(acc["stack"], c["tokens"])).otherwise(acc["stack"])
        state = let(stack, lambda after: F.struct(
            after.alias("stack"),
            F.when(~in_cmt & c["odd_q"], ~in_str).otherwise(in_str).alias("in_str"),
            F.when(cmt_opens, F.lit(True)).when(in_cmt & c["cmt_close"], F.lit(False))
            .otherwise(in_cmt).alias("in_cmt"),
            (drops & (after != "")).alias("dropping"),
            (acc["hc"] | is_comment).alias("hc"), (acc["hk"] | is_macro).alias("hk")))
        return state, F.when(keep, F.array(c["line"])).otherwise(F.array().cast("array<string>"))

    return sliced_walk(body, init, step, "string", lambda acc, out: F.struct(
        F.array_join(out, "\n").alias("body"),
        acc["hc"].alias("has_internal_comments"), acc["hk"].alias("has_constraints")))


def extract_functions(files: DataFrame, text_col: str = "text",
                      keep_comments: bool = True, keep_constraints: bool = True) -> DataFrame:
    """One row per ``function ... end`` block, nested ones included.

    Output: the file's other columns plus ``line``, ``end_line``, ``level``,
    ``doc_string``, ``function_header``, ``function_body``,
    ``has_internal_comments``, ``has_constraints``.
    """
    keys = [c for c in files.columns if c != text_col]
    return functions_of_lines(files.select(*keys, split_newlines(F.col(text_col)).alias("_lines")), keys, keep_comments, keep_constraints)


def functions_of_lines(parts: DataFrame, keys: list[str], keep_comments: bool, keep_constraints: bool,
                       stack: Column | None = None, before: Column | None = None) -> DataFrame:
    """:func:`extract_functions` of ``parts`` with ``keys`` and the array ``_lines``: whole files, or
    parts of files with the ``stack`` of what is open and the number of lines ``before`` them."""
    more = {} if stack is None else {"_stack": stack, "_before": before.cast("int")}
    per_file = parts.select(*keys, classify_lines(F.col("_lines")).alias("_cls"), *[c.alias(n) for n, c in more.items()])
    shift = (lambda n: n) if stack is None else (lambda n: n + F.col("_before"))
    with_fns = per_file.select(*keys, F.transform(find_functions(F.col("_cls"), F.col("_stack") if more else None), lambda f: F.struct(
        shift(f["hdr"]).alias("line"), shift(f["end"]).alias("end_line"), f["level"].alias("level"),
        f["doc"].alias("doc_string"), f["header"].alias("function_header"),
        body_parts(F.slice(F.col("_cls"), f["body_start"],
                           F.greatest(f["end"] - f["body_start"], F.lit(0))),
                   keep_comments, keep_constraints).alias("parts"))).alias("_fns"))
    # inline_outer: a plain inline makes the optimizer infer a size(_fns) > 0
    # filter below this projection, evaluating the whole walk a second time
    rows = with_fns.select(*keys, F.inline_outer("_fns")).where(F.col("line").isNotNull())
    return rows.select(*keys, "line", "end_line", "level", "doc_string", "function_header",
                       F.col("parts.body").alias("function_body"),
                       F.col("parts.has_internal_comments").alias("has_internal_comments"),
                       F.col("parts.has_constraints").alias("has_constraints"))


FUNCTION_RECORD = ["doc_string", "function_header", "function_body", "has_internal_comments",
                   "has_constraints"]


def extract_corpus(files: DataFrame, keep_comments: bool = True, keep_constraints: bool = True,
                   text_col: str = "text") -> DataFrame:
    """Function records of all files in one table (``repo``/``path`` kept)."""
    return extract_functions(files, text_col, keep_comments, keep_constraints)


def extract_corpus_from_tree(spark, root: str, repo_list_path: str, deny: DataFrame | None = None,
                             keep_comments: bool = True, keep_constraints: bool = True,
                             suffix: str = ".jl", limit: int | None = 1024 * 1024) -> DataFrame:
    """B7 end to end: A1 repo list -> A3 exclusion -> A4 files -> A5 text -> B1-B6.

    Tasks list the folders of the repositories and read the files below ``limit``; extraction is
    map-only.  Without a limit, files from SPLIT_BYTES on are extracted in chunks by many tasks.
    """
    from quarry.operators.repos import exclude_repos
    from quarry.sources.readers import read_source_texts, repo_dir_name, repo_list

    repos = exclude_repos(repo_list(spark, repo_list_path), deny)
    texts = read_source_texts(spark, root, repos, suffix=suffix, limit=SPLIT_BYTES if limit is None else limit)
    functions = extract_functions(texts, "text", keep_comments, keep_constraints)
    if limit is not None:
        return functions
    from quarry.operators.extract_split import extract_large_files
    from quarry.sources.listing import file_manifest
    large = file_manifest(spark, root, repos.select(repo_dir_name("name")), suffix).filter(F.col("length") >= SPLIT_BYTES)
    return functions.unionByName(extract_large_files(spark, root, large, keep_comments, keep_constraints))
