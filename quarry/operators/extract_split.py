"""Function extraction from files that are split over many tasks (B1-B7 beyond one row a file).

A file is a sequence of chunks of whole lines.  What a chunk does to the walk's state is a small
summary that can be composed, so the state before every chunk follows from a prefix scan over
summaries:

* strings and block comments: a chunk maps each of the four states (in a string, in a comment) to
  the state behind it;
* what is open: for each of the four, the chunk's block tokens, reduced to those that what is
  open before the chunk decides on.  A bracket or a block with its own closing leaves nothing,
  whatever surrounds it; so does ``if .. end``, which is a clause and an index inside brackets.
  What stays are mostly the closings of what was open before, then what is still open.

With the state known, chunks are cut behind lines of code where no function, bracket, string or
comment is open.  No function crosses such a cut, and no doc, as the line before is code.  What
lies between a chunk's first and last cut is extracted where it is; the ends of a chunk meet those
of its neighbours, in groups that are not larger than a function with what surrounds it.
Each part is walked like a whole file, from the stack at its cut, so the rows are those of
``extract_functions``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import split_newlines
from quarry.functions.walk import let, sliced_walk
from quarry.operators.extract import BRACKETS, _after_line, classify_lines, functions_of_lines
from quarry.session import scratch_path, ship_package
from quarry.sources.listing import open_root
from quarry.sources.readers import decode_text

CHUNK_BYTES = 1 << 20
TASK_BYTES, TASK_CHUNKS = 16 << 20, 512   # what a task reads at most
BLOCK = 1024              # chunks whose summaries are folded together
_SUMMARY = "array<struct<state:int,left:string>>"


# ------------------------------------------------------------------ chunks

def read_line_chunks(manifest: DataFrame, root: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``repo_dir, path, chunk, text`` of the files of a manifest, in chunks of whole lines (A4 + A5).

    A task reads the byte range it was dealt: the lines that begin there.  Ranges are cut at LF; a
    file is decoded as UTF-8 if all of its chunks are, else as ISO-8859-1.
    """
    ship_package(manifest.sparkSession)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk_bytes).cast("long"))
    ranges = manifest.select("repo_dir", "path", "length", F.posexplode(starts).alias("chunk", "start"))
    schema = T.StructType([*ranges.schema.fields, T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        for batch in batches:
            for i, (path, length, start) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("path", "length", "start")])):
                with fs.open_input_file(f"{base}/{path}") as file:
                    content = _lines_from(file, start, min(start + chunk_bytes, length), length)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary())], [*batch.schema.names, "content"])

    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-ranges.count() // max(1, min(TASK_CHUNKS, TASK_BYTES // chunk_bytes))))
    target = scratch_path(manifest.sparkSession, "line-chunks")
    ranges.repartition(tasks, "path", "chunk").mapInArrow(run, schema).write.parquet(target)
    read = manifest.sparkSession.read.schema(schema).parquet(target).filter(F.col("content").isNotNull())
    valid = read.groupBy("repo_dir", "path").agg(F.bool_and(F.is_valid_utf8(F.col("content").cast("string"))).alias("utf8"))
    text = F.when(F.col("utf8"), decode_text("content")).otherwise(F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n?", "\n"))
    last = F.col("start") + F.octet_length("content") >= F.col("length")
    # a chunk's last line break is the next chunk's beginning, but for the file's last chunk
    whole = F.when(last | ~text.endswith("\n"), text).otherwise(F.left(text, F.length(text) - 1))
    return read.join(valid, ["repo_dir", "path"]).select("repo_dir", "path", F.col("chunk").cast("long").alias("chunk"), whole.alias("text"))


def _lines_from(file, start: int, end: int, length: int, step: int = 1 << 16) -> bytes | None:
    """The lines that begin in [start, end), with what they have behind it; None without any."""
    if start:  # the byte before tells whether a line begins at start
        file.seek(start - 1)
        begin, at = None, start - 1
        while begin is None and at < end - 1:
            part = file.read(min(step, end - 1 - at))
            found = part.find(b"\n")
            begin, at = (at + found + 1, at) if found >= 0 else (None, at + len(part))
        if begin is None:
            return None
        start = begin
    file.seek(start)
    content = [file.read(end - start)]
    while not content[-1].endswith(b"\n") and sum(map(len, content)) < length - start:
        part = file.read(step)
        found = part.find(b"\n")
        content.append(part if found < 0 else part[:found + 1])
    return b"".join(content)


# --------------------------------------------------------------- summaries

def _symbol(token: Column) -> Column:
    """A block token as one character: brackets, ``)`` any closing bracket, e end, f function, i if or
    for, g begin, b any other block."""
    return (F.when(token.isin(*BRACKETS), token).when(token.isin(*BRACKETS.values()), F.lit(")"))
            .when(token == "end", F.lit("e")).when(token == "function", F.lit("f"))
            .when(token.isin("if", "for"), F.lit("i")).when(token == "begin", F.lit("g")).otherwise(F.lit("b")))


def _reduced(left: Column, s: Column) -> Column:
    """The reduced tokens ``left`` with one more symbol.

    The last symbol decides where it surely is what is open: a bracket, f or b.  i and g may be
    blocks or not; only their ``end`` is certain to leave what was there before.
    """
    top = F.right(left, F.lit(1))
    popped = F.left(left, F.length(left) - 1)
    bracket, block = top.isin(*BRACKETS), top.isin("f", "b")
    push = lambda c: F.concat(left, c)
    return (F.when(s == "", left)
            .when(s.isin(*BRACKETS, "f", "b"), push(s))
            .when(s == ")", F.when(bracket, popped).when(block, left).otherwise(push(s)))
            .when(s == "e", F.when(bracket, left).when(block | top.isin("i", "g"), popped).otherwise(push(s)))
            .when(block, push(F.lit("b")))
            .when(s == "i", F.when(bracket, left).otherwise(push(s)))
            .otherwise(F.when(top == "[", left).when(bracket, push(F.lit("b"))).otherwise(push(s))))


def _applied(stack: Column, s: Column) -> Column:
    """The stack after one symbol."""
    top = F.right(stack, F.lit(1))
    bracket = top.isin(*BRACKETS)
    popped = F.left(stack, F.length(stack) - 1)
    return (F.when(s == "", stack).when(s.isin(*BRACKETS, "f", "b"), F.concat(stack, s))
            .when(s == ")", F.when(bracket, popped).otherwise(stack))
            .when(s == "e", F.when(top.isin("b", "f"), popped).otherwise(stack))
            .when(((s == "i") & bracket) | ((s == "g") & (top == "[")), stack)
            .otherwise(F.concat(stack, F.lit("b"))))


def _lexical(state: Column, c: Column) -> Column:
    """The state (1: in a string, 2: in a comment, 3: both) after a line."""
    in_str, in_cmt = state.bitwiseAND(F.lit(1)) == 1, state.bitwiseAND(F.lit(2)) == 2
    code = state == 0
    string = F.when(c["odd_q"] & (code | in_str), code).otherwise(in_str)
    comment = F.when(code & c["cmt_open"], F.lit(True)).when(in_cmt & c["cmt_close"], F.lit(False)).otherwise(in_cmt)
    return string.cast("int") + comment.cast("int") * 2


def _moves(c: Column) -> Column:
    """Whether a line can change the walk's state."""
    return (F.size(c["tokens"]) > 0) | c["odd_q"] | c["cmt_open"] | c["cmt_close"]


def moving_lines(cls: Column) -> Column:
    """What the cuts are found by, without the texts: the lines (from 1) that can change the state, or are code."""
    numbered = F.transform(cls, lambda c, i: F.struct(
        (i + 1).alias("i"), c["tokens"].alias("tokens"), c["odd_q"].alias("odd_q"), c["cmt_open"].alias("cmt_open"),
        c["cmt_close"].alias("cmt_close"), (~c["blank"] & (c["kind"] == "code")).alias("is_code")))
    return F.filter(numbered, lambda c: _moves(c) | c["is_code"])


def summarize(cls: Column) -> Column:
    """What classified lines do to each of the four states: ``array<struct<state, left>>``."""
    def step(acc: Column, c: Column) -> Column:
        tokens = F.transform(c["tokens"], _symbol)
        left = F.when((acc["state"] == 0) & (F.size(tokens) > 0), F.aggregate(tokens, acc["left"], _reduced)).otherwise(acc["left"])
        return F.struct(_lexical(acc["state"], c).alias("state"), left.alias("left"))

    return let(F.filter(cls, _moves), lambda lines: F.transform(F.array(*map(F.lit, range(4))), lambda s: F.aggregate(
        lines, F.struct(s.alias("state"), F.lit("").alias("left")), step)))


def _composed(first: Column, then: Column) -> Column:
    def joined(a: Column) -> Column:
        b = F.get(then, a["state"])
        return F.struct(b["state"].alias("state"), F.aggregate(F.split(b["left"], ""), a["left"], _reduced).alias("left"))

    return F.transform(first, joined)


def _folded(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """One summary a key from rows (keys, place, summary)."""
    nothing = F.transform(F.array(*map(F.lit, range(4))), lambda s: F.struct(s.alias("state"), F.lit("").alias("left")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(place, "summary"))), lambda x: x["summary"])
    return rows.groupBy(*keys).agg(ordered.alias("all")).select(*keys, F.aggregate("all", nothing.cast(_SUMMARY), _composed).alias("summary"))


def _entries(rows: DataFrame, keys: list[str], place: str, start: DataFrame | None) -> DataFrame:
    """(keys, place, state, stack) before each of the rows (keys, place, summary), from what ``start`` (keys, state,
    stack) says, or from nothing."""
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(place, "summary"))).alias("all"))
    grouped = grouped.withColumns({"state": F.lit(0), "stack": F.lit("")}) if start is None else grouped.join(start, keys)

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        done = F.get(x["summary"], acc["state"])
        after = F.struct(done["state"].alias("state"), F.aggregate(F.split(done["left"], ""), acc["stack"], _applied).alias("stack"))
        return after, F.array(F.struct(x[place].alias(place), acc["state"].alias("state"), acc["stack"].alias("stack")))

    walked = sliced_walk(F.col("all"), F.struct("state", "stack"), step, f"struct<{place}:bigint,state:int,stack:string>", lambda _s, out: out)
    return grouped.select(*keys, F.inline(walked))


def entry_states(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk, state, stack) before every chunk: a prefix scan in blocks of chunks."""
    blocked = summaries.withColumn("block", F.floor(F.col("chunk") / BLOCK))
    by_block = _entries(_folded(blocked, [*keys, "block"], "chunk"), keys, "block", None)
    return _entries(blocked, [*keys, "block"], "chunk", by_block).drop("block")


# -------------------------------------------------------------------- cuts

def _cuts(lines: Column) -> Column:
    """``array<struct<at, stack>>``: the lines (from 1) behind which the file may be cut, and what is open there, from ``moving_lines``."""
    def step(acc: Column, c: Column) -> tuple[Column, Column]:
        code, i = acc["state"] == 0, c["i"]
        after = F.when(code, _after_line(acc["stack"], c["tokens"])).otherwise(acc["stack"])

        def found(x: Column) -> Column:
            state, stack = x["state"], x["stack"]
            cut = code & (state == 0) & c["is_code"] & stack.rlike("^b*$")
            return F.struct(F.struct(state.alias("state"), stack.alias("stack")).alias("next"),
                            F.when(cut, F.array(F.struct(i.alias("at"), stack.alias("stack"))))
                            .otherwise(F.array().cast("array<struct<at:int,stack:string>>")).alias("cut"))

        both = let(F.struct(_lexical(acc["state"], c).alias("state"), after.alias("stack")), found)
        return both["next"], both["cut"]

    return sliced_walk(lines, F.struct(F.col("state").alias("state"), F.col("stack").alias("stack")), step,
                       "struct<at:int,stack:string>", lambda _s, out: out)


def extract_split_functions(chunks: DataFrame, keep_comments: bool = True, keep_constraints: bool = True,
                            text_col: str = "text") -> DataFrame:
    """The rows of ``extract_functions`` of files given as rows (file columns, chunk, text).

    ``chunk`` numbers a file's chunks in order (gaps do no harm).
    """
    spark = chunks.sparkSession
    keys = [c for c in chunks.columns if c not in ("chunk", text_col)]
    lined = chunks.select(*keys, "chunk", split_newlines(F.col(text_col)).alias("_lines"))
    found = let(classify_lines(F.col("_lines")), lambda cls: F.struct(summarize(cls).alias("summary"), moving_lines(cls).alias("moving")))
    summaries = _written(lined.select(*keys, "chunk", F.size("_lines").cast("long").alias("lines"), F.inline(F.array(found))), "chunk-summaries")
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = summaries.select(*keys, "chunk", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    entered = summaries.select(*keys, "chunk", "moving").join(entry_states(summaries, keys), [*keys, "chunk"])
    known = lined.join(entered, [*keys, "chunk"]).join(before, [*keys, "chunk"])

    def pieces(cuts: Column) -> Column:
        first, last = F.get(cuts, F.lit(0)), F.get(cuts, F.size(cuts) - 1)
        piece = lambda kind, at, to, stack: F.struct(  # noqa: E731  (lines at + 1 to ``to``)
            F.lit(kind).alias("kind"), (F.col("before") + at).alias("before"), stack.alias("stack"),
            F.slice("_lines", at + 1, F.greatest(to - at, F.lit(0))).alias("_lines"))
        n = F.size("_lines")
        return F.when(F.size(cuts) == 0, F.array(piece("open", F.lit(0), n, F.col("stack")))).otherwise(F.array(
            piece("head", F.lit(0), first["at"], F.col("stack")), piece("inside", first["at"], last["at"], first["stack"]),
            piece("tail", last["at"], n, last["stack"])))

    parts = _written(known.select(*keys, "chunk", F.inline(let(_cuts(F.col("moving")), pieces))), "chunk-parts")
    has_cut = parts.filter("kind <> 'inside'").groupBy(*keys, "chunk").agg(F.bool_or(F.col("kind") == "tail").alias("cut"))
    begun = has_cut.select(*keys, "chunk", F.coalesce(F.max(F.when(F.col("cut"), F.col("chunk"))).over(earlier), F.lit(-1)).alias("begun"))
    ends = parts.filter("kind <> 'inside'").join(begun, [*keys, "chunk"]) \
        .withColumn("begun", F.when(F.col("kind") == "tail", F.col("chunk")).otherwise(F.col("begun")))
    met = ends.groupBy(*keys, "begun").agg(F.sort_array(F.collect_list(F.struct("before", "chunk", "stack", "_lines"))).alias("p"))
    met = met.select(*keys, F.get("p", F.lit(0))["before"].alias("before"), F.get("p", F.lit(0))["stack"].alias("stack"), F.flatten("p._lines").alias("_lines"))
    inside = parts.filter("kind = 'inside'").select(*keys, "before", "stack", "_lines")
    ship_package(spark)
    return functions_of_lines(inside.unionByName(met), keys, keep_comments, keep_constraints, F.col("stack"), F.col("before"))


def _written(df: DataFrame, name: str) -> DataFrame:
    target = scratch_path(df.sparkSession, name)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def extract_large_files(spark: SparkSession, root: str, manifest: DataFrame, keep_comments: bool = True,
                        keep_constraints: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """B1-B6 of the files of a manifest (``sources.listing.file_manifest``), each by as many tasks as it has chunks."""
    return extract_split_functions(read_line_chunks(manifest, root, chunk_bytes), keep_comments, keep_constraints)
