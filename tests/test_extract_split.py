"""Extraction from files in chunks of a few lines, against the walk over whole files."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import extract as ex
from quarry.operators import extract_split as sp
from quarry.sources import listing

from test_extract_random import Program

KINDS = ["if a", "for i in x", "while b", "begin", "end", "end", "end", "function f(x)", "function g(", "  y)", "x = [1,", "]", "(", ")", "foo(a) do z",
         "let q", '"""', '"a doc"', "# comment", "#= open", "close =#", "@doc x", "@info begin", "", "x = 1", "s = \"# not ( a comment\"",
         "a[end]", "[i for i in x]", "module M", "struct S", "return function (w)", "map(function (z)", "end, xs)", "quote", "f(x) = begin", "{", "}",
         "@constraint(m, [i = 1:2], begin", "end)", "try", "catch", '"""a doc', 'closed"""', "@doc \"t\" function h(x) end"]


def programs(n, seed):
    rnd = random.Random(seed)
    for i in range(n):
        yield f"p{i}.jl", "\n".join(rnd.choice(KINDS) for _ in range(rnd.randint(0, 60)))


def in_chunks(texts, lines_each, seed):
    rnd = random.Random(seed)
    for path, text in texts:
        lines, at, number = text.split("\n"), 0, 0
        while at < len(lines):
            to = at + rnd.randint(1, lines_each)
            yield path, number, "\n".join(lines[at:to])
            at, number = to, number + rnd.randint(1, 2)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("lines_each", [1, 4, 15])
def test_random_lines_equal_the_whole_walk(spark, lines_each):
    """Any sequence of lines, also programs that close what is not open."""
    texts = list(programs(150, lines_each))
    whole = ex.extract_functions(spark.createDataFrame(texts, "path string, text string"))
    chunks = spark.createDataFrame(list(in_chunks(texts, lines_each, 1)), "path string, chunk long, text string")
    assert rows(sp.extract_split_functions(chunks.repartition(4))) == rows(whole)


def test_generated_programs_equal_the_whole_walk(spark, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 3)
    rnd, texts = random.Random(7), []
    for i in range(60):
        p = Program(rnd)
        p.block(0, rnd.randint(3, 25))
        texts.append((f"p{i}.jl", "\n".join(p.lines)))
    whole = ex.extract_functions(spark.createDataFrame(texts, "path string, text string"), keep_comments=False)
    chunks = spark.createDataFrame(list(in_chunks(texts, 5, 2)), "path string, chunk long, text string")
    assert rows(sp.extract_split_functions(chunks, keep_comments=False)) == rows(whole)


def test_reduced_tokens_act_like_the_tokens(spark):
    """On any stack: the reduced symbols of a run of tokens do what the tokens do."""
    rnd = random.Random(3)
    tokens = ["(", "[", "{", ")", "]", "}", "end", "end", "function", "if", "for", "begin", "while", "let"]
    cases = [("".join(rnd.choice("([{bf") for _ in range(rnd.randint(0, 5))), [rnd.choice(tokens) for _ in range(rnd.randint(0, 12))]) for _ in range(3000)]
    df = spark.createDataFrame(cases, "stack string, tokens array<string>")
    left = F.aggregate(F.transform("tokens", sp._symbol), F.lit(""), sp._reduced)
    out = df.select("stack", "tokens", ex._after_line(F.col("stack"), F.col("tokens")).alias("whole"),
                    F.aggregate(F.split(left, ""), F.col("stack"), sp._applied).alias("reduced")).collect()
    assert [r for r in out if r["whole"] != r["reduced"]] == []


def test_one_large_file_is_many_tasks(spark):
    """A module of 6 MB: many chunks, each extracted by itself; encodings and line ends as by A5."""
    root = tempfile.mkdtemp(prefix="quarry-tree-", dir="/tmp")
    rnd = random.Random(5)
    body = "\n".join(f"# about {i}\nfunction f{i}(x, y)\n    if x\n        y = \"{'é' * rnd.randint(0, 900)}\"\n    end\nend" for i in range(5000))
    os.makedirs(root + "/o_a")
    for name, data in {"large.jl": f"module M\n{body}\nend\n".encode(), "latin.jl": body[:200_000].encode("latin-1"),
                       "crlf.jl": body[:200_000].replace("\n", "\r\n").encode(), "empty.jl": b"", "long.jl": b"x = 1\n" + b"#" * 300_000}.items():
        with open(f"{root}/o_a/{name}", "wb") as fh:
            fh.write(data)
    from quarry.sources.readers import read_source_texts
    whole = ex.extract_functions(read_source_texts(spark, root, limit=None))
    split = sp.extract_large_files(spark, root, listing.file_manifest(spark, root), chunk_bytes=1 << 16)
    assert rows(split) == rows(whole)
    chunks = sp.read_line_chunks(listing.file_manifest(spark, root), root, 1 << 16)
    assert chunks.filter("path = 'o_a/large.jl'").count() > 30
    assert chunks.agg(F.max(F.length("text"))).first()[0] <= 300_010


def test_corpus_without_a_size_limit(spark, monkeypatch):
    monkeypatch.setattr(ex, "SPLIT_BYTES", 2000)
    root = tempfile.mkdtemp(prefix="quarry-tree-", dir="/tmp")
    os.makedirs(root + "/tree/o_a")
    sizes = {"small.jl": 3, "large.jl": 300}
    for name, n in sizes.items():
        with open(f"{root}/tree/o_a/{name}", "w") as fh:
            fh.write("\n".join(f"function f{i}(x)\n  x\nend" for i in range(n)))
    with open(root + "/list.json", "w") as fh:
        fh.write('{"items": [{"name": "o/a"}]}')
    out = ex.extract_corpus_from_tree(spark, root + "/tree", root + "/list.json", limit=None)
    assert {r["path"]: r["n"] for r in out.groupBy("path").agg(F.count("*").alias("n")).collect()} == {f"o_a/{k}": n for k, n in sizes.items()}


def test_small_chunks_are_read_in_shares_of_bytes(spark, tmp_path):
    """small chunks do not become many tasks, and comment lines leave the walk that finds the cuts."""
    from quarry.operators import extract_split
    from quarry.operators.extract import classify_lines
    from quarry.sources.listing import file_manifest
    (tmp_path / "r").mkdir()
    lines = ["function f(x)", "    # end function if (", "    x", "end", ""] * 12_000
    (tmp_path / "r" / "a.jl").write_text("\n".join(lines))
    size = (tmp_path / "r" / "a.jl").stat().st_size
    chunks = extract_split.read_line_chunks(file_manifest(spark, str(tmp_path)), str(tmp_path), chunk_bytes=4096)
    assert "\n".join(r["text"] for r in chunks.orderBy("chunk").collect()).rstrip("\n") == "\n".join(lines).rstrip("\n")
    most = max(spark.sparkContext.defaultParallelism, size // 4096 // extract_split.TASK_CHUNKS + 1)
    assert size // 4096 // 16 > most and len(chunks.inputFiles()) <= most
    cls = classify_lines(F.array(*map(F.lit, lines[:5])))
    assert spark.range(1).select(extract_split.moving_lines(cls)["i"].alias("i")).first()["i"] == [1, 3, 4]
