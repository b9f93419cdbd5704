"""Function extraction on hand-written Julia source."""

import os
import sys

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import quarry.plans  # noqa: F401  (registers the queries)
from quarry.operators import extract as ex
from quarry.plans.registry import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SOURCE = '''module M

"""
    f(x)

Docs here.
"""
function f(x)
    # comment
    @constraint(m, begin
        x >= 0
    end)
    y = [i for i in 1:3 if i > 1]
    map(xs) do v
        v + 1
    end
    if x > 0; return 1; end
    @info "hi"
    return y
end

# about g
@inline function g(a) a end

@time function k()
end

@doc raw"k2 docs"
function k2(z)
    s = """
    if this were code
    """
    z
end

#= block
function hidden()
end
=#
function outer(p)
    function inner(q)
        q
    end
    inner(p)
end

end
'''


@pytest.fixture(scope="module")
def functions(spark):
    files = spark.createDataFrame([("m.jl", SOURCE)], "path string, text string")
    rows = ex.extract_functions(files).collect()
    return {r["function_header"]: r for r in rows}


@pytest.fixture(scope="module")
def stripped(spark):
    files = spark.createDataFrame([("m.jl", SOURCE)], "path string, text string")
    rows = ex.extract_functions(files, keep_comments=False, keep_constraints=False).collect()
    return {r["function_header"]: r for r in rows}


def test_found_functions(functions):
    assert set(functions) == {"function f(x)", "function g(a)", "function k()", "function k2(z)",
                              "function outer(p)", "function inner(q)"}


def test_docs(functions):
    assert functions["function f(x)"]["doc_string"] == '"""\n    f(x)\n\nDocs here.\n"""'
    assert functions["function g(a)"]["doc_string"] == "# about g"
    assert functions["function k()"]["doc_string"] == ""          # sibling is not a doc
    assert functions["function k2(z)"]["doc_string"] == '@doc raw"k2 docs"'
    assert functions["function outer(p)"]["doc_string"] == ""      # block comments are not docs
    assert functions["function inner(q)"]["doc_string"] == ""


def test_levels_and_lines(functions):
    f = functions["function f(x)"]
    assert (f["line"], f["end_line"], f["level"]) == (8, 20, 1)
    assert functions["function inner(q)"]["level"] == 2
    g = functions["function g(a)"]
    assert g["line"] == g["end_line"]


def test_flags_and_body_kept(functions):
    f = functions["function f(x)"]
    assert f["has_internal_comments"] and f["has_constraints"]
    assert f["function_body"].startswith("    # comment\n    @constraint(m, begin")
    assert f["function_body"].endswith("    @info \"hi\"\n    return y")
    k2 = functions["function k2(z)"]
    assert not k2["has_internal_comments"] and not k2["has_constraints"]
    assert "if this were code" in k2["function_body"]
    assert functions["function outer(p)"]["function_body"] == \
        "    function inner(q)\n        q\n    end\n    inner(p)"


def test_flags_and_body_stripped(stripped):
    f = stripped["function f(x)"]
    assert f["has_internal_comments"] and f["has_constraints"]
    assert f["function_body"] == (
        "    y = [i for i in 1:3 if i > 1]\n    map(xs) do v\n        v + 1\n    end\n"
        "    if x > 0; return 1; end\n    return y")


def test_header_rule(spark):
    df = spark.createDataFrame([("function  foo (x::Int, y)",), ("@inline function bar(a)",),
                                ("function baz",)], "t string")
    got = [r[0] for r in df.select(ex.function_header(df.t)).collect()]
    assert got == ["function foo(x::Int, y)", "function bar(a)", "function baz"]


def test_unbalanced_end_is_ignored(spark):
    files = spark.createDataFrame([("a.jl", "end\nfunction a()\n  1\nend\nend")], "path string, text string")
    rows = ex.extract_functions(files).collect()
    assert [(r["function_header"], r["function_body"]) for r in rows] == [("function a()", "  1")]


REAL = '''function squares(xs)
    ys = [x^2
          for x in xs
          if x > 0]
    if isempty(ys) ys = [0] end  # nothing left
    return ys
end

function long_signature(a::Int,
                        b::Vector{Float64};
                        c = "(not a bracket",
                        d = 2)::Float64
    Threads.@threads for i in eachindex(b)
        b[i] += a
    end
    first = b[begin]
    s = "if this were code"
    foo(map(b) do v
        v + 1
    end)
    bar(a,
        # inside the call, not a top-level comment
        d)
    return first
end
'''


@pytest.fixture(scope="module")
def real_functions(spark):
    files = spark.createDataFrame([("r.jl", REAL)], "path string, text string")
    rows = ex.extract_functions(files, keep_comments=False).collect()
    return {r["function_header"].split("(")[0]: r for r in rows}


def test_comprehension_and_trailing_comment(real_functions):
    sq = real_functions["function squares"]
    assert (sq["line"], sq["end_line"]) == (1, 7)
    assert sq["function_body"].endswith("    return ys")


def test_multi_line_signature(real_functions):
    f = real_functions["function long_signature"]
    assert f["function_header"] == (
        'function long_signature(a::Int,\n                        b::Vector{Float64};\n'
        '                        c = "(not a bracket",\n                        d = 2)')
    assert (f["line"], f["end_line"]) == (9, 25)
    assert f["function_body"].startswith("    Threads.@threads for i in eachindex(b)")
    assert "# inside the call" in f["function_body"]     # not top level: never stripped
    assert not f["has_internal_comments"]
    assert set(real_functions) == {"function squares", "function long_signature"}


def test_doc_macro_on_the_header_line(spark):
    src = ('@doc "Adds two numbers." function add(a, b)\n    a + b\nend\n\n'
           '# plain\n@doc raw"\\\\ raw" function sub(a, b) a - b end\n'
           '@inline function mul(a, b)\n    a * b\nend')
    files = spark.createDataFrame([("d.jl", src)], "path string, text string")
    got = {r["function_header"]: (r["doc_string"], r["function_body"], r["line"], r["end_line"])
           for r in ex.extract_functions(files).collect()}
    assert got == {
        "function add(a, b)": ('"Adds two numbers."', "    a + b", 1, 3),
        "function sub(a, b)": ('raw"\\\\ raw"', "", 6, 6),
        "function mul(a, b)": ("", "    a * b", 7, 9),
    }


def test_block_comment_in_body(spark):
    src = "function f(x)\n    #=\n    if this were code\n    =#\n    # top\n    x\nend"
    files = spark.createDataFrame([("c.jl", src)], "path string, text string")
    r = ex.extract_functions(files, keep_comments=False).collect()[0]
    assert r["has_internal_comments"]
    assert r["function_body"] == "    #=\n    if this were code\n    =#\n    x"


def test_functions_inside_lines(spark):
    src = '\n'.join([
        "function outer(xs, k = \"a)\")",
        "    g = map(function (x)",
        "        x[end] + 1",
        "    end, xs)",
        "    ok && try",
        "        f()",
        "    catch",
        "    end",
        "    y = return_if(xs[begin:end], :end, xs.end)",
        "    return if k",
        "        function (y) y end",
        "    else",
        "        [function (z) z end for z in xs if z > 0]",
        "    end",
        "end",
        "after(function named(a, (b, c)) a end, function (d) d end)",
        "function last() end"])
    rows = ex.extract_functions(spark.createDataFrame([("i.jl", src)], "path string, text string")).collect()
    assert sorted((r["line"], r["end_line"], r["level"], r["function_header"]) for r in rows) == sorted([
        (1, 15, 0, 'function outer(xs, k = "a)")'), (2, 4, 1, "function (x)"), (11, 11, 2, "function (y)"),
        (13, 13, 2, "function (z)"), (16, 16, 0, "function named(a, (b, c))"), (16, 16, 0, "function (d)"), (17, 17, 0, "function last()")])
    body = {r["line"]: r["function_body"] for r in rows}
    assert body[2] == "        x[end] + 1" and body[1].count("\n") == 12 and body[11] == ""


def test_long_literals_do_not_exhaust_the_stack(spark):
    quoted = "x" * 500_000, "\\\"" * 200_000
    src = "\n".join(f'function f{i}()\n    s = "{q}"\nend' for i, q in enumerate(quoted))
    rows = ex.extract_functions(spark.createDataFrame([("l.jl", src)], "path string, text string")).collect()
    assert sorted((r["line"], r["end_line"]) for r in rows) == [(1, 3), (4, 6)]


def _timed(spark, df):
    import time
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def test_time_follows_the_lines(spark):
    """Four times the lines, no more than about four times the time (a quadratic walk takes sixteen)."""
    from quarry.functions import code
    from pyspark.sql import functions as F
    block = "function f(x)\n    if x\n        y = 1\n    end\nend\n"

    def files(n):
        return spark.createDataFrame([("t.jl", block * (n // 5))], "path string, text string")

    for run in (ex.extract_functions, lambda d: d.select(code.fix_block_ends("text")), lambda d: d.select(code.format_code("text"))):
        _timed(spark, run(files(5000)))
        small, large = (min(_timed(spark, run(files(n))) for _ in range(2)) for n in (12_500, 50_000))
        assert large < 8 * small + 1


@pytest.mark.parametrize("name", ["b7_extract_corpus_tree", "c8_preprocess_extracted_tree"])
def test_tree_keeps_files_beyond_the_size_limit(spark, tmp_path, name):
    """A text of more than 1 MiB, and a source whose texts of one id window add up to more."""
    from oracle_check import rows_key
    texts = {i: f"text {i} é日 " * (2000 if i % 3 else 20) for i in range(1, 600)}
    texts[601] = "long é日 " + "ünï 日本 " * 100_000
    rows = [(i, t, "en", "src1" if i == 601 else "src0" if i % 3 else f"src{i % 8}", len(t)) for i, t in texts.items()]
    pq.write_table(pa.table(dict(zip(["doc_id", "text", "lang", "source", "n_chars"], map(list, zip(*rows))))), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [5, 6, 601], "text": ["a", "b", "c"]}), tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got, want = [tuple(r) for r in df.select(*columns).collect()], want.fetchall()
    assert len(got) == len(want) and rows_key(got) == rows_key(want)
