"""Golden cases for completion repair and formatting (E3-E9), derived by hand."""

import pytest

from conftest import one
from quarry.functions import code as C

README_SAMPLE = ("function fibonacci(n)\n  if n <= 2\n    return 1\n  end\n"
                 "  return fibonacci(n - 1) \n  + fibonacci(n - 2)\nend\nend\nend")


@pytest.mark.parametrize("src,expected", [
    # `function` is not a counted opener: all three trailing ends go
    (README_SAMPLE, "function fibonacci(n)\n  if n <= 2\n    return 1\n  end\n"
                    "  return fibonacci(n - 1) \n  + fibonacci(n - 2)"),
    ("if a\nfor b\nx", "if a\nfor b\nx\nend\nend"),
    ("end\nformat(z)\nend", "format(z)\nend"),            # "format" starts with "for"
    ("", ""),
    ("  end  ", ""),
    ("iffy\nendless", "iffy\nendless\nend"),
    ("while x\n  end\n  end", "while x\n  end"),
])
def test_fix_block_ends(spark, src, expected):
    assert one(spark, C.fix_block_ends("x"), src) == expected


def test_fix_block_ends_idempotent(spark):
    once = one(spark, C.fix_block_ends("x"), "if a\nend\nend\nfor i\nwhile j")
    assert one(spark, C.fix_block_ends("x"), once) == once


def test_close_first_completion(spark):
    df = spark.createDataFrame([([README_SAMPLE, "end\nend"],), ([],)], "c array<string>")
    rows = [r["r"] for r in df.select(C.close_first_completion("c").alias("r")).collect()]
    assert rows[0][0].endswith("+ fibonacci(n - 2)\nend")
    assert rows[0][1] == "end\nend"
    assert rows[1] == []


@pytest.mark.parametrize("src,expected", [
    # any `end` counts, so an inner block closes a lone function
    ("function f(x)\n  if x\n  end\nend\nprint(1)", "function f(x)\n  if x\n  end"),
    ("x = 1\ny = 2", "x = 1\ny = 2"),
    ("  function g()\nend\n\nmore", "function g()\nend"),
    ("functional\nend", "functional\nend"),
    ("", ""),
    ("a\r\nfunction f()\r\nend\r\nz", "a\nfunction f()\nend"),
])
def test_clean_output(spark, src, expected):
    assert one(spark, C.clean_output("x"), src) == expected


@pytest.mark.parametrize("src,expected", [
    # ")" swallows the following newline and indentation (kept quirk)
    ("function f(x)\nif x\ny\nend\nend", "function f(x)if x\n        y\n    end\nend"),
    ("x=1\nif a\nb", "x = 1\nif a\n    b\nend"),
    ("for i in xs\nif a; b; end\nend", "for i in xs\n    if a; b; end\nend"),
    # `else` pops without pushing again
    ("if a\nx\nelse\ny\nend", "if a\n    x\nelse\ny\nend"),
    ("a==b", "a =  = b"),
    ("if a\n\n  \nb", "if a\n\n\n    b\nend"),
    ("f( a ,b )", "f(a, b)"),
    ("", ""),
])
def test_format_code(spark, src, expected):
    assert one(spark, C.format_code("x"), src) == expected


def test_format_code_deep_indentation_is_linear(spark):
    src = "\n".join(["if x"] * 300)
    out = one(spark, C.format_code("x"), src)
    assert out.count("end") == 300


def test_postprocess_prediction(spark):
    src = "function f(x)\nreturn x+1\nend\nextra"
    assert one(spark, C.postprocess_prediction("x"), src) == "function f(x)return x + 1\nend"
    assert one(spark, C.postprocess_prediction("x", original_output=True), src) == src


def test_drop_log_lines_and_markdown(spark):
    assert one(spark, C.drop_log_lines("x"), "# log\ncode\n#x\nmore") == "code\nmore"
    assert one(spark, C.to_markdown("x"), "y = 1") == "```julia\ny = 1\n```"
