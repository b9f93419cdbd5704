"""Text rules must follow Python's str.strip / str.splitlines / split exactly."""

import pytest

from conftest import one
from quarry.functions import text as T

CASES = ["", " ", "a", "  a  ", " x ", "\x1cx\x1f", "　y ", "a\nb", "a\n", "\n",
         "a\r\nb\rc", "a\x0bb\x0cc", "x\x1cy\x1dz\x1ew", "a\x85b", "a b ", "\r\n", "a\n\n",
         "\ta b\t", "é ü ß"]


@pytest.mark.parametrize("s", CASES)
def test_py_strip(spark, s):
    assert one(spark, T.py_strip("x"), s) == s.strip()


@pytest.mark.parametrize("s", CASES)
def test_splitlines(spark, s):
    assert one(spark, T.splitlines("x"), s) == s.splitlines()


@pytest.mark.parametrize("s", CASES)
def test_split_newlines(spark, s):
    assert one(spark, T.split_newlines("x"), s) == s.split("\n")


def test_whitespace_set_is_pythons():
    assert set(T.PY_WHITESPACE) == {c for c in map(chr, range(0x110000)) if c.isspace()}
    assert set(T.SPLITLINES_CHARS) == {c for c in map(chr, range(0x110000))
                                       if len(("a" + c + "b").splitlines()) == 2}


@pytest.mark.parametrize("header,name", [
    ("function foo(x, y)", "foo"),
    ("function foo (x)", "foo "),            # the name rule keeps the space before "("
    ("function a function b(x)", "b(x)".split("(")[0]),
    ("function nothing", "nothing"),
    ("no keyword(x)", "no keyword"),
])
def test_function_name(spark, header, name):
    assert one(spark, T.function_name("x"), header) == name


def test_null_in_null_out(spark):
    assert one(spark, T.py_strip("x"), None) is None
    assert one(spark, T.function_name("x"), None) is None
