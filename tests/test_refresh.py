"""Refreshed extraction: what is read, what is replaced, and what a failed refresh leaves."""

import os
import tempfile

import pytest

from quarry.operators import extract as ex
from quarry.operators import refresh as rf
from quarry.sources.readers import read_source_texts


def put(root, rel, text, at):
    full = os.path.join(root, rel)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as fh:
        fh.write(text)
    os.utime(full, (at, at))


def functions(n, name="f"):
    return "\n".join(f"# doc {i}\nfunction {name}{i}(x)\n  x\nend" for i in range(n))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_only_changed_files_are_read(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="quarry-refresh-", dir="/tmp")
    root, store = base + "/tree", base + "/store"
    for i in range(6):
        put(root, f"o_r{i}/a.jl", functions(i + 1), 1_000)
    full = lambda: rows(ex.extract_functions(read_source_texts(spark, root)))
    assert rf.refresh(spark, root, store) == {"kept": 0, "read": 6, "extracted": 6, "gone": 0}
    assert rows(rf.read_functions(spark, store)) == full()

    def unread(*_args):
        raise AssertionError("content was read")

    with monkeypatch.context() as m:
        m.setattr(rf, "read_contents", unread)
        assert rf.refresh(spark, root, store) == {"kept": 6, "read": 0, "extracted": 0, "gone": 0}
    assert rf.versions(spark, store) == [0]  # nothing to say, no new version

    put(root, "o_r1/a.jl", functions(7, "g"), 2_000)          # changed
    put(root, "o_r2/a.jl", functions(3), 2_000)               # touched, same bytes
    put(root, "o_new/b.jl", functions(2, "h"), 2_000)         # new
    os.remove(root + "/o_r0/a.jl")                            # deleted
    before = rows(rf.read_functions(spark, store))
    with monkeypatch.context() as m:                          # a refresh that fails leaves the store as it was
        m.setattr(rf, "extract_functions", unread)
        with pytest.raises(AssertionError):
            rf.refresh(spark, root, store)
    assert rows(rf.read_functions(spark, store)) == before and rf.versions(spark, store) == [0]
    assert rf.refresh(spark, root, store) == {"kept": 3, "read": 3, "extracted": 2, "gone": 1}
    assert rows(rf.read_functions(spark, store)) == full()
    assert rows(rf.read_functions(spark, store, 0)) == before  # an older version is still there

    some = spark.createDataFrame([("o/r1",), ("o/r5",), ("o/none",)], "name string")
    assert rf.refresh(spark, root, store, some)["gone"] == 4
    assert {r["path"] for r in rf.read_functions(spark, store).collect()} == {"o_r1/a.jl", "o_r5/a.jl"}


def test_empty_tree(spark):
    base = tempfile.mkdtemp(prefix="quarry-refresh-", dir="/tmp")
    os.mkdir(base + "/tree")
    assert rf.refresh(spark, base + "/tree", base + "/store") == {"kept": 0, "read": 0, "extracted": 0, "gone": 0}
    assert rf.read_functions(spark, base + "/store").count() == 0
