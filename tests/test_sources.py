"""Sources and sinks: edge cases of the file-tree, JSON and CSV round trips."""

import gzip
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.sources import readers as rd
from quarry.sources import writers as wr


def _tree(files: dict[str, bytes]) -> str:
    root = tempfile.mkdtemp(prefix="quarry-tree-", dir="/tmp")
    for rel, data in files.items():
        full = os.path.join(root, rel)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as fh:
            fh.write(data)
    return root


def test_corpus_files_filters(spark):
    root = _tree({
        "o_a/src/x.jl": b"x = 1\n",
        "o_a/src/big.jl": b"#" * 64,
        "o_a/src/exact.jl": b"#" * 63,
        "o_a/notes.txt": b"not code",
        "o_a/.hidden.jl": b"hidden",
        "o_b/y.jl": b"y",
        "o_c/z.jl": b"z",
    })
    repos = spark.createDataFrame([("o/a",), ("o/b",)], "name string")
    got = {r["path"]: r["length"] for r in rd.corpus_files(spark, root, repos, limit=64).collect()}
    # strict size limit, suffix filter, unlisted repository dropped, hidden file skipped
    assert got == {"o_a/src/x.jl": 6, "o_a/src/exact.jl": 63, "o_b/y.jl": 1}


def test_decode_text_fallback_and_newlines(spark):
    root = _tree({"r/a.jl": "é\r\nb\rc".encode("utf-8"), "r/b.jl": "é\nü".encode("latin-1")})
    files = rd.read_source_texts(spark, root)
    got = {r["path"]: r["text"] for r in files.collect()}
    assert got == {"r/a.jl": "é\nb\nc", "r/b.jl": "é\nü"}


def test_result_docs_and_completion_rewrite(spark):
    doc = {"name": "HumanEval_7_x", "prompt": "P", "tests": "T",
           "results": [{"program": "PbodyT", "status": "OK"}]}
    comp = {"name": "HumanEval_7_x", "prompt": "P", "temperature": 0.2, "tests": "T\n", "stop_tokens": ["\nend", None],
            "completions": ["if a\nx\nend\nend", "keep"], "meta": {"é": None, "n": [1, {"x": 2}]}, "note": None}
    root = _tree({"m/HumanEval_7_x.results.json.gz": gzip.compress(json.dumps(doc).encode()),
                  "m/HumanEval_7_x.json.gz": gzip.compress(json.dumps(comp).encode())})
    from quarry.operators.evaluation import result_rows
    rows = result_rows(rd.read_result_docs(spark, root)).collect()
    assert [(r["problem"], r["prediction"], r["passed"]) for r in rows] == [("HumanEval_7_x", "body", True)]
    out = tempfile.mkdtemp(prefix="quarry-out-", dir="/tmp")
    wr.rewrite_completions(spark, root, out)
    with gzip.open(os.path.join(out, "m", "HumanEval_7_x.json.gz")) as fh:
        written = json.load(fh)
    assert written.pop("completions") == ["if a\nx\nend\nend", "keep"]
    assert list(written.items()) == [(k, v) for k, v in comp.items() if k != "completions"]
    # the input is left untouched
    with gzip.open(os.path.join(root, "m/HumanEval_7_x.json.gz")) as fh:
        assert json.load(fh) == comp


def test_csv_round_trip_keeps_text(spark):
    df = spark.createDataFrame([(1, "", '\ta "q"\n b ', None)], "id long, a string, b string, c string")
    path = tempfile.mkdtemp(prefix="quarry-csv-", dir="/tmp") + "/out"
    wr.write_csv(df, path)
    back = wr.read_csv(spark, path, df.schema).collect()[0]
    assert (back["a"], back["b"], back["c"]) == ("", '\ta "q"\n b ', None)


def test_results_array_writer(spark):
    df = spark.createDataFrame([(f"p{i}", "x", "y", i % 2 == 0, i) for i in range(25)],
                               "problem string, prompt string, prediction string, passed boolean, rank long")
    path = tempfile.mkdtemp(prefix="quarry-arr-", dir="/tmp") + "/out"
    wr.write_results(df.repartition(3), path, as_array=True)
    back = rd.read_results_array(spark, path)
    assert back.count() == 25
    assert back.where(F.col("passed")).count() == 13


def test_prompts_model_results_and_checkpoints(spark):
    rows = [{"problem": "p1", "prompt": "x", "prediction": "y", "passed": True},
            {"problem": "p2", "prompt": "x", "prediction": "y", "passed": False}]
    root = _tree({
        "prompts.jsonl": b'{"name": "HumanEval_0", "prompt": "a\\nfunction f(x)\\n"}\n{"prompt": "b"}\n',
        "res/135m_results_jl.json": json.dumps(rows).encode(),
        "res/copilot_results_jl.json": json.dumps(rows[:1]).encode(),
        "res/notes.json": b"[]",
        "models/135m/checkpoint-9/model.bin": b"x",
        "models/135m/checkpoint-10/model.bin": b"x",
        "models/135m/tokenizer.json": b"{}",
        "models/1-7B/checkpoint-3/config.json": b"{}",
    })
    prompts = rd.read_prompts(spark, root + "/prompts.jsonl").collect()
    assert [p["prompt"] for p in prompts] == ["a\nfunction f(x)\n", "b"]
    got = sorted((r["model"], r["problem"], r["passed"]) for r in rd.read_model_results(spark, root + "/res").collect())
    assert got == [("135m", "p1", True), ("135m", "p2", False), ("copilot", "p1", True)]
    ckpts = rd.list_checkpoints(spark, root + "/models")
    assert sorted(tuple(r) for r in ckpts.collect()) == [
        ("1-7B", "1-7B/checkpoint-3"), ("135m", "135m/checkpoint-10"), ("135m", "135m/checkpoint-9")]
    from quarry.operators.corpus import latest_checkpoint
    latest = {r["model"]: r["checkpoint"] for r in latest_checkpoint(ckpts).collect()}
    assert latest == {"135m": "135m/checkpoint-10", "1-7B": "1-7B/checkpoint-3"}


def test_require_inputs(spark):
    import pytest
    from quarry.operators import repos as rp
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    present = spark.createDataFrame([("a", 1), ("b", 0)], "model string, problem int")
    with pytest.raises(FileNotFoundError, match="1 missing inputs for model: c"):
        rp.require_inputs(expected, present)
    many = spark.range(500).selectExpr("cast(id as string) as model")
    with pytest.raises(rp.MissingInputs) as error:
        rp.require_inputs(many, present)
    assert error.value.count == 500 and error.value.table.count() == 500
    rp.require_inputs(expected.where("model <> 'c'"), present)
    kept, missing = rp.present_only(present, expected)
    assert kept.count() == 2 and [r["model"] for r in missing.collect()] == ["c"]


def test_write_results_is_ordered_across_part_files(spark):
    import glob
    from quarry.operators import evaluation as ev
    rows = [(f"HumanEval_{i}_x", "p", "x", i % 2 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "problem string, prompt string, prediction string, passed boolean")
    ranked = ev.order_by_problem_number(df.repartition(5))
    path = tempfile.mkdtemp(prefix="quarry-ordered-", dir="/tmp") + "/out"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        wr.write_results(ranked, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    seen = []
    for f in sorted(glob.glob(path + "/part-*.json")):
        seen += [json.loads(line)["problem"] for line in open(f)]
    assert seen == [f"HumanEval_{i}_x" for i in range(300)]
    assert len(glob.glob(path + "/part-*.json")) > 1


def test_only_listed_repositories_are_read(spark):
    root = _tree({"o_a/x.jl": b"1", "o_a/sub/y.jl": b"2", "o_b/z.jl": b"3"})
    repos = spark.createDataFrame([("o/a",), ("o/missing",)], "name string")
    files = rd.corpus_files(spark, root, repos)
    assert sorted(r["path"] for r in files.collect()) == ["o_a/sub/y.jl", "o_a/x.jl"]
    assert rd.corpus_files(spark, root, repos.where("name = 'o/missing'")).count() == 0


def test_generators_of_one_factory_are_told_apart(spark):
    from quarry.operators.completions import batch_generate

    def factory(answer):
        def load(model):
            if model == "bad":
                raise RuntimeError("no such model")
            return lambda prompts: [answer + p for p in prompts]
        return load

    requests = spark.createDataFrame([(f"p{i}", m) for i in range(20) for m in ("m1", "m2", "m3", "bad")], "prompt string, model string")
    for answer in ("A", "B", "A"):
        rows = batch_generate(requests, factory(answer), error_col="failed", splits=2).collect()
        assert len(rows) == 80
        for r in rows:
            assert r["failed"] == (r["model"] == "bad")
            assert r["completion"] == ("Error loading model: no such model" if r["failed"] else answer + r["prompt"])


def test_twenty_thousand_folders_are_listed_by_tasks(spark, monkeypatch):
    """Rounds of 500 folders a task; the driver collects no name and no path."""
    from pyspark.sql import DataFrame
    from quarry.sources import listing
    root = tempfile.mkdtemp(prefix="quarry-tree-", dir="/tmp")
    for i in range(4000):  # 4,000 repositories of five folders
        os.makedirs(os.path.join(root, f"o_r{i}", "src", "a", "b"))
        os.mkdir(os.path.join(root, f"o_r{i}", "test"))
        if i % 4 == 0:
            with open(os.path.join(root, f"o_r{i}", "src", "a", "b", "x.jl"), "w") as fh:
                fh.write("x" * (i % 1000))
    collected = []
    monkeypatch.setattr(DataFrame, "collect", lambda self, *a: collected.append(self) or [])
    monkeypatch.setattr(listing, "FOLDERS_PER_TASK", 300)
    everything = listing.file_manifest(spark, root, None, ".jl", 900)
    repos = spark.range(0, 5000, 3).selectExpr("concat('o/r', id) AS name")
    some = rd.corpus_files(spark, root, repos, with_content=False)
    whole = rd.corpus_files(spark, root, repos)
    assert not collected
    monkeypatch.undo()
    expected = {f"o_r{i}/src/a/b/x.jl": i % 1000 for i in range(0, 4000, 4)}
    got = everything.collect()
    assert len(got) == len({r["path"] for r in got}) and {r["path"]: r["length"] for r in got} == {p: n for p, n in expected.items() if n < 900}
    listed = {p: n for p, n in expected.items() if int(p.split("/")[0][3:]) % 3 == 0}
    assert {r["path"]: r["length"] for r in some.collect()} == listed
    assert {r["path"]: len(r["content"]) for r in whole.collect()} == listed


def test_files_are_read_in_shares_of_bytes(spark):
    from quarry.sources import listing
    root = _tree({f"o_a/f{i}.jl": bytes([i]) * 10_000 for i in range(100)})
    manifest = listing.file_manifest(spark, root)
    read = listing.read_contents(manifest, root, share_bytes=100_000)
    assert read.rdd.getNumPartitions() == 10
    assert sorted((r["path"], bytes(r["content"])) for r in read.collect()) == sorted((f"o_a/f{i}.jl", bytes([i]) * 10_000) for i in range(100))
    assert listing.file_manifest(spark, root + "/absent").count() == 0
    assert not listing.reachable("viewfs://store/x") and listing.reachable("file:" + root)


def _files_below(root):
    """The files of the tree; what stopped attempts may leave is no part of it."""
    found = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)
    return [f for f in found if not f.startswith("_attempts/")]


def test_failed_writes_publish_nothing(spark):
    root = tempfile.mkdtemp(prefix="quarry-out-", dir="/tmp")
    ok = spark.range(40).selectExpr("concat('a/b', id % 7, '/f', id, '.txt') AS path", "encode(cast(id AS string), 'UTF-8') AS content").repartition(5)
    broken = ok.withColumn("content", F.when(F.col("path").endswith("f33.txt"), F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        wr.write_file_tree(broken, root)
    assert _files_below(root) == []
    assert wr.write_file_tree(ok, root) == 40
    assert _files_below(root) == sorted(["_COMMITTED"] + [f"a/b{i % 7}/f{i}.txt" for i in range(40)])
    with open(root + "/a/b5/f33.txt") as fh:
        assert fh.read() == "33"
    # a second write replaces its own files and leaves the others
    assert wr.write_file_tree(ok.where("path LIKE '%f33.txt'").selectExpr("path", "encode('new', 'UTF-8') AS content"), root) == 1
    with open(root + "/a/b5/f33.txt") as fh:
        assert fh.read() == "new"
    assert len(_files_below(root)) == 41


def test_attempts_that_do_not_count_leave_no_file():
    """Two attempts of one task write the same path; only the committed one is published."""
    import pyarrow as pa
    from quarry.sources.file_sink import FileTreeWriter
    root = tempfile.mkdtemp(prefix="quarry-out-", dir="/tmp")
    writer = FileTreeWriter({"root": root, "run": "r1"})
    batch = lambda text: iter([pa.RecordBatch.from_arrays([pa.array(["x/y.txt"]), pa.array([text], pa.binary())], ["path", "content"])])
    writer.write(batch(b"speculative"))
    counted = writer.write(batch(b"counted"))
    assert not os.path.exists(root + "/x/y.txt")
    writer.commit([counted, None])
    with open(root + "/x/y.txt", "rb") as fh:
        assert fh.read() == b"counted"
    assert _files_below(root) == ["_COMMITTED", "x/y.txt"]


def test_failing_prompts_lose_only_their_rows(spark):
    from quarry.operators.completions import batch_generate, generate_each, pack

    def load(_model):
        def generate(prompts):
            if any(p and p.startswith("bad") for p in prompts):
                raise RuntimeError("bad prompt")
            assert len(prompts) * max(len(p or "") for p in prompts) <= 100 or len(prompts) == 1
            return [f"<{p}>" for p in prompts]
        return generate

    prompts = [("bad" if i % 29 == 0 else "p") + "x" * (i % 40) + str(i) for i in range(300)] + [None, "y" * 500]
    requests = spark.createDataFrame([(p, "m") for p in prompts], "prompt string, model string")
    rows = batch_generate(requests, load, error_col="failed", batch_size=16, budget=100, splits=3).collect()
    assert len(rows) == len(prompts)
    for r in rows:
        bad = (r["prompt"] or "").startswith("bad")
        assert r["failed"] == bad and r["completion"] == ("Error generating: bad prompt" if bad else f"<{r['prompt']}>")
    assert [(s.start, s.stop) for s in pack([1, 1, 5, 50, 200], 3, 100)] == [(0, 3), (3, 4), (4, 5)]
    assert generate_each(lambda ps: ps[:-1], ["a"]) == [("Error generating: 0 completions for 1 prompts", True)]
