"""Physical plans: broadcast only bounded sides, no shuffle where none is needed."""

from conftest import SF001
from quarry.functions import code as C
from quarry.operators import extract as ex
from quarry.plans import fixtures as fx
from quarry.plans.registry import QUERIES
from quarry.sources import readers as rd


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_decontaminate_is_a_broadcast_anti_join(spark):
    p = plan(QUERIES["c8_preprocess"](spark, SF001))
    assert "BroadcastHashJoin" in p and "LeftAnti" in p
    assert "SortMergeJoin" not in p


def test_code_repair_is_map_only(spark):
    code = fx.fx_code(spark, SF001)
    for col in (C.fix_block_ends("code"), C.format_code("code"), C.clean_output("code")):
        assert "Exchange" not in plan(code.select(col))


def test_extraction_is_map_only(spark):
    files = spark.read.parquet(f"{SF001}/documents.parquet").selectExpr("source as path", "text")
    assert "Exchange" not in plan(ex.extract_functions(files))


def test_scan_prunes_columns(spark):
    p = plan(fx.fx_functions(spark, SF001).select("id", "function_header"))
    assert "ReadSchema: struct<doc_id:bigint>" in p


def test_pair_statistics_join_no_results(spark):
    """What is joined are blocks of bitmaps, read from the checkpoint; the results are read once."""
    p = plan(QUERIES["g13_compare_all_pairs"](spark, SF001))
    assert "FileScan parquet" not in p and "Scan ExistingRDD" in p


def test_encoding_and_preview_are_map_only(spark):
    from quarry.operators import corpus as cp
    texts = spark.read.parquet(f"{SF001}/documents.parquet").selectExpr("doc_id as id", "text")
    vocab = cp.build_vocab(texts, 500)
    ids = cp.encode(texts, vocab)
    for df in (ids, cp.preview_tokens(ids.withColumnRenamed("ids", "input_ids"), vocab)):
        assert "Exchange" not in plan(df) and "Generate" not in plan(df)


def test_samples_and_vocabularies_gather_no_rows_in_one_task(spark):
    from quarry.operators import corpus as cp
    texts = spark.read.parquet(f"{SF001}/documents.parquet").selectExpr("doc_id as id", "text")
    for df in (cp.sample_exact(texts, 100), cp.build_vocab(texts, 100)):
        assert "TakeOrdered" not in plan(df) and "Limit" not in plan(df)


def test_file_listing_filter_is_pushed(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.jl").write_text("x")
    manifest = plan(rd.corpus_files(spark, str(tmp_path), with_content=False))
    assert "Format: Parquet" in manifest and "binaryFile" not in manifest  # listed by tasks, within the size limit
    p = plan(rd.corpus_files(spark, str(tmp_path)))
    assert "MapInArrow" in p and "binaryFile" not in p


def test_listing_filter_is_pushed_where_tasks_cannot_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rd, "reachable", lambda root: False)
    (tmp_path / "o_a").mkdir()
    (tmp_path / "o_a" / "a.jl").write_text("x")
    (tmp_path / "o_b").mkdir()
    (tmp_path / "o_b" / "b.jl").write_text("x")
    p = plan(rd.corpus_files(spark, str(tmp_path)))
    assert "PushedFilters" in p and "LessThan(length" in p
    repos = spark.createDataFrame([("o/a",)], "name string")
    assert [(r["repo_dir"], r["path"], bytes(r["content"])) for r in rd.corpus_files(spark, str(tmp_path), repos).collect()] == [("o_a", "o_a/a.jl", b"x")]
