"""The README usage example, end to end on data derived from the sf0.001 tables."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF0001
from quarry.operators import corpus, evaluation as ev, extract, preprocess
from quarry.operators.ordering import with_global_index
from quarry.plans.fixtures import fx_prompts, fx_results
from quarry.plans.queries_extract import _tree_and_list
from quarry.sources import readers, writers


def test_readme_usage(spark):
    tree, repo_list = _tree_and_list(spark, SF0001)
    base = tempfile.mkdtemp(prefix="quarry-usage-", dir="/tmp")
    fx_prompts(spark, SF0001).select("prompt").write.json(base + "/prompts")

    functions = extract.extract_corpus_from_tree(spark, tree, repo_list,
                                                 keep_comments=False, keep_constraints=False)
    prompts = readers.read_prompts(spark, base + "/prompts")
    cleaned = preprocess.preprocess(functions, prompts, remove_no_docs=False)
    writers.write_function_records(cleaned, base + "/cleaned")
    assert readers.read_function_records(spark, base + "/cleaned").count() == cleaned.count() > 0

    records = with_global_index(cleaned, [F.col("path"), F.col("line")], name="id")
    vocab = corpus.build_vocab(corpus.compose_text(records), size=500)
    rows = corpus.create_corpus(records, vocab, sample=50, seed=0)
    batches = corpus.training_batches(rows.select("id"), "135m")
    assert rows.count() == 50 and batches.agg(F.max("step")).collect()[0][0] == 6

    os.makedirs(base + "/results")
    for m in ["copilot", "m135", "m360"]:
        res = fx_results(spark, SF0001).where(F.col("model") == m)
        docs = [{"problem": str(r["problem"]), "prompt": "", "prediction": "", "passed": r["passed"]}
                for r in res.collect()]
        with open(f"{base}/results/{m}_results_jl.json", "w") as fh:
            json.dump(docs, fh)
    results = readers.read_model_results(spark, base + "/results").select("model", "problem", "passed")
    report = ev.evaluation_report(results, baseline="copilot", order=["m135", "m360"])
    assert report["pairs"].count() == 1 and report["vs_baseline"].count() == 2
