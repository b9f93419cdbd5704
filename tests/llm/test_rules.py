"""URL rules and quality rules."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import quality, queries, url_rules
from quarry.llm.url_rules import host_rule, text_rule

from .conftest import LOWER, SF, WORDS


def plain_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].translate(LOWER), rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for r in rules:
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r.name), r.name, r.verdict))
    return host, path, max(fits, default=(0, None, "allow"))[1:]


def test_rules_equal_plain_judging(spark):
    rnd = random.Random(2)
    rules = [host_rule(rnd.choice(["block", "allow"]), n) for n in
             ("net/", "example.net/en/", "com/", "a.com/x", "b.a.com/", "org/fr/", "x.org/fr/y/", "net/en/")]
    hosts = ["net", "example.net", "EXAMPLE.net", "notnet", "b.a.com", "a.com", "xa.com", "x.org", "a.com:80", "u@net", "", "fr.org", "a/net"]
    paths = ["", "/", "/en/", "/en", "/x", "/xyz", "/X", "/fr/y/z", "/fr/", "/net/", "?a=/en/", "#/en/", "/en/?q#f", "/\n/en/", "//net/"]
    urls = [f"{s}{h}{p}" for s in ("http://", "", "x://y://", "://") for h in hosts for p in paths] + [None, "", "://", "http:/net/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in url_rules.judge(pages, rules).collect():
        host, path, (name, verdict) = plain_judge(r.url, rules)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, name, verdict), r.url


def test_index_takes_the_rarest_token(spark):
    pages = spark.createDataFrame([("http://a.net/en/",), ("http://b.net/de/",), ("http://c.net/de/",)], "url string")
    index = url_rules.rarest_tokens(url_rules.with_parts(pages), [host_rule("block", "net/en/"), host_rule("block", "net/")])
    assert {k: [r.name for r in v] for k, v in index.items()} == {"en": ["net/en/"], "net": ["net/"]}


def test_part_of_a_path_token_is_no_literal():
    assert host_rule("block", "net/en").tokens == ("net",) and host_rule("block", "net/a/en").tokens == ("net", "a")


def test_own_patterns_come_after_listed_rules(spark):
    rules = [host_rule("allow", "net/login"), text_rule("block", "login", "/login", "login")]
    pages = spark.createDataFrame([("http://x.net/login",), ("http://x.com/login",), ("http://x.com/a",)], "url string")
    out = [(r.rule, r.own_rule, r.verdict) for r in url_rules.judge(pages, rules).orderBy(F.desc("url")).collect()]
    assert out == [("net/login", None, "allow"), (None, "login", "block"), (None, None, "allow")]


def test_url_edge_cases(spark):
    pages = spark.createDataFrame([(1, None, "p"), (1, None, "p"), (2, "http://x.net/", "q")], "page_id long, url string, host string")
    out = url_rules.judge(pages)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "own_rule"]
    assert sorted((r.page_id, r.host, r.verdict) for r in out.collect()) == [(1, "", "allow"), (1, "", "allow"), (2, "x.net", "block")]
    assert url_rules.judge(pages.limit(0)).count() == 0 and url_rules.judge(pages, []).filter("verdict = 'allow'").count() == 3
    with pytest.raises(ValueError):
        url_rules.judge(pages, [text_rule("block", "x", "x")])


def plain_statistics(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_statistics_equal_brute_force(spark, documents, odd_texts):
    rnd = random.Random(4)
    rows = odd_texts + [(100 + i, "".join(rnd.choice(["a ", "b\n", "c", "#", " é ", "\x0b"]) for _ in range(rnd.randint(0, 120)))) for i in range(300)]
    judged = quality.judge(documents(rows), [])
    assert judged.count() == len(rows)
    for r in judged.collect():
        assert tuple(r[c] for c in quality.BASE) == plain_statistics(r.text), r.text[:60] if r.text else r.text
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) == (not r.kept)


def test_quality_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in quality.BASE) == plain_statistics(texts[r.doc_id])
        assert not (r.base_failed and r.kept) and r.kept == (not r.base_failed and r.rule is None)


def test_learned_list_on_held_out_labels(spark):
    """Rules fitted on half of the labels find the low-quality half of the others and keep the good ones."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    held = quality.judge(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id"), rules).filter("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in held.groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))


def test_covering_orders_grows_and_prunes():
    rnd = random.Random(1)
    rows = [{"x": rnd.random(), "y": rnd.random(), "part": i % 3} for i in range(900)]
    for r in rows:
        r["bad"] = int(r["x"] > 0.8 or (r["x"] < 0.3 and r["y"] < 0.4))
    rules = quality.learn(rows, ["x", "y"])
    hit = [any(all(c.holds(r) for c in rule) for rule in rules) for r in rows]
    assert sum(h == bool(r["bad"]) for h, r in zip(hit, rows)) >= 0.93 * len(rows)
    assert quality.learn([], ["x"]) == [] and quality.learn([r | {"bad": 0} for r in rows], ["x", "y"]) == []


def test_fit_edge_cases(spark, documents, odd_texts):
    docs = documents(odd_texts)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, empty) == [] and quality.fit(docs.limit(0), empty) == []
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (4, None)], "doc_id long, quality int")
    assert quality.fit(docs, labels) == []
