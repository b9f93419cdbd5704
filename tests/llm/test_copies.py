"""Exact dedup, the Jaccard join and removal of repeated byte strings, against brute force."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import dedup_exact, fuse, jaccard, lcp_merge, queries, suffix_dedup
from quarry.llm.components import components

from .conftest import LOWER, SF, WORDS, sha

nulls_first = lambda x: (x[0] is not None, x)


def by_id(rows):
    return sorted(rows, key=lambda r: repr((r[0] is not None, r)))


# -- exact dedup ---------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 100_000])
def test_filter_admits_its_keys_and_few_others(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    found = fuse.Filter.frombytes(fuse.build(np.concatenate([keys, keys])).tobytes())
    assert fuse.contains(found, keys).all()
    others = np.random.default_rng(10**6).integers(0, 2**63, 50_000).astype(np.uint64)
    assert fuse.contains(found, others).mean() < 0.008


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        ids = groups[(t or "").translate(LOWER)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), sha((t or "").translate(LOWER))))
    return out


def test_dedup_equals_brute_force(documents, odd_texts, monkeypatch):
    monkeypatch.setattr(dedup_exact, "BUCKET_KEYS", 40)  # several buckets and filters
    rnd = random.Random(5)
    rows = odd_texts + [(rnd.randrange(1000), rnd.choice(["Copy", "copy", "COPY É", "copy é", f"t{rnd.randrange(90)}"])) for _ in range(500)]
    out = dedup_exact.exact_dedup(documents(rows)).collect()
    assert by_id([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out]) == by_id(plain_dedup(rows))
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept) == {r.text_sha256 for r in out} and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_dedup_empty_and_one_sided(documents):
    empty = documents([(1, "a")]).limit(0)
    assert dedup_exact.exact_dedup(empty).count() == 0
    assert [r.kept for r in dedup_exact.exact_dedup(documents([(5, "a")])).collect()] == [True]


def test_screen_rules_out_most_new_digests(spark):
    rows = lambda a, b: dedup_exact.digests(spark.range(a, b).selectExpr("id as doc_id", "cast(id as string) as text"))
    snapshot = dedup_exact.build_snapshot(rows(0, 3000))
    new = dedup_exact._grouped(rows(2900, 6000))
    maybe = dedup_exact.screen(new, snapshot).agg(F.sum(F.col("maybe").cast("int")), F.count("*")).first()
    assert 100 <= maybe[0] <= 160 and maybe[1] == 3100


def test_drop_copies_keeps_one_of_each(documents, odd_texts):
    docs = documents(odd_texts)
    left = dedup_exact.drop_copies(docs)
    assert left.columns == docs.columns
    texts = [(r.text or "").translate(LOWER) for r in left.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {(t or "").translate(LOWER) for _, t in odd_texts}


# -- Jaccard join --------------------------------------------------------------------------------

def plain_components(rows, width, threshold):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[j:j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for t in s for j in holders[t])
        for j, n in common.items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for t in s:
            holders[t].append(i)
    least = {}
    for x, (i, _) in enumerate(rows):
        ids = [v for v in (least.get(root(x)), i) if v is not None]
        least[root(x)] = min(ids, default=None)
    return [(i, len(sets[x]), least[root(x)]) for x, (i, _) in enumerate(rows)]


def near_copies(seed, groups=25, n=420):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(1, 70))] for _ in range(groups)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base)) + (passage if i % 3 == 0 else [])
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("width,threshold,frequent,small", [(4, 85, 6, 12), (5, 80, 32, 48)])
def test_join_equals_brute_force(documents, odd_texts, monkeypatch, width, threshold, frequent, small):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)   # combinations, and further rounds of stars
    monkeypatch.setattr(jaccard, "SMALL_KEY", small)
    rows = near_copies(width) + [(1000 + (i or 0) if i is not None else None, t) for i, t in odd_texts]
    out = jaccard.jaccard_join(documents(rows), width=width, threshold=threshold).collect()
    assert by_id([tuple(r) for r in out]) == by_id(plain_components(rows, width, threshold))


def test_join_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert by_id([tuple(r) for r in queries.op8(spark, SF).collect()]) == by_id(plain_components(rows, 4, 85))


def test_join_of_nothing(documents):
    assert jaccard.jaccard_join(documents([(1, "a")]).limit(0)).count() == 0
    assert sorted(map(tuple, jaccard.jaccard_join(documents([(1, None), (2, "")])).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_partners_always_share_a_key():
    """Random pairs at or above the threshold, whatever shingles count as frequent."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        n, threshold = int(rng.integers(2, 120)), int(rng.choice([80, 85]))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = x[rng.random(len(x)) < 0.95]
        y = np.unique(np.concatenate([y, rng.integers(0, 2**63, int(rng.integers(0, 5))).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if not len(y) or 100 * common < threshold * (len(x) + len(y) - common) or len(x) == len(y) == common:
            continue
        frequent = np.sort(x[rng.random(len(x)) < rng.random() * 1.2])
        keys = [np.concatenate(jaccard.index_keys(s, frequent, threshold)[:2]) for s in (x, y)]
        assert len(np.intersect1d(*keys)), (len(x), len(y), common)


def test_components(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    out = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[i] == 0 for i in range(1, 41)) and 0 not in out
    for a, b in edges:
        assert out.get(a, a) == out.get(b, b)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- repeated byte strings -----------------------------------------------------------------------

def test_merge_keeps_order_and_prefixes():
    rnd = random.Random(4)
    for _ in range(300):
        runs = []
        for _ in range(rnd.randint(1, 9)):
            strings = sorted("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 8))).encode() for _ in range(rnd.randint(0, 12)))
            blob = lcp_merge.pack_run(strings, [b"x"] * len(strings), np.ones(len(strings)))
            shared, back, extra, flags = lcp_merge.unpack_run(blob)
            assert back == strings and len(extra) == len(flags) == len(strings)
            runs.append((shared, back))
        order, prefix = lcp_merge.merge(runs)
        heads = [iter(r[1]) for r in runs]
        out = [next(heads[i]) for i in order]
        assert out == sorted(s for r in runs for s in r[1])
        assert all(p == lcp_merge.common_prefix(a, b) for p, a, b in zip(prefix[1:], out, out[1:]))


def plain_removal(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[j:j + length] for _, b in data for j in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for j in range(len(b) - length + 1):
            if times[b[j:j + length]] > 1:
                gone[j:j + length] = True
        spans = int(np.count_nonzero(gone[1:] < gone[:-1]))
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]))))
    return out


def passages(seed):
    rnd = random.Random(seed)
    text = lambda n, a="abcdefghij éß": "".join(rnd.choice(a) for _ in range(n))
    shared = [text(rnd.randint(150, 420)) for _ in range(12)]
    rows = []
    for i in range(200):
        out = ""
        for _ in range(rnd.randint(0, 6)):
            p, a, b = rnd.choice(shared), rnd.randint(0, 60), rnd.randint(0, 60)
            out += p[a:len(p) - b] if rnd.random() < 0.5 else text(rnd.randint(0, 150))
        rows.append((i, out))
    whole = text(3000)
    rows += [(300, whole), (301, whole[:1500] + "#" + whole[1500:]), (302, whole[:199]), (303, whole[5:205]), (304, whole[-200:]),
             (305, whole[:250] + text(50) + whole[100:350]), (306, "a" * 500), (307, "a" * 199), (308, "a" * 200), (309, "ab" * 400),
             (310, "Word " * 300), (311, "Word " * 200), (312, text(20_000)), (313, "q" * 200), (314, "s" * 201)]
    return rows


def test_removal_equals_brute_force(documents, odd_texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 5000)  # many runs to merge
    rows = passages(6) + [(1000 + i if i is not None else None, (t or "")[:3000] if t else t) for i, t in odd_texts]
    out = suffix_dedup.remove_repeats(documents(rows)).collect()
    assert by_id([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out]) == by_id(plain_removal(rows))
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in out)


def test_passage_in_many_documents_is_not_one_range(documents, monkeypatch):
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefghij éß") for _ in range(n))
    short, long, pair = text(180), text(260), text(90)  # no anchor of ``short`` has equal surroundings
    rows = [(i, text(rnd.randint(0, 150)) + rnd.choice([short, long, long[:215], short + pair + "x" * (i % 3)])
             + (long if i % 5 == 0 else "") + text(rnd.randint(0, 150))) for i in range(400)]
    rows += [(1000 + i, long[:120] + text(i % 40) + long[100:] + t) for i, (_, t) in enumerate(rows[:40])] + [(7, rows[7][1])]
    docs = documents(rows)
    given = suffix_dedup._documents(docs, "doc_id", "text")
    blocks = suffix_dedup._suffix_blocks(given, suffix_dedup.repeated_anchors(given))
    monkeypatch.setattr(suffix_dedup, "LARGE", 20)
    large = suffix_dedup._large_classes(blocks)
    splitters = suffix_dedup._splitters(blocks, 50)

    def largest_range(left_out):
        held = Counter()
        for r in suffix_dedup._ranged_runs(blocks, splitters, left_out).collect():
            held[r.part] += len(lcp_merge.unpack_run(bytes(r.run))[1])
        return max(held.values())

    # a range holds the whole class if the class is merged
    assert largest_range(large) < 50 and largest_range(large[:0]) >= 200
    out = suffix_dedup.remove_repeats(docs).collect()
    assert by_id([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out]) == by_id(plain_removal(rows))


def test_ranges_are_even_however_many_blocks(documents, spark):
    rnd = random.Random(10)
    texts = ["".join(rnd.choices("abcdefghij ", k=4000)) for _ in range(500)]
    given = suffix_dedup._documents(documents([(i, texts[i % 500]) for i in range(1000)]), "doc_id", "text")
    confs = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)  # a block for each partition
        blocks = suffix_dedup._suffix_blocks(given, suffix_dedup.repeated_anchors(given))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert blocks.count() == 48
    # the blocks' entries are of one distribution: their quantiles are at about the same places of the whole order
    splitters = suffix_dedup._splitters(blocks, 48)
    held = Counter()
    for r in suffix_dedup._ranged_runs(blocks, splitters, np.empty(0, np.int64)).collect():
        held[r.part] += len(lcp_merge.unpack_run(bytes(r.run))[1])
    assert max(held.values()) < 2.7 * sum(held.values()) / 48


def test_splitters_cut_what_is_merged(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE", 20)
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choices("abcdefghij ", k=n))
    common, pairs = [text(190) for _ in range(40)], [text(600) for _ in range(100)]  # large classes, and what is merged
    rows = [(i, "".join(common[(i * 8 + j) % 40] + text(30) for j in range(8)) + pairs[i % 100]) for i in range(200)]
    given = suffix_dedup._documents(documents(rows), "doc_id", "text")
    blocks = suffix_dedup._suffix_blocks(given, suffix_dedup.repeated_anchors(given))
    large = suffix_dedup._large_classes(blocks)
    monkeypatch.setattr(suffix_dedup, "RANGE_ENTRIES", 50)
    ranges = suffix_dedup._ranges(blocks)
    assert len(large) >= 20 and ranges >= blocks.agg({"n": "sum"}).first()[0] / 50
    is_large = lambda splitters: [suffix_dedup._class(s) in large.tolist() for s in splitters]
    assert any(is_large(suffix_dedup._splitters(blocks, ranges)))
    assert is_large(found := suffix_dedup._splitters(blocks, ranges, large)) == [False] * len(found) and found


def test_more_ranges_than_partitions_and_no_scratch_is_left(documents, spark, monkeypatch):
    written = []
    kept = suffix_dedup.materialise
    monkeypatch.setattr(suffix_dedup, "materialise", lambda *a: written.append(kept(*a)) or written[-1])
    monkeypatch.setattr(suffix_dedup, "RANGE_ENTRIES", 5)
    rows = passages(12)
    out = suffix_dedup.remove_repeats(documents(rows)).collect()
    assert by_id([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out]) == by_id(plain_removal(rows))
    there = [os.path.exists(re.sub("^file:/*", "/", df.written_path)) for df in written]
    assert there == [False, False, True]  # anchors, runs, spans
    assert spark.conf.get(suffix_dedup.CLEANUP) == "false"


@pytest.mark.parametrize("large", [2, 10**9])
def test_merge_and_keys_of_large_classes_agree(documents, odd_texts, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    rows = passages(9) + [(1000 + i if i is not None else None, (t or "")[:3000] if t else t) for i, t in odd_texts]
    out = suffix_dedup.remove_repeats(documents(rows)).collect()
    assert by_id([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out]) == by_id(plain_removal(rows))


def test_removal_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert by_id([tuple(r) for r in queries.op10(spark, SF).collect()]) == by_id(plain_removal(rows))


def test_removal_of_nothing(documents):
    assert suffix_dedup.remove_repeats(documents([(1, "a")]).limit(0)).count() == 0
    assert [r.n_removed for r in suffix_dedup.remove_repeats(documents([(1, None), (2, "a" * 100)])).collect()] == [0, 0]


def test_segments_do_not_change_anchors(monkeypatch):
    from quarry.llm import anchors as a
    data = np.random.default_rng(1).integers(97, 101, 30_000).astype(np.uint8)
    sizes = np.array([10_000, 0, 5, 19_995])
    whole = a.anchors(data, sizes, 96, 105)
    monkeypatch.setattr(a, "SEGMENT", 700)
    for x, y in zip(whole, a.anchors(data, sizes, 96, 105)):
        assert np.array_equal(x, y)
