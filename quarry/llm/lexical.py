"""Ranked lexical search: the k best documents of every query, term at a time with limited accumulators.

Index.  Documents are cut into blocks where they are read.  A block is one row: its ids, their
lengths, and the postings (document, tf) of the terms that some query has, packed by term.  The
counts of the corpus (documents, terms, df) are sums over the index, so they cover every document.

Search.  Each block serves all queries.  A query takes its terms rarest first.  While the bounds
of the terms still to come (the largest contribution of each in the block) can lift a new document
to the kth best score known, postings open accumulators; from then on they only update those there
are, exactly.  The kth best score known is that among the block's partial scores or among the
results of the blocks a task has had before, whichever is higher.  Every task keeps k results a
query, and these are ranked once more across tasks.

Scores are 64-bit integers: with N documents that hold a term, L terms in all, n terms in the
document, df documents holding a term and tf of its occurrences,
``m = 100 - B + (B * n * N) div L`` and the score adds ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``
over the query's distinct terms, w = floor(1000 * ln((2N + 2) / (2 df + 1))) (k1 = 0.8, b = 0.9).

Scale.  Texts are read once and never shuffled.  Queries travel in blocks of about QUERY_BYTES,
measured, not assumed; each block of queries has an index of its own.

Defined results: null and term-less texts hold no term and are never found; a query without terms
finds nothing; rows of one item id are one query (all their terms), a null item id included;
documents that repeat are ranked each; equal scores go by id, null ids last; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, materialise
from quarry.llm.terms import cut, slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
B = 90                    # per cent of the length normalisation
QUERY_BYTES = 4 << 20     # of distinct query terms that are searched together
GROUP = 1 << 24           # bytes of text in one block of the index, about


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Written (no, item, terms, bytes): every item id with its distinct terms; ``no`` is unique."""
    terms = F.array_remove(F.split(F.regexp_replace(ascii_lower(F.col(text_col)), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(" ")), " "), "")
    by_item = items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(terms)).alias("term")) \
        .groupBy("item").agg(F.collect_set("term").alias("terms"))
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 16)
    return materialise(by_item.select(F.monotonically_increasing_id().alias("no"), "item", "terms", size.alias("bytes")), "search-queries")


def _dealt(queries: DataFrame, query_bytes: int) -> tuple[DataFrame, int]:
    """``queries`` with a column block, so that a block has at most ``query_bytes`` or holds one query."""
    total = queries.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-2 * total // query_bytes)) if total > query_bytes else 1
    while True:
        dealt = queries.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)))
        over = dealt.groupBy("block").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).filter((F.col("b") > query_bytes) & (F.col("n") > 1))
        if over.isEmpty():
            return dealt, blocks
        blocks *= 2


def build_index(docs: DataFrame, vocabulary: list[str], group: int = GROUP) -> DataFrame:
    """Written blocks (n_docs, n_terms, ids, lengths, term, df, place, tf) of ``docs`` (id, text).

    ``term`` numbers the vocabulary's terms that occur, ``df`` counts their postings, which follow one
    another in ``place`` (the document's place in ``ids``) and ``tf``.  Documents without any of the
    terms are only counted.
    """
    kind = docs.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most QUERY_BYTES, or one query

    def postings(batch: pa.RecordBatch, words: pa.Array) -> tuple:
        lengths, found = np.zeros(batch.num_rows, np.int64), []
        at = 0
        for part in slices(batch, "text"):
            row, term = cut(part.column("text"))
            lengths[at:at + part.num_rows] = np.bincount(row, minlength=part.num_rows)
            number = pc.index_in(term, words)
            known = pc.is_valid(number).to_numpy(zero_copy_only=False)
            pair = pc.fill_null(number, 0).to_numpy()[known].astype(np.int64) << 32 | (row[known].astype(np.int64) + at)
            found.append(np.unique(pair, return_counts=True))
            at += part.num_rows
        pair, tf = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(pair, kind="stable")
        return lengths, pair[order] >> 32, pair[order] & 0xFFFFFFFF, tf[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(sent.value, pa.large_string())
        for batch in batches:
            if not batch.num_rows:
                continue
            for some in slices(batch, "text") if batch.nbytes > 2 * group else [batch]:
                lengths, term, place, tf = postings(some, words)
                numbers, df = np.unique(term, return_counts=True)
                held, where = np.unique(place, return_inverse=True)
                lists = [some.column("id").take(pa.array(held)), pa.array(lengths[held]), pa.array(numbers.astype(np.int32)),
                         pa.array(df.astype(np.int32)), pa.array(where.astype(np.int32)), pa.array(tf.astype(np.int64))]
                row = [pa.array([int(np.count_nonzero(lengths))]), pa.array([int(lengths.sum())])]
                row += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                yield pa.RecordBatch.from_arrays(row, ["n_docs", "n_terms", "ids", "lengths", "term", "df", "place", "tf"])

    schema = f"n_docs long, n_terms long, ids array<{kind}>, lengths array<long>, term array<int>, df array<int>, place array<int>, tf array<long>"
    return materialise(docs.mapInArrow(run, schema), "search-index")


def _kth(scores: np.ndarray, k: int) -> int:
    """The kth best of ``scores`` (0 if there are fewer)."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def accumulate(terms: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, known: int) -> np.ndarray:
    """Scores of a block's ``size`` documents for one query whose ``terms`` (places, contributions) come
    rarest first.  A document has its whole score, or 0 if it cannot be among the best k, whose last
    has ``known`` at least."""
    most = np.array([int(c.max(initial=0)) for _, c in terms], dtype=np.int64)
    remaining = np.cumsum(most[::-1])[::-1]
    acc, open_ = np.zeros(size, np.int64), True
    for (place, gain), left in zip(terms, remaining.tolist()):
        if open_ and left < known:
            open_ = False
        if open_:
            acc[place] += gain
            if left > known:  # else the bounds close at the next term anyhow
                known = max(known, _kth(acc, k))
        else:
            there = acc[place] > 0
            acc[place[there]] += gain[there]
    return acc


def _search(index: DataFrame, queries: list[tuple[int, list[int]]], weights: list[int], df: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(no, id, score): the best k of every query in each task."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    sent = index.sparkSession.sparkContext.broadcast((queries, weights, df))  # bounded as the vocabulary is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, df = sent.value
        ordered = [(no, sorted(terms, key=lambda t: (df[t], t))) for no, terms in queries]
        best = {no: np.empty(0, np.int64) for no, _ in queries}
        kept = defaultdict(list)
        kind = None
        for batch in batches:
            kind = batch.column("ids").type.value_type
            for b in range(batch.num_rows):
                ids, lengths, term, held, place, tf = (batch.column(c)[b].values for c in ("ids", "lengths", "term", "df", "place", "tf"))
                lengths, term, held, place, tf = (x.to_numpy(zero_copy_only=False) for x in (lengths, term, held, place, tf))
                m = 100 - B + (B * lengths * n_docs) // max(n_terms, 1)
                gain = np.repeat(np.array(weights, np.int64)[term], held) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[place]))
                ends = np.cumsum(held)
                post = {t: (place[e - h:e], gain[e - h:e]) for t, e, h in zip(term.tolist(), ends.tolist(), held.tolist())}
                for no, terms in ordered:
                    mine = [post[t] for t in terms if t in post]
                    if not mine:
                        continue
                    known = _kth(best[no], k)
                    scores = accumulate(mine, len(ids), k, known)
                    hits = np.flatnonzero(scores >= max(known, 1))
                    if len(hits) > k:
                        hits = hits[scores[hits] >= _kth(scores[hits], k)]
                    if len(hits):
                        best[no] = np.sort(np.concatenate([best[no], scores[hits]]))[-k:]
                        kept[no] = _first([*kept[no], *zip(scores[hits].tolist(), ids.take(pa.array(hits)).to_pylist())], k)
        rows = [(no, i, s) for no, found in kept.items() for s, i in found]
        if rows:
            no, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(ids, kind), pa.array(scores, pa.int64())], ["no", "id", "score"])

    return index.mapInArrow(run, f"no long, id {kind}, score long")


def _first(found: list[tuple], k: int) -> list[tuple]:
    """The best k of (score, id): high scores first, then small ids, null ids last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           query_col: str = "text", k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(``item_col``, rank, ``id_col``, score): the ``k`` best documents with a score above 0 of every item."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt, blocks = _dealt(query_terms(items, item_col, query_col), query_bytes)
    found = None
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).select("no", "terms").collect()  # at most query_bytes, or one query
        if not rows and found is not None:
            continue
        vocabulary = sorted({t for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(vocabulary)}
        index = build_index(docs, vocabulary)
        total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
        held = index.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).collect()  # a row a term
        df = [0] * len(vocabulary)
        for r in held:
            df[r["term"]] = r["df"]
        n_docs, n_terms = total["n"] or 0, total["l"] or 0
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df]
        part = _search(index, [(r["no"], [number[t] for t in r["terms"]]) for r in rows], weights, df, n_docs, n_terms, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(dealt.select("no", "item"), "no") \
        .select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
