"""Removal of repeated byte strings by a sparse suffix array, merged across tasks.

A byte goes if a LENGTH-byte string that covers it also starts somewhere else, in the same or
another document (texts as UTF-8; strings do not cross documents; overlaps count; all are judged
on the input).

* Suffixes start at anchors (``anchors.py``).  Every LENGTH-byte string has an anchor among its
  first WINDOW bytes, at the same offset in each of its occurrences, so comparing the suffixes of
  anchors, and what stands left of them, finds every repetition.
* Distributed duplicate detection first: of every anchor the hash of the RIGHT bytes that any
  match must share goes, packed, to a bucket, and comes back as one bit.  Anchors whose hash
  occurs once cannot match.
* The others' suffixes are sorted in their task (equal ones with equal left sides are one, with a
  flag), cut at splitters from a sample, sent as front-coded runs and merged with loser trees that
  never compare a known prefix again (``lcp_merge.py``).
* Around an anchor p, the repeated strings at offset o before p are those that agree with another
  entry on o bytes to the left and LENGTH - o to the right.  Right sides are classed by the common
  prefixes of the merged order, left sides by a sort of their own; entries that share both classes
  repeat.  All these strings contain p, so the least and the largest such o give the bytes to remove.
* Entries whose RIGHT bytes are those of LARGE entries or more (a passage shared by many documents)
  are not merged.  For each of their offsets the 128-bit digest of offset and LENGTH-byte string
  goes, packed and once a chunk of a block, to a bucket, and comes back as one bit.

Scale.  What is exchanged is 8 bytes for each distinct anchor key of a block, then the runs of
repeated places only, and in large classes 16 bytes for each distinct string and offset of a chunk.
An anchor with any number of copies is one entry a block only where its LENGTH bytes and the
WINDOW - 1 before agree; other surroundings make other entries of the same class.  Groups are
buckets of keys, or ranges of suffixes cut between classes, so one class that stays in the merge is
the least range: under LARGE entries counted, and one more a block (a block reports the classes of
which it has two), of LENGTH + WINDOW - 1 bytes at most.  The others hold RANGE_ENTRIES entries on
average, however many blocks there are: a block offers suffixes at random places of its order (at the
same places of each block they would lie at a few points of the whole order, and the ranges between
these would grow with the input), each for as many entries as it stands for.  Texts are shuffled
twice, by document.  The blocks and the spans are written, so a lost executor costs its tasks only;
what went into them is deleted, scratch and shuffle files, so the disk holds one step at a time.

Defined results: null text is empty; texts under LENGTH bytes keep all their bytes; repeated rows
are documents of their own, so all their bytes go if they are long enough; rows that share an id
are told apart by their text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.anchors import anchors
from quarry.llm.common import discard, materialise
from quarry.llm.lcp_merge import common_prefix, merge, pack_run, unpack_run
from quarry.llm.token_counts import _pack, _spread, _squeeze, _unpack

LENGTH = 200
WINDOW = 96
RIGHT = LENGTH - WINDOW + 1   # bytes from an anchor on that two occurrences have in common at least
BLOCK_ROWS, BLOCK_BYTES = 2000, 2 << 20
SAMPLE, STRATUM = 8, 2048     # suffixes a block offers as splitters at least, entries for one of them at most
MAX_SAMPLE = 40_000           # of which the driver sees this many, by hash order
RANGE_ENTRIES = 100_000       # entries of a range on average, at most; a task takes some 750 bytes for each
LARGE = 4096                  # entries from which on a class of equal RIGHT bytes is not merged
CHUNK = 4096                  # entries of large classes handled at once
OFFSETS = [bytes([o]) for o in range(WINDOW)]
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, name: str) -> DataFrame:
    """``materialise``d; the shuffle files of that job, which nothing else reads, are deleted."""
    conf = df.sparkSession.conf
    given = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return materialise(df, name)
    finally:
        conf.set(CLEANUP, given)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where they reach BLOCK_ROWS rows or BLOCK_BYTES of text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text").cast(pa.large_binary())).fill_null(0).to_pylist()
        first, held = 0, 0
        for i, size in enumerate(sizes):
            held += size
            if i + 1 - first >= BLOCK_ROWS or held >= BLOCK_BYTES:
                yield batch.slice(first, i + 1 - first)
                first, held = i + 1, 0
        if first < batch.num_rows:
            yield batch.slice(first)


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t.as_py() or b"" for t in batch.column("text").cast(pa.large_binary())]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text); h tells texts of one id apart."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def _anchor_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Written, one row a block: its documents, their anchors, and the anchors' keys by bucket."""
    id_type = docs.schema["id"].dataType.simpleString()
    schema = (f"rows array<struct<id:{id_type},h:bigint>>, counts binary, places binary, ranks binary, "
              "parts array<struct<bucket:int,first:int,keys:binary,twice:binary>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            texts = _bytes(batch)
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            places, keys = anchors(np.frombuffer(b"".join(texts), dtype=np.uint8), sizes, WINDOW, RIGHT)
            ends = np.cumsum(sizes)
            owner = np.searchsorted(ends, places, side="right")
            bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
            order = np.lexsort((keys, bucket))
            ordered = keys[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, bool)
            distinct = np.cumsum(new) - 1
            ranks = np.empty(len(keys), dtype=np.int64)
            ranks[order] = distinct
            unique, twice = ordered[new], np.bincount(distinct, minlength=int(new.sum())) > 1
            unique_bucket = bucket[order][new].astype(np.int64)
            cuts = np.flatnonzero(np.diff(unique_bucket, prepend=-1)).tolist()
            parts = [{"bucket": int(unique_bucket[a]), "first": a, "keys": unique[a:b].tobytes(), "twice": np.packbits(twice[a:b]).tobytes()}
                     for a, b in zip(cuts, [*cuts[1:], len(unique)])]
            row = {"rows": [{"id": i, "h": h} for i, h in zip(batch.column("id").to_pylist(), batch.column("h").to_pylist())],
                   "counts": _pack(np.bincount(owner, minlength=len(texts))), "places": _pack(places - (ends - sizes)[owner]),
                   "ranks": _pack(ranks), "parts": parts}
            types = pa.schema([("rows", pa.list_(pa.struct([("id", batch.column("id").type), ("h", pa.int64())]))),
                               *[(c, pa.binary()) for c in ("counts", "places", "ranks")],
                               ("parts", pa.list_(pa.struct([("bucket", pa.int32()), ("first", pa.int32()),
                                                             ("keys", pa.binary()), ("twice", pa.binary())])))])
            yield pa.RecordBatch.from_pylist([row], schema=types)

    return _written(docs.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), "suffix-anchors")


def _repeated_bits(t: pa.Table, kind: str) -> tuple[list[int], list[bytes]]:
    """For each row of keys how many they are, and a bit for each, set if the key occurs twice or more."""
    keys = [np.frombuffer(k.as_py(), dtype=kind) for k in t.column("keys")]
    sizes = [len(k) for k in keys]
    twice = np.concatenate([np.unpackbits(np.frombuffer(b.as_py(), dtype=np.uint8), count=n).astype(bool)
                            for b, n in zip(t.column("twice"), sizes)])
    joined = np.concatenate(keys)
    order = np.argsort(joined, kind="stable")
    ordered = joined[order]
    same = ordered[1:] == ordered[:-1]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return sizes, [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum(sizes)[:-1])]


def _repeated_keys(t: pa.Table) -> pa.Table:
    """For a bucket of keys: the bits of each block's keys."""
    sizes, bits = _repeated_bits(t, "<u8")
    return pa.table({"block": t.column("block"), "first": t.column("first"), "size": pa.array(sizes, pa.int32()),
                     "bits": pa.array(bits, pa.binary())})


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """(id, h, places): documents with anchors that may match, their byte places packed; ``scratch`` is what they are read from."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _anchor_blocks(docs, buckets)
    keys = blocks.select("block", F.inline("parts"))
    bits = keys.groupBy("bucket").applyInArrow(_repeated_keys, "block long, first int, size int, bits binary") \
        .groupBy("block").agg(F.collect_list(F.struct("first", "size", "bits")).alias("bits"))
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                counts, places, ranks = (_unpack(row[c].as_py()) for c in ("counts", "places", "ranks"))
                known = np.zeros(int(ranks.max()) + 1, dtype=bool)
                for part in row["bits"].as_py():
                    known[part["first"]:part["first"] + part["size"]] = np.unpackbits(
                        np.frombuffer(part["bits"], dtype=np.uint8), count=part["size"])
                hit = known[ranks]
                owner = np.repeat(np.arange(len(counts)), counts)[hit]
                cuts = np.cumsum(np.bincount(owner, minlength=len(counts)))
                own = np.split(places[hit], cuts[:-1])
                held = np.flatnonzero([len(x) for x in own])
                rows = row["rows"].values.take(pa.array(held))
                yield pa.RecordBatch.from_arrays([rows.field("id"), rows.field("h"), pa.array([_pack(own[x]) for x in held], pa.binary())],
                                                 ["id", "h", "places"])

    found = blocks.drop("parts").join(bits, "block").drop("block") \
        .mapInArrow(run, f"id {id_type}, h long, places binary")
    found.scratch = blocks
    return found


def _class(suffix: bytes) -> int:
    """A number for the RIGHT bytes of a suffix."""
    return int.from_bytes(hashlib.blake2b(suffix[:RIGHT], digest_size=8).digest(), "little", signed=True)


def _sample(suffixes: list[bytes], run: bytes) -> list[dict]:
    """Of each of a sorted block's equal strata a suffix at random, and how many entries it stands for."""
    strata = max(SAMPLE, -(-len(suffixes) // STRATUM))
    seed = int.from_bytes(hashlib.blake2b(run, digest_size=8).digest(), "little")  # a task that is run again draws the same
    places = ((np.arange(strata) + np.random.default_rng(seed).random(strata)) * len(suffixes) / strata).astype(np.int64)
    return [{"s": suffixes[p][:RIGHT], "n": len(suffixes) / strata} for p in np.minimum(places, len(suffixes) - 1).tolist()]


def _suffix_blocks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Written, one row a block of documents with repeated anchors: for each anchor its entry, and the
    entries as one sorted run (suffix, what stands left of it, whether it occurs twice in the block), how
    many they are and a sample of them; the classes of RIGHT bytes that hold two entries or more."""
    once = found.dropDuplicates(["id", "h"]).toDF("_id", "_h", "places")
    joined = docs.join(once, docs["id"].eqNullSafe(once["_id"]) & (docs["h"] == once["_h"])).select("id", "h", "text", "places")
    id_type = docs.schema["id"].dataType.simpleString()
    schema = (f"rows array<struct<id:{id_type},h:bigint>>, counts binary, places binary, entries binary, run binary, n int, "
              "sample array<struct<s:binary,n:double>>, classes array<struct<class:bigint,n:int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            texts = _bytes(batch)
            own = [_unpack(p.as_py()).tolist() for p in batch.column("places")]
            seen: dict[tuple[bytes, bytes], int] = {}
            numbers, more = [], []
            for text, places in zip(texts, own):
                for p in places:
                    entry = (text[p:p + LENGTH], text[max(0, p - WINDOW + 1):p])
                    n = seen.setdefault(entry, len(seen))
                    if n == len(more):
                        more.append(1)
                    else:
                        more[n] = 2
                    numbers.append(n)
            listed = list(seen)
            order = sorted(range(len(listed)), key=listed.__getitem__)
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            suffixes = [listed[i][0] for i in order]
            packed = pack_run(suffixes, [listed[i][1] for i in order], np.array(more)[order])
            row = {"rows": [{"id": i, "h": h} for i, h in zip(batch.column("id").to_pylist(), batch.column("h").to_pylist())],
                   "counts": _pack([len(x) for x in own]), "places": _pack([p for x in own for p in x]),
                   "entries": _pack(place[numbers]), "run": packed, "n": len(suffixes), "sample": _sample(suffixes, packed),
                   "classes": [{"class": _class(x), "n": n} for x, n in Counter(x[:RIGHT] for x in suffixes).items() if n > 1]}
            types = pa.schema([("rows", pa.list_(pa.struct([("id", batch.column("id").type), ("h", pa.int64())]))),
                               *[(c, pa.binary()) for c in ("counts", "places", "entries", "run")], ("n", pa.int32()),
                               ("sample", pa.list_(pa.struct([("s", pa.binary()), ("n", pa.float64())]))),
                               ("classes", pa.list_(pa.struct([("class", pa.int64()), ("n", pa.int32())])))])
            yield pa.RecordBatch.from_pylist([row], schema=types)

    return _written(joined.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), "suffix-runs")


def _splitters(blocks: DataFrame, ranges: int, large: np.ndarray = np.empty(0, np.int64)) -> list[bytes]:
    """Fewer than ``ranges`` strings that cut the entries into about equal ranges, without those of large classes."""
    sample = blocks.select("block", F.posexplode("sample").alias("i", "drawn"))
    rows = sample.orderBy(F.xxhash64("block", "i")).limit(MAX_SAMPLE).select("drawn.s", "drawn.n").collect()
    left_out = set(large.tolist())
    found = sorted((s, r["n"]) for r in rows if _class(s := bytes(r["s"])) not in left_out)
    if not found:
        return []
    upto = np.cumsum([n for _, n in found])
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges, side="right")
    return sorted({found[i][0] for i in np.minimum(cuts, len(found) - 1).tolist()})


def _ranges(blocks: DataFrame) -> int:
    """As many ranges as there are shuffle partitions, more if these were too large."""
    entries = blocks.agg(F.sum("n")).first()[0] or 0
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // RANGE_ENTRIES))


def _large_classes(blocks: DataFrame) -> np.ndarray:
    """The classes of LARGE entries or more: at most one in LARGE entries, 8 bytes each."""
    found = blocks.select(F.inline("classes")).groupBy("class").agg(F.sum("n").alias("n")).where(F.col("n") >= LARGE)
    return np.array([r["class"] for r in found.select("class").collect()], dtype=np.int64)


def _in_large(shared: list[int], strings: list[bytes], large: np.ndarray) -> np.ndarray:
    """Whether each entry of a sorted run is of a large class."""
    if not len(large):
        return np.zeros(len(strings), dtype=bool)
    starts = np.flatnonzero(np.array(shared) < RIGHT)
    own = np.array([_class(strings[i]) for i in starts.tolist()], dtype=np.int64)
    return np.repeat(np.isin(own, large), np.diff(starts, append=len(strings)))


def _ranged_runs(blocks: DataFrame, splitters: list[bytes], large: np.ndarray) -> DataFrame:
    """(block, part, first, run): the runs cut at the splitters, without the entries of large classes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("run")):
                shared, strings, lefts, more = unpack_run(blob.as_py())
                out = _in_large(shared, strings, large)
                ends = [bisect_left(strings, s) for s in splitters]
                edges = sorted({0, *ends, *(np.flatnonzero(out[1:] != out[:-1]) + 1).tolist(), len(strings)})
                found = [(bisect_right(ends, a), a, b) for a, b in zip(edges, edges[1:]) if not out[a]]
                runs = [pack_run(strings[a:b], lefts[a:b], more[a:b]) for _, a, b in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(found), pa.int64()), pa.array([i for i, _, _ in found], pa.int32()),
                     pa.array([a for _, a, _ in found], pa.int32()), pa.array(runs, pa.binary())], ["block", "part", "first", "run"])

    return blocks.select("block", "run").mapInArrow(cut, "block long, part int, first int, run binary")


def _string_keys(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The LENGTH-byte strings around the entries of a run, by offset: each entry's first offset and number
    of offsets, the distinct keys of the strings, each string's key, and whether a key occurs twice."""
    _, suffixes, lefts, more = unpack_run(run)
    first = np.maximum(0, LENGTH - np.array(list(map(len, suffixes)), dtype=np.int64))
    count = np.maximum(0, np.minimum(WINDOW - 1, np.array(list(map(len, lefts)), dtype=np.int64)) - first + 1)
    found = []
    for left, suffix, a, n in zip(lefts, suffixes, first.tolist(), count.tolist()):
        whole, at = left + suffix, len(left)
        # with the offset: a string is met from each of its anchors
        found += [hashlib.blake2b(whole[at - o:at - o + LENGTH] + OFFSETS[o], digest_size=16).digest() for o in range(a, a + n)]
    keys, ranks = np.unique(np.array(found, dtype="S16"), return_inverse=True)
    twice = np.bincount(ranks, weights=np.repeat(more, count), minlength=len(keys)) >= 2
    return first, count, keys, ranks, twice


def _repeated_strings(t: pa.Table) -> pa.Table:
    """For a bucket of keys of strings: the bits of each chunk's keys."""
    sizes, bits = _repeated_bits(t, "S16")
    return pa.table({"block": t.column("block"), "chunk": t.column("chunk"), "first": t.column("first"),
                     "size": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary())})


def _large_offsets(blocks: DataFrame, large: np.ndarray) -> DataFrame:
    """(block, first, offsets) of the entries of large classes, as ``_merged`` gives them for the others."""
    buckets = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("run")):
                shared, strings, lefts, more = unpack_run(blob.as_py())
                at = np.flatnonzero(_in_large(shared, strings, large))
                chunks = [at[a:a + CHUNK] for a in range(0, len(at), CHUNK)]
                runs = [pack_run([strings[i] for i in x], [lefts[i] for i in x], more[x]) for x in chunks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(chunks), pa.int64()), pa.array(range(len(chunks)), pa.int32()),
                     pa.array([_pack(x) for x in chunks], pa.binary()), pa.array(runs, pa.binary())], ["block", "chunk", "at", "run"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, chunk, run in zip(batch.column("block").to_pylist(), batch.column("chunk").to_pylist(), batch.column("run")):
                _, _, keys, _, twice = _string_keys(run.as_py())
                # keys are in order, and so are their buckets
                bucket = (np.frombuffer(keys.tobytes(), dtype=">u4")[::4].astype(np.int64) * buckets) >> 32
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
                pairs = list(zip(cuts, [*cuts[1:], len(keys)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(pairs), pa.int64()), pa.array([chunk] * len(pairs), pa.int32()),
                     pa.array(bucket[cuts], pa.int32()), pa.array(cuts, pa.int32()),
                     pa.array([keys[a:b].tobytes() for a, b in pairs], pa.binary()),
                     pa.array([np.packbits(twice[a:b]).tobytes() for a, b in pairs], pa.binary())],
                    ["block", "chunk", "bucket", "first", "keys", "twice"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                at = _unpack(row["at"])
                first, count, keys, ranks, _ = _string_keys(row["run"])
                known = np.zeros(len(keys), dtype=bool)
                for part in row["bits"]:
                    known[part["first"]:part["first"] + part["size"]] = np.unpackbits(
                        np.frombuffer(part["bits"], dtype=np.uint8), count=part["size"])
                hit = np.flatnonzero(known[ranks])
                entry = np.repeat(np.arange(len(at)), count)
                offset = (np.arange(len(entry)) - (np.cumsum(count) - count - first)[entry])[hit]
                low, high = np.full(len(at), -1, dtype=np.int64), np.full(len(at), -1, dtype=np.int64)
                high[entry[hit]] = offset  # the last one stays
                low[entry[hit][::-1]] = offset[::-1]
                cuts = np.flatnonzero(np.diff(at, prepend=-2) != 1).tolist()
                blobs = [_squeeze(np.stack([low[a:b], high[a:b]]).astype(np.int8).tobytes()) for a, b in zip(cuts, [*cuts[1:], len(at)])]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(cuts), pa.int64()), pa.array(at[cuts], pa.int32()),
                                                  pa.array(blobs, pa.binary())], ["block", "first", "offsets"])

    chunks = blocks.select("block", "run").mapInArrow(pick, "block long, chunk int, at binary, run binary")
    bits = chunks.mapInArrow(deal, "block long, chunk int, bucket int, first int, keys binary, twice binary") \
        .groupBy("bucket").applyInArrow(_repeated_strings, "block long, chunk int, first int, size int, bits binary") \
        .groupBy("block", "chunk").agg(F.collect_list(F.struct("first", "size", "bits")).alias("bits"))
    return chunks.join(bits, ["block", "chunk"]).mapInArrow(take, "block long, first int, offsets binary")


def _offsets(shared: np.ndarray, rights: np.ndarray, lefts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest offset at which each entry's string repeats (-1: none).

    Entries are in the order of their suffixes; ``shared`` are the common prefixes with the entry
    before, ``rights`` the suffix lengths, ``weights`` 2 for an entry that occurs twice by itself.
    """
    n = len(rights)
    low, high = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    backward = [x[::-1] for x in lefts]
    order = sorted(range(n), key=backward.__getitem__)
    left_shared = np.array([0] + [common_prefix(backward[a], backward[b]) for a, b in zip(order, order[1:])], dtype=np.int64)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    left_length = np.array(list(map(len, lefts)), dtype=np.int64)
    for o in range(WINDOW):
        fits = np.flatnonzero((left_length >= o) & (rights >= LENGTH - o))
        if not len(fits):
            continue
        right_class = np.cumsum(shared < LENGTH - o)[fits]
        left_class = np.cumsum(left_shared < o)[place[fits]] if o else np.zeros(len(fits), dtype=np.int64)
        key = right_class * (n + 1) + left_class
        by_key = np.argsort(key, kind="stable")
        ordered = key[by_key]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group = np.cumsum(first) - 1
        repeated = np.zeros(len(fits), dtype=bool)
        repeated[by_key] = (np.bincount(group, weights=weights[fits][by_key]) >= 2)[group]
        hit = fits[repeated]
        high[hit] = o
        low[hit[low[hit] < 0]] = o
    return low, high


def _merged(t: pa.Table) -> pa.Table:
    """A range of suffixes: merges the blocks' runs, returns each run's offsets in its own order."""
    runs = [unpack_run(r.as_py()) for r in t.column("run")]
    order, prefix = merge([(r[0], r[1]) for r in runs])
    order, shared = np.array(order, dtype=np.int64), np.array(prefix, dtype=np.int64)
    shared[:1] = 0
    # each run's entries in the merged order
    mine = np.split(np.argsort(order, kind="stable"), np.cumsum([len(r[1]) for r in runs])[:-1])
    number, weights, rights = (np.empty(len(order), dtype=np.int64) for _ in range(3))
    for own, r in zip(mine, runs):
        number[own], weights[own], rights[own] = np.arange(len(own)), r[3], list(map(len, r[1]))
    # entries whose RIGHT bytes nobody else has, and that occur once, are out
    near = shared >= RIGHT
    group = np.cumsum(~near) - 1
    kept = (np.bincount(group, weights=weights) >= 2)[group] if len(group) else np.empty(0, bool)
    held = np.flatnonzero(kept)
    lefts = [runs[order[i]][2][number[i]] for i in held]
    low, high = np.full(len(order), -1, dtype=np.int64), np.full(len(order), -1, dtype=np.int64)
    # an entry left out shares less than RIGHT bytes with both neighbours, so no prefix is shortened
    low[held], high[held] = _offsets(shared[held], rights[held], lefts, weights[held])
    blobs = [_squeeze(np.stack([low[own], high[own]]).astype(np.int8).tobytes()) for own in mine]
    return pa.table({"block": t.column("block"), "first": t.column("first"), "offsets": pa.array(blobs, pa.binary())})


def _spans(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Disjoint spans (start, end) of the bytes to remove from a document, in order."""
    hit = high >= 0
    start, end = places[hit] - high[hit], places[hit] - low[hit] + LENGTH
    if not len(start):
        return np.empty((0, 2), dtype=np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[True], start[1:] > end[:-1]])  # spans that touch are one run
    last = np.append(np.flatnonzero(first)[1:] - 1, len(start) - 1)
    return np.stack([start[first], end[last]], axis=1)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Written (id, h, spans) of the documents (id, h, text) that lose bytes; spans are packed pairs."""
    found = repeated_anchors(docs)
    blocks = _suffix_blocks(docs, found)
    discard(found.scratch)
    large = _large_classes(blocks)
    splitters = _splitters(blocks, _ranges(blocks), large)
    merged = _ranged_runs(blocks, splitters, large).groupBy("part").applyInArrow(_merged, "block long, first int, offsets binary")
    if len(large):
        merged = merged.unionByName(_large_offsets(blocks, large))
    merged = merged.groupBy("block").agg(F.collect_list(F.struct("first", "offsets")).alias("offsets"))
    id_type = docs.schema["id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                counts, places, entries = (_unpack(row[c].as_py()) for c in ("counts", "places", "entries"))
                both = np.full((2, int(entries.max()) + 1), -1, dtype=np.int64)
                for part in row["offsets"].as_py():
                    values = np.frombuffer(_spread(part["offsets"]), dtype=np.int8).reshape(2, -1)
                    both[:, part["first"]:part["first"] + values.shape[1]] = values
                low, high = both[:, entries]
                ends = np.cumsum(counts)
                spans = [_spans(places[a:b], low[a:b], high[a:b]) for a, b in zip(ends - counts, ends)]
                held = [x for x, s in enumerate(spans) if len(s)]
                rows = row["rows"].values.take(pa.array(held, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.field("id"), rows.field("h"), pa.array([_pack(spans[x].ravel()) for x in held], pa.binary())],
                                                 ["id", "h", "spans"])

    spans = _written(blocks.drop("run", "n", "sample", "classes").join(merged, "block").drop("block")
                     .mapInArrow(gather, f"id {id_type}, h long, spans binary"), "suffix-spans")
    discard(blocks)
    return spans


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``id_col``, n_bytes, n_removed, n_spans, kept (the remaining bytes) and
    kept_sha256."""
    given = _documents(docs, id_col, text_col)
    # rows that repeat come back once each: one of them decides for all
    spans = repeated_spans(given).dropDuplicates(["id", "h"]).toDF("_id", "_h", "spans")
    both = given.join(spans, given["id"].eqNullSafe(spans["_id"]) & (given["h"] == spans["_h"]), "left") \
        .select(F.col("id").alias(id_col), "text", "spans")
    id_type = given.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, packed in zip(_bytes(batch), batch.column("spans")):
                pairs = _unpack(packed.as_py()).reshape(-1, 2).tolist() if packed.is_valid else []
                ends = [0, *[e for _, e in pairs]]
                kept = b"".join([text[a:b] for a, b in zip(ends, [*[s for s, _ in pairs], len(text)])])
                rows.append((len(text), len(text) - len(kept), len(pairs), kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             [id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return both.mapInArrow(run, f"{id_col} {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
