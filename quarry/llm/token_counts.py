"""Token counts of whole texts without making token ids.

Each pre-token is counted once, however many documents hold it:

1. texts are cut into pre-tokens, block by block; a block of documents is one written row with,
   packed, each document's frequencies over the block's distinct pre-tokens, and those pre-tokens
   dealt into buckets by their checksum;
2. a bucket gathers its pre-tokens from all blocks and counts the pieces of each distinct one once
   (a bounded memory streams along, so a bucket of any size fits);
3. the counts return to their block, and each document's count is the sum of frequency times pieces.

What is shuffled is a block's distinct pre-tokens, not its words, so a common word costs one entry
a block; the packed frequencies travel once.  Blocks are bounded in rows and bytes (one longer text
is a block of its own).  The blocks are written, so both uses agree after a lost executor.

Defined results: null text counts as empty (0 bytes, 0 tokens); special strings inside a text count
one token each; rows that repeat are counted alike; extra columns are not returned.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.bpe import byte_chars
from quarry.llm.common import materialise
from quarry.llm.tokens import ship_vocabulary

BLOCK_ROWS = 4096
BLOCK_BYTES = 16 << 20
MAX_BUCKETS = 2048
KNOWN_WORDS = 1_000_000  # a task's memory of counted pre-tokens, emptied when full
BETWEEN = "\n"           # separates packed pre-tokens, which hold no white space
#: Fixed value: the pattern whose matches are the pre-tokens (what lies between is dropped).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


class WordCounter:
    """Pre-tokens of a lower-casing word vocabulary with byte-level pieces and word ends."""

    def __init__(self, spec: dict):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        special = [t["content"] for t in spec["added_tokens"] if not t["normalized"]]
        self.special = sorted(special, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if special else None
        self._find = regex.compile(SPLIT).findall
        self._chars = byte_chars()
        bare = spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None}
        self._model = Tokenizer.from_str(json.dumps(bare))

    def words(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a whole text, and how many special strings it holds."""
        found, specials = [text], 0
        if self._special and any(s in text for s in self.special):
            found = self._special.split(text)
            specials = len(found) - 1
        out = []
        for part in found:
            if not part.isascii():
                # lower-casing goes character by character: a final sigma is not special
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            out += self._find(part.lower())
        return out, specials

    def pieces(self, words: list[str]) -> list[int]:
        chars = self._chars
        texts = ["".join([chars[b] for b in w.encode()]) for w in words]
        return [len(e.ids) for e in self._model.encode_batch(texts, add_special_tokens=False)]


_LOADED: dict[str, WordCounter] = {}


def loaded(name: str) -> WordCounter:
    if name not in _LOADED:
        with open(SparkFiles.get(name), encoding="utf-8") as file:
            _LOADED[name] = WordCounter(json.load(file))
    return _LOADED[name]


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _spread(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _pack(values: list[int]) -> bytes:
    """Integers as squeezed unsigned 32-bit values."""
    return _squeeze(np.array(values, dtype="<u4").tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(_spread(blob), dtype="<u4").astype(np.int64)


def _block(ids: list, texts: list[str], counter: WordCounter, buckets: int) -> dict:
    rows, specials = [], []
    total: Counter = Counter()
    for text in texts:
        words, special = counter.words(text)
        rows.append(Counter(words))
        specials.append(special)
        total.update(rows[-1].keys())
    common = [w for w, _ in total.most_common()]
    place = {w: i for i, w in enumerate(common)}  # common words have small places
    starts, steps, times = [0], [], []
    for row in rows:
        own = sorted((place[w], n) for w, n in row.items())
        starts.append(starts[-1] + len(own))
        last = 0
        for p, n in own:
            steps.append(p - last)
            times.append(n)
            last = p
    dealt = [zlib.crc32(w.encode()) % buckets for w in common]
    members = defaultdict(list)
    for word, bucket in zip(common, dealt):
        members[bucket].append(word)
    parts = [{"bucket": b, "words": _squeeze(BETWEEN.join(w).encode())} for b, w in members.items()]
    return {"ids": ids, "n_bytes": [len(t.encode()) for t in texts], "specials": specials, "parts": parts,
            "dealt": _pack(dealt), "starts": _pack(starts), "steps": _pack(steps), "times": _pack(times)}


def blocks(docs: DataFrame, name: str, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """One written row for each block of documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"ids array<{kind}>, n_bytes array<bigint>, specials array<int>, "
              "parts array<struct<bucket:int,words:binary>>, dealt binary, starts binary, steps binary, times binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(name)
        for batch in batches:
            types = pa.schema([("ids", pa.list_(batch.column(0).type)), ("n_bytes", pa.list_(pa.int64())),
                               ("specials", pa.list_(pa.int32())),
                               ("parts", pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))),
                               *[(c, pa.binary()) for c in ("dealt", "starts", "steps", "times")]])
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if len(ids) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([_block(ids, texts, counter, buckets)], schema=types)
                    ids, texts, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_pylist([_block(ids, texts, counter, buckets)], schema=types)

    cut = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
    return materialise(cut.withColumn("block", F.monotonically_increasing_id()), "token-blocks")


def piece_counts(parts: DataFrame, name: str) -> DataFrame:
    """(block, bucket, pieces) for the pre-tokens of ``parts`` (block, bucket, words), bucket by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = loaded(name), {}
        for batch in batches:
            out = []
            for blob in batch.column("words"):
                words = _spread(blob.as_py()).decode().split(BETWEEN)
                if len(known) > KNOWN_WORDS:
                    known = {}
                new = [w for w in words if w not in known]
                known.update(zip(new, counter.pieces(new)))
                out.append(_pack([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())],
                                             ["block", "bucket", "pieces"])

    return parts.repartition("bucket").mapInArrow(run, "block long, bucket int, pieces binary")


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8) and n_tokens of every row of ``docs``."""
    spark = docs.sparkSession
    name = ship_vocabulary(spark, path)
    buckets = min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    written = blocks(docs, name, id_col, text_col, buckets)
    parts = written.select("block", F.explode("parts").alias("part")).select("block", "part.*")
    counted = piece_counts(parts, name).groupBy("block").agg(F.collect_list(F.struct("bucket", "pieces")).alias("counted"))
    both = written.drop("parts").join(counted, "block", "left")
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("n_bytes", LongType()),
                         StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                totals = np.array(row["specials"].values, dtype=np.int64)
                if row["counted"].is_valid:
                    totals = totals + _sums(row)
                yield pa.RecordBatch.from_arrays([row["ids"].values, row["n_bytes"].values, pa.array(totals, pa.int64())],
                                                 [id_col, "n_bytes", "n_tokens"])

    return both.mapInArrow(run, schema)


def _sums(row: dict) -> np.ndarray:
    """Each document's frequencies times pieces, from the block's packed rows."""
    starts, steps, times, dealt = (_unpack(row[c].as_py()) for c in ("starts", "steps", "times", "dealt"))
    pieces_at = np.zeros(len(dealt), dtype=np.int64)
    order = np.argsort(dealt, kind="stable")  # a bucket lists its words in the order of their places
    first = np.searchsorted(dealt[order], np.arange(dealt.max() + 2)) if len(dealt) else []
    for part in row["counted"].as_py():
        pieces_at[order[first[part["bucket"]]:first[part["bucket"] + 1]]] = _unpack(part["pieces"])
    places = np.cumsum(steps)
    firsts = starts[:-1][starts[:-1] < starts[1:]]  # each document's places start again from 0
    shift = np.zeros(len(steps), dtype=np.int64)
    if len(firsts):
        before = np.concatenate([[0], places])[firsts]
        shift[firsts] = np.diff(np.concatenate([[0], before]))
    upto = np.concatenate([[0], np.cumsum(times * pieces_at[places - np.cumsum(shift)])])
    return upto[starts[1:]] - upto[starts[:-1]]
