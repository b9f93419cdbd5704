"""The prefix trie of conversations, by collapsing whole sequences.

A conversation is a sequence of turns (role, text).  Its prefixes are nodes; conversations that
begin alike share them.  The trie is never walked:

1. Identical conversations collapse into one weighted sequence with the list of conversations that
   end there.
2. Every prefix of a sequence gets a key, the running XOR of 2 x 60 bits of a SHA-256 digest of
   (place, turn).  A sequence whose key is a proper prefix of another falls out by an anti-join;
   what stays are the leaves.
3. Weighted prefixes are aggregated by key: members, smallest member, leaves below.
4. Sums over subtrees need no pairs of nodes: every node is assigned to the smallest leaf sequence
   below it.  Along a leaf's path the assigned values are summed from the end, and a node's subtree
   is the sum of these over the leaf paths through it.

Scale.  Texts are digested where they are read and not shuffled.  A conversation of any length is
cut into slices (``running``), a node with any number of members is an aggregate with map-side
combine, a node with very many children meets them through a table of at most MAX_HUBS rows, and
lists of members travel in blocks of ids and are hashed as a stream.

Two prefixes count as equal when 120 bits of digest agree.  Defined results: null role or text counts
as empty; turns go by number (null first), equal numbers by role, then by the digest of the text;
rows that repeat are turns of their own; rows without a conversation id belong to no conversation;
an empty table has no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD, materialise
from quarry.llm.running import add, running, xor

GROUP = 20                # conversations that may share their first turns
MAX_SHARED = 4            # they share fewer turns than this
SLICE = 1024              # turns of one conversation that are handled in one task
END_IDS = 4096            # conversation ids in one block of a list of members
MAX_HUBS = 1000           # nodes with so many children that their keys are broadcast
KEY = ["depth", "a", "b"]


def digested_turns(conversations: DataFrame) -> DataFrame:
    """Written (conv, turn, role, digest, words, slice), range-sorted; no text any more."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"), role.alias("role"),
        F.sha2(F.encode(named, "UTF-8"), 256).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"))  # splits turns that repeat
    # the partition number is written with the rows: every use must see the same one
    return materialise(rows.repartitionByRange("conv", F.asc_nulls_first("turn"), "role", "digest", "row")
                       .withColumn("slice", F.spark_partition_id()), "trie-turns")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, rows): every conversation id as ``conv``, and the turns (conv, depth, digest, words, slice) of
    the rebuilt conversations, depth from 1.

    A conversation begins with the first h turns of its group's first one, h by its id's CRC-32, and
    goes on with its own turns behind its first h.
    """
    order = [F.asc_nulls_first("turn"), "role", "digest", "row"]
    placed = running(turns, ["conv"], "slice", order, {"place": (F.sum, F.lit(1).cast("long"), add)})
    shared = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(MAX_SHARED))
    own = placed.filter(F.col("place") > shared).select("conv", "place", "digest", "words")
    convs = turns.select("conv").distinct()
    first = placed.filter((F.col("conv") % GROUP == 0) & (F.col("place") < MAX_SHARED)) \
        .select(F.col("conv").alias("base"), "place", "digest", "words")
    borrowed = convs.select("conv", (F.col("conv") - F.col("conv") % GROUP).alias("base"), shared.alias("shared")) \
        .join(first, "base").filter("place <= shared").select("conv", "place", "digest", "words")
    rows = own.unionByName(borrowed).withColumn("slice", F.floor(F.col("place") / SLICE))
    rows = running(rows, ["conv"], "slice", ["place"], {"depth": (F.sum, F.lit(1).cast("long"), add)})
    return convs, rows.select("conv", "depth", "digest", "words", "slice")


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def prefixes(rows: DataFrame) -> DataFrame:
    """Written (conv, depth, a, b, parent_a, parent_b, words, slice): a row for each rebuilt turn, keyed by all up to it."""
    mixed = F.sha2(F.encode(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), "UTF-8"), 256)
    hashed = rows.withColumn("mixed", mixed).select("conv", "depth", "words", "slice", _half(F.col("mixed"), 1).alias("x"),
                                                    _half(F.col("mixed"), 31).alias("y"))
    keyed = running(hashed, ["conv"], "slice", ["depth"], {"a": (F.bit_xor, F.col("x"), xor), "b": (F.bit_xor, F.col("y"), xor)})
    return materialise(keyed.select("conv", "depth", "a", "b", xor(F.col("a"), F.col("x")).alias("parent_a"), xor(F.col("b"), F.col("y")).alias("parent_b"),
                                    "words", F.floor((F.col("depth") - 1) / SLICE).alias("slice")), "trie-prefixes")


def sequences(convs: DataFrame, prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written sequences (depth, a, b, weight, first) and ends (depth, a, b, block, ids), the ids of a block in
    ascending order.  The empty conversation has depth 0 and key 0."""
    last = prefix.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("last"))
    none = F.lit(0).cast("long")
    whole = materialise(convs.join(last, "conv", "left").select("conv", *[F.coalesce(F.col(f"last.{k}"), none).alias(k) for k in KEY]), "trie-whole")
    found = whole.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv").alias("first"))
    ends = whole.groupBy(*KEY, F.floor(F.col("conv") / END_IDS).alias("block")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    return materialise(found, "trie-sequences"), ends


def _paths(prefix: DataFrame, sequences: DataFrame) -> DataFrame:
    """The prefixes (depth 0 included) of the conversation that stands for each sequence, with size, weight and first."""
    kept = sequences.select(F.col("first").alias("conv"), F.col("depth").alias("size"), "weight")
    sliced = kept.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("size") - 1) / SLICE), F.lit(0)))))
    none = F.lit(0).cast("long")
    root = kept.select("conv", *[none.alias(c) for c in (*KEY, "parent_a", "parent_b", "words")], none.alias("slice"), "size", "weight")
    return prefix.join(sliced, ["conv", "slice"]).select(root.columns).unionByName(root)


def _list_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): the digest of each list of ids, which is never held as a whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
        key, state = None, None
        for batch in batches:
            out = []
            for *own, ids in zip(*[batch.column(c).to_pylist() for c in KEY], batch.column("ids")):
                text = ",".join(pc.cast(ids.values, pa.string()).to_pylist()).encode()
                if own == key:
                    state.update(b"," + text)
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, state.hexdigest()), schema)], schema=schema)

    return ends.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id and n_children."""
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")) \
        .agg(F.count("*").alias("n_children"))
    held = materialise(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")
    parent = held.filter("n_children > 0").select(F.col("depth").alias("p_depth"), F.col("a").alias("p_a"), F.col("b").alias("p_b"),
                                                  F.col("conv_id").alias("parent_conv_id"), "n_children")
    own = [F.col("depth") - 1 == F.col("p_depth"), F.col("parent_a") == F.col("p_a"), F.col("parent_b") == F.col("p_b")]
    # children of a node that has more than 1 / MAX_HUBS of all: fewer than MAX_HUBS such nodes, whatever the data
    least = held.count() // MAX_HUBS + 1
    hubs = F.broadcast(parent.filter(F.col("n_children") >= least).drop("n_children"))
    others = parent.filter(F.col("n_children") < least).drop("n_children")
    near = held.join(hubs, own, "left")
    apart = near.filter(F.col("p_depth").isNull()).select(*held.columns)
    return near.filter(F.col("p_depth").isNotNull()).select(*held.columns, "parent_conv_id") \
        .unionByName(apart.join(others, own, "left").select(*held.columns, "parent_conv_id"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    ``conversations`` has conv_id, turn, role and text.  A row a node: conv_id (its smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (words that need no second
    computation when members share their prefixes, over the subtree), ends_sha256 (of the ids of the
    conversations that end here) and the key (a, b).
    """
    convs, rows = rebuild(digested_turns(conversations))
    prefix = prefixes(rows)
    found, ends = sequences(convs, prefix)
    paths = _paths(prefix, found)
    nodes = materialise(paths.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max(F.col("size") > F.col("depth")).alias("goes_on"),
        F.first("parent_a").alias("parent_a"), F.first("parent_b").alias("parent_b"), F.first("words").alias("words")), "trie-members")
    leaves = found.join(nodes.filter("goes_on").select(*KEY), KEY, "left_anti")
    leaf_paths = materialise(_paths(prefix, leaves).select("conv", *KEY), "trie-leaf-paths")
    below = leaf_paths.groupBy(*KEY).agg(F.count("*").alias("n_leaves"), F.min("conv").alias("owner"))
    nodes = materialise(nodes.join(below, KEY), "trie-owned")
    assigned = nodes.select(F.col("owner").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    valued = leaf_paths.join(assigned, ["conv", "depth"], "left").withColumns(
        {"own": F.coalesce("own", F.lit(0).cast("long")), "slice": -F.floor(F.col("depth") / SLICE)})
    summed = running(valued, ["conv"], "slice", [F.desc("depth")], {"from_here": (F.sum, F.col("own"), add)})
    saved = summed.groupBy(*KEY).agg(F.sum("from_here").alias("saved_tokens"))
    whole = _with_parents(nodes.join(saved, KEY).join(_list_digests(ends), KEY, "left"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "a", "b")
