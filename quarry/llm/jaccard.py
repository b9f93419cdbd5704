"""N-gram Jaccard join with token-combination prefixes.

Two documents link when ``100 * intersection >= threshold * union`` of their shingle sets.
Documents with one and the same set are one class; the join works on classes.

Index.  All sets are put in one order: rare shingles before frequent ones, each by value.  A set of
n shingles has at least a = ceil(threshold * n / 100) in common with any partner, so partners share
a shingle among the first n - a + 1 (the prefix).  Rare shingles of the prefix are index keys by
themselves.  A set whose prefix reaches into the frequent class is extended by b shingles, which
makes partners share b + 1; if none of these is rare, then of b blocks into which frequent
shingles are dealt one holds two of them.  So all pairs of frequent shingles within a block are
its further keys (k = 2).  b depends on the size class of the smaller set; the larger one also
emits the keys of the classes its partners may have.

The frequent class only steers the work, whatever it holds the index is complete.  It has a
bounded size (``MAX_FREQUENT`` values), which is broadcast.

Candidates.  A key links its classes like a star: one class (of near copies the least edited) with
all others, so a key of any size gives a linear number of pairs.  Pairs fall out whose sizes, or
whose counts of shingles in cells of values (an upper bound of what is common), allow no link; the
rest are verified on the sets.  Keys whose classes are then all in one component are done.  In
others, pairs of classes of different components are still open: small keys (``SMALL_KEY``) pair
off what is left.  Large keys with one main component are one group; the sketches of its classes
outside the component meet, in blocks, those of all of the group, and pairs that sizes and sketches
allow are verified.  No link between different components is lost, and none inside one is needed.

Scale.  Rare keys travel packed, in buckets of key values; keys of combinations, which may be hot,
are spread without regard to the key and are counted by Spark's aggregates with map-side combine.
Texts are never
shuffled, sets only of classes with a candidate pair.

Defined results: null, empty and word-less texts have empty sets and link with nothing; rows that
repeat have one class; rows of one id with different texts are separate documents with that id; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialise
from quarry.llm.components import components
from quarry.llm.shingles import mix, set_name, shingle_set

FREQUENT = 32             # copies of a shingle in different sets, from which it counts as frequent
MAX_FREQUENT = 1 << 20
SMALL_KEY = 48
BLOCK = 512               # classes whose sketches are compared at once
SLICE = 1000              # documents handled together inside a batch
CELLS = 256
BITS = 1 << 26            # of the bitmap that picks texts (8 MB)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column("id"), [shingle_set(t.as_py(), width) for t in part.column("text")]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in a sorted array."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def sketch(tokens: np.ndarray) -> bytes | None:
    """How many shingles fall into each of CELLS cells of values, a byte each; None if a cell has more."""
    counts = np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=CELLS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def describe(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Written: (id, n, a, b, sketch) a document (a, b name its set), and (shingle, times) of shingles that
    occur in two or more different sets of one slice of documents."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, width):
            names = [set_name(s) for s in sets]
            different = {name: s for name, s in zip(names, sets)}
            joined = np.sort(np.concatenate(list(different.values())))
            starts, times = _runs(joined)
            often = times >= 2
            rows = pa.StructArray.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in names], pa.int64()),
                 pa.array([b for _, b in names], pa.int64()), pa.array(map(sketch, sets), pa.binary())],
                ["id", "n", "a", "b", "sketch"])
            shared = pa.StructArray.from_arrays([_signed(joined[starts[often]]), pa.array(times[often], pa.int64())],
                                                ["shingle", "times"])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (rows, shared)]
            yield pa.RecordBatch.from_arrays(lists, ["rows", "shared"])

    schema = f"rows array<struct<id:{id_type},n:bigint,a:bigint,b:bigint,sketch:binary>>, shared array<struct<shingle:bigint,times:bigint>>"
    written = materialise(docs.mapInArrow(run, schema), "jaccard-sets")
    return written.select(F.inline("rows")), written.select(F.inline("shared"))


def frequent_shingles(shared: DataFrame) -> np.ndarray:
    """The frequent class, sorted: shingles with at least FREQUENT counted copies, or with as many
    as leave MAX_FREQUENT of them."""
    totals = materialise(shared.groupBy("shingle").agg(F.sum("times").alias("times"))
                         .filter(F.col("times") >= FREQUENT), "jaccard-frequent")
    by_size = totals.groupBy(F.floor(F.log2("times")).alias("size")).count().orderBy(F.desc("size")).collect()
    least, room = FREQUENT, MAX_FREQUENT
    for r in by_size:  # at most 64 rows
        if r["count"] > room:
            least = 1 << (int(r["size"]) + 1)
            break
        room -= r["count"]
    rows = totals.filter(F.col("times") >= least).select("shingle").toArrow().column("shingle")
    return np.sort(rows.to_numpy().view(np.uint64))


def _common_least(n: int, threshold: int) -> int:
    return -(-threshold * n // 100)


def _size_class(n: int) -> int:
    """Classes grow by a quarter, more than two linked sets may differ in size."""
    return int(np.log(n) / np.log(1.25) + 1e-9)


def _blocks(size_class: int, threshold: int) -> int:
    least_n = max(1, int(np.ceil(1.25 ** size_class - 1e-6)))
    return max(1, least_n * (100 - threshold) // 100)


def index_keys(tokens: np.ndarray, frequent: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The keys of one set, rare shingles and combinations of two frequent ones; and how many of
    its shingles are rare."""
    n = len(tokens)
    if n < 2:  # a partner of a single shingle is the same set
        return np.empty(0, np.uint64), np.empty(0, np.uint64), n
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
    else:
        often = np.zeros(n, dtype=bool)
    rare, common = tokens[~often], tokens[often]
    least = _common_least(n, threshold)
    prefix = n - least + 1
    if prefix <= len(rare):
        return rare[:prefix], np.empty(0, np.uint64), len(rare)
    combined = []
    for size_class in range(_size_class(least), _size_class(n) + 1):
        blocks = _blocks(size_class, threshold)
        reach = common[:max(0, min(n, prefix + blocks) - len(rare))]
        block = mix(reach + np.uint64(7)) % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        reach, block = reach[order], block[order]
        starts, lengths = _runs(block)
        for step in range(1, int(lengths.max(initial=1))):  # pairs that lie ``step`` apart in a block
            first = np.flatnonzero(block[step:] == block[:-step])
            combined.append(mix(reach[first] * np.uint64(0x9E3779B97F4A7C15) + mix(reach[first + step])
                                + np.uint64(size_class)))
    return rare, np.concatenate(combined) if combined else np.empty(0, np.uint64), len(rare)


ENTRY = np.dtype([("key", "<u8"), ("a", "<i8"), ("b", "<i8"), ("n", "<i4"), ("rare", "<i4")])


def _entries(keys: list[np.ndarray], names: list[tuple[int, int]], counts: list[int],
             rare: list[int]) -> np.ndarray:
    out = np.empty(sum(map(len, keys)), dtype=ENTRY)
    if len(out):
        out["key"] = np.concatenate(keys)
        sizes = [len(k) for k in keys]
        out["a"] = np.repeat(np.array([a for a, _ in names], dtype=np.int64), sizes)
        out["b"] = np.repeat(np.array([b for _, b in names], dtype=np.int64), sizes)
        out["n"] = np.repeat(np.array(counts, dtype=np.int32), sizes)
        out["rare"] = np.repeat(np.array(rare, dtype=np.int32), sizes)
    return out


def shared_keys(docs: DataFrame, frequent: np.ndarray, width: int, threshold: int) -> DataFrame:
    """Written (key, y: struct of rare, class and n): the index entries of keys that two or more classes have."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(frequent)  # at most MAX_FREQUENT values

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, width):
            different = {set_name(s): s for s in sets if len(s)}
            both = [index_keys(s, sent.value, threshold) for s in different.values()]
            about = list(different), list(map(len, different.values())), [n for _, _, n in both]
            rare, combined = _entries([r for r, _, _ in both], *about), _entries([c for _, c, _ in both], *about)
            bucket = (rare["key"] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rare, bucket = rare[order], bucket[order]
            starts, lengths = _runs(bucket)
            numbers = bucket[starts].tolist()
            blobs = [rare[s:s + n].tobytes() for s, n in zip(starts.tolist(), lengths.tolist())]
            # combinations may be hot keys: they are dealt evenly, not by key
            share = -(-len(combined) // buckets)
            for i, at in enumerate(range(0, len(combined), max(share, 1000))):
                numbers.append(int((rare["key"][0] if len(rare) else 0) + i) % buckets)
                blobs.append(b"+" + combined[at:at + max(share, 1000)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "entries"])

    def meet(t: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in t.column("entries")]
        rare = np.unique(np.frombuffer(b"".join(b for b in blobs if len(b) % ENTRY.itemsize == 0), dtype=ENTRY))
        starts, lengths = _runs(rare["key"])
        live = rare[np.repeat(lengths > 1, lengths)]
        combined = np.frombuffer(b"".join(b[1:] for b in blobs if len(b) % ENTRY.itemsize == 1), dtype=ENTRY)
        found = np.concatenate([live, combined])
        return pa.table({"key": _signed(found["key"].astype(np.uint64)), "a": pa.array(found["a"].astype(np.int64)),
                         "b": pa.array(found["b"].astype(np.int64)), "n": pa.array(found["n"].astype(np.int64)),
                         "rare": pa.array(found["rare"].astype(np.int64))})

    packed = docs.mapInArrow(cut, "bucket int, entries binary")
    rows = packed.groupBy("bucket").applyInArrow(meet, "key long, a long, b long, n long, rare long")
    return materialise(rows.distinct().select("key", F.struct("rare", F.struct("a", "b").alias("class"), "n").alias("y")), "jaccard-keys")


NODE = "struct<a:bigint,b:bigint>"


def _bitmap(ids: DataFrame) -> np.ndarray:
    """BITS bits, set where the hash of an id falls: BITS / 8 bytes however many ids there are."""
    place = F.pmod(F.xxhash64("id"), F.lit(BITS))
    rows = ids.groupBy(F.shiftright(place, 15).alias("part")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767).cast("long"))).alias("bits")).collect()
    table = np.zeros((BITS >> 15, 4096), dtype=np.uint8)
    for r in rows:
        table[r["part"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return table.ravel()


def _token_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(class, tokens): the packed sets of the ``wanted`` classes, made again from one text each.

    Texts are not shuffled: a bitmap of the wanted texts' ids picks them where they are read, and the
    few it picks wrongly fall out in the join.
    """
    ids = wanted.join(classes, "class").select("class", "id")
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))
    placed = docs.select(F.pmod(F.xxhash64("id"), F.lit(BITS)).alias("place"), "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kind = sent.value, pa.struct([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            place = batch.column("place").to_numpy()
            hit = (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            texts = batch.column("text").filter(pa.array(hit.astype(bool)))
            for at in range(0, len(texts), SLICE):
                sets = [shingle_set(t.as_py(), width) for t in texts.slice(at, SLICE)]
                names = [dict(zip(("a", "b"), set_name(s))) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "tokens"])

    return placed.mapInArrow(pack, f"class {NODE}, tokens binary").join(wanted.select("class"), "class", "left_semi")


def _tokens(blob: pa.Scalar) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), dtype=np.uint64)


def _possible(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Written: those of ``pairs`` (u, v) whose sketches allow a link."""
    sketches = classes.select("class", "n", "sketch")
    sketched = pairs.join(sketches.toDF("u", "u_n", "x"), "u").join(sketches.toDF("v", "v_n", "y"), "v")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell holds no more common shingles than either count."""
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            known = np.array([a is not None and b is not None for a, b in zip(x, y)], dtype=bool)
            cells = [np.frombuffer(b"".join(t for t, k in zip(side, known) if k), dtype=np.uint8).reshape(-1, CELLS) for side in (x, y)]
            most = np.full(len(x), np.iinfo(np.int64).max // 1000, dtype=np.int64)
            most[known] = np.minimum(*cells).sum(axis=1, dtype=np.int64)
            total = np.array(batch.column("u_n")) + np.array(batch.column("v_n"))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array((100 + threshold) * most >= threshold * total)],
                                             ["u", "v", "fits"])

    fit = sketched.select("u", "v", "u_n", "v_n", "x", "y").mapInArrow(bound, f"u {NODE}, v {NODE}, fits boolean")
    return materialise(fit.filter("fits").select("u", "v"), "jaccard-pairs")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Written links (u, v) among the candidate ``pairs`` (u, v) of classes."""
    fit = _possible(pairs, classes, threshold)
    packed = _token_sets(fit.select(F.explode(F.array("u", "v")).alias("class")).distinct(), classes, docs, width)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = _tokens(x), _tokens(y)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int(np.count_nonzero(x[at] == y))
                linked.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())], ["u", "v", "linked"])

    both = fit.join(packed.toDF("v", "y"), "v").join(packed.toDF("u", "x"), "u").select("u", "v", "x", "y")
    links = materialise(both.mapInArrow(compare, f"u {NODE}, v {NODE}, linked boolean").filter("linked")
                        .select("u", "v").distinct(), "jaccard-links")
    discard(fit)
    return links


def _pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """Distinct (u, v), u < v, of rows with x and y (struct with class, n) whose sizes allow a link."""
    sizes = 100 * F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")
    return rows.filter(sizes & (F.col("x.class") != F.col("y.class"))) \
        .select(F.least("x.class", "y.class").alias("u"), F.greatest("x.class", "y.class").alias("v")).distinct()


def _block_pairs(groups: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Distinct pairs (u, v) of a stray and a class of its group, of different components, that sizes and sketches allow.

    ``groups`` has (main, class, component); a stray's component is not ``main``.  Classes are dealt
    into blocks of about BLOCK by a hash; every block of strays meets every block of its group in
    a row of its own.  Only sketches travel, CELLS bytes a class whatever its text's length.
    """
    held = groups.groupBy("main").agg(F.count("*").alias("held"), F.count_if(F.col("component") != F.col("main")).alias("strays"))
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    stray_blocks = F.ceil(F.col("strays") / BLOCK).cast("int")
    rows = groups.join(held, "main").join(classes.select("class", "n", "sketch"), "class") \
        .withColumns({"blocks": blocks, "stray_blocks": stray_blocks})
    one = F.struct("class", "component", "n", "sketch").alias("one")
    place = F.xxhash64("class")
    everyone = rows.groupBy("main", F.pmod(place, F.col("blocks")).alias("block")).agg(F.collect_list(one).alias("all"))
    strays = rows.filter("component <> main").groupBy("main", F.pmod(place, F.col("stray_blocks")).alias("stray_block")) \
        .agg(F.collect_list(one).alias("strays"), F.first("blocks").alias("blocks")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("blocks") - 1).cast("long"))))
    full = np.full(CELLS, 255, dtype=np.uint8).tobytes()

    def side(x: pa.StructArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Classes, components (numbered), sizes and sketches; a set without a sketch may share anything."""
        known = x.field("sketch").to_pylist()
        cells = np.frombuffer(b"".join(s if s is not None else full for s in known), dtype=np.uint8).reshape(-1, CELLS)
        names = [tuple(c.values()) for c in x.field("component").to_pylist()]
        sizes = x.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        return x.field("class"), names, np.where([s is None for s in known], -1, sizes), sizes, cells

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                us, u_comps, u_known, u_sizes, u_cells = side(batch.column("strays")[i].values)
                vs, v_comps, v_known, v_sizes, v_cells = side(batch.column("all")[i].values)
                number = {c: k for k, c in enumerate(dict.fromkeys([*u_comps, *v_comps]))}
                v_number = np.array([number[c] for c in v_comps])
                first, second = [], []
                for k, (comp, known, size, cells) in enumerate(zip(u_comps, u_known, u_sizes, u_cells)):
                    near = np.flatnonzero((v_number != number[comp]) & (100 * np.minimum(v_sizes, size) >= threshold * np.maximum(v_sizes, size)))
                    most = np.minimum(v_cells[near], cells).sum(axis=1, dtype=np.int64)
                    most = np.where((known < 0) | (v_known[near] < 0), np.minimum(v_sizes[near], size), most)
                    near = near[(100 + threshold) * most >= threshold * (v_sizes[near] + size)]
                    first.append(np.full(len(near), k))
                    second.append(near)
                yield pa.RecordBatch.from_arrays([us.take(pa.array(np.concatenate(first))), vs.take(pa.array(np.concatenate(second)))], ["u", "v"])

    both = strays.join(everyone, ["main", "block"]).select("strays", "all")
    met = both.mapInArrow(compare, f"u {NODE}, v {NODE}")
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def linked_classes(docs: DataFrame, classes: DataFrame, keys: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links (u, v) that connect classes exactly as all links would."""
    # a key's leader is its class with the fewest rare shingles: of near copies the one least edited
    stars = keys.join(keys.groupBy("key").agg(F.min("y").alias("x")), "key").filter("x <> y")
    links = _verified(_pairs(stars, threshold), classes, docs, width, threshold)
    found = components(links, "jaccard-components").toDF("class", "component")
    marked = keys.select("key", "y", "y.class").join(found, "class", "left") \
        .select("key", "y", F.coalesce("component", "class").alias("component"))
    marked = materialise(marked, "jaccard-marked")
    state = marked.groupBy("key", "component").agg(F.count("*").alias("held")).groupBy("key").agg(
        F.max(F.struct("held", "component")).alias("most"), F.sum("held").alias("size"), F.count("*").alias("different"))
    # the leader has met all others, so a key of two classes has nothing left
    still = materialise(marked.join(state.filter("different > 1 and size > 2")
                                    .select("key", "size", F.col("most.component").alias("main")), "key"), "jaccard-open")
    small, large = still.filter(F.col("size") <= SMALL_KEY), still.filter(F.col("size") > SMALL_KEY)
    members = small.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("y", "component"))).alias("m"))
    left = members.select("m", F.posexplode("m").alias("i", "first"))
    inner = left.select("first", F.explode(F.slice("m", F.col("i") + 2, F.lit(SMALL_KEY))).alias("second")) \
        .filter("first.component <> second.component").select(F.col("first.y").alias("x"), F.col("second.y").alias("y"))
    more = _verified(_pairs(inner, threshold), classes, docs, width, threshold)
    # large keys of one main component, which hold the same near copies again and again, are one group
    groups = materialise(large.select("main", "y.class", "component").distinct(), "jaccard-groups")
    far = _verified(_block_pairs(groups, classes, threshold), classes, docs, width, threshold)
    discard(keys, marked, still, groups)
    return links.unionByName(more).unionByName(far)


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                 threshold: int = 80) -> DataFrame:
    """Every row of ``docs`` as ``id_col``, n_shingles and component_id: the smallest id that links
    of ``threshold`` per cent or more lead to, the document's own included."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, shared = describe(docs, width)
    rows = rows.withColumn("class", F.struct("a", "b")).drop("a", "b")
    classes = materialise(rows.filter("n > 0").groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "jaccard-classes")
    keys = shared_keys(docs, frequent_shingles(shared), width, threshold)
    links = linked_classes(docs, classes, keys, width, threshold)
    found = components(links, "jaccard-components").toDF("class", "component")
    member = classes.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = member.groupBy("component").agg(F.min("id").alias("component_id"))
    named = member.join(least, "component").select("class", "component_id")
    return rows.join(named, "class", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
