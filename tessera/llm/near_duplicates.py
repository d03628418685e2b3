"""Documents linked by the Jaccard similarity of their word shingles, exactly.

1. Each task counts the shingles of its texts in a fixed number of cells; the sum over all tasks orders shingles from
   rare to frequent. The order only has to be the same everywhere for the result to be exact.
2. Equal sets are one node. Two sets of sizes n and m that reach the threshold share at least need(n, m) shingles, so
   they share one within the first n - need + 1 of one and the first m - need + 1 of the other, in that order. Nodes
   meet in tiles of one such shingle, sorted into bands by size; only sizes that can reach the threshold are paired.
3. Each node has a hashed bitmap as a signature. A bit that is set in one alone stands for a shingle that the other
   lacks, so bit counts bound the overlap from above; pairs below what is needed go.
4. What is left is intersected as sorted arrays. First one pair for each node, then, once those links are contracted
   to components, only pairs between different components. Tiles of more than TILE nodes pair each node with the
   first of its band at first; if their nodes are then still in several components, they are cut into sub-tiles in
   order of component, and sub-tiles compare bitmaps unless both are one component. So a group of thousands of copies
   costs about as many comparisons as it has members, and no link between different components is left out.

Rows of tiles are dealt by range of (shingle, size, node), so that a shingle of any share of all rows is spread over
tasks; a tile on a border between tasks is treated as a large one.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.scratch import materialise, partitions
from tessera.llm.texts import held, slices

CELL_BITS = 22
RANGES = 64
TILE = 64
SUB_TILE = 256
#: Keys of tiles up to which they are broadcast.
MOST_BROADCAST = 100_000
#: Rows of tiles that a task holds at once, about.
FLUSH = 200_000
#: Bits of the filter that picks texts whose arrays are needed: 16 for each wanted id, within these powers of 2. Its misses only cost time.
LEAST_FILTER_BITS, MOST_FILTER_BITS = 20, 28
#: Pairs of a task's tiles that are looked at together, about.
PAIRS = 200_000
MOST_WORDS = 200_000
MOST_BITMAP = 1 << 14
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(held("word hashes", _Words).__getitem__, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingles(text: str, size: int) -> np.ndarray:
    """Distinct hashed shingles of a text, sorted: A-Z in lower case, words between ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    w = word_hash(words)
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = _mixed(h * _MIX[0] + w[i : len(w) - size + 1 + i])
    return np.unique(h)


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles from which sets of n and m reach the threshold."""
    return -(-(percent * (n + m)) // (100 + percent))


def key_of(s: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle, in about twice as many bits as there are shingles."""
    bits = min(MOST_BITMAP, max(64, 1 << int(np.ceil(np.log2(2 * len(s))))))
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _folded(maps: list[bytes], width: int) -> np.ndarray:
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0) for b in maps])


def bound(a: list[bytes], b: list[bytes], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most shingles that the sets of each pair can share, by their bitmaps."""
    out = np.minimum(n, m)
    width = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        x, y = _folded([a[i] for i in at], w), _folded([b[i] for i in at], w)
        alone_x = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
        alone_y = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
        out[at] = np.minimum(out[at], np.minimum(n[at] - alone_x, m[at] - alone_y))
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays of distinct values reach the threshold."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _window_pairs(n: np.ndarray, ends: np.ndarray, percent: int, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j: every row with the later rows of its group, up to ``ends``, whose size is within reach; n ascends in a group.

    They come in parts of about ``most`` pairs, of whole rows i.
    """
    rows = np.arange(len(n))
    step = np.int64(n.max(initial=0) + 2) * 2
    group = np.cumsum(np.r_[0, (ends[1:] != ends[:-1])]) if len(ends) else ends
    top = np.searchsorted(group * step + n, group * step + np.minimum(100 * n // percent, step - 1), side="right")
    count = np.maximum(np.minimum(top, ends) - rows - 1, 0)
    upto = np.cumsum(count)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        part = count[lo:hi]
        i = np.repeat(rows[lo:hi], part)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part) + i + 1
        lo = hi


def tile_pairs(
    key: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, percent: int, tile: int, cut: Sequence[int] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of nodes to compare from the rows of tiles, and a mark for rows of large tiles; those of the shingles ``cut`` count as large.

    Rows are (shingle, node, size of the node, place of the shingle in the node's order), already sorted by shingle,
    size and node, without repeats.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    ends = np.repeat(starts + sizes, sizes)
    is_large = (sizes > tile) | np.isin(key[starts], np.array(cut, np.int64))
    large = np.repeat(is_large, sizes)
    small = np.flatnonzero(~large)
    pairs = []
    for i, j in _window_pairs(n[small], np.searchsorted(small, ends[small]), percent):
        i, j = small[i], small[j]
        keep = np.minimum(n[i] - at[i], n[j] - at[j]) >= needed(n[i], n[j], percent)
        pairs.append(np.stack([node[i[keep]], node[j[keep]]], axis=1))
    for s, size in zip(starts[is_large].tolist(), sizes[is_large].tolist(), strict=True):
        # Even with the smallest node in reach, a row needs enough shingles from its place on; the others meet elsewhere.
        # Of a tile that is cut, smaller nodes may be in another part.
        own = np.arange(s, s + size)
        least = np.maximum(0 if key[s] in cut else n[s], -(-percent * n[own] // 100))
        able = n[own] - at[own] >= needed(n[own], least, percent)
        large[own[~able]] = False
        own = own[able]
        while len(own):  # bands: sizes within reach of the band's first node, which all are paired with
            rest = own[1 : int(np.searchsorted(n[own], 100 * n[own[0]] // percent, side="right"))]
            near = rest[np.minimum(n[own[0]] - at[own[0]], n[rest] - at[rest]) >= needed(n[own[0]], n[rest], percent)]
            pairs.append(np.stack([np.full(len(near), node[own[0]]), node[near]], axis=1))
            own = own[1 + len(rest) :]
    found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    found = np.unique(np.sort(found, axis=1), axis=0)
    return found[:, 0], found[:, 1], large


def _shingle_order(docs: DataFrame, size: int) -> np.ndarray:
    """For each cell of shingles, how frequent it is over all documents, on a logarithmic scale of bytes."""
    cells = 1 << CELL_BITS
    each = cells // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for _, texts in slices(batches):
            for t in texts:
                np.add.at(total, (shingles(t, size) >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        packed = [zlib.compress(total[r * each : (r + 1) * each].tobytes(), 1) for r in range(RANGES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(packed, pa.binary())], ["range", "counts"])

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in frames:
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64)
                sums[r] = sums[r] + counts if r in sums else counts
        scaled = [np.minimum(255, np.round(6 * np.log2(1 + s))).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(scaled, pa.binary())], ["range", "scaled"])

    # Every task gives RANGES rows and every range ends as one; the table has as many cells whatever the input.
    counted = docs.select("text").mapInArrow(count, "range int, counts binary").repartition(min(RANGES, partitions(docs.sparkSession)), "range")
    found = {r.range: r.scaled for r in counted.mapInArrow(add, "range int, scaled binary").collect()}
    return np.frombuffer(b"".join(found.get(r, bytes(each)) for r in range(RANGES)), np.uint8)


_KEPT: dict[str, object] = {}


def kept(name: str, shared):
    """The value of a broadcast, taken apart once in each worker."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = shared.value
    return _KEPT[name]


def link_documents(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """The component of every document of ``docs`` (doc_id, text) under the links of all pairs that reach the threshold.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles. A text
    of fewer words is one shingle as a whole; a text without words, or null, has an empty set and links with nothing.
    Shingles are told apart by 64-bit hashes within the pairs that are compared, sets by hashes of 128 bits. Returns
    doc_id, n_shingles, component_id (the smallest id reachable; of a document that links with none, its own), one row
    for each row of ``docs``; null ids are passed over when the smallest is taken. Repeated rows are copies of each
    other. Very long texts are sets like any other. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    order = spark.sparkContext.broadcast(_shingle_order(docs, size))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        seen: set[bytes] = set()
        for part, texts in slices(batches):
            out = []
            for t in texts:
                s = shingles(t, size)
                key = key_of(s) if len(s) else None
                keys = sig = None
                if len(s) and key not in seen:
                    seen.add(key)
                    least = int(needed(np.int64(len(s)), np.int64(-(-percent * len(s) // 100)), percent))
                    cell = rank[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                    keys = s[np.lexsort((s, cell))][: len(s) - least + 1].view(np.int64)
                    sig = bitmap(s)
                out.append((len(s), key, keys, sig))
            if len(seen) > 1_000_000:
                seen.clear()
            columns = [part.column(0), *[pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()))]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key", "keys", "sig"])

    sets = materialise(docs.mapInArrow(prefixes, f"doc_id {kind}, n bigint, key binary, keys array<bigint>, sig binary"), "shingle-sets")

    # Equal sets become one node with a number, which is fixed as the table is written. Rows that repeat a set within a
    # task hold nothing but its key.
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    nodes = sets.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"), F.max("n").alias("n"), first("keys"), first("sig"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")
    signatures = nodes.select("node", "n", "sig")

    # Tiles: all nodes that have a shingle early in their order, in the order of shingle, size and node.
    placed = nodes.select("node", "n", F.posexplode("keys").alias("at", "key"))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "key", "node", "n", "at"]
        none = lambda length: pa.nulls(length, pa.int64())

        def pairs(rows: np.ndarray, cut: list[int]) -> Iterator[pa.RecordBatch]:
            key, node, n, at = rows
            a, b, large = tile_pairs(key, node, n, at, percent, TILE, cut)
            for lo in range(0, len(a), 100_000):
                x, y = pa.array(a[lo : lo + 100_000]), pa.array(b[lo : lo + 100_000])
                yield pa.RecordBatch.from_arrays([x, y, *[none(len(x))] * 4], names)
            k = int(large.sum())
            yield pa.RecordBatch.from_arrays([none(k), none(k), *[pa.array(v[large]) for v in (key, node, n, at)]], names)

        held, cut = np.zeros((4, 0), np.int64), []
        for b in batches:
            if not b.num_rows:
                continue
            if not cut:  # the first shingle may begin in the task before
                cut = [int(b.column("key")[0].as_py())]
            held = np.concatenate([held, np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("key", "node", "n", "at")])], axis=1)
            if held.shape[1] >= FLUSH:
                last = int(held[0, -1])
                end = int(np.searchsorted(held[0], last))
                if end < FLUSH // 2:  # one shingle has most of the rows: they are cut here, as on a border
                    end, cut = held.shape[1], [*cut, last]
                yield from pairs(held[:, :end], cut)
                held = held[:, end:]
        if held.shape[1]:
            yield from pairs(held, [*cut, int(held[0, -1])])

    dealt = placed.repartitionByRange(partitions(spark), "key", "n", "node").sortWithinPartitions("key", "n", "node")
    dealt = materialise(dealt.select("key", "node", "n", F.col("at").cast("long").alias("at")).mapInArrow(tiles, "a bigint, b bigint, key bigint, node bigint, n bigint, at bigint"), "shingle-tiles")
    large_tiles = dealt.filter("key is not null").select("key", "node", "n", "at")
    within = _compare_bitmaps(dealt.filter("a is not null").select("a", "b").distinct(), signatures, percent)

    # One pair for each node first: most copies of a text are linked by these alone. Each node is in one of them as b.
    first_pairs = materialise(within.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs")
    arrays = _arrays(docs, nodes, within.select(F.col("a").alias("node")).unionByName(within.select(F.col("b").alias("node"))), size)
    links = materialise(_intersect(first_pairs, arrays, percent, ["b"]), "links")
    labels = connected_components(links)
    rest = _across(within.join(first_pairs, ["a", "b"], "left_anti"), labels)
    links = materialise(links.unionByName(_intersect(rest, arrays, percent, ["a", "b"])), "links")
    if not large_tiles.isEmpty():
        labels = connected_components(links)
        links = materialise(links.unionByName(_large_tile_links(docs, nodes, large_tiles, labels, signatures, size, percent)), "links")
    labels = connected_components(links)

    named = nodes.select("key", "node", "low").join(labels, "node", "left")
    least = named.filter("label is not null").groupBy("label").agg(F.min("low").alias("least"))
    components = named.join(least, "label", "left").select("key", F.coalesce("least", "low").alias("component_id"))
    return sets.select("doc_id", "n", "key").join(components, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose nodes are not yet in one component."""
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _compare_bitmaps(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps leave room for enough shared shingles."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            most = bound(batch.column(3).to_pylist(), batch.column(5).to_pylist(), n, m)
            mask = pa.array(most >= needed(n, m, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    # Both sides are the same columns under the same names, so that one shuffle of the signatures serves both joins.
    full = pairs.join(signatures.alias("x"), F.col("a") == F.col("x.node")).join(signatures.alias("y"), F.col("b") == F.col("y.node"))
    full = full.select("a", "b", F.col("x.n").alias("n"), F.col("x.sig").alias("sa"), F.col("y.n").alias("m"), F.col("y.sig").alias("sb"))
    return materialise(full.mapInArrow(keep, "a bigint, b bigint"), "bitmap-pairs")


def _arrays(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, array) of the wanted nodes, from their texts.

    A filter over ids, of bounded size, picks the texts to read again, so that texts need no shuffle.
    """
    spark = docs.sparkSession
    origins = materialise(nodes.select("node", "key", "low").join(wanted.distinct(), "node", "left_semi"), "shingle-origins")
    bits = 1 << min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, (16 * origins.count()).bit_length()))
    ranges = 256
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            slots = b.column(0).to_numpy()
            for r in np.unique(slots // (bits // ranges)).tolist():
                found.setdefault(r, np.zeros(bits // ranges, np.uint8))[slots[slots // (bits // ranges) == r] % (bits // ranges)] = 1
        packed = [zlib.compress(np.packbits(v).tobytes(), 1) for v in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(packed, pa.binary())], ["range", "bits"])

    marked = origins.select(slot("low").alias("slot")).repartition(min(ranges, partitions(spark)), F.floor(F.col("slot") / F.lit(bits // ranges))).mapInArrow(mark, "range int, bits binary")
    filled = np.zeros((ranges, bits // ranges // 8), np.uint8)
    for r in marked.collect():
        filled[r.range] |= np.frombuffer(zlib.decompress(r.bits), np.uint8)
    shared = spark.sparkContext.broadcast(filled.reshape(-1))
    name = uuid.uuid4().hex

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = kept(name, shared)
        seen: set[bytes] = set()
        for batch in batches:
            slots = batch.column(1).to_numpy()
            hit = pa.array((filter_[slots >> 3] >> (7 - (slots & 7)) & 1).astype(bool))
            for _, texts in slices([pa.RecordBatch.from_arrays([batch.column(0).filter(hit)], ["text"])]):
                found = {key_of(s): s for s in (shingles(t, size) for t in texts) if len(s)}
                rows = [(k, v.tobytes()) for k, v in found.items() if k not in seen]
                seen.update(found)
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["key", "array"])

    # Tasks may build the array of a set that several of them hold, each once; the first stays. Grouped by the key that
    # the join has as well, arrays are shuffled once.
    built = docs.select("text", slot("doc_id").alias("slot")).mapInArrow(build, "key binary, array binary").groupBy("key").agg(F.first("array").alias("array"))
    return materialise(built.join(origins.select("key", "node"), "key").select("node", "array"), "shingle-arrays")


def _intersect(pairs: DataFrame, arrays: DataFrame, percent: int, by: Sequence[str]) -> DataFrame:
    """The pairs that reach the threshold. Pairs are dealt over tasks by the nodes ``by``; arrays follow, each once a task."""
    spark = pairs.sparkSession
    groups = partitions(spark) * 4
    pairs = pairs.withColumn("task", F.pmod(F.xxhash64(*by), F.lit(groups)).cast("int"))
    follow = pairs.select(F.col("task").alias("to"), F.col("a").alias("node")).unionByName(pairs.select(F.col("task").alias("to"), F.col("b").alias("node"))).distinct()

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        have = {n: np.frombuffer(x, np.uint64) for n, x in zip(right["node"], right["array"], strict=True)}
        good = [linked(have[a], have[b], percent) for a, b in zip(left["a"], left["b"], strict=True)]
        return left.loc[np.array(good, bool), ["a", "b"]]

    sent = follow.join(arrays, "node")
    return pairs.groupBy("task").cogroup(sent.groupBy("to")).applyInPandas(check, "a bigint, b bigint")


def _large_tile_links(docs: DataFrame, nodes: DataFrame, rows: DataFrame, labels: DataFrame, signatures: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different components of large tiles, enough to join all that are linked there.

    Rows are dealt by range of (shingle, component, size, node) and cut there into sub-tiles, so no task sees a whole
    tile. Two sub-tiles meet in a task of their own unless their sizes are out of reach or both are of one component.
    There, pairs whose places, sizes and bitmaps leave room are intersected, unless links found before have already
    joined their components: a task gives fewer links than it has rows.
    """
    labelled = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    mixed = materialise(mixed, "mixed-tiles")
    mixed = F.broadcast(mixed) if mixed.count() <= MOST_BROADCAST else mixed
    open_ = materialise(labelled.join(mixed, "key", "left_semi").select("key", "label", "n", "node", "at"), "open-tiles")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = 0
        for b in batches:
            sub = (np.arange(b.num_rows) + passed) // SUB_TILE + b.column("part").to_numpy() * (1 << 40)
            passed += b.num_rows
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("key", "label", "n", "node", "at")], pa.array(sub)], ["key", "label", "n", "node", "at", "sub"])

    ordered = open_.repartitionByRange(partitions(docs.sparkSession), "key", "label", "n", "node").sortWithinPartitions("key", "label", "n", "node")
    cut = ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(number, "key bigint, label bigint, n bigint, node bigint, at bigint, sub bigint")
    cut = materialise(cut, "sub-tiles")
    ranges = cut.groupBy("key", "sub").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = (ranges.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("sub", "least", "most", "lo", "hi")]) for side in "ij")
    reach = (F.col("least_j") * percent <= F.col("most_i") * 100) & (F.col("least_i") * percent <= F.col("most_j") * 100)
    one = (F.col("lo_i") == F.col("hi_j")) & (F.col("hi_i") == F.col("lo_j"))
    meets = x.join(y, "key").filter((F.col("sub_i") <= F.col("sub_j")) & reach & ~one).select("key", F.col("sub_i").alias("i"), F.col("sub_j").alias("j"))
    meets = materialise(meets, "sub-tile-pairs")
    arrays = _arrays(docs, nodes, cut.select("node"), size)
    full = materialise(cut.join(signatures.select("node", "sig"), "node").join(arrays, "node"), "full-sub-tiles")
    left = meets.join(full.withColumnRenamed("sub", "i"), ["key", "i"])
    right = meets.join(full.withColumnRenamed("sub", "j"), ["key", "j"])
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n, m = left["n"].to_numpy(np.int64), right["n_"].to_numpy(np.int64)
        la, lb = left["label"].to_numpy(), right["label_"].to_numpy()
        na, nb = left["node"].to_numpy(), right["node_"].to_numpy()
        ra, rb = n - left["at"].to_numpy(np.int64), m - right["at_"].to_numpy(np.int64)
        sa, sb = left["sig"].tolist(), right["sig_"].tolist()
        xa, xb = ([np.frombuffer(v, np.uint64) for v in c] for c in (left["array"], right["array_"]))
        root: dict[int, int] = {}
        out = []

        def find(label: int) -> int:
            while (up := root.get(label, label)) != label:
                root[label] = root.get(up, up)
                label = up
            return label

        for lo in range(0, len(na), 64):
            part = slice(lo, lo + 64)
            x, y = n[part, None], m[None, :]
            room = (la[part, None] != lb[None, :]) & (100 * y >= percent * x) & (100 * x >= percent * y)
            room &= np.minimum(ra[part, None], rb[None, :]) >= needed(x, y, percent)
            i, j = np.nonzero(room)
            for at in range(0, len(i), 20_000):
                p, q = i[at : at + 20_000] + lo, j[at : at + 20_000]
                good = bound([sa[k] for k in p], [sb[k] for k in q], n[p], m[q]) >= needed(n[p], m[q], percent)
                for u, v in zip(p[good].tolist(), q[good].tolist(), strict=True):
                    mine, other = find(la[u]), find(lb[v])
                    if mine != other and linked(xa[u], xb[v], percent):
                        root[mine] = other
                        out.append((na[u], nb[v]))
        return pd.DataFrame(out, columns=["a", "b"])

    keys = ["key", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy("key_", "i_", "j_")).applyInPandas(compare, "a bigint, b bigint")
