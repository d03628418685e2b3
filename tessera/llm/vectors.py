"""Searches over tables of vectors: an exact threshold algorithm and a forest of random-projection trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import materialise

HITS = "query bigint, query_id bigint, vec_id bigint, score {0}"

#: Components of the rows and queries of a block, at most, and rows or queries of it.
BLOCK_CELLS = 1 << 19
BLOCK_ROWS = 8192
BLOCK_QUERIES = 2048
#: Queries that are scored at once inside a task.
AT_ONCE = 256
#: Distinct dimensions up to which their counts are broadcast.
MOST_DIMENSIONS = 10_000
#: Sorted lists are first read to this share of their length; each further round doubles the depth.
FIRST_DEPTH = 1 / 256

# Forest
TREES = 16
MOST_LEVELS = 10
LEAF_ROWS = 50
#: Vectors that the forest is fitted on, about: those whose hashed row number is below a bound.
FOREST_SAMPLE = 20_000
#: A query takes leaves from the queue until they hold SHARE * n ** -POWER of the n vectors.
SHARE, POWER = 2.7, 0.18


def usable(table: DataFrame, nonzero: bool = False) -> DataFrame:
    """Rows (num, vec_id, v array<double>, dim) whose id is not null and whose vector is not null, empty or holding null or non-finite components.

    ``num`` tells rows apart, also those that agree in everything else; it is fixed once the rows are written.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0)).filter(F.coalesce(finite, F.lit(False)))
    rows = rows.filter(F.exists("v", lambda x: x != 0)) if nonzero else rows
    return rows.select(F.monotonically_increasing_id().alias("num"), "vec_id", "v", F.size("v").alias("dim"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of what all blocks found for each query row; each task keeps its own best k before anything moves."""
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _first_k(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: greatest score first, ties to the smaller id."""
    order = np.lexsort((ids, -score, query)) if score.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (query[i], -score[i], ids[i])), np.int64)
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


class SortedLists:
    """One list of rows for each dimension, greatest component first, over a block of integer vectors."""

    def __init__(self, nums: np.ndarray, ids: np.ndarray, x: np.ndarray, lists: np.ndarray | None = None):
        self.nums, self.ids, self.x = nums, ids, x
        self.lists = np.argsort(-x.astype(np.float64 if x.dtype != object else object), axis=0, kind="stable") if lists is None else lists

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fagin's threshold algorithm for a batch of queries: (query, row, score) of the k greatest inner products of each.

        Ties go to the smaller id; the row numbered ``own`` is left out, and so is what scores below ``floor``, the k-th
        score that the query has elsewhere. Each round reads all lists that an open query needs a step deeper: from the
        greatest end for positive weights, from the smallest for negative ones. Rows met for the first time are scored
        by random access, for all open queries in one product. The bound of a query is the score of a row that has in
        every dimension what the lists have last shown; once its k-th score is above that, no row that has not been met
        can reach its result, and the query is closed.
        """
        n = len(self.ids)
        whole = float(np.abs(self.x).max(initial=0)) * float(np.abs(q).max(initial=0)) * self.x.shape[1] < 2**53
        kind = np.float64 if whole else object
        x, q, best = self.x.astype(kind), q.astype(kind), floor.astype(kind)
        top = np.full((len(q), k), -np.inf).astype(kind)
        met = np.zeros(n, bool)
        open_ = np.arange(len(q))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))]
        depth, step = 0, max(k, int(n * FIRST_DEPTH))
        while depth < n and len(open_):
            to = min(n, depth + step)
            shown = np.zeros(n, bool)
            shown[self.lists[depth:to, np.flatnonzero((q[open_] > 0).any(axis=0))]] = True
            shown[self.lists[n - to : n - depth, np.flatnonzero((q[open_] < 0).any(axis=0))]] = True
            if to == n or not (q[open_] != 0).any():  # a query of zeros needs no list, and any row may be in its result
                shown[:] = True
                to = n
            new = np.flatnonzero(shown & ~met)
            met |= shown
            for lo in range(0, len(new), BLOCK_ROWS):
                part = new[lo : lo + BLOCK_ROWS]
                scores = q[open_] @ x[part].T
                scores[own[open_][:, None] == self.nums[part][None, :]] = -np.inf
                good = scores >= best[open_][:, None]
                if not whole:
                    good &= scores != -np.inf
                else:
                    good &= np.isfinite(scores)
                if not good.any():
                    continue
                hit = np.flatnonzero(good.any(axis=1))
                i, j = np.nonzero(good)
                both = np.concatenate([top[open_[hit]], scores[hit]], axis=1)
                top[open_[hit]] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:] if whole else np.sort(both, axis=1)[:, -k:]
                best[open_[hit]] = np.maximum(best[open_[hit]], top[open_[hit]].min(axis=1))
                i, j = open_[i], (j, scores[i, j])
                keep = j[1] >= best[i]
                found.append((i[keep], part[j[0][keep]], j[1][keep]))
            up, down = np.where(q[open_] > 0, q[open_], 0), np.where(q[open_] < 0, q[open_], 0)
            columns = np.arange(x.shape[1])
            bound = up @ x[self.lists[to - 1], columns] + down @ x[self.lists[n - to], columns]
            open_ = open_[~(best[open_] > bound)]
            depth, step = to, step * 2
        query, row, score = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = score >= best[query]
        query, row, score = query[keep], row[keep], score[keep]
        first = _first_k(query, self.ids[row], score, k)
        return query[first], row[first], score[first]


def _small(x: np.ndarray) -> np.ndarray:
    """The integers in the shortest type that holds them all."""
    for kind in (np.int8, np.int16, np.int32):
        if len(x) == 0 or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


_PACKED = "dim int, {0} bigint, n int, kind string, nums binary, ids binary, x binary"


def _unpack(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(r.x, r.kind).reshape(r.n, r.dim).astype(np.int64)
    return np.frombuffer(r.nums, np.int64), np.frombuffer(r.ids, np.int64), x


def _packer(block: str, lists: bool):
    """One row for all rows of a block; with ``lists`` the sorted lists are made here, once for all queries."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["vec_id", "num"])
        x = np.stack(frame["v"].to_list())
        small = _small(x)
        row = [frame["dim"].iloc[0], frame[block].iloc[0], len(frame), small.dtype.str, frame["num"].to_numpy(np.int64).tobytes(), frame["vec_id"].to_numpy(np.int64).tobytes(), small.tobytes()]
        names = ["dim", block, "n", "kind", "nums", "ids", "x"]
        if lists:
            order = np.argsort(-small.astype(np.float64) if small.dtype != np.int64 else ~small, axis=0, kind="stable")
            row.append(order.astype(np.uint16 if len(frame) < 1 << 16 else np.uint32).tobytes())
            names.append("lists")
        return pd.DataFrame([row], columns=names)

    return pack


def exact_top_k(table: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """For each row of ``table`` (vec_id, embedding) whose id is divisible by ``every``: the k rows of greatest inner product.

    Components count as floor(scale * x). Rows are dealt by hash to blocks, one row of the block table each, which holds
    the sorted lists of its rows; queries are dealt to blocks as well. Each block of queries first searches one block of
    rows, so that every query has a k-th score to start from; then every other block is searched with that as a floor.
    What the blocks find is merged by query.

    The query's own row is left out; other rows of its id are candidates, and each row of a repeated id is a query
    of its own. Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
    an id; candidates have the dimension of the query. Returns query_id, rank from 1, vec_id, score; ties to the
    smaller id; fewer than k rows if there are fewer candidates; none for an empty table. Other columns are ignored.
    """
    spark = table.sparkSession
    rows = usable(table).withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")))
    rows = materialise(rows, "vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    most = F.greatest(F.lit(64), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_CELLS) / F.col("dim"))))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n_rows"), F.count_if(is_query).alias("n_queries"))
    sizes = materialise(sizes.select("dim", F.ceil(F.col("n_rows") / most).alias("blocks"), F.ceil(F.col("n_queries") / F.least(F.lit(BLOCK_QUERIES), most)).alias("query_blocks")), "vector-blocks")
    if sizes.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_DIMENSIONS else sizes
    sized = rows.join(sizes, "dim")
    deal = lambda blocks, salt: F.pmod(F.xxhash64("num", F.lit(salt)), F.col(blocks))
    packed = sized.withColumn("block", deal("blocks", 1)).groupBy("dim", "block").applyInPandas(_packer("block", True), _PACKED.format("block") + ", lists binary")
    packed = materialise(packed, "sorted-lists")
    queries = sized.filter(is_query).withColumn("queries", deal("query_blocks", 2)).groupBy("dim", "queries").applyInPandas(_packer("queries", False), _PACKED.format("queries"))
    queries = materialise(queries.join(sizes.select("dim", "blocks"), "dim").withColumn("floor", F.lit(None).cast("binary")), "query-blocks")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> tuple:
        b, r = next(left.itertuples()), next(right.itertuples())
        nums, ids, x = _unpack(b)
        lists = SortedLists(nums, ids, x, np.frombuffer(b.lists, np.uint16 if b.n < 1 << 16 else np.uint32).reshape(b.n, b.dim))
        own, own_ids, q = _unpack(r)
        floor = np.full(r.n, -np.inf) if r.floor is None else np.frombuffer(r.floor, np.float64)
        parts = []
        for lo in range(0, r.n, AT_ONCE):
            at = slice(lo, lo + AT_ONCE)
            query, row, score = lists.search(q[at], own[at], floor[at], k)
            parts.append((query + lo, row, score))
        query, row, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        return r, query, own[query], own_ids[query], ids[row], score

    def begin(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["dim", "queries", "n", "kind", "nums", "ids", "x", "blocks", "floor", "hits"])
        r, query, own, own_ids, ids, score = search(left, right)
        floor = np.full(r.n, -np.inf)
        full, last = np.unique(query[::-1], return_index=True)
        kth = score[::-1][last].astype(np.float64)
        enough = (np.bincount(query, minlength=r.n)[full] == k) & (np.abs(kth) < 2**53)
        floor[full[enough]] = kth[enough]
        hits = [{"query": a, "query_id": b, "vec_id": c, "score": _long(s)} for a, b, c, s in zip(own.tolist(), own_ids.tolist(), ids.tolist(), score.tolist(), strict=True)]
        row = [r.dim, r.queries, r.n, r.kind, r.nums, r.ids, r.x, r.blocks, floor.tobytes(), hits]
        return pd.DataFrame([row], columns=["dim", "queries", "n", "kind", "nums", "ids", "x", "blocks", "floor", "hits"])

    def go_on(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["query", "query_id", "vec_id", "score"])
        _, _, own, own_ids, ids, score = search(left, right)
        return pd.DataFrame({"query": own, "query_id": own_ids, "vec_id": ids, "score": [_long(s) for s in score.tolist()]})

    # Every pair of blocks of a dimension meets once: in the first search if their numbers agree, else with a floor.
    keys = ["dim", "block", "queries"]
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pairs = packed.join(sizes, "dim").filter(F.col("query_blocks") > 0).withColumn("queries", numbers("query_blocks"))
    own = F.col("block") == F.col("queries") % F.col("blocks")
    sent, rest = (pairs.filter(c).drop("blocks", "query_blocks") for c in (own, ~own))
    first = queries.withColumn("block", F.col("queries") % F.col("blocks"))
    hits_type = "hits array<struct<query:bigint,query_id:bigint,vec_id:bigint,score:bigint>>"
    begun = sent.groupBy(*keys).cogroup(first.groupBy(*keys)).applyInPandas(begin, _PACKED.format("queries") + ", blocks bigint, floor binary, " + hits_type)
    begun = materialise(begun, "first-blocks")
    others = begun.drop("hits").withColumn("block", numbers("blocks")).filter(F.col("block") != F.col("queries") % F.col("blocks"))
    found = rest.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(go_on, HITS.format("bigint"))
    return _best(begun.select(F.explode("hits").alias("h")).select("h.*").unionByName(found), k)


def _long(score: float) -> int:
    """The score as a long; one beyond its range is the end of that range."""
    return max(-(2**63), min(2**63 - 1, int(score)))


class Forest:
    """Random-projection trees of equal depth: a level of a tree has one direction, each of its nodes an offset of its own.

    Leaves are numbered from 0 over all trees.
    """

    def __init__(self, sample: np.ndarray, n: int, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.levels = trees, int(np.clip(np.ceil(np.log2(max(2, n / LEAF_ROWS))), 1, MOST_LEVELS))
        planes = rng.normal(size=(trees, self.levels, sample.shape[1]))
        self.planes = planes / np.linalg.norm(planes, axis=2, keepdims=True)
        #: By tree and level, the median of what the sample projects to, for each node of that level.
        self.offsets = [[np.zeros(2**level) for level in range(self.levels)] for _ in range(trees)]
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(self.levels):
                side = sample @ self.planes[t, level]
                order = np.lexsort((side, node))
                begin, end = (np.searchsorted(node[order], np.arange(2**level), s) for s in ("left", "right"))
                middle = np.minimum((begin + end) // 2, len(sample) - 1)
                self.offsets[t][level] = np.where(end > begin, side[order][middle], 0.0)
                node = 2 * node + (side > self.offsets[t][level][node])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        node = np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            side = x @ self.planes[t].T
            for level in range(self.levels):
                node[:, t] = 2 * node[:, t] + (side[:, level] > self.offsets[t][level][node[:, t]])
        return node + np.arange(self.trees, dtype=np.int32) * 2**self.levels

    def distances(self, x: np.ndarray) -> np.ndarray:
        """How far each row is from each leaf: the squares of its distances to the planes that it would have to cross, summed."""
        out = []
        for t in range(self.trees):
            side = x @ self.planes[t].T
            far = np.zeros((len(x), 1))
            for level in range(self.levels):
                margin = side[:, level, None] - self.offsets[t][level][None, :]
                over = np.square(margin)
                far = np.stack([far + np.where(margin > 0, over, 0), far + np.where(margin > 0, 0, over)], axis=2).reshape(len(x), -1)
            out.append(far)
        return np.concatenate(out, axis=1)

    def visits(self, x: np.ndarray, sizes: np.ndarray, n: int, share: float, k: int) -> np.ndarray:
        """Which leaves each row searches: one queue over all trees, nearest first, until they are to hold ``share`` of n rows.

        Trees are taken as independent, so total / (trees * n) of each tree gives 1 - (1 - that) ** trees of the rows. At
        least k + 1 rows are held by one tree.
        """
        budget = max(self.trees * n * (1 - max(0.0, 1 - share) ** (1 / self.trees)), self.trees * (k + 1))
        out = np.zeros((len(x), len(sizes)), bool)
        for i, far in enumerate(self.distances(x)):
            queue = np.argsort(far, kind="stable")
            out[i, queue[: int(np.searchsorted(np.cumsum(sizes[queue]), budget)) + 1]] = True
        return out


def forest_top_k(table: DataFrame, every: int = 20, k: int = 20, trees: int = TREES, share: float = SHARE, power: float = POWER) -> DataFrame:
    """For each row of ``table`` (vec_id, embedding) whose id is divisible by ``every``: k near rows by inner product.

    The forest's offsets are fitted on about FOREST_SAMPLE rows; every row is put into its leaf of every tree. A query
    takes leaves from a queue that all trees share until they hold ``share * n ** -power`` of the n rows. The rows of
    those leaves are united and each is scored once, exactly. Rows and queries are dealt by hash to blocks, so a leaf
    with a third of all rows is many tasks' work.

    The query's own row is left out; other rows of its id are candidates, and each row of a repeated id is a query of
    its own. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
    an id. Each dimension has a forest of its own; queries meet rows of their dimension. Returns query_id, rank from
    1, vec_id, score, as far as found; ties to the smaller id; none for an empty table. Other columns are ignored.
    """
    rows = materialise(usable(table, nonzero=True), "vectors")
    sizes = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}  # one row for each dimension
    found = [_forest_hits(rows.filter(F.col("dim") == dim).drop("dim"), n, every, k, trees, min(1.0, share * n**-power)) for dim, n in sorted(sizes.items())]
    if not found:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _best(reduce(DataFrame.unionByName, found), k)


def _forest_hits(rows: DataFrame, n: int, every: int, k: int, trees: int, share: float) -> DataFrame:
    """What each block of rows of one dimension finds for each query: its best k of the rows that the query's leaves hold."""
    spark = rows.sparkSession
    chance = F.pmod(F.xxhash64("num"), F.lit(1 << 30))
    sample = rows.filter(chance < int((1 << 30) * min(1.0, FOREST_SAMPLE / n))).orderBy("num").select("v").collect()
    sample = np.array([r.v for r in sample], np.float64) if sample else np.array([rows.first().v], np.float64)
    forest = spark.sparkContext.broadcast(Forest(sample, n, trees))
    dim = sample.shape[1]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            leaves = forest.value.leaves(x)
            columns = [b.column("num"), b.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in leaves], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["num", "vec_id", "v", "leaves"])

    indexed = materialise(rows.mapInArrow(index, "num long, vec_id long, v binary, leaves binary"), "forest-index")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(forest.value.trees * 2**forest.value.levels, np.int64)
        for b in batches:
            held += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], ["leaf", "n"])

    # One count for each leaf: at most trees * 2 ** MOST_LEVELS rows, whatever the number of vectors.
    counted = indexed.select("leaves").mapInArrow(count, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(trees * 2**forest.value.levels, np.int64)
    held[[r.leaf for r in counted]] = [r.n for r in counted]
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    most = max(64, min(BLOCK_ROWS, BLOCK_CELLS // dim))
    blocks, query_blocks = -(-n // most), max(1, -(-indexed.filter(is_query).count() // min(BLOCK_QUERIES, most)))
    deal = lambda b, salt: F.pmod(F.xxhash64("num", F.lit(salt)), F.lit(b))
    others = lambda b: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b - 1).cast("long")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                x = np.frombuffer(b"".join(part.column("v").to_pylist()), np.float64).reshape(part.num_rows, dim)
                bits = np.packbits(forest.value.visits(x, held, n, share, k), axis=1)
                columns = [part.column("num"), part.column("vec_id"), part.column("v"), pa.array([r.tobytes() for r in bits], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["num", "vec_id", "v", "visits"])

    visits = indexed.filter(is_query).select("num", "vec_id", "v").mapInArrow(visit, "num long, vec_id long, v binary, visits binary")
    visits = materialise(visits, "forest-visits").select("num", "vec_id", "v", "visits", deal(query_blocks, 2).alias("queries"), others(blocks).alias("block"))
    candidates = indexed.select("num", "vec_id", "v", "leaves", deal(blocks, 1).alias("block"), others(query_blocks).alias("queries"))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values(["vec_id", "num"])
            nums, ids = left["num"].to_numpy(), left["vec_id"].to_numpy()
            x = np.frombuffer(b"".join(left["v"]), np.float64).reshape(len(left), dim)
            leaves = np.frombuffer(b"".join(left["leaves"]), np.int32).reshape(len(left), trees)
            for own, own_id, v, bits in zip(right["num"], right["vec_id"], right["v"], right["visits"], strict=True):
                visited = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
                at = np.flatnonzero(visited[leaves].any(axis=1) & (nums != own))
                if not len(at):
                    continue
                q = np.frombuffer(v, np.float64)
                if len(at) > k:  # sums in another order may differ in the last bits, so all within reach of the k-th stay
                    rough = x[at] @ q
                    kth = np.partition(rough, len(at) - k)[len(at) - k]
                    at = at[rough >= kth - 1e-9 * (np.abs(q).sum() * np.abs(x[at]).max() + 1e-300)]
                exact = (x[at] * q).sum(axis=1)
                first = _first_k(np.zeros(len(at), np.int64), ids[at], exact, k)
                out += [(own, own_id, i, s) for i, s in zip(ids[at[first]].tolist(), exact[first].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"])

    keys = ["block", "queries"]
    return candidates.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(rerank, HITS.format("double"))
