"""Ranked lexical search: exact inner products by best-first search of sparse ball trees.

A document is a sparse vector over the terms of the items: a term's weight times its saturated frequency, both whole
numbers. An item is the set of its terms, so that a document's score is the inner product of its vector with a vector
of ones. Documents are read in blocks where they lie. Each block becomes a balanced ball tree: a node is split at the
median of the direction between two of its documents that lie far apart, and has the centroid of its documents and the
largest distance of one from it. No document of a node scores more than the item's product with the centroid plus the
root of its number of terms times that radius. The same holds for each term alone, where centre and radius come to the
largest value of the term in the node; the lower of the two bounds, of the ball and of its terms, counts. An item visits nodes in order of that bound, starting with what it has
found in the task's earlier blocks, and stops where the bound is below its k-th score; documents of the leaves that it
reaches are scored in whole numbers.

Bounds are doubles. A sum of n terms of one sign is off by at most n times 2^-53 of itself, so bounds that are raised
by SLACK of themselves are safe for vectors of up to 10^6 terms in a block; in radii, where terms are subtracted, the
same share of what was subtracted is added.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import materialise
from tessera.llm.texts import slices

#: Documents of a block and, if they have many terms, these; documents of a leaf.
BLOCK_DOCS, BLOCK_TERMS, LEAF_DOCS = 4096, 2_000_000, 32
#: Cells of a table of nodes by terms; a tree over more terms has fewer nodes.
CELLS = 6_000_000
#: Bytes of terms of the items that are searched for together; more are searched for in several passes.
ITEM_BYTES = 16_000_000
#: Share by which bounds are raised.
SLACK = 1e-9
#: Percent of the length normalisation, and the constant of the saturation in eighths of a hundredth; fixed values.
LENGTH_PERCENT, SATURATION, SCALE = 90, 8, 1_000_000_000

_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """ASCII letters, in lower case, digits and all other characters beyond ASCII stand together as terms."""
    return text.encode().translate(_TERM_BYTES).split()


def term_weight(n: int, df: int) -> int:
    """The weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Block:
    """Sparse rows (documents) of whole numbers as a ball tree; the rows are put in the order of its leaves."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int, leaf: int = LEAF_DOCS) -> None:
        n = len(starts) - 1
        depth = max(0, min(math.ceil(math.log2(max(n / leaf, 1))), int(math.log2(max(CELLS / max(width, 1), 1)))))
        self.starts, self.terms, self.values, self.width = starts, terms, values, width
        self.order = np.arange(n)
        self.float = values.astype(np.float64)
        self.square = self._sum(self.float * self.float)
        #: Borders of the nodes of each level, and centroids and radii of all nodes, level by level.
        self.borders = [np.array([0, n])]
        centroids, radii = [], []
        for level in range(depth + 1):
            centre, radius, apart = self._balls(self.borders[level])
            centroids.append(centre)
            radii.append(radius)
            if level < depth:
                self._split(self.borders[level], apart)
                self.borders.append(np.unique(np.concatenate([self.borders[level], (self.borders[level][:-1] + self.borders[level][1:]) // 2])) if n > 1 else self.borders[level])
        self.centroids, self.radii = np.concatenate(centroids), np.concatenate(radii)
        self.depth = depth
        self.most = np.concatenate(self._largest()[::-1])

    def _largest(self) -> list[np.ndarray]:
        """The largest value of each term in each node, from leaves upwards."""
        sizes = np.diff(self.borders[-1])
        table = np.zeros(len(sizes) * self.width)
        np.maximum.at(table, np.repeat(np.repeat(np.arange(len(sizes)), sizes), np.diff(self.starts)) * self.width + self.terms, self.float)
        levels = [table.reshape(len(sizes), self.width)]
        for above, below in zip(self.borders[-2::-1], self.borders[:0:-1], strict=True):
            levels.append(np.maximum.reduceat(levels[-1], np.searchsorted(below, above[:-1]), axis=0))
        return levels

    def _sum(self, cells: np.ndarray) -> np.ndarray:
        """Sums of cells by row; rows may be empty."""
        total = np.concatenate([np.zeros(1, cells.dtype), np.cumsum(cells)]) if cells.dtype.kind == "i" else None
        if total is not None:
            return total[self.starts[1:]] - total[self.starts[:-1]]
        out = np.zeros(len(self.starts) - 1)
        filled = np.flatnonzero(self.starts[1:] > self.starts[:-1])
        if len(filled):
            out[filled] = np.add.reduceat(cells, self.starts[filled])
        return out

    def _products(self, node: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Each row's product with its node's row of ``table``."""
        return self._sum(table[np.repeat(node, np.diff(self.starts)), self.terms] * self.float)

    def _row(self, rows: np.ndarray) -> np.ndarray:
        """Rows as dense rows of a table."""
        out = np.zeros((len(rows), self.width))
        for i, r in enumerate(rows):
            lo, hi = self.starts[r], self.starts[r + 1]
            out[i, self.terms[lo:hi]] = self.float[lo:hi]
        return out

    def _balls(self, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroids and radii of the nodes of a level, and each row's distance from its node's centroid."""
        sizes = np.diff(borders)
        node = np.repeat(np.arange(len(sizes)), sizes)
        cell = np.repeat(node, np.diff(self.starts)) * self.width + self.terms
        centre = np.bincount(cell, self.float, len(sizes) * self.width).reshape(len(sizes), self.width) / sizes[:, None]
        length = (centre * centre).sum(axis=1)[node]
        away = np.maximum(self.square - 2 * self._products(node, centre) + length, 0) + SLACK * (self.square + length)
        return centre, np.sqrt(np.maximum.reduceat(away, borders[:-1])) * (1 + SLACK), away

    def _split(self, borders: np.ndarray, away: np.ndarray) -> None:
        """Put the rows of each node in order along the direction between two that are far apart."""
        sizes = np.diff(borders)
        node = np.repeat(np.arange(len(sizes)), sizes)
        farthest = lambda d: np.array([lo + d[lo:hi].argmax() for lo, hi in zip(borders[:-1], borders[1:], strict=True)])
        one = farthest(away)
        table = self._row(one)
        to_one = self._products(node, table)
        table -= self._row(farthest(self.square - 2 * to_one))
        self._reorder(np.lexsort((self._products(node, table), node)))

    def _reorder(self, by: np.ndarray) -> None:
        lengths = np.diff(self.starts)[by]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        cells = np.arange(starts[-1]) - np.repeat(starts[:-1] - self.starts[by], lengths)
        self.terms, self.values, self.float = self.terms[cells], self.values[cells], self.float[cells]
        self.starts, self.square, self.order = starts, self.square[by], self.order[by]

    def bounds(self, items: list[np.ndarray]) -> np.ndarray:
        """The most that a document of each node can score, by node and item."""
        wanted = np.zeros((self.width, len(items)))
        for i, terms in enumerate(items):
            wanted[terms, i] = 1
        reach = np.sqrt([len(t) for t in items])
        ball, terms = self.centroids @ wanted + self.radii[:, None] * reach, self.most @ wanted
        return np.minimum(ball, terms) * (1 + SLACK) + SLACK

    def search(self, terms: np.ndarray, bounds: np.ndarray, found: list[tuple], ids: list, k: int, mask: np.ndarray) -> int:
        """Bring the item's best (score, order of id, id) up to date with this block; returns the number of rows scored.

        ``mask`` has a place for each term, all zero; it is left so.
        """
        mask[terms] = 1
        first = np.cumsum([0] + [len(b) - 1 for b in self.borders])
        open_, scored = [(-bounds[0], 0, 0)], 0
        while open_:
            bound, level, at = heapq.heappop(open_)
            if len(found) == k and -bound < found[0][0]:
                break
            lo, hi = self.borders[level][at], self.borders[level][at + 1]
            if level == self.depth:
                scored += int(hi - lo)
                self._score(int(lo), int(hi), mask, found, ids, k)
                continue
            below = self.borders[level + 1]
            for child in range(int(np.searchsorted(below, lo)), int(np.searchsorted(below, hi))):
                # A node's bound holds for its children as well.
                heapq.heappush(open_, (max(bound, -bounds[first[level + 1] + child]), level + 1, child))
        mask[terms] = 0
        return scored

    def _score(self, lo: int, hi: int, mask: np.ndarray, found: list[tuple], ids: list, k: int) -> None:
        a, b = self.starts[lo], self.starts[hi]
        total = np.concatenate([[0], np.cumsum(self.values[a:b] * mask[self.terms[a:b]])])
        scores = total[self.starts[lo + 1 : hi + 1] - a] - total[self.starts[lo:hi] - a]
        least = found[0][0] if len(found) == k else 1
        for r in np.flatnonzero(scores >= least):
            key = ids[self.order[lo + r]]
            entry = (int(scores[r]), _later(key), key)
            if len(found) < k:
                heapq.heappush(found, entry)
            elif entry[:2] > found[0][:2]:
                heapq.heapreplace(found, entry)


class _later:
    """Ids in descending order, null the least: of equal scores the smallest id is worth most, null least."""

    __slots__ = ("key",)

    def __init__(self, key: object) -> None:
        self.key = key

    def __lt__(self, other: _later) -> bool:
        if self.key is None or other.key is None:
            return self.key is None and other.key is not None
        return other.key < self.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _later) and self.key == other.key

    __hash__ = None


def project(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """Each document that has a term: its number of terms, and those of ``vocabulary`` with their frequencies."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(sent.value)}
        for part, texts in slices(batches):
            sizes, terms, counts = [], [], []
            for text in texts:
                words = terms_of(text)
                known = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
                which, often = np.unique(known[known >= 0], return_counts=True)
                sizes.append(len(words))
                terms.append(which)
                counts.append(often.astype(np.int32))
            rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])
            yield rows.filter(pa.array([s > 0 for s in sizes], pa.bool_()))

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, counts array<int>")


def document_frequencies(projected: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of ``size`` terms: counted in every task, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["term", "df"])

    rows = projected.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return out


def _blocks(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n: int, length: int) -> Iterator[tuple[Block, list]]:
    """Blocks of documents of bounded size, with the ids of their documents."""
    ids, sizes, terms, counts, held = [], [], [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            ids.append(batch.column("doc_id")[i].as_py())
            sizes.append(batch.column("n")[i].as_py())
            terms.append(batch.column("terms")[i].values.to_numpy())
            counts.append(batch.column("counts")[i].values.to_numpy())
            held += len(terms[-1])
            if len(ids) == BLOCK_DOCS or held >= BLOCK_TERMS:
                yield _block(sizes, terms, counts, weights, n, length), ids
                ids, sizes, terms, counts, held = [], [], [], [], 0
    if ids:
        yield _block(sizes, terms, counts, weights, n, length), ids


def _block(sizes: list[int], terms: list[np.ndarray], counts: list[np.ndarray], weights: np.ndarray, n: int, length: int) -> Block:
    lengths = np.array([len(t) for t in terms])
    norm = np.repeat(np.array([100 - LENGTH_PERCENT + LENGTH_PERCENT * s * n // length for s in sizes], np.int64), lengths)
    which, tf = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.int64)
    values = weights[which] * ((SCALE * tf) // (1000 * tf + SATURATION * norm))
    return Block(np.concatenate([[0], np.cumsum(lengths)]), which, values, len(weights))


def _search(projected: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, n: int, length: int, k: int) -> DataFrame:
    """The k best documents of each item among those of each task (item, doc_id, score)."""
    sent = projected.sparkSession.sparkContext.broadcast((items, weights))
    kind = dict(projected.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        found: list[list[tuple]] = [[] for _ in items]
        mask = np.zeros(len(weights), np.int64)
        at_once = max(1, CELLS // max(len(weights), 1))
        id_type = pa.null()

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("doc_id").type
                yield batch

        for block, ids in _blocks(typed(), weights, n, length):
            for lo in range(0, len(items), at_once):
                bounds = block.bounds([terms for _, terms in items[lo : lo + at_once]])
                for j, (_, terms) in enumerate(items[lo : lo + at_once]):
                    block.search(terms, bounds[:, j], found[lo + j], ids, k, mask)
        rows = [(item, entry[2], entry[0]) for (item, _), best in zip(items, found, strict=True) for entry in best]
        if rows:
            item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, id_type), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return projected.mapInArrow(run, f"item bigint, doc_id {kind}, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The k documents of ``docs`` that score highest for each row of ``items`` (item_id, rank, doc_id, score).

    Only scores above 0 count; equal scores rank by ascending id, null last; of rows with one id each is a document of
    its own. Every row of ``items`` has its own list, also rows with null or repeated ids or equal texts. A null or
    empty text has no terms: a document without terms counts nowhere, an item without terms has no rows. Very long
    texts are read whole. Empty tables give no rows; other columns are ignored.

    The terms of the items are sent to every task, at most about ``item_bytes`` of them in a pass over the documents. A
    task keeps k documents for each item, whatever it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            terms = [sorted({t.decode() for t in terms_of(text)}) for text in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(terms, pa.list_(pa.string()))], ["item", "item_id", "terms"])

    kind = dict(items.select(F.col(item_col).alias("item_id")).dtypes)["item_id"]
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    asked = materialise(numbered.mapInArrow(run, f"item bigint, item_id {kind}, terms array<string>").filter("size(terms) > 0"), "lexical-items")
    weight = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t))
    passes = 1 + (asked.agg(F.sum(weight)).first()[0] or 0) // item_bytes
    found = None
    for i in range(passes):
        mine = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == i)
        best = _one_pass(docs, mine, k, id_col, text_col)
        found = best if found is None else found.unionByName(best)
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _one_pass(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """The k best documents of each task for the items ``asked``, whose terms are bounded in bytes."""
    rows = asked.select("item", "terms").toArrow()
    listed = [[t.encode() for t in terms] for terms in rows.column("terms").to_pylist()]
    vocabulary = sorted({t for terms in listed for t in terms})
    projected = materialise(project(docs, vocabulary, id_col, text_col), "lexical-docs")
    n, length = projected.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(projected, len(vocabulary))
    weights = np.array([term_weight(n, d) if d else 0 for d in df.tolist()], np.int64)
    number = {t: i for i, t in enumerate(vocabulary)}
    # A term without weight or document adds nothing to any score.
    items = [(item, np.array([number[t] for t in terms if weights[number[t]] > 0], np.int64)) for item, terms in zip(rows.column("item").to_pylist(), listed, strict=True)]
    items = [(item, terms) for item, terms in items if len(terms)]
    if not items:
        return projected.select(F.lit(0).cast("long").alias("item"), "doc_id", F.lit(0).cast("long").alias("score")).filter("false")
    return _search(projected, items, weights, n, length, k)
