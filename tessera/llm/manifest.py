"""A Merkle manifest of a dataset: leaves by group, subtree roots exchanged in butterfly rounds, proofs for every row.

Leaves of a group are dealt over aligned blocks of equally many leaves. Each block hashes its own subtree. Then, round by
round, a block swaps the root that it has reached with one block of each other subtree under the same parent, the ones
with the same place inside their subtrees, and hashes the parent. Every block of a subtree does so, redundantly, so that
after the last round each has the root and, from what it received, the proof of all of its leaves above itself; nothing
is sent down again. The roots of the groups are the leaves of one more tree, built in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import materialise, partitions

#: Leaves of a block; a power of the fanout.
LEAVES = 4096
#: Nodes that become one parent.
FANOUT = 2
#: Characters of a digest in hexadecimal.
DIGEST = 64
#: A column of the path upwards: what stands before and behind a node's own digest at each level.
PATH = "array<struct<before:string,behind:string>>"


def _field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(_field, values)), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(leaves: list[str], height: int, fanout: int) -> list[list[str]]:
    """The nodes of ``height`` + 1 levels, from leaves upwards; a run of fewer nodes, even of one, has a parent as well."""
    levels = [leaves]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def siblings(levels: list[list[str]], place: int, fanout: int) -> list[tuple[str, str]]:
    """What stands before and behind a leaf's ancestor in its run, at each level but the last."""
    out = []
    for nodes in levels[:-1]:
        run = place - place % fanout
        out.append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + fanout])))
        place //= fanout
    return out


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    for before, behind in path:
        leaf = digest(before + leaf + behind)
    return leaf


def _height(nodes: int, fanout: int) -> int:
    """Levels until one of so many nodes is left."""
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // fanout), height + 1
    return height


def _block_height(blocks: int, members: int, leaves: int, fanout: int) -> int:
    """Levels of a block's own subtree: up to the root of its group if it is the only one, else those of a full block."""
    return _height(members if blocks == 1 else leaves, fanout)


def _placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with their place in their group and the size of it: sums over range partitions, then over groups inside."""
    spark = rows.sparkSession
    ranged = materialise(rows.repartitionByRange(partitions(spark), group, *order).withColumn("part", F.spark_partition_id()), "manifest-ranges")
    # One row for each group and part that it reaches: no more than groups and parts together.
    counts = ranged.groupBy(group, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(group)).alias("members"))
    nth = F.row_number().over(Window.partitionBy("part", group).orderBy(*order))
    return ranged.withColumn("nth", nth).join(offsets, ["part", group]).withColumn("place", F.col("before") + F.col("nth") - 1).drop("part", "nth", "before")


def _blocks(placed: DataFrame, group: str, carried: Sequence[str], leaves: int, fanout: int) -> DataFrame:
    """One row for each block (group, block, blocks, members, rows, root), its rows in order with the columns ``carried``."""
    listed = F.sort_array(F.collect_list(F.struct("place", *carried))).alias("rows")
    blocks = placed.groupBy(group, F.floor(F.col("place") / leaves).alias("block"), "members").agg(listed)
    blocks = blocks.withColumn("blocks", F.ceil(F.col("members") / leaves))

    def hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for i in range(batch.num_rows):
                mine = [r["leaf"] for r in batch.column("rows")[i].as_py()]
                height = _block_height(batch.column("blocks")[i].as_py(), len(mine), leaves, fanout)
                roots.append(levels_of(mine, height, fanout)[-1][0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "root"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema)
    return materialise(blocks.mapInArrow(hash_blocks, schema + ", root string"), "manifest-blocks")


def exchange(blocks: DataFrame, group: str, fanout: int) -> DataFrame:
    """Butterfly rounds over blocks (group, block, blocks, root): the root of each group and each block's path to it.

    In a round a block asks one block of each other subtree under the same parent. Where the last subtree has fewer
    blocks, its blocks are asked in turn, so none is asked much more often than others.
    """
    state = blocks.select(group, "block", "blocks", "root", F.array().cast(PATH).alias("path"))
    width, most = 1, blocks.agg(F.max("blocks")).first()[0] or 0
    while width < most:
        b, digit = F.col("block"), F.floor(F.col("block") / width) % fanout
        run = F.floor(b / (width * fanout)) * fanout * width
        open_ = state.filter(F.col("blocks") > width)
        asked = open_.select(group, "block", "blocks", digit.alias("digit"), F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("side"), run.alias("run"))
        asked = asked.withColumn("start", F.col("run") + F.col("side") * width).filter((F.col("start") < F.col("blocks")) & (F.col("side") != F.col("digit")))
        there = F.least(F.lit(width).cast("long"), F.col("blocks") - F.col("start"))
        asked = asked.select(group, "block", "digit", "side", (F.col("start") + F.col("block") % width % there).alias("partner"))
        sent = state.select(group, F.col("block").alias("partner"), "root")
        received = asked.join(sent, [group, "partner"]).groupBy(group, "block").agg(F.sort_array(F.collect_list(F.struct("side", "digit", "root"))).alias("got"))
        joined = lambda keep: F.array_join(F.transform(F.filter(F.coalesce("got", F.array().cast("array<struct<side:int,digit:bigint,root:string>>")), keep), lambda g: g["root"]), "")
        state = state.join(received, [group, "block"], "left").withColumns({"up": F.struct(joined(lambda g: g["side"] < g["digit"]).alias("before"), joined(lambda g: g["side"] > g["digit"]).alias("behind"))})
        climbs = F.col("blocks") > width
        root = F.when(climbs, F.sha2(F.concat("up.before", "root", "up.behind"), 256)).otherwise(F.col("root"))
        path = F.when(climbs, F.concat("path", F.array("up"))).otherwise(F.col("path"))
        state = materialise(state.select(group, "block", "blocks", root.alias("root"), path.alias("path")), "manifest-round")
        width *= fanout
    return state


def dataset_manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id", tampered: tuple[str, Column, Column] | None = None, leaves: int = LEAVES, fanout: int = FANOUT) -> DataFrame:
    """The proof of every row of ``docs`` in one tree over all of them (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    A leaf is the digest of the row's ``columns``. Leaves of a group ascend by id, null first, rows of one id by leaf;
    roots of groups ascend by group, null first, bytewise. ``proof_sha256`` is of a leaf's siblings in all levels up to
    the root. ``tampered`` names a column, a condition and another value: rows that meet it are folded from the leaf
    that this value gives, with the original siblings, all others from their own leaf; ``verified`` says whether the
    root comes out. ``leaves`` is a power of ``fanout``.

    Null values, also ids, are values of their own; null and repeated ids and repeated rows each have a leaf, and where
    rows are equal so are their leaves, and each still has its own place and proof. Empty and very long texts are hashed
    whole where they are read; only digests travel. An empty table gives no rows; other columns are ignored.
    """
    if leaves != fanout ** _height(leaves, fanout):
        raise ValueError("leaves of a block are a power of the fanout")
    values = {c: F.col(c) for c in columns}
    leaf = leaf_digest(list(values.values()))
    other = leaf
    if tampered is not None:
        name, changed, value = tampered
        other = F.when(changed, leaf_digest(list((values | {name: value}).values()))).otherwise(leaf)
    # Groups as text that is never null: null is first, and others keep their order.
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("key")
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    blocks = _blocks(_placed(docs.select(key, F.col(id_col).alias("doc_id"), leaf.alias("leaf"), other.alias("other")), "key", ["doc_id", "leaf"]), "key", ["doc_id", "leaf", "other"], leaves, fanout)
    lower = exchange(blocks, "key", fanout)

    tops = lower.filter("block = 0").select(F.lit(0).alias("all"), "key", F.col("root").alias("leaf"))
    top_blocks = _blocks(_placed(tops, "all", ["key"]), "all", ["key", "leaf"], leaves, fanout)
    upper = exchange(top_blocks, "all", fanout)
    of_groups = _proofs(top_blocks, upper.withColumn("subroot", F.lit(None).cast("string")).withColumn("top", F.array().cast(PATH)), ["all", "block"], "key", "string", leaves, fanout)
    tops = materialise(of_groups.select(F.col("id").alias("key"), F.col("root").alias("tree"), F.col("path").alias("top")), "manifest-groups")

    above = lower.withColumnRenamed("root", "subroot").join(tops, "key").withColumnRenamed("tree", "root")
    proofs = _proofs(blocks, above, ["key", "block"], "doc_id", kind, leaves, fanout)
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _proofs(blocks: DataFrame, above: DataFrame, on: list[str], name: str, kind: str, leaves: int, fanout: int) -> DataFrame:
    """Every row of ``blocks`` with its path, from its block's own levels, the block's path and that of its group."""
    joined = blocks.select(*on, "blocks", "rows").join(above.select(*on, "subroot", "root", F.col("path").alias("middle"), "top"), on)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.schema.field("rows").type.value_type
            out = pa.schema([("id", listed.field(name).type), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("path", pa.list_(pair))])
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("rows", "blocks", "subroot", "root", "middle", "top")}
                rows = row["rows"]
                levels = levels_of([r["leaf"] for r in rows], _block_height(row["blocks"], len(rows), leaves, fanout), fanout)
                shared = [(p["before"], p["behind"]) for p in row["middle"] + row["top"]]
                paths = [siblings(levels, place, fanout) + shared for place in range(len(rows))]
                columns = [
                    pa.array([r[name] for r in rows], out.field("id").type),
                    pa.array([r["leaf"] for r in rows], pa.string()),
                    pa.array([row["subroot"]] * len(rows), pa.string()),
                    pa.array([row["root"]] * len(rows), pa.string()),
                    pa.array([digest("".join(a + b for a, b in path)) for path in paths], pa.string()),
                    pa.array([fold(r.get("other") or r["leaf"], path) for r, path in zip(rows, paths, strict=True)], pa.string()),
                    pa.array([[{"before": a, "behind": b} for a, b in path] for path in paths] if keep else [None] * len(rows), out.field("path").type),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    # Paths of rows are only kept for groups, which are few; those of documents would be a block's levels for each row.
    keep = name == "key"
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, path {PATH}"
    pair = pa.struct([("before", pa.string()), ("behind", pa.string())])
    return joined.mapInArrow(prove, schema)
