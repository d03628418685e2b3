"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree. Native."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.places import FILE, PLACE, bit_bucket, bit_position, has_bit, placed
from tessera.llm.scratch import materialise

#: Members of a node of the reduction tree, on average at the leaves and at most above.
FAN = 1024
#: A probability this near to 0 or 1 is whole: what is left of it is rounding.
WHOLE = 1e-9
#: Source tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each source of ``sizes`` (source, source_size): its target by weight, no more than ``most`` times its size.

    Weights repeat over the sources in code-point order, null last. What a capped source cannot take goes to
    the others by weight until none is above its cap: with level x the target is min(cap, x * weight), and x
    follows from the sources sorted by cap / weight. The windows run over one row for each source, not over
    documents.
    """
    ranked = sizes.select("source", F.col("source_size"), "units", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).alias("nth"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The first source, by ratio, whose cap the level no longer reaches sets the level for itself and all after it.
    leveled = capped.withColumn("level", left / rest)
    free = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    return leveled.withColumn("level", F.first(free, ignorenulls=True).over(everything)).select(
        "source", "source_size", "units", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) that the keys alone decide."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def _settled(unit: Column, extra: Column) -> Column:
    return F.struct(unit["doc_id"].alias("doc_id"), unit["size"].alias("size"), unit["rows"].alias("rows"), unit["whole"].alias("whole"), extra.cast("int").alias("extra"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, whatever the number of places where it stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is_whole(p: Column) -> Column:
    return (p <= WHOLE) | (p >= 1 - WHOLE)


def _fold(seed: int, empty: Column):
    """One step of the rounding over units from the largest down; mass, probability times size, moves until one side is whole.

    The open unit meets the next one if that has at least half its size. Else it meets all smaller units together: what
    it gains they lose in proportion to their mass, what it loses they gain in proportion to their space. Each time a
    coin between the two directions keeps every expected mass. So units meet their like, and what is left of a size is
    settled by all that is smaller; the unit that is open in the end is a small one, unless all others had too little.
    ``slope`` and ``shift`` say what has become of the probabilities of the units behind, ``size`` and ``mass`` are theirs.
    """

    def probability(acc: Column, unit: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), acc["slope"] * unit["p"] + acc["shift"]))

    def state(acc: Column, **changed: Column) -> Column:
        return F.struct(*[changed.get(c, acc[c]).alias(c) for c in ("open", "done", "slope", "shift", "size", "mass")])

    def behind(acc: Column, unit: Column) -> dict[str, Column]:
        return {"size": acc["size"] - unit["size"], "mass": acc["mass"] - unit["p"] * unit["size"]}

    def come(acc: Column, unit: Column, p: Column, **changed: Column) -> Column:
        """The unit is settled if it is whole, else open if no other is."""
        done = changed.get("done", acc["done"])
        whole = F.concat(done, F.array(_settled(unit, p > 0.5)))
        opened = F.when(_is_whole(p), changed.get("open", acc["open"])).otherwise(unit.withField("p", p))
        return state(acc, **(changed | behind(acc, unit) | {"open": opened, "done": F.when(_is_whole(p), whole).otherwise(done)}))

    def pair(acc: Column, unit: Column, p: Column) -> Column:
        a, b = acc["open"], unit.withField("p", p)
        to_a, to_b = F.least((1 - a["p"]) * a["size"], p * b["size"]), F.least(a["p"] * a["size"], (1 - p) * b["size"])
        coin = _uniform(F.lit(seed), a["h"], b["h"]) * (to_a + to_b) < to_b
        moved = F.struct((a["p"] + F.when(coin, to_a).otherwise(-to_b) / a["size"]).alias("a"), (p - F.when(coin, to_a).otherwise(-to_b) / b["size"]).alias("b"))

        def after(m: Column) -> Column:
            whole = lambda unit, p: F.when(_is_whole(p), F.array(_settled(unit, p > 0.5))).otherwise(F.slice(acc["done"], 1, 0))
            opened = F.when(~_is_whole(m["a"]), a.withField("p", m["a"])).when(~_is_whole(m["b"]), b.withField("p", m["b"])).otherwise(empty)
            return state(acc, open=opened, done=F.concat(acc["done"], whole(a, m["a"]), whole(b, m["b"])), **behind(acc, unit))

        return _let(moved, after)

    def pool(acc: Column, unit: Column) -> Column:
        a = acc["open"]
        has = F.least(acc["size"].cast("double"), F.greatest(F.lit(0.0), acc["slope"] * acc["mass"] + acc["shift"] * acc["size"]))

        def meet(has: Column) -> Column:
            gain, loss = F.least((1 - a["p"]) * a["size"], has), F.least(a["p"] * a["size"], acc["size"] - has)
            coin = _uniform(F.lit(seed), a["h"], unit["h"]) * (gain + loss) < loss
            # What each of the smaller ones keeps of its mass, or of its space.
            keeps = F.when(coin, F.when(has > 0, 1 - gain / has).otherwise(1.0)).otherwise(F.when(acc["size"] > has, 1 - loss / (acc["size"] - has)).otherwise(1.0))
            return F.struct(coin.alias("coin"), (a["p"] + F.when(coin, gain).otherwise(-loss) / a["size"]).alias("p"), keeps.alias("keeps"))

        def after(m: Column) -> Column:
            whole = _is_whole(m["p"])
            done = F.when(whole, F.concat(acc["done"], F.array(_settled(a, m["p"] > 0.5)))).otherwise(acc["done"])
            shift = acc["shift"] * m["keeps"] + F.when(m["coin"], 0.0).otherwise(1 - m["keeps"])
            left = F.when(whole, empty).otherwise(a.withField("p", m["p"]))
            return _let(state(acc, open=left, done=done, slope=acc["slope"] * m["keeps"], shift=shift), lambda met: last(met, unit, probability(met, unit)))

        return _let(_let(has, meet), after)

    def last(met: Column, unit: Column, p: Column) -> Column:
        # Where the open unit stayed open, all smaller ones are whole, but for rounding.
        rounded = F.when(met["open"].isNotNull(), F.round(p)).otherwise(p)
        return _let(rounded, lambda q: come(met, unit, q))

    def step(acc: Column, unit: Column) -> Column:
        def act(p: Column) -> Column:
            alone = acc["open"].isNull() | _is_whole(p)
            return F.when(alone, come(acc, unit, p)).when(unit["size"] * 2 >= acc["open"]["size"], pair(acc, unit, p)).otherwise(pool(acc, unit))

        return _let(probability(acc, unit), act)

    return step


def _reduce(members: DataFrame, seed: int) -> DataFrame:
    """Fold the members of every (source, node), from the largest down and then by their hashes, to one open unit at most."""
    kinds = dict(members.select("unit.*").dtypes)
    fields = ("size", "h", "doc_id", "rows", "whole", "p")
    unit_type = "struct<" + ",".join(f"{c}:{kinds[c]}" for c in fields) + ">"
    done_type = f"array<struct<doc_id:{kinds['doc_id']},size:bigint,rows:bigint,whole:bigint,extra:int>>"
    ordered = F.sort_array(F.collect_list(F.struct(*[F.col(f"unit.{c}").alias(c) for c in fields])), asc=False).alias("units")
    grouped = members.groupBy("source", "node").agg(ordered, F.sum("unit.size").alias("size"), F.sum(F.col("unit.p") * F.col("unit.size")).alias("mass"))
    empty = F.lit(None).cast(unit_type)
    start = F.struct(empty.alias("open"), F.array().cast(done_type).alias("done"), F.lit(1.0).alias("slope"), F.lit(0.0).alias("shift"), F.col("size"), F.col("mass"))
    return grouped.select("source", "node", F.aggregate("units", start, _fold(seed, empty)).alias("s")).select("source", "node", "s.open", "s.done")


def mix_copies(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 20240229, fan: int = FAN) -> DataFrame:
    """How many copies of each row of ``docs`` (doc_id, text, source) a mix by source weights takes.

    The size of a row is its number of words. A source with target t and size s wants t / s copies of each of
    its rows; the whole part is taken, and the fractional parts go through pivotal rounding. Rows meet in leaves
    of about ``fan`` units chosen by hash, from the largest down, each leaf leaves one open unit at most, mostly its
    smallest, and open units meet in ever higher nodes until one is left for each source, which a coin of its own
    probability settles. So a source misses its target by less than one document, most often one of its smallest.
    Every draw is a hash of the unit, so reruns agree. A hot source only has more leaves.

    Rows that agree in id, source and size form one unit with a row count, so any number of repeats fits; they share
    its copies, which of them has one more is all alike. Units of equal size meet in order of a hash. Very long texts
    count by their words. Rows without words (null, empty or blank text) have no mass and get the whole part of the wanted copies. A null
    source is a source. No row gets more than ``most`` copies, rounded up. An empty table gives no rows.

    Returns doc_id, source, size, copies, source_size, target; one row for each row of ``docs``.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    of_part = materialise(sized.groupBy("doc_id", "source", "size", F.spark_partition_id().alias("part")).agg(F.count("*").alias("held")), "mix-parts")
    units = materialise(of_part.groupBy("doc_id", "source", "size").agg(F.sum("held").alias("rows")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    sources = materialise(source_targets(sizes, weights, share, most), "mix-sources")
    n_sources, most_units = sources.agg(F.count("*"), F.max("units")).first()

    def with_source(df: DataFrame) -> DataFrame:
        table = sources.withColumnRenamed("source", "source_")
        table = F.broadcast(table) if n_sources <= BROADCAST_SOURCES else table
        return df.join(table, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")

    wanted = with_source(units).withColumn("each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    part = F.col("rows") * (F.col("each") - F.floor("each"))
    wanted = wanted.select(
        "source", "doc_id", "size", "rows", (F.col("rows") * F.floor("each") + F.floor(part)).alias("whole"), (part - F.floor(part)).alias("p"),
        F.xxhash64(F.lit(seed), "doc_id", "source", "size").alias("h"), F.ceil(F.col("units") / fan).cast("long").alias("leaves"),
    )
    rounds = (F.col("size") > 0) & (F.col("p") > 0)
    settled = wanted.filter(~rounds).select("source", "doc_id", "size", "rows", F.col("whole").alias("copies"))
    members = wanted.filter(rounds).select("source", F.pmod("h", "leaves").alias("node"), F.struct("size", "h", "doc_id", "rows", "whole", "p").alias("unit"))
    nodes = max(1, -(-(most_units or 1) // fan))
    level = 0
    while True:
        reduced = materialise(_reduce(members, seed + level), f"mix-level-{level}")
        settled = settled.unionByName(
            reduced.select("source", F.explode("done").alias("d")).select("source", "d.doc_id", "d.size", "d.rows", (F.col("d.whole") + F.col("d.extra")).alias("copies"))
        )
        opened = reduced.filter(F.col("open").isNotNull())
        if nodes == 1:
            break
        members = opened.select("source", F.floor(F.col("node") / fan).alias("node"), F.col("open").alias("unit"))
        nodes, level = -(-nodes // fan), level + 1
    last = (_uniform(F.lit(seed - 1), F.col("open.h")) < F.col("open.p")).cast("long")
    settled = settled.unionByName(opened.select("source", "open.doc_id", "open.size", "open.rows", (F.col("open.whole") + last).alias("copies")))

    # Rows of a unit are numbered on from what the parts of the input before hold, so that no task writes out a whole unit.
    share_of_row = F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") < F.col("copies") % F.col("rows")).cast("long")
    before = F.coalesce(F.sum("held").over(Window.partitionBy("doc_id", "source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_part = of_part.withColumn("before", before).withColumnsRenamed({"doc_id": "id_", "source": "source_", "size": "size_"})
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_"))
    one = settled.filter("rows = 1").select("source", "doc_id", "size", "copies")
    several = settled.filter("rows > 1").join(of_part, same)
    several = several.withColumn("nth", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("held") - 1))).select("source", "doc_id", "size", share_of_row.alias("copies"))
    return with_source(one.unionByName(several)).select("doc_id", "source", "size", "copies", "source_size", "target")


#: Units of several rows up to which they are broadcast.
BROADCAST_UNITS = 50_000
#: Bitmaps, of 4 kB for 32768 rows of a file each, that are broadcast together.
BITMAPS = 1 << 14


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as :func:`mix_copies` says, columns unchanged.

    Rows of equal id, source and size share their unit's copies in the order of the parts of the input and, within a
    part, of a hash of the text; which of such rows is first is settled by that alone. A null id or source is a value
    like any other. Rows without words are taken as often as every row of their source is. Very long texts count by
    their words. An empty table gives no rows. What is shuffled are ids and places of rows; how often a row is taken
    comes back to it by broadcast bitmaps of places, up to BITMAPS of them, beyond that by a join.
    """
    unit = ("id_", "source_", "size_")
    table = placed(docs, "mix-input")
    copies = mix_copies(table, **options).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    copies = materialise(copies, "mix-copies")
    sized = table.select(
        FILE, PLACE, F.xxhash64("text").alias("hash_"), F.spark_partition_id().alias("part_"),
        F.col("doc_id").alias("id_"), F.col("source").alias("source_"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size_"),
    )
    sized = materialise(sized, "mix-rows")
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_"))
    shared = copies.filter("rows > 1")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_UNITS else shared
    joined = lambda units: sized.join(units, same).select(FILE, PLACE, "hash_", "part_", *unit, "copies", "rows")
    # Units of one row, nearly all, need no numbers. Rows of a larger unit are numbered within each part of the input,
    # on from what the parts before hold, so a unit of any share of all rows is many tasks' work.
    one = joined(copies.filter("rows = 1")).select(FILE, PLACE, F.col("copies").alias("times"))
    many = joined(shared).withColumn("nth", F.row_number().over(Window.partitionBy(*unit, "part_").orderBy("hash_")) - 1)
    held = sized.join(shared.select("doc_id", "source", "size"), same, "left_semi").groupBy(*unit, "part_").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*unit).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*[F.col(c).alias(f"{c}of") for c in (*unit, "part_")], before.alias("before"))
    many = many.join(held, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}of")) for c in (*unit, "part_")]))
    taken = F.floor(F.col("copies") / F.col("rows")) + (F.col("before") + F.col("nth") < F.col("copies") % F.col("rows")).cast("long")
    times = one.unionByName(many.select(FILE, PLACE, taken.alias("times"))).filter("times > 0")
    return _taken(table, times).select(*docs.columns)


def _taken(table: DataFrame, times: DataFrame) -> DataFrame:
    """The rows of ``table`` (file, place, ...) as often as ``times`` (file, place, times) says, 0 if it has none."""
    bucket = bit_bucket(F.col(PLACE))
    bits = times.groupBy(FILE, bucket.alias("bucket_"), "times").agg(F.bitmap_construct_agg(bit_position(F.col(PLACE))).alias("bits_")).withColumnRenamed("times", "times_")
    bits = materialise(bits, "mix-taken")
    if bits.count() > BITMAPS:
        held = table.join(times.withColumnRenamed("times", "times_"), [FILE, PLACE])
    else:
        held = table.withColumn("bucket_", bucket).join(F.broadcast(bits), [FILE, "bucket_"]).filter(has_bit(F.col("bits_"), F.col(PLACE)))
    return held.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times_"))))
