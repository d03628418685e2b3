"""Several edits of one text, in order: which of them hold, and the text that they leave.

An edit is a row (path, edit_id, ...); those of a file count in order of ``edit_id``, and one whose lines meet those of an
earlier edit that was applied is rejected. An edit that was rejected or not found holds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import corpus
from tessera.operators.scans import PART, carried, in_ranges, inside

APPLIED, OVERLAPPING, NO_MATCH, NO_MATCH_FOUND = "APPLIED", "OVERLAPPING_EDIT", "NO_MATCH", "NO_MATCH_FOUND"
_LINES = "struct<first:int,last:int>"
_OUTCOME = "struct<edit_id:{},status:string,kind:string,similarity:double,first_line:int,last_line:int>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, whatever the number of places where it stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _meets(held: Column, first: Column, last: Column) -> Column:
    return F.exists(held, lambda h: (h["first"] <= last) & (h["last"] >= first))


def overlap_groups(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``placed`` (key, edit_id, first_line, last_line) with ``group_``, the first line of a group of edits that hang together.

    Edits of different groups of a document never meet. Rows are in order of their first lines; a group begins where
    no earlier row reaches to, which is carried over range partitions.
    """
    order = ["first_line", "last_line", "edit_id"]
    ranged = carried(in_ranges(placed, [key, *order], "edits"), [key], {"before_": (F.max("last_line"), F.max)})
    reach = F.max("last_line").over(inside([key], order).rowsBetween(Window.unboundedPreceding, -1))
    begins = ranged.withColumn("reach_", F.greatest(F.col("before_"), reach))
    begins = begins.withColumn("begin_", F.when(F.col("reach_").isNull() | (F.col("first_line") > F.col("reach_")), F.col("first_line"))).drop("before_", "reach_")
    begins = carried(begins, [key], {"group_": (F.max("begin_"), F.max)})
    upto = F.max("begin_").over(inside([key], order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return begins.withColumn("group_", F.greatest(F.col("group_"), upto)).drop("begin_", PART)


def accepted_in_order(edits: Column) -> Column:
    """Of an array of edits (edit_id, first_line, last_line, ...), in order of ``edit_id``, those that meet no accepted one before."""
    empty = F.filter(edits, lambda _: F.lit(False))
    return F.aggregate(F.array_sort(edits, lambda a, b: F.when(a["edit_id"] < b["edit_id"], -1).when(a["edit_id"] > b["edit_id"], 1).otherwise(0)), empty, lambda held, e: (
        F.when(F.exists(held, lambda h: (h["first_line"] <= e["last_line"]) & (h["last_line"] >= e["first_line"])), held).otherwise(F.concat(held, F.array(e)))
    ))


def edit_conflicts(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Edits (key, edit_id, first_line, last_line) whose lines meet those of an earlier applied edit of the same document.

    Only edits of one overlap group are put in order together, so a document with very many edits is not one task's
    work unless they all hang together.
    """
    groups = overlap_groups(placed.select(key, "edit_id", "first_line", "last_line"), key)
    listed = groups.groupBy(key, "group_").agg(F.collect_list(F.struct("edit_id", "first_line", "last_line")).alias("edits"))
    lost = F.array_except("edits", accepted_in_order(F.col("edits")))
    return listed.select(key, F.explode(lost).alias("e")).select(key, "e.edit_id", "e.first_line", "e.last_line")


def edited_files(files: DataFrame, edits: DataFrame, force: bool = False, least: float = 0.6) -> DataFrame:
    """Each file (path, text) with all edits (edit_id, old_text, new_text) that belong in it, put together.

    Edits are looked for in all files at once, by :func:`tessera.operators.corpus.located_edits`. Those that its bands
    apply are accepted in order of ``edit_id`` unless their lines meet an accepted edit's; the lines of each accepted
    one are then replaced, from the first to the last. Returns path, edited (null where no edit is accepted), accepted
    and rejected, sorted arrays of their ids.
    """
    # What is less alike than the lowest band that is applied decides nothing, as the best match of an edit decides.
    lowest = (tx.NEEDS_FORCE if force else tx.APPLY) / 100 - 1e-9
    found = corpus.located_edits(files, edits, force, max(least, lowest)).filter("applied")
    piece = F.struct("edit_id", F.col("line_no").alias("first_line"), "last_line", "target", "new_text")
    listed = found.groupBy("path").agg(F.collect_list(piece).alias("edits")).withColumn("held", accepted_in_order(F.col("edits")))
    joined = files.select("path", "text").join(listed, "path", "left")
    rows = F.split(tx.unix_lines(F.col("text")), "\n")
    by_line = F.array_sort("held", lambda a, b: F.when(a["first_line"] < b["first_line"], -1).when(a["first_line"] > b["first_line"], 1).otherwise(0))
    # The lines so far, and the number of lines of the file that they stand for.
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("upto"))

    def replace(state: Column, e: Column) -> Column:
        lines = lambda first, last: F.slice(rows, first, last - first + 1)
        stretch = F.array_join(lines(e["first_line"], e["last_line"]), "\n")
        kept = lines(state["upto"] + 1, e["first_line"] - 1)
        return F.struct(F.concat(state["out"], kept, F.array(corpus.exact_edit(stretch, e["target"], e["new_text"]))).alias("out"), e["last_line"].alias("upto"))

    end = F.aggregate(by_line, start, replace, lambda state: F.array_join(F.concat(state["out"], F.slice(rows, state["upto"] + 1, F.size(rows))), "\n"))
    ids = lambda edits: F.array_sort(F.transform(edits, lambda e: e["edit_id"]))
    none = F.array().cast(f"array<{dict(edits.dtypes)['edit_id']}>")
    return joined.select(
        "path", F.when(F.size("held") > 0, end).alias("edited"), F.coalesce(ids(F.col("held")), none).alias("accepted"),
        F.coalesce(F.array_except(ids(F.col("edits")), ids(F.col("held"))), none).alias("rejected"),
    )


def _best_window(rows: Column, old: Column, k: Column, least: float, most_distance: float, ignore_whitespace: bool) -> Column:
    """(similarity, place) of the window of k lines that is most like ``old``, the first of several; null if none is good enough."""
    wanted = tx.prepared(old, True, ignore_whitespace)

    def score(i: Column) -> Column:
        text = F.array_join(F.slice(rows, i + 1, k), "\n")
        window = tx.prepared(text, True, ignore_whitespace)
        longer = F.greatest(F.length(window), F.length(wanted))
        most = F.floor(F.lit(1 - least) * longer + F.lit(1e-9)).cast("int")
        near = F.abs(F.length(window) - F.length(wanted)) <= most
        distance = F.when(near, F.call_function("levenshtein", window, wanted, most)).otherwise(-1)
        similarity = F.when(longer == 0, 1.0).when(distance >= 0, 1 - distance / longer).otherwise(0.0)
        share = F.when(distance >= 0, distance / F.greatest(F.length(text), F.length(old), F.lit(1))).otherwise(1.0)
        return F.struct(similarity.alias("similarity"), (-i).alias("back"), share.alias("share"))

    windows = F.transform(F.sequence(F.lit(0), F.size(rows) - k), score)
    best = F.when(F.size(rows) >= k, F.array_max(windows))
    return F.when((best["similarity"] >= least - 1e-12) & (best["share"] <= most_distance), best)


def edits_in_sequence(files: DataFrame, edits: DataFrame, case_sensitive: bool = False, ignore_whitespace: bool = True, least: float = 0.7, most_distance: float = 0.25) -> DataFrame:
    """Each file (path, text) after its own edits (path, edit_id, old_text, new_text), one after the other (path, edited, outcomes).

    Each edit is looked for in the text that the edits before it left: its first exact occurrence; else, unless
    ``case_sensitive``, the window of as many lines that is most like it in prepared form, from a similarity of
    ``least`` and up to a distance of ``most_distance`` of the longer text. Its lines may not meet those of an edit that
    was applied before, which move as lines above them come and go. An edit changes the occurrence, or the lines of its
    window, and has one entry in ``outcomes`` (edit_id, status, kind, similarity, first_line, last_line), with the lines
    where it stood when it was applied or rejected.

    Files without edits are left as they are, edits of no file are nowhere, an empty old text matches nothing. The edits
    of a file are one row, as each depends on those before it.
    """
    kind = dict(edits.dtypes)["edit_id"]
    ordered = F.array_sort(F.collect_list(F.struct("edit_id", tx.unix_lines(F.coalesce("old_text", F.lit(""))).alias("old"), tx.unix_lines(F.coalesce("new_text", F.lit(""))).alias("new"))))
    joined = files.select("path", tx.unix_lines(F.col("text")).alias("text")).join(edits.groupBy("path").agg(ordered.alias("edits")), "path", "left")
    none = lambda t: F.array().cast(f"array<{t}>")
    start = F.struct(F.col("text").alias("text"), none(_LINES).alias("held"), none(_OUTCOME.format(kind)).alias("outcomes"))

    def step(state: Column, e: Column) -> Column:
        found = F.struct(F.split(state["text"], "\n").alias("rows"), F.when(F.length(e["old"]) > 0, F.instr(state["text"], e["old"])).otherwise(0).alias("at"))
        return _let(found, lambda f: _let(place(state, e, f), lambda p: outcome(state, e, f, p)))

    def lines_of(text: Column) -> Column:
        return F.size(F.split(text, "\n"))

    def place(state: Column, e: Column, found: Column) -> Column:
        """Where the edit stands: lines, similarity and kind, all null if nowhere."""
        k = lines_of(e["old"])
        exact = F.struct(lines_of(F.substring(state["text"], F.lit(1), found["at"] - 1)).alias("first"), F.lit(1.0).alias("similarity"), F.lit("exact").alias("kind"))
        nowhere = F.lit(None).cast("struct<first:int,similarity:double,kind:string>")
        window = nowhere
        if not case_sensitive:
            best = _best_window(found["rows"], e["old"], k, least, most_distance, ignore_whitespace)
            near = _let(best, lambda b: F.when(b.isNotNull(), F.struct((1 - b["back"]).alias("first"), b["similarity"].alias("similarity"), F.lit("window").alias("kind"))))
            window = F.when(F.length(e["old"]) > 0, near)
        return _let(F.when(found["at"] > 0, exact).otherwise(window), lambda w: F.struct(w["first"].alias("first"), (w["first"] + k - 1).alias("last"), w["similarity"].alias("similarity"), w["kind"].alias("kind")))

    def outcome(state: Column, e: Column, found: Column, p: Column) -> Column:
        missing = NO_MATCH_FOUND if case_sensitive else NO_MATCH
        status = F.when(p["first"].isNull(), missing).when(_meets(state["held"], p["first"], p["last"]), OVERLAPPING).otherwise(APPLIED)
        return _let(status, lambda s: F.struct(
            F.when(s == APPLIED, changed(state, e, found, p)).otherwise(state["text"]).alias("text"),
            F.when(s == APPLIED, held_after(state, e, p)).otherwise(state["held"]).alias("held"),
            F.concat(state["outcomes"], F.array(F.struct(e["edit_id"].alias("edit_id"), s.alias("status"), p["kind"].alias("kind"), p["similarity"].alias("similarity"), p["first"].alias("first_line"), p["last"].alias("last_line")))).alias("outcomes"),
        ))

    def changed(state: Column, e: Column, found: Column, p: Column) -> Column:
        spliced = F.concat(F.slice(found["rows"], 1, p["first"] - 1), F.array(e["new"]), F.slice(found["rows"], p["last"] + 1, F.size(found["rows"])))
        return F.when(p["kind"] == "exact", corpus.exact_edit(state["text"], e["old"], e["new"])).otherwise(F.array_join(spliced, "\n"))

    def held_after(state: Column, e: Column, p: Column) -> Column:
        """Lines that are held: those behind the edit move by what it adds, and its own new lines."""
        grown = lines_of(e["new"]) - (p["last"] - p["first"] + 1)
        shift = lambda h: F.when(h["first"] > p["last"], grown).otherwise(0)
        moved = F.transform(state["held"], lambda h: F.struct((h["first"] + shift(h)).alias("first"), (h["last"] + shift(h)).alias("last")))
        return F.concat(moved, F.array(F.struct(p["first"].alias("first"), (p["last"] + grown).alias("last"))))

    end = F.aggregate(F.coalesce("edits", none(f"struct<edit_id:{kind},old:string,new:string>")), start, step)
    return joined.select("path", end.alias("end")).select("path", F.col("end.text").alias("edited"), "end.outcomes")
