"""Search, statistics and set-wise edits over tables of files (path, text, size) and lines (path, line_no, text)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.matching import find_patterns, similar_pairs, similar_stretches


def lines(files: DataFrame, keep: Sequence[str] = ("path",)) -> DataFrame:
    split = F.posexplode(F.split(tx.unix_lines(F.col("text")), "\n")).alias("pos", "text")
    return files.select(*keep, split).select(*keep, (F.col("pos") + 1).alias("line_no"), "text")


def filter_files(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), extensions: Sequence[str] = (), max_depth: int | None = None, name: str | None = None, max_size: int | None = None, text_only: bool = False, defaults: bool = False) -> DataFrame:
    """Files by globs, extensions, depth, part of the name and size; all on metadata, before any content is read.

    With ``defaults`` the default excludes count besides those given, and the default includes where none is given.
    """
    if defaults:
        include, exclude = include or tx.DEFAULT_INCLUDES, [*tx.DEFAULT_EXCLUDES, *exclude]
    path, out = F.col("path"), files
    if include:
        out = out.filter(tx.matches_any(path, list(include)))
    if exclude:
        out = out.filter(~tx.matches_any(path, list(exclude)))
    if extensions:
        out = out.filter(tx.extension(path).isin(*extensions))
    if text_only:
        out = out.filter((tx.extension(path) == "") | tx.extension(path).isin(*tx.TEXT_EXTENSIONS))
    if max_depth is not None:
        out = out.filter(tx.depth(path) <= max_depth)
    if name is not None:
        out = out.filter(F.contains(tx.file_name(path), F.lit(name)))
    if max_size is not None:
        out = out.filter(F.col("size") <= max_size)
    return out


def search(line_table: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = True) -> DataFrame:
    """Lines that hold a literal or match a regular expression; one that does not compile is taken literally."""
    if usable := tx.line_pattern(pattern, regex):
        return line_table.filter(F.col("text").rlike(("(?i)" if ignore_case else "") + usable))
    text, wanted = (F.lower("text"), pattern.lower()) if ignore_case else (F.col("text"), pattern)
    return line_table.filter(F.contains(text, F.lit(wanted)))


def search_many(line_table: DataFrame, patterns: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Each line with each of the literals (pattern_id, pattern) that it holds, and the place of the first: one pass for all of them."""
    fold = F.lower if ignore_case else F.col
    asked = patterns.select("pattern_id", fold("pattern").alias("pattern"))
    found = find_patterns(line_table.select("path", "line_no", fold("text").alias("text")), asked)
    return found.select("path", "line_no", "pattern_id", F.col("at").alias("column"))


def symbol_search(line_table: DataFrame, name: str) -> DataFrame:
    """One row for each line and declaration pattern that it matches."""
    patterns = [p.format(re.escape(name)) for p in tx.SYMBOL_PATTERNS]
    hits = F.explode(F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(i)) for i, p in enumerate(patterns)]))).alias("pattern")
    return line_table.select("path", "line_no", "text", hits)


def similar_lines(line_table: DataFrame, queries: DataFrame, threshold: float, least_length: int = 3) -> DataFrame:
    """Lines whose similarity to a line of a query (query_id, query) is over ``threshold`` (path, line_no, text, query_id, query_line, similarity)."""
    q = queries.select("query_id", F.posexplode(F.split("query", "\n")).alias("query_line", "query")).withColumn("query", tx.stripped(F.col("query"))).filter(F.length("query") >= least_length)
    rows = line_table.withColumn("line", tx.stripped(F.col("text"))).filter(F.length("line") >= least_length)
    return similar_pairs(rows, q, threshold).select(*line_table.columns, "query_id", "query_line", "similarity")


def similar_blocks(line_table: DataFrame, queries: DataFrame, threshold: float, least_length: int = 10) -> DataFrame:
    """Blocks of as many lines as a query of several lines has, over ``threshold`` (path, line_no, text, query_id, similarity)."""
    q = queries.withColumn("k", F.size(F.split("query", "\n"))).filter("k > 1").select("query_id", "k", tx.stripped(F.col("query")).alias("query"))
    sizes = [r.k for r in q.select("k").distinct().orderBy("k").collect()]  # numbers of lines, few by their nature
    found = [line_table.select("path", "line_no", "text", F.lit(None).cast(q.schema["query_id"].dataType).alias("query_id"), F.lit(0.0).alias("similarity")).filter("false")]
    for k in sizes:
        rows = blocks(line_table, k).withColumn("line", tx.stripped(F.col("text"))).filter(F.length("line") >= least_length)
        found.append(similar_pairs(rows, q.filter(F.col("k") == k), threshold).select("path", "line_no", "text", "query_id", "similarity"))
    return reduce(DataFrame.unionByName, found)


def best_matches(line_table: DataFrame, queries: DataFrame, least: float = 0.1, n: int = 5) -> DataFrame:
    """For each file and query the n most similar lines and, for a query of several lines, blocks (path, query_id, nth, kind, line_no, similarity, text).

    Ties: lines before blocks, then by line and by line of the query.
    """
    singles = similar_lines(line_table, queries, least).withColumn("kind", F.lit("single_line"))
    several = similar_blocks(line_table, queries, least).withColumns({"kind": F.lit("multi_line"), "query_line": F.lit(0)})
    columns = ["path", "query_id", "line_no", "query_line", "kind", "similarity", "text"]
    return _ranked(singles.select(columns).unionByName(several.select(columns)), n)


def _ranked(found: DataFrame, n: int) -> DataFrame:
    by = Window.partitionBy("path", "query_id").orderBy(F.desc("similarity"), F.desc("kind"), "line_no", "query_line")
    ranked = found.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= n)
    return ranked.select("path", "query_id", "nth", "kind", "line_no", "similarity", "text")


def best_in_files(files: DataFrame, queries: DataFrame, least: float = 0.1, n: int = 5) -> DataFrame:
    """What :func:`best_matches` finds in the lines of ``files`` (path, text), by one pass over the texts that moves no block of lines."""
    single = queries.select("query_id", F.lit(1).alias("size"), F.posexplode(F.split("query", "\n")).alias("query_line", "query"))
    single = single.withColumn("query", tx.stripped(F.col("query"))).filter(F.length("query") >= 3)
    several = queries.select("query_id", F.size(F.split("query", "\n")).alias("size"), F.lit(0).alias("query_line"), tx.stripped(F.col("query")).alias("query")).filter("size > 1")
    found = similar_stretches(files.select("path", "text"), single.unionByName(several), least, (3, 10))
    kind = F.when(F.col("size") == 1, "single_line").otherwise("multi_line")
    return _ranked(found.select("path", "query_id", "line_no", "query_line", kind.alias("kind"), "similarity", F.col("stretch").alias("text")), n)


def blocks(line_table: DataFrame, k: int) -> DataFrame:
    """Every full block of k consecutive lines of a file, by the number of its first line."""
    ahead = Window.partitionBy("path").orderBy("line_no").rowsBetween(0, k - 1)
    listed = F.collect_list("text").over(ahead)
    return line_table.select("path", "line_no", listed.alias("block")).filter(F.size("block") == k).select("path", "line_no", F.array_join("block", "\n").alias("text"))


def context(line_table: DataFrame, n: int) -> DataFrame:
    around = Window.partitionBy("path").orderBy("line_no").rowsBetween(-n, n)
    return line_table.withColumn("context", F.array_join(F.collect_list("text").over(around), "\n"))


def top_matches(matches: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The n best of each key: highest similarity, then first line."""
    by = Window.partitionBy(*keys).orderBy(F.desc("similarity"), "line_no", "query_id")
    return matches.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= n)


def smart_search(line_table: DataFrame, query: str, max_results: int, threshold: float = 0.6) -> DataFrame:
    """Symbol, text and, only if both are empty, similarity matches in one ranked list; each source has a share of the results."""
    tag = lambda df, source, rank: df.select("path", "line_no", F.lit(source).alias("source"), F.lit(rank).alias("priority"))
    symbols = tag(symbol_search(line_table, query), "symbol", 2)
    texts = tag(search(line_table, query), "text", 3)
    found = symbols.unionByName(texts)
    spark = line_table.sparkSession
    if found.isEmpty():
        found = tag(similar_lines(line_table, spark.createDataFrame([(0, query)], "query_id int, query string"), threshold), "similarity", 4)
    caps = F.when(F.col("source") == "text", max_results).otherwise(max(1, max_results // 2))
    first = Window.partitionBy("source").orderBy("path", "line_no")
    return found.distinct().withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= caps).orderBy("priority", "path", "line_no").limit(max_results).drop("nth")


def corpus_statistics(files: DataFrame) -> DataFrame:
    """Characters, lines and white-space tokens of each file."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.size(F.filter(F.split(text, r"[ \t\n\r]+"), lambda t: t != ""))
    return files.select("path", F.length(text).alias("characters"), F.size(F.split(text, "\n")).alias("lines"), tokens.alias("tokens"))


def corpus_totals(files: DataFrame) -> DataFrame:
    """One row: files, and characters, lines and tokens over all of them."""
    each = corpus_statistics(files)
    return each.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("characters", "lines", "tokens")])


def sorted_listing(files: DataFrame, most: int | None = None) -> DataFrame:
    """Files in order of path; with ``most`` the first so many, of which each task keeps no more."""
    ordered = files.orderBy("path")
    return ordered if most is None else ordered.limit(most)


def directory_rollup(files: DataFrame) -> DataFrame:
    """Files and bytes below every directory, at any depth; the root is the empty path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select(F.explode(above).alias("dir"), "size").groupBy("dir").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).withColumn("depth", F.when(F.col("dir") == "", 0).otherwise(tx.depth(F.col("dir"))))


def bundles(files: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Files of each named group of globs; a file may be in several."""
    member = F.explode(F.array_compact(F.array(*[F.when(F.col("path").rlike(tx.glob_pattern(g)), F.lit(n)) for n, g in groups.items()]))).alias("bundle")
    return files.select("path", member)


def content_duplicates(files: DataFrame) -> DataFrame:
    return files.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.count("*").alias("n"), F.min("path").alias("first_path")).filter("n > 1")


def secret_scan(line_table: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Lines that match a rule (reason, pattern): one row for each line and reason."""
    hits = F.explode(F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(r)) for r, p in rules]))).alias("reason")
    return line_table.select("path", "line_no", hits)


def without_suspicious(files: DataFrame, found: DataFrame) -> DataFrame:
    return files.join(found.select("path").distinct(), "path", "left_anti")


def changed_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines of (path, text) that only one side has, with repeats, marked - or +."""
    pick = lambda df: df.select("path", "text")
    return pick(before).exceptAll(pick(after)).withColumn("sign", F.lit("-")).unionByName(pick(after).exceptAll(pick(before)).withColumn("sign", F.lit("+")))


def exact_edit(text: Column, old: Column, new: Column) -> Column:
    """The text with the first occurrence of ``old`` replaced; null if there is none."""
    at = F.instr(text, old)
    return F.when((at > 0) & (F.length(old) > 0), F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text))))


def eligibility(content: Column, path: Column, size: Column, limit: int = 5 * 1024 * 1024) -> Column:
    return F.when(size > limit, "FILE_TOO_LARGE").when(tx.classify(content, path) == tx.BINARY, "BINARY_FILE_ERROR").otherwise("OK")


def located_edits(files: DataFrame, edits: DataFrame, force: bool = False, least: float = 0.1) -> DataFrame:
    """Where each edit (edit_id, old_text, new_text) belongs in each file (path, text) in which anything is like it.

    An exact occurrence is where it belongs, with band ``exact``. Else the best line or block decides by its band:
    applied, applied with ``force``, or reported. Returns path, edit_id, band, similarity, kind, line_no, last_line,
    applied, target (what stands there) and new_text.
    """
    e = edits.select("edit_id", "old_text", "new_text")
    exact = find_patterns(files.select("path", "text"), e, pattern="old_text")
    line = F.size(F.split(F.substring("text", F.lit(1), F.col("at") - 1), "\n"))
    exact = exact.select(
        "path", "edit_id", F.lit("exact").alias("band"), F.lit(1.0).alias("similarity"), F.lit("exact").alias("kind"), line.alias("line_no"),
        (line + F.size(F.split("old_text", "\n")) - 1).alias("last_line"), F.lit(True).alias("applied"), F.col("old_text").alias("target"), "new_text",
    )
    best = best_in_files(files, edits.select(F.col("edit_id").alias("query_id"), F.col("old_text").alias("query")), least, 1)
    best = best.select("path", F.col("query_id").alias("edit_id"), "similarity", "kind", "line_no", F.col("text").alias("found"))
    best = best.withColumn("band", tx.similarity_band(F.col("similarity") * 100))
    best = best.withColumn("applied", (F.col("band") == "apply") | ((F.col("band") == "needs force") & F.lit(force))).join(e.select("edit_id", "new_text"), "edit_id")
    last = F.col("line_no") + F.size(F.split("found", "\n")) - 1
    best = best.select("path", "edit_id", "band", "similarity", "kind", "line_no", last.alias("last_line"), "applied", tx.stripped(F.col("found")).alias("target"), "new_text")
    # Both are looked for once; what is only alike counts where nothing is exact.
    is_exact = F.col("kind") == "exact"
    both = exact.unionByName(best).withColumn("exact_", F.max(is_exact).over(Window.partitionBy("path", "edit_id")))
    return both.filter(is_exact | ~F.col("exact_")).drop("exact_")


def fuzzy_edits(files: DataFrame, edits: DataFrame, force: bool = False, least: float = 0.1) -> DataFrame:
    """What becomes of each edit in each file where anything is like it, each for itself.

    Returns what :func:`located_edits` finds (path, edit_id, band, similarity, kind, line_no, applied) and edited, the
    text with what was found replaced. :func:`tessera.operators.edits.edited_files` puts the edits of a file together.
    """
    found = located_edits(files, edits, force, least).join(files.select("path", "text"), "path")
    edited = F.when(F.col("applied"), exact_edit(F.col("text"), F.col("target"), F.col("new_text")))
    return found.select("path", "edit_id", "band", "similarity", "kind", "line_no", "applied", edited.alias("edited"))


def window_edits(line_table: DataFrame, old_text: str, least: float = 0.7, most_distance: float = 0.25, ignore_whitespace: bool = True, case_sensitive: bool = False) -> DataFrame:
    """For each file the best window of as many lines as ``old_text`` has, compared in prepared form, with a status.

    A window counts from a similarity of ``least`` on if its distance is at most ``most_distance`` of the longer of the
    two texts as they stand; without one, line and similarity are null. With ``case_sensitive`` only a window that holds
    the text as it stands counts.
    """
    k = old_text.count("\n") + 1
    windows = blocks(line_table, k)
    if case_sensitive:
        found = windows.filter(F.contains("text", F.lit(old_text))).groupBy("path").agg(F.min("line_no").alias("line_no")).withColumns({"similarity": F.lit(1.0), "status": F.lit("OK")})
    else:
        prepared = windows.withColumn("line", tx.prepared(F.col("text"), True, ignore_whitespace))
        wanted = line_table.sparkSession.range(1).select(tx.prepared(F.lit(old_text), True, ignore_whitespace).alias("query"))
        scored = similar_pairs(prepared, wanted, least - 1e-9)
        distance = (1 - F.col("similarity")) * F.greatest(F.length("line"), F.length("query"))
        best = top_matches(scored.withColumns({"distance": distance, "query_id": F.lit(0)}), ["path"], 1)
        good = F.col("distance") <= most_distance * F.greatest(F.length("text"), F.lit(len(old_text)))
        found = best.select("path", "line_no", "similarity", F.when(good, "OK").otherwise("NO_MATCH_FOUND").alias("status"))
    of_files = line_table.groupBy("path").agg(F.count("*").alias("lines_"))
    missed = F.when(F.col("lines_") >= k, "NO_MATCH_FOUND").otherwise("NO_MATCH")
    return of_files.join(found, "path", "left").select("path", "line_no", "similarity", F.coalesce("status", missed).alias("status"))


def search_breakdown(found: DataFrame) -> DataFrame:
    """Results by source."""
    return found.groupBy("source").agg(F.count("*").alias("n"))
