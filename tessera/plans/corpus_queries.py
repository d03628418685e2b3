"""Queries of corpus search and edits over ``documents`` as files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import corpus as co
from tessera.operators import edits as ed
from tessera.operators import parameters
from tessera.plans.pixel_tables import rounded

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


FILES_SQL = """files AS (SELECT doc_id, concat(source, '/', lang, '/doc_', CAST(doc_id AS VARCHAR), CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.md' WHEN 3 THEN '.txt' ELSE '.png' END) AS path, text, n_chars AS size FROM documents)"""
LINES_SQL = FILES_SQL + """, lines AS (SELECT path, CAST(unnest(range(1, len(l) + 1)) AS INT) AS line_no, unnest(l) AS text FROM (SELECT path, string_split(text, chr(10)) AS l FROM files))"""


def files(spark: SparkSession, d: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, (".py", ".js", ".md", ".txt", ".png"))), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), end).alias("path"), "text", F.col("n_chars").alias("size"))


def line_table(spark: SparkSession, d: str) -> DataFrame:
    return co.lines(files(spark, d))


@query(f"WITH {LINES_SQL} SELECT path, line_no FROM lines WHERE contains(lower(text), 'license')")
def line_search(spark: SparkSession, d: str) -> DataFrame:
    return co.search(line_table(spark, d), "License").select("path", "line_no")


@query(f"WITH {LINES_SQL} SELECT path, line_no FROM lines WHERE regexp_matches(text, '(?i)licensed? under|[0-9]{{4}}-[0-9]{{4}}')")
def regex_search(spark: SparkSession, d: str) -> DataFrame:
    return co.search(line_table(spark, d), "licensed? under|[0-9]{4}-[0-9]{4}", regex=True).select("path", "line_no")


@query(f"WITH {LINES_SQL} SELECT path, line_no FROM lines WHERE contains(lower(text), '(6')")
def invalid_regex_search(spark: SparkSession, d: str) -> DataFrame:
    """A pattern that does not compile is searched for as it stands."""
    return co.search(line_table(spark, d), "(6", regex=True).select("path", "line_no")


@query(f"""WITH {LINES_SQL}, p AS (SELECT item_id * 3 + k AS pattern_id, lower(string_split(text, ' ')[k + 2]) AS pattern FROM benchmark, range(3) r(k))
SELECT path, line_no, CAST(pattern_id AS BIGINT) AS pattern_id, CAST(strpos(lower(text), pattern) AS INT) AS "column" FROM lines JOIN p ON length(pattern) > 7 AND contains(lower(text), pattern)""")
def many_searches(spark: SparkSession, d: str) -> DataFrame:
    """Words of all benchmark items, of eight characters or more, looked for in every line at once."""
    words = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.posexplode(F.slice(F.split("text", " "), 2, 3)).alias("k", "pattern"))
    asked = words.select((F.col("item_id") * 3 + F.col("k")).alias("pattern_id"), "pattern").filter(F.length("pattern") > 7)
    return co.search_many(line_table(spark, d), asked)


# Source lines made of parts: a declaration of each in one of six forms.
_FORMS = ("def {}(x):", "class {}:", "function {}() {{", "const {} = 1", "let {} = 2", "return {}")
SOURCE_SQL = "source AS (SELECT p_type AS path, CAST(p_partkey AS INT) AS line_no, CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '" + "' || name || '".join(f.replace("{{", "{").split("{}")) + "'" for i, f in enumerate(_FORMS)) + " END AS text FROM (SELECT *, replace(p_brand, '#', '_') || '_' || p_size AS name FROM part))"
_SYMBOL = " UNION ALL ".join(f"SELECT path, line_no, {i} AS pattern FROM source WHERE regexp_matches(text, '\\b{w}\\s+Brand_1')" for i, w in enumerate(("def", "class", "function", "const", "let", "var")))


def source_lines(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"))
    text = F.lit(None).cast("string")
    for i, form in enumerate(_FORMS):
        before, after = form.replace("{{", "{").split("{}")
        text = F.when(F.col("p_partkey") % 6 == i, F.concat(F.lit(before), name, F.lit(after))).otherwise(text)
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("path"), F.col("p_partkey").cast("int").alias("line_no"), text.alias("text"))


@query(f"WITH {SOURCE_SQL} {_SYMBOL}")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return co.symbol_search(source_lines(spark, d), "Brand_1").select("path", "line_no", "pattern")


@query(f"WITH {SOURCE_SQL}, m AS (SELECT path, line_no, text, CASE WHEN regexp_matches(text, '\\b(def|class|function|const|let|var)\\s+Brand_11') THEN 'symbol' END AS s, CASE WHEN contains(lower(text), 'brand_11') THEN 'text' END AS t FROM source), f AS (SELECT path, line_no, s AS source FROM m WHERE s IS NOT NULL UNION ALL SELECT path, line_no, t FROM m WHERE t IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path, line_no) AS nth FROM f), k AS (SELECT source FROM r WHERE nth <= CASE source WHEN 'text' THEN 30 ELSE 15 END ORDER BY CASE source WHEN 'symbol' THEN 2 ELSE 3 END, path, line_no LIMIT 30) SELECT source, count(*) AS n FROM k GROUP BY source")
def search_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Sources of a ranked list of thirty: declarations first, then lines that hold the name."""
    return co.search_breakdown(co.smart_search(source_lines(spark, d), "Brand_11", 30))


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE regexp_matches(path, '(?i)\\.(py|js|md|txt)$')")
def listed_by_default(spark: SparkSession, d: str) -> DataFrame:
    """What a listing admits unless told otherwise: default includes less default excludes."""
    return co.filter_files(files(spark, d), defaults=True).select("path")


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE path LIKE '%.md' OR path LIKE '%.py'")
def text_files(spark: SparkSession, d: str) -> DataFrame:
    return co.filter_files(files(spark, d), extensions=["md", "py", "png"], text_only=True).select("path")


@query(f"WITH {FILES_SQL} SELECT path, size FROM files ORDER BY path LIMIT 100")
def sorted_listing(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred files by path: the limit is the feature."""
    return co.sorted_listing(files(spark, d).select("path", "size"), 100)


@query(f"WITH {LINES_SQL} SELECT path, line_no, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview FROM lines")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return line_table(spark, d).select("path", "line_no", tx.preview(F.col("text"), 80).alias("preview"))


@query(f"""WITH {FILES_SQL}, e AS (SELECT path, CASE WHEN size > 2000 THEN 'FILE_TOO_LARGE' WHEN path LIKE '%.png' THEN 'BINARY_FILE_ERROR' ELSE 'OK' END AS status FROM files)
SELECT path, status, CASE status WHEN 'BINARY_FILE_ERROR' THEN 0.95 WHEN 'FILE_TOO_LARGE' THEN 0.1 END::DOUBLE AS confidence, CASE status WHEN 'BINARY_FILE_ERROR' THEN 'edit_file works only on text files. Use write_file with base64 encoding for binary files.' WHEN 'FILE_TOO_LARGE' THEN 'An unexpected error occurred. Check server logs for details.' END AS hint FROM e""")
def edit_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Whether each file may be edited, and what an error calls for; quotation marks of hints are left out."""
    status = co.eligibility(F.col("text").cast("binary"), F.col("path"), F.col("size"), 2000)
    told = files(spark, d).select("path", status.alias("status")).withColumn("h", F.when(F.col("status") != "OK", tx.hint(F.col("status"))))
    return told.select("path", "status", F.col("h.confidence").alias("confidence"), F.replace("h.hint", F.lit("'"), F.lit("")).alias("hint"))


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE regexp_matches(path, '(?i)^(.*/)?[^/]*\\.(py|md)$') AND NOT regexp_matches(path, '(?i)^src1[^/]*/.*$') AND len(string_split(path, '/')) <= 3 AND size <= 4000 AND contains(path, 'doc_')")
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return co.filter_files(files(spark, d), include=["*.{py,md}"], exclude=["src1*/**"], max_depth=3, name="doc_", max_size=4000).select("path")


@query(f"WITH {FILES_SQL} SELECT path, regexp_extract(path, '\\.([a-z]+)$', 1) AS ext, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'md' THEN 'markdown' ELSE 'text' END AS language, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'js' THEN 'text/javascript' WHEN 'md' THEN 'text/markdown' WHEN 'png' THEN 'image/png' ELSE 'text/plain' END AS media_type, regexp_replace(path, '(\\.[a-z]+)$', '_matched\\1') AS result_name, CASE WHEN path LIKE '%.png' THEN 'binary' ELSE 'text' END AS kind, 'result_doc_' || doc_id || regexp_extract(path, '(\\.[a-z]+)$', 1) AS written_as FROM files")
def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    kind = tx.classify(F.col("text").cast("binary"), p)
    f = files(spark, d).withColumn("kind", kind)
    return f.select("path", tx.extension(p).alias("ext"), tx.language(p).alias("language"), tx.media_type(p, F.col("kind") == tx.BINARY).alias("media_type"), tx.matched_name(p).alias("result_name"), "kind", tx.result_name(p).alias("written_as"))


@query(f"WITH {FILES_SQL}, e AS (SELECT unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS dir, unnest([0, 1, 2]) AS depth, size FROM files) SELECT dir, CAST(depth AS INT) AS depth, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM e GROUP BY ALL")
def dir_rollup(spark: SparkSession, d: str) -> DataFrame:
    return co.directory_rollup(files(spark, d))


@query(f"WITH {FILES_SQL} SELECT path, length(text) AS characters, len(string_split(text, chr(10))) AS lines, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda t: t <> '')) AS tokens FROM files")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return co.corpus_statistics(files(spark, d))


@query(f"WITH {FILES_SQL} SELECT count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda t: t <> ''))) AS BIGINT) AS tokens FROM files")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    return co.corpus_totals(files(spark, d))


RULES = [("email", "[A-Za-z0-9._]+@[A-Za-z0-9.]+"), ("card", "[0-9]{4} ?[0-9]{4} ?[0-9]{4} ?[0-9]{4}"), ("token", "[0-9a-f]{32}")]


@query(f"WITH {LINES_SQL} " + " UNION ALL ".join(f"SELECT path, line_no, '{r}' AS reason FROM lines WHERE regexp_matches(text, '{p}')" for r, p in RULES))
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return co.secret_scan(line_table(spark, d), RULES)


@query(f"WITH {LINES_SQL} SELECT path FROM files WHERE path NOT IN (SELECT path FROM lines WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for _, p in RULES) + ")")
def without_suspicious(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return co.without_suspicious(f, co.secret_scan(co.lines(f), RULES)).select("path")


BUNDLES = {"python": "*.py", "first": "src1/**", "notes": "*.{md,txt}"}


@query(f"WITH {FILES_SQL}, b AS (SELECT path, 'python' AS bundle FROM files WHERE path LIKE '%.py' UNION ALL SELECT path, 'first' FROM files WHERE path LIKE 'src1/%' UNION ALL SELECT path, 'notes' FROM files WHERE path LIKE '%.md' OR path LIKE '%.txt') SELECT coalesce(bundle, 'all') AS bundle, count(DISTINCT path) AS files FROM b GROUP BY ROLLUP (bundle)")
def bundle_unique(spark: SparkSession, d: str) -> DataFrame:
    return co.bundles(files(spark, d), BUNDLES).rollup("bundle").agg(F.countDistinct("path").alias("files")).withColumn("bundle", F.coalesce("bundle", F.lit("all")))


@query(f"WITH {FILES_SQL} SELECT sha256(text) AS digest, count(*) AS n, min(path) AS first_path FROM files GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return co.content_duplicates(files(spark, d))


@query(f"WITH {LINES_SQL} SELECT path, line_no, md5(string_agg(text, chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS block FROM lines QUALIFY count(*) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3")
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    return co.blocks(line_table(spark, d), 3).select("path", "line_no", F.md5("text").alias("block"))


@query(f"WITH {LINES_SQL} SELECT path, line_no, md5(string_agg(text, chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS context FROM lines")
def line_context(spark: SparkSession, d: str) -> DataFrame:
    return co.context(line_table(spark, d), 1).select("path", "line_no", F.md5("context").alias("context"))


@query("SELECT doc_id, md5(CASE WHEN strpos(text, ' the ') > 0 THEN substr(text, 1, strpos(text, ' the ') - 1) || ' THE ' || substr(text, strpos(text, ' the ') + 5) END) AS edited FROM documents")
def exact_edit(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(co.exact_edit(F.col("text"), F.lit(" the "), F.lit(" THE "))).alias("edited"))


#: What a user looks for: two lines, so that files are searched for lines and for blocks.
SEARCHED = "Licensed under the Apache License, Version 2.0\nyou may not use this file except in compliance"


@query()
def similarity_top5(spark: SparkSession, d: str) -> DataFrame:
    """The five lines or blocks of each file that are most like a text of two lines, over a similarity of 0.1."""
    q = spark.createDataFrame([(0, SEARCHED)], "query_id int, query string")
    found = co.best_matches(line_table(spark, d), q, 0.1, 5)
    return rounded(found.select("path", "query_id", "nth", "kind", "line_no", "similarity"), "similarity")


def varied_edits(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as texts to replace: as they are, with a mark behind, with doubled letters, with words left out."""
    bench, text = spark.read.parquet(f"{d}/benchmark.parquet"), F.col("text")
    longer = F.replace(text, F.lit("er"), F.lit("eer"))
    fewer = F.regexp_replace(text, r" (th|an|in)\w* ", " ")
    old = F.when(F.col("item_id") % 4 == 0, text).when(F.col("item_id") % 4 == 1, F.concat(text, F.lit("!"))).when(F.col("item_id") % 4 == 2, longer).otherwise(fewer)
    return bench.select(F.col("item_id").alias("edit_id"), old.alias("old_text"), F.concat(F.lit("["), F.col("item_id").cast("string"), F.lit("]")).alias("new_text"))


@query()
def fuzzy_edit(spark: SparkSession, d: str) -> DataFrame:
    """Varied benchmark items replaced in all files, as far as they are like a line or a block: from 0.6, where reports begin."""
    out = co.fuzzy_edits(files(spark, d), varied_edits(spark, d), force=True, least=0.6)
    return rounded(out.select("path", "edit_id", "band", "similarity", "kind", "line_no", "applied", F.md5("edited").alias("edited")), "similarity")


@query()
def window_edits(spark: SparkSession, d: str) -> DataFrame:
    """The window of each file that is most like a license notice of two lines."""
    return rounded(co.window_edits(line_table(spark, d), "Licensed under the Apache License,\nVersion 2.0 (the License)"), "similarity")


@query(f"WITH {LINES_SQL}, m AS (SELECT path, line_no, 'text' AS source, 3 AS priority FROM lines WHERE contains(lower(text), 'apache') QUALIFY row_number() OVER (ORDER BY path, line_no) <= 20) SELECT * FROM m ORDER BY priority, path, line_no LIMIT 20")
def smart_search(spark: SparkSession, d: str) -> DataFrame:
    """A ranked list of at most twenty results: the limit is the feature."""
    return co.smart_search(line_table(spark, d), "Apache", 20)


@query("""WITH RECURSIVE p AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS edit_id, l_linenumber * 3 AS a, l_linenumber * 3 + CAST(l_quantity AS INT) % 6 AS b FROM lineitem),
f AS (SELECT doc_id, edit_id, [{'a': a, 'b': b}] AS held, TRUE AS ok FROM p WHERE edit_id = 1
 UNION ALL SELECT doc_id, edit_id, CASE WHEN meets THEN held ELSE list_append(held, {'a': a, 'b': b}) END, NOT meets FROM (
  SELECT p.doc_id, p.edit_id, f.held, p.a, p.b, len(list_filter(f.held, lambda h: h.a <= p.b AND h.b >= p.a)) > 0 AS meets FROM f JOIN p ON p.doc_id = f.doc_id AND p.edit_id = f.edit_id + 1))
SELECT doc_id, CAST(edit_id AS INT) AS edit_id FROM f WHERE NOT ok""")
def edit_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Edits that meet an earlier edit of their document which was itself accepted."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    first = F.col("l_linenumber") * 3
    placed = items.select(F.col("l_orderkey").alias("doc_id"), nth.alias("edit_id"), first.alias("first_line"), (first + F.round("l_quantity").cast("int") % 6).alias("last_line"))
    return ed.edit_conflicts(placed).select("doc_id", "edit_id")


# Edits of each document, from its own words: two neighbours, or a line break between them, become one of three texts.
_SEQUENCE_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
e AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] AS old, CASE k % 3 WHEN 0 THEN '[' || w[k] || ']' WHEN 1 THEN w[k] || chr(10) || w[k + 1] ELSE 'gone' END AS new FROM (SELECT doc_id, w, unnest(range(1, least(len(w), 7))) AS k FROM w)),
f(doc_id, k, text, held, outcomes) AS (SELECT doc_id, 0, text, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]), '' FROM documents WHERE doc_id IS NOT NULL
 UNION ALL SELECT doc_id, k, CASE WHEN status = 'APPLIED' THEN substr(text, 1, spot - 1) || new || substr(text, spot + length(old)) ELSE text END,
  CASE WHEN status = 'APPLIED' THEN list_append(list_transform(held, lambda h: {'a': h.a + CASE WHEN h.a > b THEN grown ELSE 0 END, 'b': h.b + CASE WHEN h.a > b THEN grown ELSE 0 END}), {'a': a, 'b': b + grown}) ELSE held END,
  outcomes || CASE WHEN status = 'NO_MATCH_FOUND' THEN status ELSE status || ' ' || a || '-' || b END || ';'
 FROM (SELECT *, CASE WHEN spot = 0 THEN 'NO_MATCH_FOUND' WHEN len(list_filter(held, lambda h: h.a <= b AND h.b >= a)) > 0 THEN 'OVERLAPPING_EDIT' ELSE 'APPLIED' END AS status
  FROM (SELECT *, a + old_lines - 1 AS b, length(new) - length(replace(new, chr(10), '')) + 1 - old_lines AS grown
   FROM (SELECT f.*, e.old, e.new, strpos(f.text, e.old) AS spot, length(e.old) - length(replace(e.old, chr(10), '')) + 1 AS old_lines,
     length(substr(f.text, 1, strpos(f.text, e.old) - 1)) - length(replace(substr(f.text, 1, strpos(f.text, e.old) - 1), chr(10), '')) + 1 AS a
    FROM (SELECT doc_id, k + 1 AS k, text, held, outcomes FROM f) f JOIN e USING (doc_id, k)))))
SELECT doc_id, md5(text) AS edited, outcomes FROM f QUALIFY k = max(k) OVER (PARTITION BY doc_id)"""


@query(_SEQUENCE_SQL)
def edits_in_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Up to six edits of each document one after the other, where they stand in the text that those before left."""
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("path"), "text")
    w = docs.filter("text IS NOT NULL").select("path", F.filter(F.split("text", " "), lambda x: x != "").alias("w")).filter("size(w) > 1")
    each = w.select("path", "w", F.explode(F.sequence(F.lit(1), F.least(F.size("w") - 1, F.lit(6)))).alias("edit_id"))
    k, one, two = F.col("edit_id"), F.get("w", F.col("edit_id") - 1), F.get("w", F.col("edit_id"))
    new = F.when(k % 3 == 0, F.concat(F.lit("["), one, F.lit("]"))).when(k % 3 == 1, F.concat(one, F.lit("\n"), two)).otherwise("gone")
    edits = each.select("path", "edit_id", F.concat(one, F.lit(" "), two).alias("old_text"), new.alias("new_text"))
    out = ed.edits_in_sequence(docs, edits, case_sensitive=True)
    told = F.transform("outcomes", lambda o: F.concat_ws(" ", o["status"], F.concat(o["first_line"].cast("string"), F.lit("-"), o["last_line"].cast("string"))))
    return out.select(F.col("path").alias("doc_id"), F.md5("edited").alias("edited"), F.concat(F.array_join(told, ";"), F.when(F.size(told) > 0, ";").otherwise("")).alias("outcomes"))


@query()
def edited_files(spark: SparkSession, d: str) -> DataFrame:
    """All files with the varied benchmark items replaced: one text for each file in which an edit is accepted."""
    out = ed.edited_files(files(spark, d), varied_edits(spark, d), force=True).filter("edited IS NOT NULL")
    return out.select("path", F.md5("edited").alias("edited"), F.array_join(F.transform("accepted", lambda i: i.cast("string")), ",").alias("accepted"), F.array_join(F.transform("rejected", lambda i: i.cast("string")), ",").alias("rejected"))


@query(f"WITH {LINES_SQL}, a AS (SELECT path, replace(text, 'the', 'THE') AS text FROM lines) SELECT count(*) AS changed FROM ((SELECT path, text FROM lines EXCEPT ALL SELECT path, text FROM a) UNION ALL (SELECT path, text FROM a EXCEPT ALL SELECT path, text FROM lines))")
def changed_lines(spark: SparkSession, d: str) -> DataFrame:
    before = line_table(spark, d)
    after = before.withColumn("text", F.replace("text", F.lit("the"), F.lit("THE")))
    return co.changed_lines(before, after).agg(F.count("*").alias("changed"))


# Settings as JSON, made of events: every seventh is malformed.
SETTINGS_SQL = """settings AS (SELECT event_id, CASE WHEN event_id % 7 = 3 THEN '{broken' ELSE '{"num_colors": ' || CAST(user_id AS VARCHAR) || ', "quality": ' || CAST(event_id % 15 - 2 AS VARCHAR) || ', "hue_weight": ' || CAST(event_id % 25 AS VARCHAR) || '.5, "extremes_threshold": ' || CAST(event_id % 70 AS VARCHAR) || '}' END AS js,
 event_id % 7 = 3 AS broken, user_id, event_id % 15 - 2 AS q, event_id % 25 + 0.5::DOUBLE AS hue, event_id % 70 AS x FROM events)"""


def settings(spark: SparkSession, d: str) -> DataFrame:
    e, text = F.col("event_id"), lambda c: c.cast("string")
    js = F.concat(F.lit('{"num_colors": '), text(F.col("user_id")), F.lit(', "quality": '), text(e % 15 - 2), F.lit(', "hue_weight": '), text(e % 25), F.lit('.5, "extremes_threshold": '), text(e % 70), F.lit("}"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(e % 7 == 3, "{broken").otherwise(js).alias("js"))


@query(f"""WITH {SETTINGS_SQL} SELECT event_id, CASE WHEN broken THEN 8 ELSE CAST(greatest(2, least(256, user_id)) AS INT) END AS num_colors, CASE WHEN broken THEN 5 ELSE CAST(greatest(1, least(10, q)) AS INT) END AS quality,
 CASE WHEN broken THEN 3.0 ELSE greatest(0.1, least(10.0, hue)) END::DOUBLE AS hue_weight, CASE WHEN broken THEN 10 ELSE CAST(greatest(0, least(50, x)) AS INT) END AS extremes_threshold, 1.0::DOUBLE AS saturation_weight, 8.0::DOUBLE AS dithering_strength, 25 AS edge_detection_threshold FROM settings""")
def parameter_clamping(spark: SparkSession, d: str) -> DataFrame:
    """Parameters from JSON, with defaults and limits; a malformed text gives all defaults."""
    parsed = settings(spark, d).select("event_id", parameters.settings(F.col("js")).alias("s"))
    return parsed.select("event_id", *[F.col(f"s.{n}").alias(n) for n in ("num_colors", "quality", "hue_weight", "extremes_threshold", "saturation_weight", "dithering_strength", "edge_detection_threshold")])


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 1 END AS n, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 7.0::DOUBLE END AS hue, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 10.0::DOUBLE END AS boost, p_size / 100.0::DOUBLE AS weight_a, 1 AS n_steps FROM part")
def json_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Focus ranges, weights and steps from JSON; focus ranges that are no list are null."""
    size = F.col("p_size")
    one = F.concat(F.lit('{"target_hsv": ['), (size * 7).cast("string"), F.lit(', 50, 60], "range_h": 30, "range_s": 40, "range_v": 50, "boost_factor": '), (size / 10).cast("string"), F.lit("}"))
    js = F.when(F.col("p_partkey") % 5 == 0, one).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    w = F.concat(F.lit('{"a": '), (size / 100).cast("string"), F.lit("}"))
    parsed = spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", parameters.focus_ranges(js).alias("f"), parameters.weights(w).alias("w"), parameters.steps(F.lit('[{"method": "basic", "params": {"strength": "0.5"}}]')).alias("s"),
    )
    first = F.get("f", F.lit(0))
    return parsed.select("p_partkey", F.when(F.col("f").isNotNull(), F.size("f")).alias("n"), F.get(first["target_hsv"], F.lit(0)).alias("hue"), first["boost_factor"].alias("boost"), F.element_at("w", F.lit("a")).alias("weight_a"), F.size("s").alias("n_steps"))
