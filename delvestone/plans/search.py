"""Queries on sources, scans, predicates and line search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import grep
from ..sources import tables
from .registry import query

LINES = "(SELECT doc_id, CAST(line_number AS BIGINT) line_number, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents))"
PATHS = "(SELECT DISTINCT file_id, concat('/', coalesce(collection,'none'), '/', name) path, name, coalesce(collection,'none') folder, size_bytes, sha256, lower(regexp_extract(name, '\\.([^.]+)$', 1)) extension FROM upload_manifest)"


def docs(spark, d):
    return tables.table(spark, d, "documents")


def doc_lines(spark, d):
    return grep.lines(docs(spark, d))


def paths(spark, d):
    m = tables.table(spark, d, "upload_manifest")
    folder = F.coalesce("collection", F.lit("none"))
    return m.select("file_id", F.concat(F.lit("/"), folder, F.lit("/"), F.col("name")).alias("path"), "name", folder.alias("folder"), "size_bytes", "sha256", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).alias("extension")).distinct()


@query("a1_schema_evolution", "SELECT id, name, CAST(coalesce(version, 0) AS BIGINT) AS version, CAST(NULL AS VARCHAR) AS review, CAST(0 AS BIGINT) AS reviews FROM knowledge_clusters")
def a1(spark, d):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("version", T.LongType()), T.StructField("review", T.StringType()), T.StructField("reviews", T.LongType())])
    return tables.conform(tables.table(spark, d, "knowledge_clusters"), schema, {"reviews": 0}).withColumn("version", F.coalesce("version", F.lit(0).cast("bigint")))


@query("a2_import_count", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a2(spark, d):
    return tables.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("a4_csv_types", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def a4(spark, d):
    """Rows as CSV text and back with declared types."""
    schema = "n_nationkey bigint, n_name string, n_regionkey bigint"
    text = tables.table(spark, d, "nation").select(F.to_csv(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("v"))
    return text.select(F.from_csv("v", schema).alias("r")).select("r.*")


@query("a11_parameters", "SELECT event_type, count(*) AS n FROM events WHERE user_id < 50 AND value > 10 GROUP BY 1")
def a11(spark, d):
    return spark.sql("SELECT event_type, count(*) AS n FROM {t} WHERE user_id < :most AND value > :least GROUP BY 1", args={"most": 50, "least": 10}, t=tables.table(spark, d, "events"))


@query("a12_file_listing", f"SELECT path, extension FROM {PATHS} WHERE extension IN ('pdf','md') AND name NOT LIKE '.%' AND length(path) - length(replace(path,'/','')) <= 3")
def a12(spark, d):
    return paths(spark, d).where(F.col("extension").isin("pdf", "md") & ~F.col("name").startswith(".") & (F.size(F.split("path", "/")) <= 4)).select("path", "extension")


@query("a13_directory_walk", f"SELECT folder, path FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name, file_id) r FROM {PATHS} WHERE extension IN ('pdf','md','txt','html','docx')) WHERE r <= 5")
def a13(spark, d):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("folder").orderBy("name", "file_id"))
    return paths(spark, d).where(F.col("extension").isin("pdf", "md", "txt", "html", "docx")).withColumn("r", r).where("r <= 5").select("folder", "path")


@query("a14_name_hints", f"SELECT path FROM {PATHS} WHERE lower(name) LIKE '%court%' OR lower(regexp_replace(name, '\\.[^.]+$', '')) = 'local_turbine'")
def a14(spark, d):
    return paths(spark, d).where(F.lower("name").contains("court") | (F.lower(F.regexp_replace("name", r"\.[^.]+$", "")) == "local_turbine")).select("path")


@query("a15_incremental_scan", f"SELECT p.file_id, p.path, CASE WHEN e.file_id IS NULL THEN 'new' WHEN e.at IS NULL OR e.at < m.at THEN 'stale' ELSE 'fresh' END AS state FROM {PATHS} p LEFT JOIN (SELECT file_id, max(extracted_at) AS at FROM extraction_outputs WHERE length(content) > 0 GROUP BY 1) e USING (file_id) LEFT JOIN (SELECT file_id, max(extracted_at) AS at FROM page_contents GROUP BY 1) m USING (file_id)")
def a15(spark, d):
    """Files whose text hasn't been extracted, or not since their pages were: keys and times only, contents untouched."""
    e = tables.table(spark, d, "extraction_outputs").where(F.length("content") > 0).groupBy("file_id").agg(F.max("extracted_at").alias("had"), F.lit(True).alias("seen"))
    m = tables.table(spark, d, "page_contents").groupBy("file_id").agg(F.max("extracted_at").alias("at"))
    state = F.when(F.col("seen").isNull(), "new").when(F.col("had").isNull() | (F.col("had") < F.col("at")), "stale").otherwise("fresh")
    return paths(spark, d).join(e, "file_id", "left").join(m, "file_id", "left").select("file_id", "path", state.alias("state"))


@query("a17_typed_dispatch", f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN extension IN ('txt','md','html') THEN 'text' WHEN extension = 'pdf' THEN 'pdf' WHEN extension IN ('xlsx','csv') THEN 'table' WHEN extension IN ('png','jpg') THEN 'image' ELSE 'other' END AS kind FROM {PATHS}) GROUP BY 1")
def a17(spark, d):
    e = F.col("extension")
    kind = F.when(e.isin("txt", "md", "html"), "text").when(e == "pdf", "pdf").when(e.isin("xlsx", "csv"), "table").when(e.isin("png", "jpg"), "image").otherwise("other")
    return paths(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("a18_text_head", "SELECT doc_id, array_to_string(string_split(substring(text,1,2048), chr(10))[1:5], chr(10)) AS head_lines, length(text) AS chars FROM documents")
def a18(spark, d):
    return tables.head_schema(docs(spark, d)).select("doc_id", "head_lines", "chars")


@query("a20_json_validity", "SELECT json_valid(props) AS valid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def a20(spark, d):
    e = tables.table(spark, d, "events")
    return e.groupBy(F.try_parse_json("props").isNotNull().alias("valid"), F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("a23_pages", "SELECT file_id, CAST(page_number AS BIGINT) AS page_number, length(content) AS chars FROM (SELECT DISTINCT file_id, page_number, content FROM page_contents) WHERE page_number BETWEEN 2 AND 4 AND length(content) > 0")
def a23(spark, d):
    p = tables.table(spark, d, "page_contents").where(F.col("page_number").between(2, 4) & (F.length("content") > 0))
    return p.select("file_id", F.col("page_number").cast("bigint").alias("page_number"), "content").distinct().select("file_id", "page_number", F.length("content").cast("bigint").alias("chars"))


@query("a24_scan_metadata", "SELECT doc_id, substring(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 2)[1], 1, 120) AS title, substring(text, 1, 800) AS preview, length(text) <= 102400 AS whole FROM documents WHERE text IS NOT NULL")
def a24(spark, d):
    title = F.substring(F.try_element_at(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 2), F.lit(1)), 1, 120)
    return docs(spark, d).where("text is not null").select("doc_id", title.alias("title"), F.substring("text", 1, 800).alias("preview"), (F.length("text") <= 102400).alias("whole"))


@query("a26_group_digest", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, min(l_quantity) AS low, max(l_quantity) AS high, min(l_extendedprice) AS low_price, max(l_extendedprice) AS high_price FROM lineitem GROUP BY 1")
def a26(spark, d):
    return tables.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.min("l_extendedprice").alias("low_price"), F.max("l_extendedprice").alias("high_price"))


@query("a28_collision_suffix", f"SELECT file_id, CASE WHEN r = 1 THEN name ELSE regexp_replace(name, '(\\.[^.]*)?$', concat('_', CAST(r - 1 AS VARCHAR), '\\1')) END AS stored FROM (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY file_id) r FROM {PATHS})")
def a28(spark, d):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("folder", "name").orderBy("file_id"))
    ext = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    stem = F.expr("left(name, length(name) - length(ext))")
    return paths(spark, d).withColumns({"r": r, "ext": ext}).select("file_id", F.when(F.col("r") == 1, F.col("name")).otherwise(F.concat(stem, F.lit("_"), (F.col("r") - 1).cast("string"), F.col("ext"))).alias("stored"))


@query("a30_collect_docs", f"SELECT path, size_bytes FROM {PATHS} WHERE extension IN ('pdf','md','txt') AND size_bytes > 0 AND size_bytes <= 10485760 ORDER BY size_bytes, path LIMIT 5")
def a30(spark, d):
    return paths(spark, d).where(F.col("extension").isin("pdf", "md", "txt") & F.col("size_bytes").between(1, 10485760)).orderBy("size_bytes", "path").limit(5).select("path", "size_bytes")


@query("a31_benchmark_loader", f"SELECT e.item_id, count(p.file_id) AS n_files FROM eval_items e LEFT JOIN {PATHS} p ON lower(regexp_replace(p.name, '\\.[^.]+$', '')) = lower(e.doc_name) GROUP BY 1")
def a31(spark, d):
    e = tables.table(spark, d, "eval_items").withColumn("stem", F.lower("doc_name"))
    p = paths(spark, d).select("file_id", F.lower(F.regexp_replace("name", r"\.[^.]+$", "")).alias("stem"))
    return e.join(p, "stem", "left").groupBy("item_id").agg(F.count("file_id").alias("n_files"))


@query("a33_small_content", "SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE substring(text, 1, 8000) END AS content FROM documents WHERE length(text) > 0")
def a33(spark, d):
    return docs(spark, d).where(F.length("text") > 0).select("doc_id", F.when(F.length("text") <= 1000, F.col("text")).otherwise(F.substring("text", 1, 8000)).alias("content"))


@query("b1_grep_literal", f"SELECT doc_id, line_number, line FROM {LINES} WHERE contains(lower(line), 'settlement')")
def b1(spark, d):
    return grep.grep(doc_lines(spark, d), "settlement")


@query("b1_grep_regex", f"SELECT doc_id, line_number FROM {LINES} WHERE regexp_matches(line, 'within [0-9]+ (weeks|days)')")
def b1r(spark, d):
    return grep.grep(doc_lines(spark, d), "within [0-9]+ (weeks|days)", literal=False, ignore_case=False).select("doc_id", "line_number")


@query("b2_grep_or", f"SELECT doc_id, line_number, term FROM {LINES}, (VALUES ('tribunal'), ('vaccine'), ('turbine')) t(term) WHERE contains(lower(line), term)")
def b2(spark, d):
    return grep.grep_or(doc_lines(spark, d), ["tribunal", "vaccine", "turbine"]).select("doc_id", "line_number", "term")


@query("b2_grep_or_regex", f"SELECT doc_id, line_number FROM {LINES} WHERE regexp_matches(line, '(?i)(?:trib[a-z]+)|(?:vacc[a-z]+)')")
def b2r(spark, d):
    return grep.grep_or(doc_lines(spark, d), ["trib[a-z]+", "vacc[a-z]+"], literal=False).select("doc_id", "line_number")


@query("b3_grep_and", f"SELECT doc_id, line_number FROM {LINES} WHERE contains(lower(line), 'appeal') AND doc_id IN (SELECT doc_id FROM documents WHERE contains(lower(text), 'counsel') AND contains(lower(text), 'verdict') AND contains(lower(text), 'appeal'))")
def b3(spark, d):
    return grep.grep_and(docs(spark, d), ["counsel", "verdict", "appeal"]).select("doc_id", "line_number")


@query("b3_grep_same_line", f"SELECT doc_id, line_number FROM {LINES} WHERE contains(lower(line), 'appeal') AND contains(lower(line), 'counsel')")
def b3s(spark, d):
    return grep.grep_and(docs(spark, d), ["counsel", "appeal"], same_line=True).select("doc_id", "line_number")


@query("b4_grep_not", f"SELECT doc_id, line_number FROM {LINES} WHERE contains(lower(line), 'appeal') AND doc_id IN (SELECT doc_id FROM documents WHERE NOT contains(lower(text), 'counsel') AND NOT contains(lower(text), 'statute'))")
def b4(spark, d):
    return grep.grep_not(docs(spark, d), "appeal", ["counsel", "statute"]).select("doc_id", "line_number")


@query("b6_count_only", f"SELECT doc_id, count(*) AS n_lines FROM {LINES} WHERE contains(lower(line), 'report') GROUP BY 1")
def b6(spark, d):
    return grep.count_only(doc_lines(spark, d), "report")


@query("b7_invert", f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE NOT contains(lower(line), 'report') GROUP BY 1")
def b7(spark, d):
    return grep.grep(doc_lines(spark, d), "report", invert=True).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("b8_whole_word", f"SELECT doc_id, line_number FROM {LINES} WHERE regexp_matches(line, '(?i)\\b(?:court)\\b')")
def b8(spark, d):
    return grep.grep(doc_lines(spark, d), "court", whole_word=True).select("doc_id", "line_number")


@query("b9_replace", f"SELECT doc_id, line_number, regexp_replace(line, '([0-9]+) weeks', '\\1 w', 'g') AS after FROM {LINES} WHERE regexp_matches(line, '([0-9]+) weeks')")
def b9(spark, d):
    return grep.replace(doc_lines(spark, d), "([0-9]+) weeks", "$1 w").select("doc_id", "line_number", "after")


@query("b10_file_names", f"SELECT path, CASE WHEN regexp_matches(name, '(?i)^local') THEN '^local' ELSE 'treaty' END AS pattern FROM {PATHS} WHERE regexp_matches(name, '(?i)^local') OR regexp_matches(name, '(?i)treaty')")
def b10(spark, d):
    return grep.by_name(paths(spark, d), ["^local", "treaty", "(["]).select("path", "pattern")


@query("b11_globs", f"SELECT path FROM {PATHS} WHERE regexp_matches(path, '^/north_[^/]*/[^/]*$') AND NOT regexp_matches(path, '^.*\\.pdf$')")
def b11(spark, d):
    return grep.glob_filter(paths(spark, d), ["/north_*/*"], ["**.pdf"]).select("path")


@query("b13_path_scope", f"SELECT path FROM {PATHS} WHERE starts_with(path, '/filings/') OR starts_with(path, '/outer_notes/')")
def b13(spark, d):
    return paths(spark, d).where(grep.in_scope("path", [], ["/filings", "/outer_notes/"])).select("path")


@query("b16_cluster_like", "SELECT id, CASE WHEN name LIKE '%treaty%' THEN 3 WHEN description LIKE '%treaty%' THEN 2 ELSE 1 END::BIGINT AS tier FROM (SELECT DISTINCT id, name, description, content FROM knowledge_clusters) WHERE name LIKE '%treaty%' OR description LIKE '%treaty%' OR content LIKE '%treaty%' ORDER BY tier DESC, id LIMIT 20")
def b16(spark, d):
    c = tables.table(spark, d, "knowledge_clusters").select("id", "name", "description", "content").distinct()
    hit = [F.coalesce(F.col(x).contains("treaty"), F.lit(False)) for x in ("name", "description", "content")]
    tier = F.when(hit[0], 3).when(hit[1], 2).otherwise(1).cast("bigint")
    return c.where(hit[0] | hit[1] | hit[2]).select("id", tier.alias("tier")).orderBy(F.desc("tier"), "id").limit(20)


@query("b17_attribute_filter", "SELECT id, last_modified FROM (SELECT DISTINCT id, lifecycle, last_modified FROM knowledge_clusters) WHERE upper(lifecycle) = 'STABLE' AND last_modified IS NOT NULL ORDER BY last_modified DESC, id LIMIT 25")
def b17(spark, d):
    c = tables.table(spark, d, "knowledge_clusters").where((F.upper("lifecycle") == "STABLE") & F.col("last_modified").isNotNull())
    return c.select("id", "last_modified").distinct().orderBy(F.desc("last_modified"), "id").limit(25)


@query("b18_point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def b18(spark, d):
    return tables.table(spark, d, "customer").where("c_custkey = 42").select("c_custkey", "c_name")


@query("b21_good_lines", f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE length(trim(line)) >= 10 AND length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= length(line) * 0.3::DOUBLE AND NOT regexp_matches(line, '^\\s*[#*>=~_\\-|]+\\s*$') AND NOT regexp_matches(line, '^\\s*(?:page|seite|página)\\s+\\d+') AND NOT regexp_matches(line, '^\\s*\\d+\\s*$') AND NOT regexp_matches(line, '(?i)all rights reserved|cookie policy|click here') GROUP BY 1")
def b21(spark, d):
    return doc_lines(spark, d).where(grep.good_line()).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("b22_page_range", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3")
def b22(spark, d):
    return tables.table(spark, d, "lineitem").where(F.col("l_linenumber").between(2, 3)).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))


@query("b23_recency", "SELECT user_id, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1")
def b23(spark, d):
    e = tables.table(spark, d, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    return e.join(now, F.col("ts") >= F.col("now") - F.expr("INTERVAL 2 DAY")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("b26_upload_validation", "SELECT file_id, coalesce(regexp_matches(collection, '^[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}$'), false) AS good_name, size_bytes BETWEEN 1 AND 52428800 AS good_size FROM (SELECT DISTINCT file_id, collection, size_bytes FROM upload_manifest)")
def b26(spark, d):
    m = tables.table(spark, d, "upload_manifest").select("file_id", "collection", "size_bytes").distinct()
    return m.select("file_id", F.coalesce(F.col("collection").rlike("^[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}$"), F.lit(False)).alias("good_name"), F.col("size_bytes").between(1, 52428800).alias("good_size"))
