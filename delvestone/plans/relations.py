"""Queries on joins, aggregations, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import anchors, grep, joins, windows
from ..sources.tables import table
from .registry import query
from .search import LINES, doc_lines, docs, paths, PATHS

KC = "(SELECT DISTINCT id, name, description, content, confidence, abstraction_level, hotness, lifecycle, create_time, last_modified, CAST(version AS BIGINT) AS version, CAST(merge_count AS BIGINT) AS merge_count FROM knowledge_clusters)"
TN = "(SELECT DISTINCT file_id, node_id, parent_id, CAST(ord AS BIGINT) AS ord, CAST(level AS BIGINT) AS level, title, summary, char_range[1] AS a, char_range[2] AS b, CAST(page_range[1] AS BIGINT) AS p1, CAST(page_range[2] AS BIGINT) AS p2, CAST(table_count AS BIGINT) AS table_count, content_type FROM tree_nodes)"
SH = "(SELECT DISTINCT * FROM search_history)"


def clusters(spark, d):
    return table(spark, d, "knowledge_clusters").select("id", "name", "description", "content", "confidence", "abstraction_level", "hotness", "lifecycle", "create_time", "last_modified", F.col("version").cast("bigint").alias("version"), F.col("merge_count").cast("bigint").alias("merge_count")).distinct()


def nodes(spark, d):
    t = table(spark, d, "tree_nodes")
    return t.select("file_id", "node_id", "parent_id", F.col("ord").cast("bigint").alias("ord"), F.col("level").cast("bigint").alias("level"), "title", "summary", F.try_element_at("char_range", F.lit(1)).alias("a"), F.try_element_at("char_range", F.lit(2)).alias("b"), F.try_element_at("page_range", F.lit(1)).cast("bigint").alias("p1"), F.try_element_at("page_range", F.lit(2)).cast("bigint").alias("p2"), F.col("table_count").cast("bigint").alias("table_count"), "content_type").distinct()


def history(spark, d):
    return table(spark, d, "search_history").distinct()


@query("c1_join_distinct", "SELECT DISTINCT d.doc_id FROM documents d LEFT JOIN (SELECT DISTINCT file_id, name FROM upload_manifest) m USING (file_id) WHERE m.name ILIKE '%treaty%' OR contains(lower(d.text), 'armistice') OR contains(lower(d.text), 'peasant revolt')")
def c1(spark, d):
    """Documents found by their file's name, or by their text: two branches, united."""
    m = table(spark, d, "upload_manifest").where(F.lower("name").contains("treaty")).select("file_id").distinct()
    named = docs(spark, d).join(m, "file_id", "left_semi").select("doc_id")
    held = docs(spark, d).where(F.lower("text").contains("armistice") | F.lower("text").contains("peasant revolt")).select("doc_id")
    return named.union(held).distinct()


@query("c2_scalar_count", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders FROM customer c")
def c2(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("c3_artifact_lookup", "SELECT m.file_id, e.file_id IS NOT NULL AS extracted, t.file_id IS NOT NULL AS has_tree FROM (SELECT DISTINCT file_id FROM upload_manifest) m LEFT JOIN (SELECT DISTINCT file_id FROM extraction_outputs) e USING (file_id) LEFT JOIN (SELECT DISTINCT file_id FROM tree_nodes) t USING (file_id)")
def c3(spark, d):
    m = table(spark, d, "upload_manifest").select("file_id").distinct()
    e = table(spark, d, "extraction_outputs").select("file_id").distinct().withColumn("e", F.lit(True))
    t = table(spark, d, "tree_nodes").select("file_id").distinct().withColumn("t", F.lit(True))
    return m.join(e, "file_id", "left").join(t, "file_id", "left").select("file_id", F.coalesce("e", F.lit(False)).alias("extracted"), F.coalesce("t", F.lit(False)).alias("has_tree"))


@query("c4_scope_semi_join", "SELECT doc_id FROM documents WHERE file_id IN (SELECT file_id FROM upload_manifest WHERE collection = 'filings')")
def c4(spark, d):
    m = table(spark, d, "upload_manifest").where("collection = 'filings'").select("file_id")
    return docs(spark, d).join(m, "file_id", "left_semi").select("doc_id")


@query("c5_change_set", "WITH a AS (SELECT doc_id, md5(text) h FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5(text || '!') ELSE md5(text) END h FROM documents WHERE doc_id % 11 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b USING (doc_id)")
def c5(spark, d):
    """Two snapshots made of one table: what was added, changed and deleted."""
    t = docs(spark, d).select("doc_id", "text")
    before = t.where("doc_id % 7 != 0").select("doc_id", F.md5("text").alias("h"))
    after = t.where("doc_id % 11 != 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("h"))
    return joins.change_set(before, after, "doc_id", "h")


@query("c6_stale_purge", "SELECT DISTINCT file_id, node_id FROM tree_nodes WHERE file_id NOT IN (SELECT file_id FROM upload_manifest WHERE collection = 'filings')")
def c6(spark, d):
    stale = table(spark, d, "upload_manifest").where("collection = 'filings'").select("file_id")
    return table(spark, d, "tree_nodes").join(stale, "file_id", "left_anti").select("file_id", "node_id").distinct()


@query("c7_orphans", "SELECT DISTINCT file_id FROM page_contents WHERE file_id NOT IN (SELECT file_id FROM tree_nodes)")
def c7(spark, d):
    return table(spark, d, "page_contents").select("file_id").distinct().join(table(spark, d, "tree_nodes").select("file_id"), "file_id", "left_anti")


@query("c8_missing_files", "SELECT DISTINCT m.file_id FROM upload_manifest m WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.file_id = m.file_id)")
def c8(spark, d):
    return table(spark, d, "upload_manifest").select("file_id").distinct().join(docs(spark, d).where("file_id is not null").select("file_id"), "file_id", "left_anti")


@query("c9_duplicates", f"SELECT file_id, count(*) OVER (PARTITION BY sha256) > 1 AS duplicate FROM {PATHS}")
def c9(spark, d):
    p = paths(spark, d)
    many = p.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1").select("sha256", F.lit(True).alias("m"))
    return p.join(many, "sha256", "left").select("file_id", F.coalesce("m", F.lit(False)).alias("duplicate"))


@query("c10_co_occurrence", "WITH p AS (SELECT DISTINCT l_suppkey s, l_partkey g FROM lineitem WHERE l_suppkey IS NOT NULL) SELECT a.s AS a, b.s AS b, count(*) AS shared, least(1.0::DOUBLE, count(*) * 0.25::DOUBLE) AS weight FROM p a JOIN p b ON a.g = b.g AND a.s < b.s GROUP BY 1, 2")
def c10(spark, d):
    return joins.co_occurrence(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("c13_scope_coverage", "SELECT source, avg(CASE WHEN file_id IN (SELECT file_id FROM upload_manifest WHERE collection = 'filings') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS coverage FROM documents WHERE file_id IS NOT NULL GROUP BY 1")
def c13(spark, d):
    m = table(spark, d, "upload_manifest").where("collection = 'filings'").select("file_id").distinct().withColumn("hit", F.lit(1.0))
    return docs(spark, d).where("file_id is not null").join(m, "file_id", "left").groupBy("source").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("coverage"))


@query("c14_path_priority", f"SELECT p.file_id, arg_min(h.hint, (CASE WHEN lower(regexp_replace(p.name, '\\.[^.]+$', '')) = h.hint THEN 1 WHEN starts_with(lower(p.name), h.hint) THEN 2 ELSE 3 END) * 10 + h.i) AS hint FROM {PATHS} p JOIN (VALUES ('local', 0), ('treaty', 1), ('court', 2)) h(hint, i) ON contains(lower(p.name), h.hint) GROUP BY 1")
def c14(spark, d):
    """The best of several hints for a path: whole name, start, anywhere; ties by the hints' order."""
    hints = ("local", "treaty", "court")
    low = F.lower("name")
    tier = lambda h: F.when(F.regexp_replace(low, r"\.[^.]+$", "") == h, 1).when(low.startswith(h), 2).otherwise(3)
    held = F.array_compact(F.array(*[F.when(low.contains(h), F.struct((tier(h) * 10 + i).alias("k"), F.lit(h).alias("hint"))) for i, h in enumerate(hints)]))
    return paths(spark, d).select("file_id", F.array_min(held)["hint"].alias("hint")).where("hint is not null")


@query("c15_anchor_lookup", "SELECT item_id, doc_id, p - length(regexp_extract(left(text, p - 1), '[^\n]*$')) AS at FROM (SELECT e.item_id, d.doc_id, d.text, coalesce(nullif(strpos(d.text, left(e.evidence_text, 80)), 0), nullif(strpos(d.text, left(e.evidence_text, 50)), 0), strpos(d.text, left(e.evidence_text, 30))) AS p FROM eval_items e JOIN documents d ON contains(d.text, left(e.evidence_text, 30)))")
def c15(spark, d):
    """The start of the line where the first 80, else 50, else 30 characters stand."""
    e = table(spark, d, "eval_items").select("item_id", "evidence_text").distinct()
    return anchors.locate(docs(spark, d), e, "doc_id", "text", "item_id", "evidence_text").distinct()


@query("c16_as_of_page", f"SELECT file_id, node_id, a, (SELECT max(p.p1) FROM {TN} p WHERE p.file_id = n.file_id AND p.p1 IS NOT NULL AND p.a IS NOT NULL AND p.a <= n.a AND p.a = (SELECT max(q.a) FROM {TN} q WHERE q.file_id = n.file_id AND q.p1 IS NOT NULL AND q.a <= n.a)) AS page FROM {TN} n WHERE a IS NOT NULL")
def c16(spark, d):
    n = nodes(spark, d).where("a is not null")
    points = n.where("p1 is not null").groupBy("file_id", "a").agg(F.max("p1").alias("page"))
    return joins.as_of(n.select("file_id", "node_id", "a"), points, "file_id", "a", "page").select("file_id", "node_id", "a", "page")


@query("c17_page_ranges", f"SELECT file_id, page, min(a) AS low, max(b) AS high FROM (SELECT file_id, a, b, unnest(generate_series(p1, p2)) AS page FROM {TN} WHERE p1 IS NOT NULL AND p2 >= p1 AND p2 - p1 < 5 AND a < b) GROUP BY 1, 2")
def c17(spark, d):
    n = nodes(spark, d).where("p1 is not null and p2 >= p1 and p2 - p1 < 5 and a < b")
    return n.select("file_id", "a", "b", F.explode(F.sequence("p1", "p2")).alias("page")).groupBy("file_id", "page").agg(F.min("a").alias("low"), F.max("b").alias("high"))


@query("d1_table_count", "SELECT count(*) AS n FROM events")
def d1(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"))


@query("d2_column_profile", "SELECT 'value' AS col, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count(DISTINCT value) AS n_distinct, count(value) AS present, count(*) - count(value) AS missing FROM events UNION ALL SELECT 'user_id', min(user_id)::DOUBLE, max(user_id)::DOUBLE, round(avg(user_id), 6), count(DISTINCT user_id), count(user_id), count(*) - count(user_id) FROM events")
def d2(spark, d):
    """One pass over all columns; the rows are made of the one result row."""
    e, cols = table(spark, d, "events"), ("value", "user_id")
    parts = []
    for c in cols:
        v = F.col(c).cast("double")
        parts += [F.min(v).alias(f"{c}_low"), F.max(v).alias(f"{c}_high"), F.round(F.avg(v), 6).alias(f"{c}_mean"), F.countDistinct(c).alias(f"{c}_d"), F.count(c).alias(f"{c}_p"), (F.count("*") - F.count(c)).alias(f"{c}_m")]
    one = e.agg(*parts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"{c}_low").alias("low"), F.col(f"{c}_high").alias("high"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_d").alias("n_distinct"), F.col(f"{c}_p").alias("present"), F.col(f"{c}_m").alias("missing")) for c in cols])).alias("r")).select("r.*")


@query("d3_lifecycle_distribution", f"SELECT l.v AS lifecycle, count(k.id) AS n, round(avg(k.confidence), 4) AS mean_confidence FROM (VALUES ('EMERGING'), ('STABLE'), ('CONTESTED'), ('DEPRECATED')) l(v) LEFT JOIN {KC} k ON upper(k.lifecycle) = l.v GROUP BY 1")
def d3(spark, d):
    dim = spark.createDataFrame([(x,) for x in ("EMERGING", "STABLE", "CONTESTED", "DEPRECATED")], "lifecycle string")
    k = clusters(spark, d).groupBy(F.upper("lifecycle").alias("lifecycle")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    return dim.join(k, "lifecycle", "left").select("lifecycle", F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence")


@query("d4_abstraction_stats", f"SELECT abstraction_level, count(*) AS n, min(confidence) AS low, max(confidence) AS high, round(avg(hotness), 4) AS mean_hotness FROM {KC} GROUP BY 1")
def d4(spark, d):
    return clusters(spark, d).groupBy("abstraction_level").agg(F.count("*").alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.round(F.avg("hotness"), 4).alias("mean_hotness"))


@query("d5_daily_timeline", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def d5(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("d6_token_frequency", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 100")
def d6(spark, d):
    w = docs(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


@query("d7_graph_edges", "SELECT CAST(user_id AS VARCHAR) AS source, json_extract_string(props, '$.k') AS target, event_type AS kind, count(*) AS weight FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2, 3")
def d7(spark, d):
    e = table(spark, d, "events").withColumn("target", F.get_json_object("props", "$.k")).where("target is not null")
    return e.groupBy(F.col("user_id").cast("string").alias("source"), "target", F.col("event_type").alias("kind")).agg(F.count("*").alias("weight"))


@query("d8_usage_rollup", "SELECT coalesce(event_type, 'ALL') AS event_type, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type)")
def d8(spark, d):
    return table(spark, d, "events").rollup("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total")).select(F.coalesce("event_type", F.lit("ALL")).alias("event_type"), "calls", "total")


@query("d9_chat_activity", f"SELECT kb_name, count(*) AS searches, count(*) FILTER (WHERE results_count > 0) AS with_results, max(created_at) AS last_at FROM {SH} GROUP BY 1")
def d9(spark, d):
    return history(spark, d).groupBy("kb_name").agg(F.count("*").alias("searches"), F.count_if(F.col("results_count") > 0).alias("with_results"), F.max("created_at").alias("last_at"))


@query("d12_tree_counts", f"SELECT folder, count(*) AS n FROM {PATHS} GROUP BY 1")
def d12(spark, d):
    return paths(spark, d).groupBy("folder").agg(F.count("*").alias("n"))


@query("d13_keyword_tf", f"SELECT doc_id, count(*) FILTER (WHERE contains(lower(line), 'report')) AS report, count(*) FILTER (WHERE contains(lower(line), 'summary')) AS summary FROM {LINES} GROUP BY 1")
def d13(spark, d):
    """Lines with each term, of all terms in one pass, without exploding lines."""
    count = lambda t: F.size(F.filter(F.split("text", "\n"), lambda x: F.contains(F.lower(x), F.lit(t)))).cast("bigint")
    return docs(spark, d).where("text is not null").select("doc_id", count("report").alias("report"), count("summary").alias("summary"))


@query("d14_document_frequency", "SELECT w AS word, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM documents) GROUP BY 1")
def d14(spark, d):
    w = docs(spark, d).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("df"))


@query("d15_term_frequency", "SELECT doc_id, w AS word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1, 2 HAVING count(*) > 10")
def d15(spark, d):
    w = docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.groupBy("doc_id", "word").agg(F.count("*").alias("tf")).where("tf > 10")


@query("d16_merge_clusters", f"SELECT abstraction_level, upper(lifecycle) AS lifecycle, array_to_string(list_sort(list_distinct(list(left(name, 1)))), ',') AS initials, round(avg(confidence), 6) AS confidence, sum(merge_count)::BIGINT AS merges FROM {KC} GROUP BY 1, 2")
def d16(spark, d):
    return clusters(spark, d).groupBy("abstraction_level", F.upper("lifecycle").alias("lifecycle")).agg(F.array_join(F.sort_array(F.collect_set(F.substring("name", 1, 1))), ",").alias("initials"), F.round(F.avg("confidence"), 6).alias("confidence"), F.sum("merge_count").alias("merges"))


@query("d17_split_chunks", "SELECT o_orderkey, least(((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // greatest(1, count(*) OVER (PARTITION BY o_custkey) // 3)), 2)::BIGINT AS chunk FROM orders")
def d17(spark, d):
    w = Window.partitionBy("o_custkey")
    size = F.greatest(F.lit(1), F.expr("count(*) over (partition by o_custkey) div 3"))
    i = F.row_number().over(w.orderBy("o_orderkey")) - 1
    return table(spark, d, "orders").withColumns({"i": i, "s": size}).select("o_orderkey", F.least(F.expr("i div s"), F.lit(2)).cast("bigint").alias("chunk"))


@query("d18_benchmark_metrics", "SELECT coalesce(question_type, 'unknown') AS question_type, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE answer IN ('Yes','No')) / count(*), 4) AS share_binary, round(avg(length(question)), 4) AS mean_length FROM eval_items GROUP BY 1")
def d18(spark, d):
    return table(spark, d, "eval_items").groupBy(F.coalesce("question_type", F.lit("unknown")).alias("question_type")).agg(F.count("*").alias("n"), F.round(F.lit(100.0) * F.count_if(F.col("answer").isin("Yes", "No")) / F.count("*"), 4).alias("share_binary"), F.round(F.avg(F.length("question")), 4).alias("mean_length"))


@query("d19_company_breakdown", "SELECT company, count(*) AS n, count(*) FILTER (WHERE answer = 'No') AS n_no FROM eval_items GROUP BY 1")
def d19(spark, d):
    return table(spark, d, "eval_items").groupBy("company").agg(F.count("*").alias("n"), F.count_if(F.col("answer") == "No").alias("n_no"))


@query("d20_manifest_usage", f"SELECT folder, sum(size_bytes)::BIGINT AS used, round(100.0::DOUBLE * sum(size_bytes) / 1073741824, 2) AS percent FROM {PATHS} GROUP BY 1")
def d20(spark, d):
    return paths(spark, d).groupBy("folder").agg(F.sum("size_bytes").alias("used"), F.round(F.lit(100.0) * F.sum("size_bytes") / F.lit(1073741824), 2).alias("percent"))


@query("d21_compile_status", f"SELECT count(DISTINCT p.file_id) AS files, count(DISTINCT t.file_id) AS trees, count(t.node_id) AS nodes FROM {PATHS} p LEFT JOIN {TN} t USING (file_id) WHERE p.folder = 'filings'")
def d21(spark, d):
    p = paths(spark, d).where("folder = 'filings'").select("file_id").distinct()
    t = nodes(spark, d).groupBy("file_id").agg(F.count("*").alias("n"))  # before the join, so that no node moves twice
    return p.join(t, "file_id", "left").agg(F.count("*").alias("files"), F.count("n").alias("trees"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"))


@query("d22_lint_report", f"SELECT issue, count(*) AS n FROM (SELECT 'empty_content' AS issue FROM {KC} WHERE coalesce(length(content), 0) < 10 UNION ALL SELECT 'no_description' FROM {KC} WHERE coalesce(trim(description), '') = '' UNION ALL SELECT 'modified_before_created' FROM {KC} WHERE last_modified < create_time) GROUP BY 1")
def d22(spark, d):
    """All rules in one pass: each record has an array of its issues."""
    rules = {"empty_content": F.coalesce(F.length("content"), F.lit(0)) < 10, "no_description": F.coalesce(F.trim("description"), F.lit("")) == "", "modified_before_created": F.col("last_modified") < F.col("create_time")}
    issues = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return clusters(spark, d).select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("d23_health_score", "SELECT user_id, CASE WHEN s >= 80 THEN 'good' WHEN s >= 50 THEN 'fair' ELSE 'poor' END AS status FROM (SELECT user_id, 100 - CASE WHEN avg(value) > 60 THEN 30 WHEN avg(value) > 50 THEN 15 ELSE 0 END - CASE WHEN max(value) > 99 THEN 30 ELSE 0 END AS s FROM events GROUP BY 1)")
def d23(spark, d):
    s = F.lit(100) - F.when(F.avg("value") > 60, 30).when(F.avg("value") > 50, 15).otherwise(0) - F.when(F.max("value") > 99, 30).otherwise(0)
    e = table(spark, d, "events").groupBy("user_id").agg(s.alias("s"))
    return e.select("user_id", F.when(F.col("s") >= 80, "good").when(F.col("s") >= 50, "fair").otherwise("poor").alias("status"))


@query("d25_history_stats", f"SELECT count(*) AS searches, sum(results_count)::BIGINT AS results, count(*) FILTER (WHERE created_at >= (SELECT max(created_at) FROM {SH}) - INTERVAL 7 DAY) AS recent FROM {SH}")
def d25(spark, d):
    h = history(spark, d)
    last = F.broadcast(h.agg(F.max("created_at").alias("last")))  # one row
    return h.join(last).agg(F.count("*").alias("searches"), F.sum(F.col("results_count").cast("bigint")).alias("results"), F.count_if(F.col("created_at") >= F.col("last") - F.expr("INTERVAL 7 DAY")).alias("recent"))


HITS = f"(SELECT doc_id, line_number, length(line) AS len, length(line) - length(replace(lower(line), 'report', '')) AS score FROM {LINES} WHERE contains(lower(line), 'report'))"


def hits(spark, d):
    return grep.grep(doc_lines(spark, d), "report").select("doc_id", "line_number", F.length("line").cast("bigint").alias("len"), (F.length("line") - F.length(F.replace(F.lower("line"), F.lit("report"), F.lit("")))).cast("bigint").alias("score"))


@query("w1_top_matches", f"SELECT doc_id, line_number, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_number) AS rank, count(*) OVER (PARTITION BY doc_id) AS total FROM {HITS}) WHERE rank <= 3")
def w1(spark, d):
    return windows.top_per_group(hits(spark, d), ["doc_id"], [F.desc("score"), F.col("line_number")], 3, total=True).select("doc_id", "line_number", "rank", "total")


@query("w3_merge_files", f"SELECT doc_id, min(line_number) AS first_line, count(*) AS n, sum(score)::BIGINT AS total FROM {HITS} GROUP BY 1")
def w3(spark, d):
    return hits(spark, d).groupBy("doc_id").agg(F.min("line_number").alias("first_line"), F.count("*").alias("n"), F.sum("score").alias("total"))


@query("w4_gap_prune", f"WITH s AS (SELECT source, doc_id, n_chars::DOUBLE AS score FROM documents WHERE n_chars IS NOT NULL), r AS (SELECT *, row_number() OVER w AS rank, max(score) OVER (PARTITION BY source) AS m, CASE WHEN score < lag(score) OVER w * 0.5::DOUBLE THEN 1 ELSE 0 END AS cut FROM s WINDOW w AS (PARTITION BY source ORDER BY score DESC, doc_id)), c AS (SELECT *, sum(cut) OVER (PARTITION BY source ORDER BY rank) AS cuts FROM r) SELECT source, doc_id, rank FROM c WHERE ((score >= m * 0.3::DOUBLE AND cuts = 0) OR rank <= 1) AND rank <= 10")
def w4(spark, d):
    s = docs(spark, d).where("n_chars is not null").select("source", "doc_id", F.col("n_chars").cast("double").alias("score"))
    return windows.gap_prune(s, ["source"], "score", "doc_id").select("source", "doc_id", "rank")


@query("w5_context_windows", f"WITH s AS (SELECT doc_id, line_number, greatest(1, line_number - 2) AS a, line_number + 2 AS b FROM {HITS}), n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM s), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_number) AS island FROM n) SELECT doc_id, min(a) AS start, max(b) AS \"end\", count(*) AS hits FROM i GROUP BY doc_id, island")
def w5(spark, d):
    return windows.merge_windows(hits(spark, d), ["doc_id"], "line_number", 2)


@query("w6_char_budget", f"WITH r AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY doc_id ORDER BY score DESC, line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {HITS}) SELECT doc_id, line_number, least(len, 500 - before)::BIGINT AS kept FROM r WHERE before < 500")
def w6(spark, d):
    return windows.budget(hits(spark, d), ["doc_id"], [F.desc("score"), F.col("line_number")], "len", 500).select("doc_id", "line_number", F.col("kept").cast("bigint").alias("kept"))


@query("w7_page_ends", f"SELECT file_id, node_id, coalesce(lead(p1) OVER (PARTITION BY file_id ORDER BY ord, node_id), p2) AS page_end FROM {TN} WHERE level = 1")
def w7(spark, d):
    w = Window.partitionBy("file_id").orderBy("ord", "node_id")
    return nodes(spark, d).where("level = 1").select("file_id", "node_id", F.coalesce(F.lead("p1").over(w), F.col("p2")).alias("page_end"))


@query("w8_char_ends", f"SELECT file_id, node_id, lead(a) OVER (PARTITION BY file_id ORDER BY a, node_id) AS char_end FROM {TN} WHERE a IS NOT NULL")
def w8(spark, d):
    return nodes(spark, d).where("a is not null").select("file_id", "node_id", F.lead("a").over(Window.partitionBy("file_id").orderBy("a", "node_id")).alias("char_end"))


@query("w9_hierarchy", f"WITH o AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY ord, node_id) AS i, level FROM {TN}) SELECT file_id, i, level, (SELECT max(p.i) FROM o p WHERE p.file_id = o.file_id AND p.i < o.i AND p.level < o.level) AS parent FROM o")
def w9(spark, d):
    o = nodes(spark, d).select("file_id", F.row_number().over(Window.partitionBy("file_id").orderBy("ord", "node_id")).cast("bigint").alias("i"), "level")
    return windows.parents(o, ["file_id"], "i", "level")


@query("w10_fragment_runs", f"WITH l AS (SELECT doc_id, line_number, length(line) BETWEEN 1 AND 79 AS short FROM {LINES}), g AS (SELECT *, line_number - row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS g FROM l WHERE short) SELECT doc_id, min(line_number) AS first, max(line_number) AS last, count(*) AS length FROM g GROUP BY doc_id, g HAVING count(*) >= 3")
def w10(spark, d):
    return windows.runs(doc_lines(spark, d), ["doc_id"], "line_number", F.length("line").between(1, 79), 3)


@query("w12_numeric_runs", f"WITH l AS (SELECT doc_id, line_number, len(regexp_extract_all(line, '[0-9]+')) >= 2 AS num FROM {LINES}), g AS (SELECT *, line_number - row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS g FROM l WHERE num) SELECT doc_id, min(line_number) AS first, max(line_number) AS last, count(*) AS length FROM g GROUP BY doc_id, g HAVING count(*) >= 3")
def w12(spark, d):
    return windows.runs(doc_lines(spark, d), ["doc_id"], "line_number", F.regexp_count("line", F.lit("[0-9]+")) >= 2, 3)


@query("w13_uniform_groups", f"SELECT file_id, g, count(*) AS n, min(i) AS first FROM (SELECT file_id, i, (i - 1) // 15 AS g FROM (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY ord, node_id) AS i FROM {TN})) GROUP BY 1, 2")
def w13(spark, d):
    i = F.row_number().over(Window.partitionBy("file_id").orderBy("ord", "node_id")).cast("bigint")
    return nodes(spark, d).withColumn("i", i).withColumn("g", F.expr("(i - 1) div 15")).groupBy("file_id", "g").agg(F.count("*").alias("n"), F.min("i").alias("first"))


@query("w16_flatness", f"WITH c AS (SELECT file_id, level, count(*) n FROM {TN} GROUP BY 1, 2) SELECT file_id, sum(n)::BIGINT AS total, sum(n) > 20 AND max(n) > 0.9::DOUBLE * sum(n) AS flat FROM c GROUP BY 1")
def w16(spark, d):
    c = nodes(spark, d).groupBy("file_id", "level").agg(F.count("*").alias("n")).groupBy("file_id").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return c.select("file_id", "total", ((F.col("total") > 20) & (F.col("most") > F.lit(0.9) * F.col("total"))).alias("flat"))


@query("w17_newest_first_budget", f"WITH r AS (SELECT id, kb_name, greatest(1, floor(length(query) / 3.5::DOUBLE)) AS tokens, created_at FROM {SH} WHERE query IS NOT NULL), b AS (SELECT *, sum(tokens) OVER w AS used, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY kb_name ORDER BY created_at DESC NULLS LAST, id)) SELECT id, kb_name, n FROM b WHERE used <= 200 OR n = 1")
def w17(spark, d):
    w = Window.partitionBy("kb_name").orderBy(F.col("created_at").desc_nulls_last(), "id")
    r = history(spark, d).where("query is not null").withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("query") / F.lit(3.5))))
    b = r.withColumns({"used": F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(w).cast("bigint")})
    return b.where("used <= 200 or n = 1").select("id", "kb_name", "n")


@query("w18_recent_messages", f"SELECT id, created_at FROM {SH} WHERE created_at IS NOT NULL ORDER BY created_at DESC, id LIMIT 20")
def w18(spark, d):
    return history(spark, d).where("created_at is not null").orderBy(F.desc("created_at"), "id").limit(20).select("id", "created_at")


@query("w19_session_list", f"SELECT kb_name, left(arg_min(query, concat(strftime(created_at, '%Y%m%d%H%M%S%f'), id)), 50) AS first_query, left(arg_max(query, concat(strftime(created_at, '%Y%m%d%H%M%S%f'), id)), 100) AS last_query, count(*) AS n FROM {SH} WHERE created_at IS NOT NULL AND query IS NOT NULL GROUP BY 1")
def w19(spark, d):
    h = history(spark, d).where("created_at is not null and query is not null").withColumn("k", F.concat(F.date_format("created_at", "yyyyMMddHHmmssSSSSSS"), F.col("id")))
    return h.groupBy("kb_name").agg(F.substring(F.min_by("query", "k"), 1, 50).alias("first_query"), F.substring(F.max_by("query", "k"), 1, 100).alias("last_query"), F.count("*").alias("n"))


@query("w20_round_robin", f"WITH t AS (SELECT doc_id, line_number, term FROM {LINES}, (VALUES ('tribunal'), ('verdict'), ('counsel')) t(term) WHERE contains(lower(line), term)), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY line_number) AS deal FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY deal, term) AS rank FROM a) SELECT doc_id, line_number, term, rank FROM b WHERE rank <= 5")
def w20(spark, d):
    found = grep.grep_or(doc_lines(spark, d), ["tribunal", "verdict", "counsel"])
    return windows.round_robin(found, "term", [F.col("line_number")], 5, ["doc_id"]).select("doc_id", "line_number", "term", "rank")


@query("w22_page_estimate", f"SELECT file_id, node_id, least(10, greatest(1, 1 + (a * 10) // 20000)) AS page FROM {TN} WHERE a IS NOT NULL")
def w22(spark, d):
    return nodes(spark, d).where("a is not null").select("file_id", "node_id", F.least(F.lit(10), F.greatest(F.lit(1), F.expr("1 + (a * 10) div 20000"))).cast("bigint").alias("page"))


@query("f1_top_recent", f"SELECT id, hotness FROM {KC} WHERE hotness IS NOT NULL ORDER BY hotness DESC, id LIMIT 10")
def f1(spark, d):
    return clusters(spark, d).where("hotness is not null").orderBy(F.desc("hotness"), "id").limit(10).select("id", "hotness")


@query("f2_paged_list", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def f2(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("f4_tier_sort", f"SELECT id, CASE upper(lifecycle) WHEN 'STABLE' THEN 0 WHEN 'EMERGING' THEN 1 ELSE 2 END::BIGINT AS tier FROM {KC} ORDER BY tier, id")
def f4(spark, d):
    """All records in the order of the tiers."""
    u = F.upper("lifecycle")
    return clusters(spark, d).select("id", F.when(u == "STABLE", 0).when(u == "EMERGING", 1).otherwise(2).cast("bigint").alias("tier")).orderBy("tier", "id")


@query("g1_ordered_union", "SELECT doc_id, min(p)::BIGINT AS priority FROM (SELECT doc_id, 1 AS p FROM documents WHERE contains(lower(text), 'tribunal') UNION ALL SELECT doc_id, 2 FROM documents WHERE source = 'wiki-notes' UNION ALL SELECT doc_id, 3 FROM documents WHERE doc_kind = 'log') GROUP BY 1")
def g1(spark, d):
    """The first of several sources that has a row, in one pass over the table."""
    p = F.when(F.lower("text").contains("tribunal"), 1).when(F.col("source") == "wiki-notes", 2).when(F.col("doc_kind") == "log", 3)
    return docs(spark, d).select("doc_id", p.cast("bigint").alias("priority")).where("priority is not null")


@query("g3_overlap", "SELECT doc_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), ['tribunal','verdict','counsel','appeal'])) / 4.0::DOUBLE, 6) AS overlap FROM documents WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), ['tribunal','verdict','counsel','appeal'])) > 0")
def g3(spark, d):
    q = F.array(*map(F.lit, ("tribunal", "verdict", "counsel", "appeal")))
    n = F.size(F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), q))
    return docs(spark, d).select("doc_id", F.round(n / F.lit(4.0), 6).alias("overlap")).where("overlap > 0")


@query("g4_difference", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 2 EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 3")
def g4(spark, d):
    t = table(spark, d, "lineitem")
    return t.where("l_linenumber = 2").select("l_partkey").subtract(t.where("l_linenumber = 3").select("l_partkey"))


@query("g5_page_merge", "WITH a AS (SELECT DISTINCT file_id, CAST(page_number AS BIGINT) AS page_number FROM page_contents WHERE page_number % 2 = 0), b AS (SELECT DISTINCT file_id, CAST(page_number AS BIGINT) AS page_number FROM page_contents) SELECT file_id, page_number, 'old' AS origin FROM a UNION ALL SELECT file_id, page_number, 'new' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.file_id = b.file_id AND a.page_number = b.page_number)")
def g5(spark, d):
    b = table(spark, d, "page_contents").select("file_id", F.col("page_number").cast("bigint").alias("page_number")).distinct()
    a = b.where("page_number % 2 = 0")
    return a.withColumn("origin", F.lit("old")).union(b.join(a, ["file_id", "page_number"], "left_anti").withColumn("origin", F.lit("new")))


@query("g7_component_coverage", "SELECT doc_id, array_to_string(list_filter(['appeal','vaccine','turbine'], lambda t: contains(lower(text), t)), ',') AS covered FROM documents WHERE text IS NOT NULL")
def g7(spark, d):
    terms = F.array(*map(F.lit, ("appeal", "vaccine", "turbine")))
    return docs(spark, d).where("text is not null").select("doc_id", F.array_join(F.filter(terms, lambda t: F.contains(F.lower(F.col("text")), t)), ",").alias("covered"))
