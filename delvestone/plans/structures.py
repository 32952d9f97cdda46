"""Queries on document structure, tables, clusters, the graph and event time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import joins, ranking, structure
from ..sources.tables import table
from ..streaming import events as ev
from .registry import query
from .relations import KC, TN, clusters, nodes
from .search import LINES, doc_lines, docs

_MD, _NO = "(?s)^(#{1,6})[ \\t]+(.+)\\z", "(?s)^(\\d+(?:\\.\\d+)*)[. \\t]+(.+)\\z"
_ST = "(?i)^(PART|CHAPTER|ITEM|SECTION|ARTICLE|APPENDIX|EXHIBIT|SCHEDULE|ANNEX)[ \\t]+([\\p{L}\\p{N}_][\\p{L}\\p{N}_ .:\\-]*)\\z"
HEAD = (
    "(SELECT doc_id, line_number, char_start, kind, CASE kind WHEN 'markdown' THEN length(m) WHEN 'numbered' THEN len(string_split(n, '.')) ELSE CASE WHEN upper(w) IN ('PART','CHAPTER') THEN 1 WHEN upper(w) IN ('ITEM','SECTION','ARTICLE') THEN 2 ELSE 3 END END::BIGINT AS level,"
    " CASE kind WHEN 'markdown' THEN trim(ma) WHEN 'numbered' THEN concat(n, ' ', trim(na)) ELSE concat(upper(w), ' ', trim(wa)) END AS title"
    " FROM (SELECT *, CASE WHEN m <> '' AND trim(ma) <> '' THEN 'markdown' WHEN n <> '' AND trim(na) <> '' AND length(line) <= 120 THEN 'numbered' WHEN w <> '' THEN 'structural' END AS kind"
    " FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start"
    + "".join(f", regexp_extract(line, '{x}', {i}) AS {a}" for x, a, i in ((_MD, "m", 1), (_MD, "ma", 2), (_NO, "n", 1), (_NO, "na", 2), (_ST, "w", 1), (_ST, "wa", 2)))
    + f" FROM {LINES})) WHERE kind IS NOT NULL)"
)
_FIRST = "CASE kind WHEN 'markdown' THEN 0 WHEN 'numbered' THEN 1 ELSE 2 END"


@query("k1_headings", f"SELECT doc_id, line_number, char_start, kind, level, title FROM {HEAD}")
def k1(spark, d):
    return structure.headings(doc_lines(spark, d), "doc_id")


@query("k4_heading_cascade", f"SELECT doc_id, line_number, kind FROM (SELECT *, {_FIRST} AS k, min({_FIRST}) OVER (PARTITION BY doc_id) AS m FROM {HEAD}) WHERE k = m")
def k4(spark, d):
    return structure.cascade(structure.headings(doc_lines(spark, d), "doc_id"), "doc_id").select("doc_id", "line_number", "kind")


@query("k5_outline", f"SELECT doc_id, line_number, level, title FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM (SELECT *, {_FIRST} AS k, min({_FIRST}) OVER (PARTITION BY doc_id) AS m FROM {HEAD}) WHERE k = m) WHERE c >= 3")
def k5(spark, d):
    """The headings of the first kind that gives at least three."""
    return structure.outline(structure.headings(doc_lines(spark, d), "doc_id"), "doc_id").select("doc_id", "line_number", "level", "title")


@query("k3_structural", f"SELECT doc_id, line_number, level, title FROM {HEAD} WHERE kind = 'structural'")
def k3(spark, d):
    return structure.headings(doc_lines(spark, d), "doc_id").where("kind = 'structural'").select("doc_id", "line_number", "level", "title")


@query("k8_located_titles", f"SELECT h.doc_id, h.title, h.level, strpos(d.text, h.title) - 1 AS char_start FROM (SELECT DISTINCT doc_id, title, level FROM {HEAD} WHERE char_start < 8000) h JOIN documents d USING (doc_id) WHERE strpos(d.text, h.title) > 0")
def k8(spark, d):
    """Headings proposed from a text's first 8,000 characters (a model's part; here those of the rules), found again in the text."""
    proposed = structure.headings(doc_lines(spark, d), "doc_id").where("char_start < 8000").select("doc_id", "title", "level").distinct()
    return structure.located(docs(spark, d), "doc_id", "text", proposed)


@query("k11_recursive_tree")
def k11(spark, d):
    """Where a text is cut depends on where it was cut before: no SQL."""
    return structure.recursive_tree(docs(spark, d), "doc_id", "text")


@query("k9_node_depths", f"WITH RECURSIVE w AS (SELECT file_id, node_id, 0 AS depth FROM {TN} WHERE parent_id IS NULL UNION ALL SELECT n.file_id, n.node_id, w.depth + 1 FROM w JOIN {TN} n ON n.file_id = w.file_id AND n.parent_id = w.node_id) SELECT file_id, node_id, depth::BIGINT AS depth FROM w")
def k9(spark, d):
    return structure.depths(nodes(spark, d).select("file_id", "node_id", "parent_id").distinct(), "file_id", "node_id", "parent_id")


@query("k9_leaves", f"SELECT DISTINCT file_id, node_id FROM {TN} n WHERE NOT EXISTS (SELECT 1 FROM {TN} c WHERE c.file_id = n.file_id AND c.parent_id = n.node_id)")
def k9l(spark, d):
    return structure.leaves(nodes(spark, d), "file_id", "node_id", "parent_id").select("file_id", "node_id").distinct()


@query("k12_adaptive_depth", "SELECT doc_id, CASE WHEN n_chars < 2000 THEN 2 WHEN n_chars < 5000 THEN 3 ELSE 4 END::BIGINT AS depth, least(5000, greatest(1200, floor(n_chars * 0.15::DOUBLE)))::BIGINT AS preview FROM documents WHERE n_chars IS NOT NULL")
def k12(spark, d):
    n = F.col("n_chars")
    return docs(spark, d).where("n_chars is not null").select("doc_id", F.when(n < 2000, 2).when(n < 5000, 3).otherwise(4).cast("bigint").alias("depth"), F.least(F.lit(5000), F.greatest(F.lit(1200), F.floor(n * F.lit(0.15)))).cast("bigint").alias("preview"))


@query("k14_noise_filter", f"SELECT file_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id, title, p1, p2 ORDER BY length(coalesce(summary, '')) DESC, node_id) AS r FROM {TN} WHERE trim(coalesce(title, '')) <> '') WHERE r = 1")
def k14(spark, d):
    n = nodes(spark, d).withColumn("rich", F.length(F.coalesce("summary", F.lit(""))))
    return structure.noise_filter(n, "file_id", "title", ["p1", "p2"], "rich", "node_id").select("file_id", "node_id")


@query("k15_section_map", f"SELECT file_id, node_id, concat(repeat('  ', level::INT), coalesce(trim(title), '-')) AS line FROM {TN}")
def k15(spark, d):
    return nodes(spark, d).select("file_id", "node_id", F.concat(F.call_function("repeat", F.lit("  "), F.col("level").cast("int")), F.coalesce(F.trim("title"), F.lit("-"))).alias("line"))


@query("k16_short_summaries", "SELECT doc_id, left(trim(regexp_replace(left(text, 500), '[ \\t\\n]+', ' ', 'g')), 200) AS summary FROM documents WHERE text IS NOT NULL")
def k16(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.substring(F.trim(F.regexp_replace(F.substring("text", 1, 500), r"[ \t\n]+", " ")), 1, 200).alias("summary"))


@query("k17_heading_candidates", f"SELECT doc_id, line_number FROM {LINES} WHERE length(line) BETWEEN 10 AND 100 AND NOT regexp_matches(line, '[0-9]') AND NOT regexp_matches(line, '[.!?:;,]\\s*$') AND len(string_split(trim(line), ' ')) <= 12")
def k17(spark, d):
    line = F.col("line")
    return doc_lines(spark, d).where(F.length(line).between(10, 100) & ~line.rlike("[0-9]") & ~line.rlike(r"[.!?:;,]\s*$") & (F.size(F.split(F.trim(line), " ")) <= 12)).select("doc_id", "line_number")


RULE = "^\\s*\\|(?:\\s*:?-+:?\\s*\\|)+\\s*$"


@query("l1_table_digests", f"WITH t AS (SELECT doc_id, line_number, line, regexp_matches(line, '{RULE}') AS rule FROM {LINES} WHERE regexp_matches(line, '^\\s*\\|.*\\|\\s*$')), g AS (SELECT *, line_number - row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS g FROM t) SELECT doc_id, min(line_number) AS first_line, count(*) FILTER (WHERE NOT rule) AS n_rows, max(len(string_split(trim(line), '|')) - 2) FILTER (WHERE NOT rule) AS n_cols, arg_min(line, line_number) FILTER (WHERE NOT rule) AS header FROM g GROUP BY doc_id, g HAVING max(len(string_split(trim(line), '|')) - 2) FILTER (WHERE NOT rule) > 1")
def l1(spark, d):
    return structure.table_digests(doc_lines(spark, d), "doc_id")


@query("l2_tables_in_nodes", f"SELECT n.file_id, n.node_id, count(p.page_number) AS n_pages FROM (SELECT DISTINCT file_id, node_id, p1, p2 FROM {TN} WHERE p1 <= p2) n LEFT JOIN (SELECT DISTINCT file_id, page_number FROM page_contents WHERE regexp_matches(content, '[0-9].*[0-9]')) p ON p.file_id = n.file_id AND p.page_number BETWEEN n.p1 AND n.p2 GROUP BY 1, 2")
def l2(spark, d):
    """Pages in page ranges: a range's pages are listed, so that the join is an equality."""
    n = nodes(spark, d).where("p1 <= p2").select("file_id", "node_id", "p1", "p2").distinct()
    p = table(spark, d, "page_contents").where(F.col("content").rlike("[0-9].*[0-9]")).select("file_id", F.col("page_number").cast("bigint").alias("page")).distinct().withColumn("hit", F.lit(1))
    listed = n.select("file_id", "node_id", F.explode(F.sequence("p1", "p2")).alias("page"))
    return listed.join(p, ["file_id", "page"], "left").groupBy("file_id", "node_id").agg(F.count("hit").alias("n_pages"))


@query("m1_upsert", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 0 AND o_totalprice IS NOT NULL")
def m1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    changes = o.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return joins.upsert(o, changes, "o_orderkey", "o_totalprice")


@query("m2_version_bump", f"SELECT id, name, CASE WHEN confidence > 0.9 THEN coalesce(version, 0) + 1 ELSE version END::BIGINT AS version, CASE WHEN confidence > 0.9 THEN TIMESTAMP '2030-01-01 00:00:00' ELSE last_modified END AS last_modified FROM {KC}")
def m2(spark, d):
    base = clusters(spark, d).select("id", "name", "version", "last_modified", "confidence")
    changes = base.where("confidence > 0.9").select("id", F.lit(None).cast("string").alias("name")).distinct()
    return cl.update(base, changes, "id", ["name"], F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")).select("id", "name", "version", "last_modified")


@query("m3_delete", f"SELECT id FROM {KC} WHERE id NOT IN (SELECT id FROM knowledge_clusters WHERE upper(lifecycle) = 'DEPRECATED')")
def m3(spark, d):
    c = clusters(spark, d)
    return cl.delete(c, c.where(F.upper("lifecycle") == "DEPRECATED"), "id").select("id")


@query("m5_embedding_check", "SELECT coalesce(len(embedding_vector), -1)::BIGINT AS dim, embedding_model, count(DISTINCT id) AS n FROM knowledge_clusters GROUP BY 1, 2")
def m5(spark, d):
    return table(spark, d, "knowledge_clusters").groupBy(F.coalesce(F.array_size("embedding_vector"), F.lit(-1)).cast("bigint").alias("dim"), "embedding_model").agg(F.countDistinct("id").alias("n"))


@query("m6_hotness", f"SELECT id, round(least(1.0::DOUBLE, coalesce(hotness, 0.5::DOUBLE) + 0.1::DOUBLE), 6) AS hotness FROM {KC}")
def m6(spark, d):
    return clusters(spark, d).select("id", cl.hotter().alias("hotness"))


@query("m7_promotion", f"SELECT id, CASE WHEN upper(lifecycle) = 'EMERGING' AND coalesce(merge_count, 0) >= 3 THEN 'STABLE' ELSE upper(lifecycle) END AS lifecycle FROM {KC}")
def m7(spark, d):
    return clusters(spark, d).select("id", cl.promoted().alias("lifecycle"))


@query("m8_edge_upsert", "SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS kind, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2, 3")
def m8(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("weight"))
    return cl.merge_edges(e, "source", "target", "kind", "weight")


@query("c11_graph_expansion", "WITH p AS (SELECT DISTINCT l_suppkey s, l_partkey g FROM lineitem), e AS (SELECT a.s AS a, b.s AS b, least(1.0::DOUBLE, count(*) * 0.25::DOUBLE) AS weight FROM p a JOIN p b ON a.g = b.g AND a.s <> b.s GROUP BY 1, 2) SELECT b AS s, max(weight) AS weight FROM e WHERE a IN (3, 5) AND b NOT IN (3, 5) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def c11(spark, d):
    edges = cl.undirected(joins.co_occurrence(table(spark, d, "lineitem"), "l_suppkey", "l_partkey").select("a", "b", "weight"))
    seeds = spark.createDataFrame([(3,), (5,)], "s bigint")
    return cl.expand(seeds, edges, "s")


@query("m12_catalog", f"SELECT id, name, left(coalesce(description, content, ''), 500) AS summary FROM {KC}")
def m12(spark, d):
    return clusters(spark, d).select("id", "name", F.substring(F.coalesce("description", "content", F.lit("")), 1, 500).alias("summary"))


@query("m13_compile_hints", f"SELECT id FROM {KC} WHERE contains(lower(name), 'treaty') OR contains(lower(name), 'tribunal') ORDER BY confidence DESC NULLS LAST, id LIMIT 15")
def m13(spark, d):
    return clusters(spark, d).where(ranking.holds_any(["name"], ["treaty", "tribunal"])).orderBy(F.col("confidence").desc_nulls_last(), "id").limit(15).select("id")


@query("s3_rate_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def p3_counts(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, d, "events").select("event_id", F.count("*").over(w).alias("n"))


@query("s3_rate_limit")
def s3(spark, d):
    """Whether a hit passes depends on whether those before it passed: no SQL."""
    return ev.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id", (3600.0, 2), (86400.0, 20))


@query("s4_usage", "SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s4(spark, d):
    return ev.usage(table(spark, d, "events"), "event_type", "value").withColumn("total", F.round("total", 4))


@query("s9_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def s9(spark, d):
    w = ev.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("s9_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def s9s(spark, d):
    s = ev.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
