"""Queries on stores, routing, evidence, tree navigation and incremental work."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import grep, policies, ranking, structure, windows
from ..sources import tables
from ..sources.lineage import materialise, remove, shared_folder
from ..sources.tables import table
from .registry import query
from .relations import HITS, KC, SH, TN, clusters, history, hits, nodes
from .search import LINES, PATHS, doc_lines, docs, paths
from .texts import BM


def in_folder(spark, make):
    """The rows of ``make(folder)`` for a folder of its own, which is deleted before they are read."""
    folder = f"{shared_folder(spark)}/own-{uuid.uuid4().hex}"
    try:
        return materialise(make(folder))
    finally:
        remove(spark, folder)


@query("a3_export_round_trip", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def a3(spark, d):
    """Through a versioned table in the session's shared folder, written twice."""

    def make(folder):
        store = tables.VersionedTable(spark, folder)
        store.write(table(spark, d, "region").limit(0).select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name"))
        store.write(table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name"))
        return store.read()

    return in_folder(spark, make)


@query("a10_script", "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")
def a10(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("delvestone_orders")
    return tables.run_script(spark, "-- counts; by priority\nSELECT o_orderpriority AS p, count(*) AS n FROM delvestone_orders GROUP BY 1 HAVING count(*) > 10;")[-1]


@query("a29_fresh_cache", f"SELECT id, created_at FROM {SH} WHERE created_at > (SELECT max(created_at) FROM search_history) - INTERVAL 72 HOUR")
def a29(spark, d):
    h = history(spark, d)
    last = F.broadcast(h.agg(F.max("created_at").alias("last")))  # one row
    return h.join(last, F.col("created_at") > F.col("last") - F.expr("INTERVAL 72 HOUR")).select("id", "created_at")


@query("a35_browse", f"SELECT folder, name FROM {PATHS} WHERE folder = 'filings' ORDER BY lower(name), file_id LIMIT 30")
def a35(spark, d):
    return paths(spark, d).where("folder = 'filings'").orderBy(F.lower("name"), "file_id").limit(30).select("folder", "name")


@query("b5_retrieve", f"SELECT doc_id, line_number, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_number) AS rank FROM {HITS} WHERE doc_id IN (SELECT doc_id FROM documents WHERE contains(lower(text), 'appeal'))) WHERE rank <= 5")
def b5(spark, d):
    """AND over documents, then the best lines of each."""
    found = grep.grep_and(docs(spark, d), ["appeal", "report"])
    n = F.length("line") - F.length(F.replace(F.lower("line"), F.lit("report"), F.lit("")))
    return windows.top_per_group(found.withColumn("score", n), ["doc_id"], [F.desc("score"), F.col("line_number")], 5).select("doc_id", "line_number", "rank")


@query("b14_path_validation", f"SELECT DISTINCT trim(name) AS name FROM {PATHS} WHERE trim(name) <> '' AND NOT starts_with(name, '-') AND NOT contains(name, chr(0))")
def b14(spark, d):
    return paths(spark, d).where((F.trim("name") != "") & ~F.col("name").startswith("-") & ~F.contains(F.col("name"), F.lit("\x00"))).select(F.trim("name").alias("name")).distinct()


@query("b19_small_talk", f"SELECT id, regexp_matches(lower(trim(query)), '^(?:hi|hello|hey|thanks|thank you|test|ok|你好|谢谢)[\\s!.?。！]*$') AS chat FROM {SH} WHERE query IS NOT NULL")
def b19(spark, d):
    return history(spark, d).where("query is not null").select("id", policies.small_talk("query").alias("chat"))


@query("b20_refusals", "SELECT doc_id, coalesce(length(trim(text)) < 20 OR contains(lower(left(text, 500)), 'cannot answer') OR contains(lower(left(text, 500)), 'not available') OR contains(lower(left(text, 500)), 'no information') OR contains(lower(left(text, 500)), 'unable to') OR contains(lower(left(text, 500)), 'n/a'), true) AS refused FROM documents")
def b20(spark, d):
    return docs(spark, d).select("doc_id", policies.refusal("text").alias("refused"))


@query("b25_allowed_paths", f"SELECT path, starts_with(path, '/filings/') OR starts_with(path, '/north_') AS allowed FROM {PATHS}")
def b25(spark, d):
    return paths(spark, d).select("path", (grep.in_scope("path", [], ["/filings"]) | F.col("path").startswith("/north_")).alias("allowed"))


@query("d10_knowledge_activity", f"SELECT id, last_modified FROM {KC} WHERE last_modified IS NOT NULL ORDER BY last_modified DESC, id LIMIT 10")
def d10(spark, d):
    return clusters(spark, d).where("last_modified is not null").orderBy(F.desc("last_modified"), "id").limit(10).select("id", "last_modified")


@query("d11_storage_info", f"SELECT extension, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, max(size_bytes) AS largest FROM {PATHS} GROUP BY 1")
def d11(spark, d):
    return paths(spark, d).groupBy("extension").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.max("size_bytes").alias("largest"))


@query("d24_compile_counters", "SELECT mime_type, count(*) AS n, count(*) FILTER (WHERE coalesce(length(content), 0) = 0) AS empty_n, sum(page_count)::BIGINT AS pages FROM (SELECT DISTINCT file_id, mime_type, content, page_count FROM extraction_outputs) GROUP BY 1")
def d24(spark, d):
    e = table(spark, d, "extraction_outputs").select("file_id", "mime_type", "content", "page_count").distinct()
    return e.groupBy("mime_type").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.length("content"), F.lit(0)) == 0).alias("empty_n"), F.sum(F.col("page_count").cast("bigint")).alias("pages"))


@query("w2_rerank_in_files", f"SELECT doc_id, line_number, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_number) AS place FROM {HITS}")
def w2(spark, d):
    """Every hit, with its place in its own file."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "line_number"))
    return hits(spark, d).select("doc_id", "line_number", place.cast("bigint").alias("place"))


@query("w11_oversized_tail", f"WITH s AS (SELECT file_id, node_id, a, b - a AS span FROM {TN} WHERE level = 1 AND a IS NOT NULL AND b > a), q AS (SELECT *, quantile_disc(span, 0.25) OVER (PARTITION BY file_id) AS q FROM s), f AS (SELECT *, CASE WHEN span > 3 * q THEN 0 ELSE 1 END AS small FROM q), r AS (SELECT *, sum(small) OVER (PARTITION BY file_id ORDER BY a DESC, node_id DESC ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT file_id, count(*) AS n FROM r WHERE k = 0 GROUP BY 1")
def w11(spark, d):
    """Trailing sections each more than three times the lower quartile: a running flag from the end."""
    s = nodes(spark, d).where("level = 1 and a is not null and b > a").withColumn("span", F.col("b") - F.col("a"))
    q = s.groupBy("file_id").agg(F.expr("percentile_disc(0.25) within group (order by span)").alias("q"))
    w = Window.partitionBy("file_id").orderBy(F.desc("a"), F.desc("node_id")).rowsBetween(Window.unboundedPreceding, 0)
    r = s.join(q, "file_id").withColumn("k", F.sum(F.when(F.col("span") > 3 * F.col("q"), 0).otherwise(1)).over(w))
    return r.where("k = 0").groupBy("file_id").agg(F.count("*").alias("n"))


@query("w14_numbering_levels", f"SELECT file_id, node_id, CASE WHEN regexp_matches(title, '^\\s*\\d+\\.\\d+') THEN 2 WHEN regexp_matches(title, '^\\s*\\d+\\.?\\s') THEN 1 END::BIGINT AS numbered FROM {TN}")
def w14(spark, d):
    t = F.col("title")
    return nodes(spark, d).select("file_id", "node_id", F.when(t.rlike(r"^\s*\d+\.\d+"), 2).when(t.rlike(r"^\s*\d+\.?\s"), 1).cast("bigint").alias("numbered"))


@query("w15_prefix_levels", f"WITH p AS (SELECT split_part(trim(title), ' ', 1) AS prefix, count(*) AS n FROM {TN} WHERE trim(title) <> '' GROUP BY 1 HAVING count(*) >= 2) SELECT prefix, n, row_number() OVER (ORDER BY n, prefix) AS level FROM p")
def w15(spark, d):
    """Every repeated prefix: its place among those as frequent, after the number of rarer ones (one row for each frequency)."""
    p = nodes(spark, d).where("trim(title) != ''").groupBy(F.split(F.trim("title"), " ")[0].alias("prefix")).agg(F.count("*").alias("n")).where("n >= 2")
    rarer = p.groupBy("n").agg(F.count("*").alias("c")).select("n", (F.sum("c").over(Window.orderBy("n")) - F.col("c")).alias("rarer"))
    place = F.row_number().over(Window.partitionBy("n").orderBy("prefix"))
    return p.withColumn("place", place).join(rarer, "n").select("prefix", "n", (F.col("rarer") + F.col("place")).cast("bigint").alias("level"))


@query("w21_range_repair", f"SELECT file_id, node_id, CASE WHEN p2 < p1 THEN p1 ELSE p2 END AS p_end FROM {TN} WHERE p1 IS NOT NULL")
def w21(spark, d):
    return nodes(spark, d).where("p1 is not null").select("file_id", "node_id", F.when(F.col("p2") < F.col("p1"), F.col("p1")).otherwise(F.col("p2")).alias("p_end"))


@query("f3_sorted_clusters", f"SELECT id, coalesce(confidence, 0.0::DOUBLE) AS c FROM {KC} ORDER BY c DESC, id LIMIT 40")
def f3(spark, d):
    return clusters(spark, d).select("id", F.coalesce("confidence", F.lit(0.0)).alias("c")).orderBy(F.desc("c"), "id").limit(40)


@query("f5_by_size", f"SELECT file_id, size_bytes FROM {PATHS} ORDER BY size_bytes, file_id LIMIT 40")
def f5(spark, d):
    return paths(spark, d).orderBy("size_bytes", "file_id").limit(40).select("file_id", "size_bytes")


@query("f8_suggestions", f"SELECT name, strpos(lower(name), 'court') AS pos FROM (SELECT DISTINCT name FROM {PATHS} WHERE contains(lower(name), 'court')) ORDER BY pos, name LIMIT 8")
def f8(spark, d):
    p = paths(spark, d).select("name").distinct().where(F.lower("name").contains("court"))
    return p.select("name", F.instr(F.lower("name"), "court").cast("bigint").alias("pos")).orderBy("pos", "name").limit(8)


@query("g2_merge_hints", f"SELECT id, min(p)::BIGINT AS p FROM (SELECT id, 1 AS p FROM {KC} WHERE contains(lower(name), 'court') UNION ALL SELECT id, 2 FROM {KC} WHERE hotness > 0.8) GROUP BY 1 ORDER BY 2, 1 LIMIT 15")
def g2(spark, d):
    k = clusters(spark, d)
    return ranking.merge_hints([(k.where(ranking.holds_any(["name"], ["court"])), "id"), (k.where("hotness > 0.8"), "id")], "id", 15)


@query("g8_recent_queries", f"SELECT kb_name, array_to_string(list(query ORDER BY created_at, id), ' | ') AS recent FROM (SELECT *, row_number() OVER (PARTITION BY kb_name ORDER BY created_at DESC, id DESC) AS r FROM {SH} WHERE query IS NOT NULL AND created_at IS NOT NULL) WHERE r <= 5 GROUP BY 1")
def g8(spark, d):
    h = history(spark, d).where("query is not null and created_at is not null")
    last = h.withColumn("r", F.row_number().over(Window.partitionBy("kb_name").orderBy(F.desc("created_at"), F.desc("id")))).where("r <= 5")
    items = F.array_sort(F.collect_list(F.struct("created_at", "id", "query")))
    return last.groupBy("kb_name").agg(F.array_join(F.transform(items, lambda x: x["query"]), " | ").alias("recent"))


@query("h17_numeric_evidence", "SELECT doc_id, regexp_matches(lower(text), 'revenue|margin|profit|dividend') AND regexp_matches(text, '[$€]\\s?[0-9]|[0-9](?:\\.[0-9]+)?\\s?%|[0-9]{1,3},[0-9]{3}') AS numeric_evidence FROM documents WHERE text IS NOT NULL")
def h17(spark, d):
    t = F.col("text")
    return docs(spark, d).where("text is not null").select("doc_id", (F.lower(t).rlike("revenue|margin|profit|dividend") & t.rlike(r"[$€]\s?[0-9]|[0-9](?:\.[0-9]+)?\s?%|[0-9]{1,3},[0-9]{3}")).alias("numeric_evidence"))


@query("h20_arithmetic", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(abs(l_extendedprice * (1 - l_discount) - l_extendedprice) / nullif(l_extendedprice, 0), 6) AS gap FROM lineitem WHERE l_discount > 0.05")
def h20(spark, d):
    gap = F.try_divide(F.abs(F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_extendedprice")), F.col("l_extendedprice"))
    return table(spark, d, "lineitem").where("l_discount > 0.05").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.round(gap, 6).alias("gap"))


@query("h26_keyword_split", f"SELECT id, array_to_string(list_filter(list_transform(string_split_regex(query, '[,;|]'), lambda x: trim(x)), lambda x: x <> ''), '/') AS parts FROM {SH} WHERE query IS NOT NULL")
def h26(spark, d):
    return history(spark, d).where("query is not null").select("id", F.array_join(F.filter(F.transform(F.split("query", "[,;|]"), lambda x: F.trim(x)), lambda x: x != ""), "/").alias("parts"))


@query("i9_table_relevance", f"SELECT doc_id, line_number, (contains(lower(line), 'revenue')::INT + contains(lower(line), 'total')::INT) / 2.0::DOUBLE AS relevance FROM {LINES} WHERE starts_with(line, '|')")
def i9(spark, d):
    low = F.lower("line")
    return doc_lines(spark, d).where(F.col("line").startswith("|")).select("doc_id", "line_number", ((low.contains("revenue").cast("int") + low.contains("total").cast("int")) / F.lit(2.0)).alias("relevance"))


@query("i11_novelty", "SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(text, '[0-9][0-9,.]*[0-9]')), lambda x: NOT list_contains(['2019','2020','2021'], x)))::BIGINT AS new_numbers FROM documents WHERE text IS NOT NULL")
def i11(spark, d):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9][0-9,.]*[0-9]"), F.lit(0)))
    return docs(spark, d).where("text is not null").select("doc_id", F.size(F.array_except(found, F.array(*map(F.lit, ("2019", "2020", "2021"))))).cast("bigint").alias("new_numbers"))


@query("i15_index_probe", f"SELECT doc_id, score FROM {BM} WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_kind = 'report') ORDER BY score DESC, doc_id LIMIT 3")
def i15(spark, d):
    """Scored on the whole corpus, then limited to the scope."""
    b = ranking.bm25(docs(spark, d), "doc_id", "text", ["appeal", "tribunal", "appeal"])
    return b.join(docs(spark, d).where("doc_kind = 'report'").select("doc_id"), "doc_id", "left_semi").orderBy(F.desc("score"), "doc_id").limit(3)


@query("i18_leaf_routing", f"SELECT file_id, node_id, CASE WHEN content_type = 'table' OR table_count > 0 THEN 'pages' WHEN a IS NULL OR b <= a OR b - a < 200 THEN 'summary' ELSE 'chars' END AS route FROM {TN}")
def i18(spark, d):
    r = F.when((F.col("content_type") == "table") | (F.col("table_count") > 0), "pages").when(F.col("a").isNull() | (F.col("b") <= F.col("a")) | (F.col("b") - F.col("a") < 200), "summary").otherwise("chars")
    return nodes(spark, d).select("file_id", "node_id", r.alias("route"))


@query("i22_evidence_cascade", f"WITH t AS (SELECT doc_id, count(*) FILTER (WHERE starts_with(line, '|')) AS n, count(*) FILTER (WHERE contains(lower(line), 'report')) AS h FROM {LINES} GROUP BY 1), s AS (SELECT d.doc_id, length(d.text) AS size, CASE WHEN t.n >= 3 THEN 'tables' WHEN d.file_id IN (SELECT file_id FROM tree_nodes) THEN 'tree' WHEN length(d.text) <= 2000 THEN 'whole' WHEN t.h > 2 THEN 'windows' WHEN t.h > 0 THEN 'wide windows' ELSE 'head' END AS source FROM documents d LEFT JOIN t USING (doc_id) WHERE d.text IS NOT NULL) SELECT doc_id, source, least(size, CASE WHEN source = 'head' THEN 2000 ELSE 40000 END)::BIGINT AS most FROM s")
def i22(spark, d):
    """Where a document's evidence is to come from, and how many characters of it at most."""
    lines = F.split("text", "\n")
    t = docs(spark, d).where("text is not null").join(table(spark, d, "tree_nodes").select("file_id").where("file_id is not null").distinct().withColumn("tree", F.lit(True)), "file_id", "left")
    rows, hits = F.size(F.filter(lines, lambda x: x.startswith("|"))), F.size(F.filter(lines, lambda x: F.contains(F.lower(x), F.lit("report"))))
    source, most = ranking.evidence_source(rows, F.coalesce("tree", F.lit(False)), F.length("text"), hits)
    return t.select("doc_id", source.alias("source"), most.cast("bigint").alias("most"))


@query("i25_target_choice", f"SELECT p.folder, p.file_id FROM (SELECT p.*, row_number() OVER (PARTITION BY folder ORDER BY CASE WHEN file_id IN (SELECT file_id FROM tree_nodes) THEN 0 ELSE 1 END, name, file_id) AS r FROM {PATHS} p) p WHERE r <= 3")
def i25(spark, d):
    t = table(spark, d, "tree_nodes").select("file_id").distinct().withColumn("t", F.lit(0))
    own = paths(spark, d).join(t, "file_id", "left").withColumn("t", F.coalesce("t", F.lit(1)))
    return windows.top_per_group(own, ["folder"], [F.col("t"), F.col("name"), F.col("file_id")], 3).select("folder", "file_id")


@query("j2_fuzzy_anchors", "SELECT doc_id, start, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, start) AS r FROM (SELECT doc_id, start, len(list_intersect(list_distinct(regexp_extract_all(lower(substring(text, start + 1, 500)), '[a-z]+')), ['appeal','report','turbine','counsel']))::BIGINT AS hits FROM (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 500) + 1, 250)) AS start FROM documents WHERE length(text) > 0)) WHERE hits > 0) WHERE r <= 5")
def j2(spark, d):
    q = F.array(*map(F.lit, ("appeal", "report", "turbine", "counsel")))
    w = ranking.text_windows(docs(spark, d), "doc_id", "text").withColumn("hits", F.size(F.array_intersect(fn.words("content", "[a-z]+"), q)).cast("bigint")).where("hits > 0")
    return windows.top_per_group(w, ["doc_id"], [F.desc("hits"), F.col("start")], 5).select("doc_id", "start", "hits")


@query("j9_hash_sample")
def j9(spark, d):
    """A sample of fixed size by the key's hash: the same rows whatever the partitions."""
    return docs(spark, d).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(50).select("doc_id")


@query("j12_representative_nodes", f"SELECT file_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY level, ord, node_id) AS r FROM {TN} WHERE length(coalesce(summary, '')) > 20) WHERE r <= 15")
def j12(spark, d):
    n = nodes(spark, d).where(F.length(F.coalesce("summary", F.lit(""))) > 20)
    return windows.top_per_group(n, ["file_id"], [F.col("level"), F.col("ord"), F.col("node_id")], 15).select("file_id", "node_id")


@query("k2_numbered_titles", f"SELECT file_id, node_id, len(string_split(regexp_extract(title, '^\\s*(\\d+(?:\\.\\d+)*)', 1), '.'))::BIGINT AS depth FROM {TN} WHERE regexp_matches(title, '^\\s*\\d+(?:\\.\\d+)*')")
def k2(spark, d):
    return nodes(spark, d).where(F.col("title").rlike(r"^\s*\d+(?:\.\d+)*")).select("file_id", "node_id", F.size(F.split(F.regexp_extract("title", r"^\s*(\d+(?:\.\d+)*)", 1), r"\.")).cast("bigint").alias("depth"))


@query("k10_node_ids", "SELECT DISTINCT file_id, node_id, CASE WHEN char_range[1] >= 0 THEN concat('N', repeat('0', greatest(0, 6 - length(char_range[1]::VARCHAR))), char_range[1]::VARCHAR) END AS by_offset FROM tree_nodes")
def k10(spark, d):
    """An id from a node's offset, of six digits at least; none where there is no offset."""
    return nodes(spark, d).select("file_id", "node_id", structure.offset_id("a").alias("by_offset")).distinct()


@query("k13_navigation", f"SELECT file_id, node_id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, node_id) AS r FROM (SELECT file_id, node_id, 2 * contains(lower(coalesce(title, '')), 'court')::BIGINT + contains(lower(coalesce(summary, '')), 'court')::BIGINT + 2 * contains(lower(coalesce(title, '')), 'appeal')::BIGINT + contains(lower(coalesce(summary, '')), 'appeal')::BIGINT AS score FROM {TN}) WHERE score > 0) WHERE r <= 3")
def k13(spark, d):
    return structure.navigate(nodes(spark, d), "file_id", "node_id", ["court", "appeal"])


@query("k19_leaf_evidence", f"SELECT n.file_id, n.node_id, md5(substring(e.content, n.a + 1, least(n.b - n.a, 500))) AS h FROM (SELECT DISTINCT file_id, node_id, greatest(a, 0) AS a, b FROM {TN} t WHERE b > greatest(a, 0) AND NOT EXISTS (SELECT 1 FROM tree_nodes c WHERE c.file_id = t.file_id AND c.parent_id = t.node_id)) n JOIN (SELECT file_id, max(content) AS content FROM extraction_outputs WHERE content IS NOT NULL GROUP BY 1) e USING (file_id) WHERE n.a < length(e.content)")
def k19(spark, d):
    """The text of every leaf, whatever its level."""
    n = structure.leaves(nodes(spark, d), "file_id", "node_id", "parent_id").withColumn("a", F.greatest("a", F.lit(0)))
    n = n.where("b > a").select("file_id", "node_id", "a", "b").distinct()
    e = table(spark, d, "extraction_outputs").where("content is not null").groupBy("file_id").agg(F.max("content").alias("content"))
    part = F.call_function("substring", F.col("content"), (F.col("a") + 1).cast("int"), F.least(F.col("b") - F.col("a"), F.lit(500)).cast("int"))
    return n.join(e, "file_id").where(F.col("a") < F.length("content")).select("file_id", "node_id", F.md5(part).alias("h"))


@query("l3_dense_pages", "SELECT DISTINCT file_id, CAST(page_number AS BIGINT) AS page_number FROM page_contents WHERE length(regexp_replace(content, '[^0-9]', '', 'g')) > 0.04::DOUBLE * length(content)")
def l3(spark, d):
    p = table(spark, d, "page_contents").where(F.length(F.regexp_replace("content", "[^0-9]", "")) > F.lit(0.04) * F.length("content"))
    return p.select("file_id", F.col("page_number").cast("bigint").alias("page_number")).distinct()


@query("l5_gap_pages", f"SELECT DISTINCT p.file_id, CAST(p.page_number AS BIGINT) AS page_number FROM page_contents p WHERE length(p.content) > 0 AND NOT EXISTS (SELECT 1 FROM {TN} n WHERE n.file_id = p.file_id AND p.page_number BETWEEN n.p1 AND n.p2)")
def l5(spark, d):
    covered = nodes(spark, d).where("p1 <= p2").select("file_id", F.explode(F.sequence("p1", "p2")).alias("page_number")).distinct()
    p = table(spark, d, "page_contents").where(F.length("content") > 0).select("file_id", F.col("page_number").cast("bigint").alias("page_number")).distinct()
    return p.join(covered, ["file_id", "page_number"], "left_anti")


@query("m4_json_columns", "SELECT DISTINCT id, coalesce(json_array_length(CASE WHEN json_valid(queries) THEN queries END), 0)::BIGINT AS n_queries, coalesce(json_array_length(CASE WHEN json_valid(evidences) THEN evidences END), 0)::BIGINT AS n_evidences FROM knowledge_clusters")
def m4(spark, d):
    """Sizes of the JSON lists of every record; broken JSON, or JSON that is no list, has none."""
    n = lambda c: F.coalesce(F.json_array_length(c), F.lit(0)).cast("bigint")
    return table(spark, d, "knowledge_clusters").select("id", n("queries").alias("n_queries"), n("evidences").alias("n_evidences")).distinct()


@query("m9_fallback_clusters", "SELECT concat('FS', substring(sha256(text), 1, 8)) AS id, left(text, 60) AS name, 0.5::DOUBLE AS confidence, CASE WHEN file_id IS NULL THEN 'EMERGING' ELSE 'STABLE' END AS lifecycle FROM documents WHERE length(text) > 0")
def m9(spark, d):
    """A cluster of every text; one without a file behind it is emerging."""
    state = F.when(F.col("file_id").isNull(), "EMERGING").otherwise("STABLE")
    return docs(spark, d).where(F.length("text") > 0).select(fn.short_id("FS", "text", 8).alias("id"), F.substring("text", 1, 60).alias("name"), F.lit(0.5).alias("confidence"), state.alias("lifecycle"))


@query("m14_compile_pipeline", "WITH c AS (SELECT m.file_id, CASE WHEN e.file_id IS NULL THEN 'missing' WHEN t.file_id IS NULL THEN 'flat' ELSE 'tree' END AS state FROM (SELECT DISTINCT file_id FROM upload_manifest) m LEFT JOIN (SELECT DISTINCT file_id FROM extraction_outputs WHERE length(content) > 0) e USING (file_id) LEFT JOIN (SELECT DISTINCT file_id FROM tree_nodes) t USING (file_id)) SELECT state, count(*) AS n FROM c GROUP BY 1")
def m14(spark, d):
    m = table(spark, d, "upload_manifest").select("file_id").distinct()
    e = table(spark, d, "extraction_outputs").where(F.length("content") > 0).select("file_id").distinct().withColumn("e", F.lit(1))
    t = table(spark, d, "tree_nodes").select("file_id").distinct().withColumn("t", F.lit(1))
    state = F.when(F.col("e").isNull(), "missing").when(F.col("t").isNull(), "flat").otherwise("tree")
    return m.join(e, "file_id", "left").join(t, "file_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("s5_session_budget", "SELECT event_id FROM (SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE used <= 500 AND n <= 10")
def s5(spark, d):
    """The first ten of each user are found with a limit on the map side; sums run over those only."""
    first = windows.top_per_group(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 10)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("used", F.sum("value").over(w)).where("used <= 500").select("event_id")


@query("s8_audit_rows", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, concat(event_type, '/', json_extract_string(props, '$.k')) AS action FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def s8(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")).where("k is not null")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.concat("event_type", F.lit("/"), "k").alias("action"))


@query("u2_keyword_tool", f"SELECT doc_id, min(line_number) AS first_line, count(*) AS n FROM {LINES} WHERE contains(lower(line), 'appeal') OR contains(lower(line), 'turbine') OR contains(lower(line), '(a|b)') GROUP BY 1")
def u2(spark, d):
    """Terms are literal: the last one isn't taken for a pattern."""
    tools = policies.Tools()
    tools.register("keywords", lambda terms: policies.keyword_tool(doc_lines(spark, d), terms))
    return tools.call("keywords", terms=["appeal", "turbine", "(a|b)"])


@query("u3_file_read", "SELECT doc_id, md5(left(text, 30000)) AS h FROM documents WHERE text IS NOT NULL")
def u3(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.md5(F.substring("text", 1, 30000)).alias("h"))


@query("u9_hashed_embedding")
def u9(spark, d):
    """The default of the embedding step; its hash isn't in SQL."""
    return history(spark, d).where("query is not null").select("id", policies.hashed_embedding("query").alias("v"))


#: A predicted answer for each item, of every kind that a judge meets: the gold one, marked up, cut, off by one in a hundred, refused.
PREDICTED = "CASE item_id % 5 WHEN 0 THEN answer WHEN 1 THEN concat('**', answer, '**') WHEN 2 THEN left(answer, length(answer) // 2) WHEN 3 THEN concat('Answer: ', answer) ELSE 'I am unable to answer that from the evidence.' END"
NORM = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[*_`\"'']', '', 'g'), '(?i)^\\s*(?:answer|final answer)\\s*:\\s*', ''), '[$€£,]', '', 'g'), '(\\d+\\.\\d*?)0+\\b', '\\1', 'g')))"
NUM = "(CASE WHEN regexp_matches(lower(trim({0})), '^\\(.*\\)$') OR starts_with(lower(trim({0})), '-') THEN -1.0 ELSE 1.0 END * try_cast(nullif(regexp_extract(regexp_replace(lower(trim({0})), '[,$€£]', '', 'g'), '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) * CASE WHEN regexp_matches(lower(trim({0})), '(?:\\d|\\s)(?:b|bn|billion)\\b') THEN 1e9 WHEN regexp_matches(lower(trim({0})), '(?:\\d|\\s)(?:m|mn|million)\\b') THEN 1e6 WHEN regexp_matches(lower(trim({0})), '(?:\\d|\\s)(?:k|thousand)\\b') THEN 1e3 WHEN contains(lower(trim({0})), '%') THEN 0.01 ELSE 1.0 END)::DOUBLE"


@query("u15_judge", f"WITH e AS (SELECT item_id, answer, {PREDICTED} AS p FROM eval_items), n AS (SELECT item_id, {NORM.format('p')} AS a, {NORM.format('answer')} AS b, {NUM.format('p')} AS x, {NUM.format('answer')} AS y, p FROM e) SELECT item_id, CASE WHEN p IS NULL OR length(trim(p)) < 1 OR contains(lower(left(p, 500)), 'cannot answer') OR contains(lower(left(p, 500)), 'not available') OR contains(lower(left(p, 500)), 'no information') OR contains(lower(left(p, 500)), 'unable to') OR contains(lower(left(p, 500)), 'n/a') THEN 'refused' WHEN a = b THEN 'exact' WHEN CASE WHEN abs(x) < 10 AND abs(y) < 10 THEN abs(x - y) <= 0.3 ELSE abs(x - y) <= 0.02 * greatest(abs(x), abs(y)) END THEN 'numeric' WHEN x IS NOT NULL AND y IS NOT NULL THEN 'wrong' ELSE 'undecided' END AS verdict FROM n")
def u15(spark, d):
    """Every item's gold answer against a prediction, right, marked up, cut short or refused."""
    e = table(spark, d, "eval_items").select("item_id", "answer", F.expr(PREDICTED.replace("length(answer) // 2", "cast(length(answer) div 2 as int)")).alias("predicted"))
    return e.select("item_id", policies.verdict("predicted", "answer").alias("verdict"))


@query("u17_default_summary", "SELECT doc_id, left(trim(regexp_replace(left(text, 600), '[ \\t\\n]+', ' ', 'g')), 200) AS summary FROM documents WHERE text IS NOT NULL")
def u17(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", policies.default_summary("text").alias("summary"))


@query("u19_relevance_tiers", f"SELECT file_id, CASE WHEN contains(lower(name), 'court') THEN 'high' WHEN contains(lower(name), 'co') THEN 'medium' ELSE 'low' END AS relevance FROM {PATHS}")
def u19(spark, d):
    return paths(spark, d).select("file_id", ranking.relevance_tier("name", ["court"]).alias("relevance"))

