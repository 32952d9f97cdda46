"""Queries on the remaining small operators: dialects, salvage, ordering, table rendering, evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import grep, joins, policies, ranking, structure, windows
from ..sources.tables import table
from .registry import query
from .relations import KC, SH, TN, clusters, history, nodes
from .search import LINES, PATHS, doc_lines, docs, paths


@query("a19_delimiter_sniff", "SELECT item_id, CASE WHEN c >= s AND c > 0 THEN ',' WHEN s > 0 THEN ';' ELSE 'none' END AS delimiter FROM (SELECT item_id, length(question) - length(replace(question, ',', '')) AS c, length(question) - length(replace(question, ';', '')) AS s FROM eval_items)")
def a19(spark, d):
    n = lambda ch: F.length("question") - F.length(F.replace(F.col("question"), F.lit(ch), F.lit("")))
    return table(spark, d, "eval_items").select("item_id", F.when((n(",") >= n(";")) & (n(",") > 0), ",").when(n(";") > 0, ";").otherwise("none").alias("delimiter"))


@query("a34_artifact_keys", "SELECT file_id, min(concat('N', file_id, '_', length(content))) AS artifact FROM extraction_outputs WHERE content IS NOT NULL GROUP BY 1")
def a34(spark, d):
    e = table(spark, d, "extraction_outputs").where("content is not null")
    return e.groupBy("file_id").agg(F.min(F.concat(F.lit("N"), "file_id", F.lit("_"), F.length("content").cast("string"))).alias("artifact"))


@query("d26_overview", f"SELECT 'clusters' AS part, count(*) AS n FROM {KC} UNION ALL SELECT 'files', count(*) FROM {PATHS} UNION ALL SELECT 'searches', count(*) FROM {SH} UNION ALL SELECT 'events', count(*) FROM events")
def d26(spark, d):
    parts = {"clusters": clusters(spark, d), "files": paths(spark, d), "searches": history(spark, d), "events": table(spark, d, "events")}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.union(one)
    return out


@query("g6_section_dedupe", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10) || chr(10)), lambda b: NOT starts_with(b, '|')), chr(10) || chr(10)) AS kept FROM documents WHERE contains(text, chr(10) || '|')")
def g6(spark, d):
    """Text blocks that aren't tables, of documents that have tables of their own."""
    t = docs(spark, d).where(F.contains(F.col("text"), F.lit("\n|")))
    return t.select("doc_id", F.array_join(F.filter(F.split("text", "\n\n"), lambda b: ~b.startswith("|")), "\n\n").alias("kept"))


@query("h12_catalog_keywords", "SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+'), lambda w: length(w) BETWEEN 2 AND 20 AND NOT regexp_matches(w, '^[0-9]+$')))), ' ') AS keywords FROM (SELECT DISTINCT id, name FROM knowledge_clusters WHERE name IS NOT NULL)")
def h12(spark, d):
    k = table(spark, d, "knowledge_clusters").select("id", "name").distinct().where("name is not null")
    w = F.filter(fn.words("name"), lambda x: F.length(x).between(2, 20) & ~x.rlike("^[0-9]+$"))
    return k.select("id", F.array_join(F.array_sort(F.array_distinct(w)), " ").alias("keywords"))


#: Answers of a summarising step, of each form that a parser meets: both tags, one of them, none, and unclosed.
ANSWER = "CASE item_id % 4 WHEN 0 THEN concat('<PRECISE>', answer, '</PRECISE>', chr(10), '<SUMMARY> ', question, ' </SUMMARY>') WHEN 1 THEN concat('<SUMMARY>', question, '</SUMMARY>') WHEN 2 THEN concat('Plain. ', question) ELSE concat('<SUMMARY>', question) END"


@query("h23_summary_parse", f"SELECT item_id, trim(regexp_extract({ANSWER}, '(?s)<SUMMARY>(.*?)</SUMMARY>', 1)) AS summary, trim(regexp_extract({ANSWER}, '(?s)<PRECISE>(.*?)</PRECISE>', 1)) AS precise FROM eval_items")
def h23(spark, d):
    s = table(spark, d, "eval_items").select("item_id", F.expr(ANSWER).alias("s"))
    return s.select("item_id", fn.tag("s", "SUMMARY").alias("summary"), fn.tag("s", "PRECISE").alias("precise"))


#: Every Markdown heading of the documents as HTML, with an element inside and a class.
HTML = "SELECT doc_id, line_number, concat('<p>x</p><h', n, ' class=\"c\">', substring(line, 1, 3), '<b>', substring(line, 4), '</b></h', n, '>') AS html FROM (SELECT *, length(regexp_extract(line, '^(#{{1,6}}) ', 1)) AS n FROM {0}) WHERE n > 0"


@query("h24_html_headings", f"SELECT doc_id, line_number, regexp_extract(html, '(?is)<h([1-6])[^>]*>', 1)::BIGINT AS level, trim(regexp_replace(regexp_extract(html, '(?is)<h[1-6][^>]*>(.*)</h[1-6]>', 1), '<[^>]+>', '', 'g')) AS title FROM ({HTML.format(LINES)})")
def h24(spark, d):
    n = F.length(F.regexp_extract("line", "^(#{1,6}) ", 1)).cast("string")
    h = doc_lines(spark, d).withColumn("n", n).where("n != '0'").select("doc_id", "line_number", F.concat(F.lit("<p>x</p><h"), "n", F.lit(' class="c">'), F.expr("substring(line, 1, 3)"), F.lit("<b>"), F.expr("substring(line, 4)"), F.lit("</b></h"), "n", F.lit(">")).alias("html"))
    level, title = fn.html_heading("html")
    return h.select("doc_id", "line_number", level.alias("level"), title.alias("title"))


@query("h25_valid_text", "SELECT doc_id, NOT contains(text, chr(65533)) AS clean FROM documents WHERE text IS NOT NULL")
def h25(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", (F.is_valid_utf8("text") & ~F.contains(F.col("text"), F.lit("�"))).alias("clean"))


@query("i4_default_idf", "SELECT subject, greatest(0.5::DOUBLE, least(1.0::DOUBLE, length(subject) / 5.0::DOUBLE)) AS idf FROM subject_areas")
def i4(spark, d):
    return table(spark, d, "subject_areas").select("subject", F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.length("subject") / F.lit(5.0))).alias("idf"))


@query("i10_table_structure", f"SELECT doc_id, count(*) AS n_rows, round(avg(CASE WHEN regexp_matches(line, '[0-9]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS numeric_share FROM {LINES} WHERE starts_with(line, '|') GROUP BY 1 HAVING count(*) >= 5")
def i10(spark, d):
    rows = doc_lines(spark, d).where(F.col("line").startswith("|"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.round(F.avg(F.when(F.col("line").rlike("[0-9]"), 1.0).otherwise(0.0)), 6).alias("numeric_share")).where("n_rows >= 5")


@query("i14_catalog_overlap", f"SELECT id, len(list_intersect(list_distinct(regexp_extract_all(lower(concat_ws(' ', name, description)), '[\\p{{L}}\\p{{N}}]+')), ['court','contract','breach','appeal']))::BIGINT AS overlap FROM {KC} WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(concat_ws(' ', name, description)), '[\\p{{L}}\\p{{N}}]+')), ['court','contract','breach','appeal'])) > 0 ORDER BY 2 DESC, 1 LIMIT 20")
def i14(spark, d):
    return ranking.overlap_rank(clusters(spark, d), "id", ["name", "description"], ["court", "contract", "breach", "appeal"], 20)


@query("i16_largest_discrepancy", "SELECT l_returnflag, round(max(abs(l_extendedprice * l_discount - l_extendedprice * l_tax)), 4) AS worst, count(*) FILTER (WHERE abs(l_discount - l_tax) > 0.01) AS n FROM lineitem GROUP BY 1")
def i16(spark, d):
    gap = F.abs(F.col("l_extendedprice") * F.col("l_discount") - F.col("l_extendedprice") * F.col("l_tax"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.max(gap), 4).alias("worst"), F.count_if(F.abs(F.col("l_discount") - F.col("l_tax")) > 0.01).alias("n"))


@query("i21_page_selection", "SELECT file_id, page FROM (SELECT file_id, unnest([greatest(1, n // 2), greatest(1, n * 3 // 4)]) AS page FROM (SELECT file_id, max(page_count)::BIGINT AS n FROM extraction_outputs WHERE page_count > 0 GROUP BY 1)) GROUP BY 1, 2")
def i21(spark, d):
    e = table(spark, d, "extraction_outputs").where("page_count > 0").groupBy("file_id").agg(F.max("page_count").cast("bigint").alias("n"))
    return e.select("file_id", F.explode(F.array_distinct(F.array(F.greatest(F.lit(1), F.expr("n div 2")), F.greatest(F.lit(1), F.expr("n * 3 div 4"))))).alias("page"))


@query("i23_keyword_order", f"WITH k AS (SELECT id, pos, kw, 10.0 - pos AS w FROM (SELECT id, generate_subscripts(p, 1) AS pos, unnest(p) AS kw FROM (SELECT id, list_filter(list_transform(string_split_regex(lower(query), '(?:^| )(?:(?:of|and|for|the|in|a) )+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM {SH} WHERE query IS NOT NULL))) SELECT id, kw, (CASE WHEN contains(kw, ' ') THEN greatest(w, 7) ELSE w END)::DOUBLE AS weight, row_number() OVER (PARTITION BY id ORDER BY contains(kw, ' ') DESC, pos) AS place FROM k")
def i23(spark, d):
    """The phrases of each search, those of several words first and of a weight of 7 at least."""
    parts = F.filter(F.transform(F.split(F.lower("query"), "(?:^| )(?:(?:of|and|for|the|in|a) )+"), lambda x: F.trim(x)), lambda x: x != "")
    k = history(spark, d).where("query is not null").select("id", F.posexplode(parts).alias("i", "kw")).withColumn("w", F.lit(9.0) - F.col("i"))
    return ranking.order_keywords(k, "id", "kw", "w", "i").select("id", "kw", "weight", "place")


@query("j10_line_snapshot", f"SELECT doc_id, max(line_number) AS last_line FROM (SELECT doc_id, line_number, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {LINES}) WHERE used < 700 GROUP BY 1")
def j10(spark, d):
    """The part of a snapshot that is certain: lines up to the budget's forced share."""
    own = doc_lines(spark, d).withColumn("n", F.length("line").cast("bigint"))
    return windows.budget(own, ["doc_id"], [F.col("line_number")], "n", 700).groupBy("doc_id").agg(F.max("line_number").alias("last_line"))


@query("k20_outline_repair", f"SELECT file_id, node_id, p1, greatest(p1, coalesce(min(p1) OVER (PARTITION BY file_id, level ORDER BY p1 RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, p2, p1)) AS p_end FROM {TN} WHERE p1 IS NOT NULL")
def k20(spark, d):
    """Of each level the pages up to the next section's."""
    w = Window.partitionBy("file_id", "level").orderBy("p1").rangeBetween(1, Window.unboundedFollowing)
    n = nodes(spark, d).where("p1 is not null")
    return n.select("file_id", "node_id", "p1", F.greatest("p1", F.coalesce(F.min("p1").over(w) - 1, "p2", "p1")).alias("p_end"))


@query("l4_dense_lines", "SELECT file_id, page_number, count(*) AS n FROM (SELECT file_id, CAST(page_number AS BIGINT) AS page_number, unnest(string_split(content, chr(10))) AS line FROM (SELECT DISTINCT file_id, page_number, content FROM page_contents)) WHERE len(regexp_extract_all(line, '[0-9]+')) >= 2 GROUP BY 1, 2")
def l4(spark, d):
    """Lines with several numbers, counted inside each page's row."""
    p = table(spark, d, "page_contents").select("file_id", F.col("page_number").cast("bigint").alias("page_number"), "content").distinct()
    n = F.size(F.filter(F.split("content", "\n"), lambda x: F.regexp_count(x, F.lit("[0-9]+")) >= 2)).cast("bigint")
    return p.where("content is not null").select("file_id", "page_number", n.alias("n")).where("n > 0")


@query("l6_digest_supplement", "WITH a AS (SELECT DISTINCT file_id, CAST(page_number AS BIGINT) AS page FROM page_contents WHERE regexp_matches(content, '[$€]')), b AS (SELECT DISTINCT file_id, CAST(page_number AS BIGINT) AS page FROM page_contents WHERE regexp_matches(content, '[0-9],[0-9]{3}')) SELECT file_id, page, 1::BIGINT AS origin FROM a UNION ALL SELECT file_id, page, 2 FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.file_id = b.file_id AND a.page = b.page)")
def l6(spark, d):
    p = F.when(F.col("content").rlike("[$€]"), 1).when(F.col("content").rlike("[0-9],[0-9]{3}"), 2).cast("bigint")
    rows = table(spark, d, "page_contents").select("file_id", F.col("page_number").cast("bigint").alias("page"), p.alias("origin")).where("origin is not null")
    return rows.groupBy("file_id", "page").agg(F.min("origin").alias("origin"))


@query("l7_table_render", f"WITH t AS (SELECT doc_id, line_number, line, length(line) AS n FROM {LINES} WHERE starts_with(line, '|')), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM t) SELECT doc_id, string_agg(line, chr(10) ORDER BY line_number) AS rendered FROM b WHERE used < 300 GROUP BY 1")
def l7(spark, d):
    t = doc_lines(spark, d).where(F.col("line").startswith("|")).withColumn("n", F.length("line"))
    kept = windows.budget(t, ["doc_id"], [F.col("line_number")], "n", 300)
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "line"))), lambda x: x["line"]), "\n").alias("rendered"))


@query("m10_reused_content", f"SELECT id, concat_ws(chr(10), content, nullif(concat('[', name, '] ', left(description, 100)), '')) AS t FROM {KC} WHERE content IS NOT NULL AND name IS NOT NULL AND description IS NOT NULL")
def m10(spark, d):
    k = clusters(spark, d).where("content is not null and name is not null and description is not null")
    return k.select("id", F.concat_ws("\n", "content", F.concat(F.lit("["), "name", F.lit("] "), F.substring("description", 1, 100))).alias("t"))


@query("m11_evidence_paths", f"WITH RECURSIVE n AS (SELECT DISTINCT file_id, node_id, parent_id, title FROM {TN}), w AS (SELECT file_id, node_id, coalesce(trim(title), '') AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.file_id, n.node_id, concat(w.path, ' > ', coalesce(trim(n.title), '')) FROM n JOIN w ON n.file_id = w.file_id AND n.parent_id = w.node_id) SELECT * FROM w")
def m11(spark, d):
    """The titles from the root down to each node, whatever its level."""
    return structure.title_paths(nodes(spark, d), "file_id", "node_id", "parent_id", "title")


@query("s1_incremental_compile", f"WITH a AS (SELECT file_id, sha256 FROM {PATHS} WHERE size_bytes % 3 <> 0), b AS (SELECT file_id, sha256 FROM {PATHS}) SELECT b.file_id FROM b LEFT JOIN a USING (file_id) WHERE a.sha256 IS DISTINCT FROM b.sha256")
def s1(spark, d):
    """What a compile has to handle: files that are new or changed since the manifest."""
    now = paths(spark, d).select("file_id", "sha256")
    before = paths(spark, d).where("size_bytes % 3 != 0").select("file_id", "sha256")
    return joins.change_set(before, now, "file_id", "sha256").where(F.col("change").isin("added", "modified")).select("file_id")


@query("u4_knowledge_tool", f"SELECT id FROM {KC} WHERE contains(lower(name), 'court') OR contains(lower(description), 'court') ORDER BY confidence DESC NULLS LAST, id LIMIT 3")
def u4(spark, d):
    return clusters(spark, d).where(ranking.holds_any(["name", "description"], ["court"])).orderBy(F.col("confidence").desc_nulls_last(), "id").limit(3).select("id")


@query("u14_fallbacks", f"SELECT doc_id, line_number FROM {LINES} WHERE contains(lower(line), 'tribunal')")
def u14(spark, d):
    """The first strategy that finds anything."""
    own = doc_lines(spark, d)
    return policies.cascade(lambda: grep.grep(own, "no such words at all"), lambda: grep.grep(own, "tribunal")).select("doc_id", "line_number")


@query("u16_routing", f"SELECT id, CASE WHEN regexp_matches(lower(trim(query)), '^(?:hi|hello|hey|thanks|thank you|test|ok|你好|谢谢)[\\s!.?。！]*$') THEN 'chat' WHEN length(trim(query)) = 0 THEN 'empty' ELSE 'search' END AS route FROM {SH} WHERE query IS NOT NULL")
def u16(spark, d):
    return history(spark, d).where("query is not null").select("id", F.when(policies.small_talk("query"), "chat").when(F.length(F.trim("query")) == 0, "empty").otherwise("search").alias("route"))


@query("i13_diverse_choice")
def i13(spark, d):
    """Each choice depends on those before it: no SQL."""
    v = table(spark, d, "embeddings").withColumn("s", F.col("label") / F.lit(10.0))
    return spark.createDataFrame([(int(k), i) for i, k in enumerate(ranking.mmr(v, "vec_id", "embedding", "s", 10))], "vec_id bigint, place int")
