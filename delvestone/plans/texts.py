"""Queries on scalar functions, ranking and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import ranking
from ..sources.tables import table
from .registry import query
from .relations import KC, SH, clusters, history
from .search import LINES, PATHS, doc_lines, docs, paths

TOK = "regexp_extract_all(lower(text), '[a-z]+')"


@query("h1_fingerprint", "SELECT doc_id, concat(md5(CASE WHEN strlen(text) <= 16384 THEN encode(text) ELSE encode(text)[1:8192] || encode(text)[-8192:] END), '_', strlen(text)) AS fingerprint FROM documents WHERE text IS NOT NULL")
def h1(spark, d):
    """Texts of any length; of long ones the head and the tail count."""
    return docs(spark, d).where("text is not null").select("doc_id", fn.fingerprint("text").alias("fingerprint"))


@query("h2_cache_keys", f"SELECT file_id, concat(sha256, '_', size_bytes) AS cache_key FROM {PATHS}")
def h2(spark, d):
    return paths(spark, d).select("file_id", F.concat_ws("_", "sha256", F.col("size_bytes").cast("string")).alias("cache_key"))


@query("h3_short_ids", "SELECT doc_id, concat('C', substring(sha256(text), 1, 10)) AS cid FROM documents WHERE text IS NOT NULL")
def h3(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", fn.short_id("C", "text").alias("cid"))


@query("h4_cluster_text", f"SELECT id, concat_ws(chr(10) || chr(10), nullif(trim(name), ''), nullif(trim(description), ''), nullif(trim(content), '')) AS t FROM {KC}")
def h4(spark, d):
    return clusters(spark, d).select("id", fn.joined_text("name", "description", "content").alias("t"))


#: The tags that are looked for in a text.
TAGS = ("title", "NAME", "DESCRIPTION", "CONTENT")


@query("h5_tags", "SELECT doc_id, " + ", ".join(f"regexp_replace(regexp_extract(text, '(?s)<{t}>(.*?)</{t}>', 1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS {t.lower()}" for t in TAGS) + " FROM documents WHERE text IS NOT NULL")
def h5(spark, d):
    """The whole text of every document, a column for each tag; empty where the tag is missing."""
    return docs(spark, d).where("text is not null").select("doc_id", *[fn.tag_body("text", t).alias(t.lower()) for t in TAGS])


@query("h6_json_salvage", "SELECT CASE WHEN json_valid(m) THEN 'valid' WHEN m LIKE '%{%}%' AND json_valid(regexp_extract(m, '(?s)(\\{.*\\})', 1)) THEN 'inside' ELSE 'none' END AS state, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN concat('Answer: ', props, ' end') ELSE props END AS m FROM events) GROUP BY 1")
def h6(spark, d):
    m = table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Answer: "), "props", F.lit(" end"))).otherwise(F.col("props")).alias("m"))
    s = fn.salvage_json("m")
    return m.groupBy(F.when(s.isNull(), "none").when(s == F.col("m"), "valid").otherwise("inside").alias("state")).agg(F.count("*").alias("n"))


@query("h7_clamped_weights", "SELECT event_id, least(10, greatest(1, CAST(json_extract_string(props, '$.k') AS BIGINT))) AS weight FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def h7(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").where(k.isNotNull()).select("event_id", F.least(F.lit(10), F.greatest(F.lit(1), k)).cast("bigint").alias("weight"))


@query("h8_log_tf", f"SELECT doc_id, round(CASE WHEN tf > 0 THEN 1 + ln(tf) ELSE 0 END, 6)::DOUBLE AS w FROM (SELECT doc_id, len(list_filter({TOK}, lambda x: x = 'report')) AS tf FROM documents WHERE text IS NOT NULL)")
def h8(spark, d):
    tf = F.size(F.filter(fn.words("text", "[a-z]+"), lambda x: x == "report"))
    return docs(spark, d).where("text is not null").select("doc_id", F.round(fn.log_tf(tf), 6).alias("w"))


@query("h9_human_size", f"SELECT file_id, CASE WHEN size_bytes < 1024 THEN concat(size_bytes, ' B') WHEN size_bytes < 1048576 THEN format('{{:.1f}} KB', round_even(size_bytes / 1024.0::DOUBLE, 1)) ELSE format('{{:.1f}} MB', round_even(size_bytes / 1048576.0::DOUBLE, 1)) END AS size FROM {PATHS}")
def h9(spark, d):
    """Every file, round sizes too; ties go to the even digit."""
    return paths(spark, d).select("file_id", fn.human_size("size_bytes").alias("size"))


@query("h10_head_mid_tail", "SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE concat_ws(chr(10) || '...' || chr(10), substring(text, 1, 400), substring(text, (length(text) // 2) - 100 + 1, 200), right(text, 400)) END AS sample FROM documents WHERE text IS NOT NULL")
def h10(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", fn.head_mid_tail("text", 1000).alias("sample"))


@query("h11_tokens", "SELECT id, array_to_string(list_sort(list_distinct(list_concat(w, flatten(list_transform(list_filter(w, lambda x: regexp_matches(x, '\\p{Han}')), lambda x: list_concat(list_transform(range(1, length(x)), lambda i: substring(x, i, 2)), list_transform(range(1, length(x) - 1), lambda i: substring(x, i, 3)))))))), ' ') AS tokens FROM (SELECT DISTINCT id, query, regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+') AS w FROM search_history WHERE query IS NOT NULL)")
def h11(spark, d):
    """Every query, with the pairs and triples of signs of those in Han."""
    h = table(spark, d, "search_history").select("id", "query").distinct().where("query is not null")
    return h.select("id", F.array_join(F.array_sort(fn.cjk_tokens("query")), " ").alias("tokens"))


@query("h13_preprocess", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s_]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL")
def h13(spark, d):
    """The whole text of every document, in any script."""
    return docs(spark, d).where("text is not null").select("doc_id", fn.preprocess("text", "_").alias("t"))


@query("h14_bigrams", f"SELECT g AS gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i+1]))) AS g FROM (SELECT {TOK} AS t FROM documents WHERE text IS NOT NULL)) GROUP BY 1 HAVING count(*) >= 50")
def h14(spark, d):
    w = docs(spark, d).where("text is not null").select(fn.words("text", "[a-z]+").alias("w"))
    return w.select(F.explode(fn.n_grams(F.col("w"), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 50")


@query("h15_complexity", f"SELECT id, CASE WHEN contains(lower(query),'compare') OR contains(lower(query),'difference') OR contains(lower(query),'versus') OR contains(lower(query),'between') OR contains(lower(query),'trend') OR contains(lower(query),'why') OR length(query) > 120 THEN 'complex' WHEN length(query) > 40 THEN 'moderate' ELSE 'simple' END AS level FROM {SH} WHERE query IS NOT NULL")
def h15(spark, d):
    return history(spark, d).where("query is not null").select("id", fn.complexity("query").alias("level"))


@query("h16_quantity", "SELECT doc_id, round(least(1.0::DOUBLE, coalesce(len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) * 4.0::DOUBLE / nullif(len(w), 0), 0)), 6) AS q FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL)")
def h16(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", fn.quantity("text").alias("q"))


@query("h18_coverage", "SELECT doc_id, round((contains(lower(text),'appeal')::INT + contains(lower(text),'verdict')::INT + contains(lower(text),'report')::INT) / 3.0::DOUBLE, 6) AS c FROM documents WHERE text IS NOT NULL")
def h18(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", fn.coverage("text", ["appeal", "verdict", "report"]).alias("c"))


@query("h19_pages_named", f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(query), '(?:pages?|pp?\\.)\\s*(\\d{{1,3}})', 1), lambda x: x::INT), lambda n: n BETWEEN 1 AND 500))), ',') AS pages FROM (SELECT id, concat(query, ' see page ', results_count) AS query FROM {SH} WHERE query IS NOT NULL AND results_count IS NOT NULL)")
def h19(spark, d):
    h = history(spark, d).where("query is not null and results_count is not null").select("id", F.concat("query", F.lit(" see page "), F.col("results_count").cast("string")).alias("query"))
    return h.select("id", F.array_join(fn.pages_named("query"), ",").alias("pages"))


#: The amounts and shares in the documents, as they are written.
AMOUNT = "[(]?[$€]?[0-9][0-9,]*(?:[.][0-9]+)?(?: ?(?:million|billion|thousand|[%kKmMbB]\\b))?[)]?"


@query("h21_numbers", f"SELECT doc_id, s, round((CASE WHEN regexp_matches(s, '^[(].*[)]$') THEN -1.0 ELSE 1.0 END * try_cast(regexp_extract(regexp_replace(s, '[,$€]', '', 'g'), '[0-9]+(?:[.][0-9]+)?') AS DOUBLE) * CASE WHEN regexp_matches(lower(s), '[0-9 ](?:b|billion)\\b') THEN 1e9 WHEN regexp_matches(lower(s), '[0-9 ](?:m|million)\\b') THEN 1e6 WHEN regexp_matches(lower(s), '[0-9 ](?:k|thousand)\\b') THEN 1e3 WHEN contains(s, '%') THEN 0.01 ELSE 1.0 END)::DOUBLE, 6) AS v FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{AMOUNT}'))) AS s FROM documents WHERE text IS NOT NULL)")
def h21(spark, d):
    """Every number of every text, with its value."""
    s = docs(spark, d).where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(AMOUNT), F.lit(0)))).alias("s"))
    return s.select("doc_id", "s", F.round(fn.number_of("s"), 6).alias("v"))


@query("h22_plain_answers", "SELECT item_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, '[*_`\"'']', '', 'g'), '(?i)^\\s*(?:answer|final answer)\\s*:\\s*', ''), '[$€£,]', '', 'g'), '(\\d+\\.\\d*?)0+\\b', '\\1', 'g'))) AS a FROM eval_items")
def h22(spark, d):
    return table(spark, d, "eval_items").select("item_id", fn.plain_answer("answer").alias("a"))


@query("h27_safe_names", f"SELECT file_id, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM {PATHS}")
def h27(spark, d):
    return paths(spark, d).select("file_id", fn.safe_name("name").alias("safe"))


@query("h28_token_estimate", "SELECT doc_id, greatest(1, floor(length(text) / 3.5::DOUBLE))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def h28(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", fn.token_estimate("text").alias("tokens"))


@query("h29_timestamps", "SELECT doc_id, floor(epoch(created_at))::BIGINT AS seconds, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso FROM documents WHERE created_at IS NOT NULL")
def h29(spark, d):
    t = F.col("created_at").cast("timestamp")
    return docs(spark, d).where("created_at is not null").select("doc_id", F.unix_timestamp(t).alias("seconds"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("h30_vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS norm FROM embeddings")
def h30(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(fn.dot("embedding", "embedding")), 4).alias("norm"))


@query("h31_listing", f"SELECT id, concat('[', id, '] ', name, ': ', left(coalesce(description, ''), 200)) AS line FROM {KC} WHERE name IS NOT NULL")
def h31(spark, d):
    return clusters(spark, d).where("name is not null").select("id", F.concat(F.lit("["), "id", F.lit("] "), "name", F.lit(": "), F.substring(F.coalesce("description", F.lit("")), 1, 200)).alias("line"))


@query("i1_line_score", f"SELECT doc_id, line_number, round((0.0 + 2.0 * (n / (n + 1)) * CASE WHEN regexp_matches(l, '\\breport\\b') THEN 2.0 ELSE 1.0 END * 1.0) / (length(line) / 100.0::DOUBLE + 1), 6)::DOUBLE AS score FROM (SELECT *, lower(line) AS l, (length(line) - length(replace(lower(line), 'report', ''))) / 6.0::DOUBLE AS n FROM {LINES} WHERE contains(lower(line), 'report'))")
def i1(spark, d):
    rows = doc_lines(spark, d).where(F.contains(F.lower("line"), F.lit("report")))
    return rows.select("doc_id", "line_number", ranking.line_score("line", {"report": 2.0}).alias("score"))


@query("i2_name_score", f"SELECT file_id, CASE WHEN name = 'Local' THEN 1.0 WHEN lower(name) = 'local' THEN 0.9 WHEN starts_with(name, 'Local') THEN 0.8 WHEN starts_with(lower(name), 'local') THEN 0.75 WHEN contains(name, 'Local') THEN 0.6 WHEN contains(lower(name), 'local') THEN 0.55 ELSE round(0.3::DOUBLE + 0.2::DOUBLE * least(1.0::DOUBLE, 5.0::DOUBLE / greatest(length(name), 1)), 6) END::DOUBLE AS score FROM {PATHS}")
def i2(spark, d):
    return paths(spark, d).select("file_id", fn.name_score("name", "Local").alias("score"))


@query("i5_topic_relevance", f"SELECT id, least(10.0::DOUBLE, 5.0::DOUBLE * (contains(lower(name), 'treaty')::INT + contains(lower(content), 'treaty')::INT) / 2 + CASE WHEN length(coalesce(description, '')) > 200 THEN 2.0 WHEN length(coalesce(description, '')) > 50 THEN 1.5 ELSE 1.0 END)::DOUBLE AS score FROM {KC} WHERE name IS NOT NULL AND content IS NOT NULL")
def i5(spark, d):
    n = F.length(F.coalesce("description", F.lit("")))
    hit = F.contains(F.lower("name"), F.lit("treaty")).cast("int") + F.contains(F.lower("content"), F.lit("treaty")).cast("int")
    return clusters(spark, d).where("name is not null and content is not null").select("id", F.least(F.lit(10.0), F.lit(5.0) * hit / 2 + F.when(n > 200, 2.0).when(n > 50, 1.5).otherwise(1.0)).alias("score"))


BM = f"(WITH t AS (SELECT doc_id, {TOK} AS w FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, len(w)::DOUBLE AS n, len(list_filter(w, lambda x: x = 'appeal'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'tribunal'))::DOUBLE AS b FROM t), s AS (SELECT count(*)::DOUBLE AS total_docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0)::DOUBLE AS da, count(*) FILTER (WHERE b > 0)::DOUBLE AS db FROM r) SELECT doc_id, round(2 * ln((s.total_docs - da + 0.5) / (da + 0.5) + 1) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * n / mean)) + ln((s.total_docs - db + 0.5) / (db + 0.5) + 1) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * n / mean)), 6)::DOUBLE AS score FROM r, s WHERE a + b > 0)"


@query("i6_bm25", f"SELECT doc_id, score FROM {BM}")
def i6(spark, d):
    """A repeated query token counts twice."""
    return ranking.bm25(docs(spark, d), "doc_id", "text", ["appeal", "tribunal", "appeal"])


@query("i7_fusion", f"WITH c AS (SELECT doc_id, score AS b, n_chars::DOUBLE AS e FROM {BM} JOIN documents USING (doc_id)), s AS (SELECT avg(b) mb, stddev_pop(b) sb, avg(e) me, stddev_pop(e) se FROM c) SELECT doc_id, round(1 / (1 + exp(-(0.6 * coalesce((b - mb) / sb, -3) + 0.4 * coalesce((e - me) / se, -3)))), 4)::DOUBLE AS score FROM c, s")
def i7(spark, d):
    """Both channels come from one reading of the texts."""
    both = ranking.bm25(docs(spark, d), "doc_id", "text", ["appeal", "tribunal", "appeal"], keep=("n_chars",))
    both = both.select("doc_id", F.col("score").alias("b"), F.col("n_chars").cast("double").alias("e"))
    return ranking.fuse(both, "doc_id", {"b": 0.6, "e": 0.4}).select("doc_id", F.round("score", 4).alias("score"))


CATALOG = "(SELECT d.doc_id, min(m.name) AS name, min(left(d.text, 200)) AS summary FROM documents d JOIN (SELECT DISTINCT file_id, name FROM upload_manifest) m USING (file_id) WHERE d.text IS NOT NULL GROUP BY 1)"
TREES = "(SELECT DISTINCT doc_id FROM documents WHERE file_id IN (SELECT file_id FROM tree_nodes))"


def catalog(spark, d):
    """(doc_id, name, summary) of the documents that have a file."""
    m = table(spark, d, "upload_manifest").select("file_id", "name").distinct()
    return docs(spark, d).where("text is not null").join(m, "file_id").groupBy("doc_id").agg(F.min("name").alias("name"), F.min(F.substring("text", 1, 200)).alias("summary"))


def trees(spark, d):
    return docs(spark, d).join(table(spark, d, "tree_nodes").select("file_id").distinct(), "file_id", "left_semi").select("doc_id").distinct()


def _held(word: str) -> str:
    return f"len(list_filter(string_split(lower(text), chr(10)), lambda x: contains(x, '{word}')))"


@query(
    "i3_file_ranking",
    f"WITH f AS (SELECT doc_id, source, {_held('appeal')} AS a, {_held('report')} AS b FROM documents WHERE text IS NOT NULL),"
    " s AS (SELECT doc_id, source, CASE WHEN a > 0 THEN 1 + ln(a) ELSE 0 END + CASE WHEN b > 0 THEN 1 + ln(b) ELSE 0 END AS s0 FROM f WHERE a + b > 0),"
    f" c AS (SELECT *, lower(concat(summary, ' ', name)) AS low FROM {CATALOG}),"
    " w AS (SELECT *, regexp_extract_all(low, '[\\p{L}\\p{N}]+') AS t, contains(low, 'appeal report')::INT AS whole FROM c),"
    " k AS (SELECT doc_id, 5.0 * ((CASE WHEN list_contains(t, 'appeal') THEN 1 WHEN contains(low, 'appeal') THEN 0.5 ELSE 0 END) + (CASE WHEN list_contains(t, 'report') THEN 1 WHEN contains(low, 'report') THEN 0.5 ELSE 0 END) + whole) / (2 + whole) + CASE WHEN length(summary) > 100 THEN 2.0 WHEN length(summary) > 30 THEN 1.5 WHEN length(summary) > 0 THEN 1 ELSE 0 END AS topic FROM w),"
    f" j AS (SELECT s.doc_id, 0.85 * s0 / max(s0) OVER () * 10 + 0.15 * least(10, coalesce(topic, 0) + CASE WHEN s.doc_id IN (SELECT doc_id FROM {TREES}) THEN 0.5 ELSE 0 END) + CASE WHEN source = 'filings-archive' THEN 3 ELSE 0 END AS score FROM s LEFT JOIN k USING (doc_id)),"
    " t AS (SELECT doc_id, round(score, 6)::DOUBLE AS score FROM j ORDER BY 2 DESC, 1 LIMIT 50),"
    " g AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r, max(score) OVER () AS top, CASE WHEN score < 0.5 * lag(score) OVER (ORDER BY score DESC, doc_id) THEN 1 ELSE 0 END AS cut FROM t),"
    " q AS (SELECT *, sum(cut) OVER (ORDER BY r) AS cuts FROM g) SELECT doc_id, score FROM q WHERE r = 1 OR (score >= 0.3 * top AND cuts = 0)",
)
def i3(spark, d):
    """Lines that hold the keywords, blended with the catalogue, lifted where a tree search chose the file, and pruned."""
    probed = docs(spark, d).where("source = 'filings-archive'").select("doc_id")
    return ranking.rank_files(docs(spark, d), "doc_id", "text", ["appeal", "report"], 50, query="appeal report", catalog=catalog(spark, d), trees=trees(spark, d), probed=probed)


#: A query as a user would put it: two words of names, one of which is only begun in some, and a year.
ASKED = "Which treaty and court of 2001?"
OVERLAP = "CASE WHEN contains({0}, 'treaty') THEN 2.0 WHEN contains({0}, 'trea') THEN 0.5 ELSE 0 END + CASE WHEN contains({0}, 'court') THEN 2.0 WHEN contains({0}, 'cour') THEN 0.5 ELSE 0 END + CASE WHEN contains({0}, '2001') THEN 3.0 ELSE 0 END"


@query("i8_tree_prefilter", f"SELECT file_id, score::DOUBLE AS score FROM (SELECT file_id, {OVERLAP.format('stem')} AS score FROM (SELECT file_id, regexp_replace(lower(name), '\\.[^.]+$', '') AS stem FROM {PATHS})) WHERE score >= 0.5")
def i8(spark, d):
    return paths(spark, d).select("file_id", ranking.name_overlap("name", ASKED).alias("score")).where("score >= 0.5")


#: Asked of every document: a question for a number, with words that some of them hold.
QUESTION = "What total revenue did the annual report name?"


@query("i12_evidence_acceptance", "SELECT doc_id, CASE WHEN doc_kind = 'qa' THEN 'complete' WHEN source = 'filings-archive' THEN 'judged' WHEN length(text) >= 800 AND (contains(l, 'total')::INT + contains(l, 'revenue')::INT + contains(l, 'annual')::INT + contains(l, 'report')::INT + contains(l, 'name')::INT) / 5.0 >= 0.3 THEN 'coverage' WHEN regexp_matches(text, '[$€£]\\s?[0-9]|(?:^|[^\\p{L}\\p{N}_])[0-9][0-9,.]*\\s?%|(?:^|[^\\p{L}\\p{N}_])[0-9]{1,3}(?:,[0-9]{3})+') THEN 'numeric' ELSE 'reject' END AS reason FROM (SELECT *, lower(text) AS l FROM documents WHERE text IS NOT NULL)")
def i12(spark, d):
    """Every document as evidence; two columns stand for what retrieval and a judge said."""
    reason = ranking.acceptance(F.lit(QUESTION), "text", F.col("doc_kind") == "qa", F.col("source") == "filings-archive")
    return docs(spark, d).where("text is not null").select("doc_id", reason.alias("reason"))


@query("c12_vector_search", "SELECT vec_id, cos FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS cos FROM embeddings ORDER BY cos DESC, vec_id LIMIT 10) WHERE cos >= 0.5")
def c12(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id = 7").select("embedding").first()[0]
    return ranking.nearest(v, "vec_id", "embedding", list(q), 10, 0.5)


@query("i17_reuse_ladder", "SELECT CASE WHEN c >= 0.85 THEN 'hard' WHEN c >= 0.65 THEN 'soft' WHEN c >= 0.5 THEN 'fallback' ELSE 'none' END AS tier, count(*) AS n FROM (SELECT round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS c FROM embeddings) GROUP BY 1")
def i17(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id = 7").select("embedding").first()[0]
    c = F.round(fn.cosine("embedding", F.array(*[F.lit(float(x)) for x in q])), 6)
    return v.groupBy(F.when(c >= 0.85, "hard").when(c >= 0.65, "soft").when(c >= 0.5, "fallback").otherwise("none").alias("tier")).agg(F.count("*").alias("n"))


@query("i19_generic_summary", "SELECT DISTINCT file_id, node_id, length(coalesce(summary, '')) < 80 AS generic FROM tree_nodes")
def i19(spark, d):
    return table(spark, d, "tree_nodes").select("file_id", "node_id", (F.length(F.coalesce("summary", F.lit(""))) < 80).alias("generic")).distinct()


@query("i20_structured", "SELECT doc_id, len(regexp_extract_all(text, '(?m)^\\|')) >= 2 AS has_table, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 6) AS digits FROM documents WHERE text IS NOT NULL")
def i20(spark, d):
    t = F.col("text")
    return docs(spark, d).where("text is not null").select("doc_id", (F.regexp_count(t, F.lit(r"(?m)^\|")) >= 2).alias("has_table"), F.round(F.length(F.regexp_replace(t, "[^0-9]", "")) / F.greatest(F.length(t), F.lit(1)), 6).alias("digits"))


@query("j1_roi_windows")
def j1(spark, d):
    """Windows drawn at random by key: no SQL gives the same draws."""
    return ranking.roi_windows(docs(spark, d), "doc_id", "text", ["appeal", "report", "turbine"], whole=2000, least=3.0)


@query("j5_window_read", "SELECT doc_id, substring(text, greatest(0, least(300, length(text) - 500)) + 1, 500) AS part FROM documents WHERE text IS NOT NULL")
def j5(spark, d):
    s = F.greatest(F.lit(0), F.least(F.lit(300), F.length("text") - 500))
    return docs(spark, d).where("text is not null").select("doc_id", F.call_function("substring", F.col("text"), s + 1, F.lit(500)).alias("part"))


@query("j6_windows", "SELECT doc_id, start, md5(substring(text, start + 1, 500)) AS h FROM (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 500) + 1, 250)) AS start FROM documents WHERE length(text) > 0)")
def j6(spark, d):
    return ranking.text_windows(docs(spark, d), "doc_id", "text").select("doc_id", "start", F.md5("content").alias("h"))


@query("j7_importance", f"SELECT file_id, round(log2(greatest(size_bytes, 1024)) / 20 * CASE WHEN extension IN ('pdf','docx','tex') THEN 1.5 ELSE 1 END, 6)::DOUBLE AS score FROM {PATHS}")
def j7(spark, d):
    s = F.log2(F.greatest("size_bytes", F.lit(1024))) / 20 * F.when(F.col("extension").isin("pdf", "docx", "tex"), 1.5).otherwise(1.0)
    return paths(spark, d).select("file_id", F.round(s, 6).alias("score"))


@query("j7_weighted_sample")
def j7s(spark, d):
    s = F.log2(F.greatest("size_bytes", F.lit(1024))) / 20
    return ranking.weighted_sample(paths(spark, d), "file_id", s, 100).select("file_id")


@query("j8_stratified", f"SELECT file_id, folder FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY size_bytes DESC, file_id) AS r, count(*) OVER (PARTITION BY folder) AS c, count(*) OVER () AS t FROM {PATHS}) WHERE r <= greatest(1, (c * 60) // t)")
def j8(spark, d):
    return ranking.stratified_share(paths(spark, d), "folder", [F.desc("size_bytes"), F.col("file_id")], 60).select("file_id", "folder")


@query("j11_interval_pages", "SELECT DISTINCT file_id, CAST(page_number AS BIGINT) AS page_number, left(content, 150) AS snippet FROM page_contents p WHERE (page_number - 1) % 10 = 0 OR page_number = (SELECT max(page_number) FROM page_contents q WHERE q.file_id = p.file_id)")
def j11(spark, d):
    """Every tenth page and the last one of each file."""
    p = table(spark, d, "page_contents").select("file_id", F.col("page_number").cast("bigint").alias("page_number"), F.substring("content", 1, 150).alias("snippet"))
    last = p.groupBy("file_id").agg(F.max("page_number").alias("page_number"))
    return p.where("(page_number - 1) % 10 = 0").union(p.join(last, ["file_id", "page_number"])).distinct()


@query("u12_chunks", "SELECT doc_id, i, md5(substring(text, i * 2000 + 1, 2000)) AS h FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 2000 + 1)) AS i FROM documents WHERE length(text) > 0)")
def u12(spark, d):
    i = F.explode(F.sequence(F.lit(0), F.expr("cast((length(text) - 1) div 2000 as int)"))).alias("i")
    return docs(spark, d).where(F.length("text") > 0).select("doc_id", "text", i).select("doc_id", F.col("i").cast("bigint").alias("i"), F.md5(F.call_function("substring", F.col("text"), F.col("i") * 2000 + 1, F.lit(2000))).alias("h"))
