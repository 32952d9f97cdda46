"""Queries on the search entry point, the store, file formats and their round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import text as fn
from ..operators import clusters as cl
from ..operators import joins, policies, ranking
from ..sources import catalog, files, tables
from ..sources.tables import table
from .more import NORM, NUM, PREDICTED, in_folder
from .registry import query
from .relations import SH, TN, clusters, history, nodes
from .search import LINES, PATHS, docs, paths
from .texts import _held, trees
from .texts import catalog as summaries

ASKED = "What does the appeal report?"


def names(spark, d):
    m = table(spark, d, "upload_manifest").select("file_id", "name").distinct()
    return docs(spark, d).join(m, "file_id").select("doc_id", "name").distinct()


@query(
    "v6_search_fast",
    f"WITH f AS (SELECT doc_id, text, {_held('appeal')} AS a, {_held('report')} AS b FROM documents WHERE text IS NOT NULL),"
    " s AS (SELECT *, round(CASE WHEN a > 0 THEN 1 + ln(a) ELSE 0 END + CASE WHEN b > 0 THEN 1 + ln(b) ELSE 0 END, 6)::DOUBLE AS score FROM f WHERE a + b > 0 ORDER BY score DESC, doc_id LIMIT 5),"
    " g AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, max(score) OVER () AS top, CASE WHEN score < 0.5 * lag(score) OVER (ORDER BY score DESC, doc_id) THEN 1 ELSE 0 END AS cut FROM s),"
    " q AS (SELECT * FROM (SELECT *, sum(cut) OVER (ORDER BY place) AS cuts FROM g) WHERE place = 1 OR (score >= 0.3 * top AND cuts = 0)),"
    " l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM q),"
    " h AS (SELECT doc_id, n FROM l WHERE contains(lower(line), 'appeal') OR contains(lower(line), 'report')),"
    " r AS (SELECT doc_id, CASE WHEN count(*) <= 2 THEN 100 ELSE 30 END AS far FROM h GROUP BY 1),"
    " k AS (SELECT l.*, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM l JOIN r USING (doc_id) WHERE EXISTS (SELECT 1 FROM h WHERE h.doc_id = l.doc_id AND abs(h.n - l.n) <= far)),"
    " e AS (SELECT doc_id, left(string_agg(CASE WHEN prev IS NULL THEN line WHEN prev = n - 1 THEN concat(chr(10), line) ELSE concat(chr(10), '...', chr(10), line) END, '' ORDER BY n), 40000) AS evidence FROM k GROUP BY 1)"
    " SELECT doc_id, place, score, 'keywords' AS source, evidence, CASE WHEN length(evidence) >= 800 AND (contains(lower(evidence), 'appeal') OR contains(lower(evidence), 'report')) THEN 'coverage' ELSE 'reject' END AS reason FROM q JOIN e USING (doc_id)",
)
def v6(spark, d):
    return Engine(spark, docs(spark, d)).search(ASKED, "FAST")


@query(
    "v6_search_names",
    f"SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, score, 'name' AS source, name AS evidence, 'name' AS reason FROM (SELECT DISTINCT doc_id, name, round(0.3::DOUBLE + 0.2::DOUBLE * least(1.0::DOUBLE, 11.0::DOUBLE / greatest(length(name), 1)), 6) + CASE WHEN contains(s, 'local') THEN 2 WHEN contains(s, 'loca') THEN 0.5 ELSE 0 END + CASE WHEN contains(s, 'court') THEN 2 WHEN contains(s, 'cour') THEN 0.5 ELSE 0 END AS score FROM (SELECT d.doc_id, m.name, regexp_replace(lower(m.name), '\\.[^.]+$', '') AS s FROM documents d JOIN (SELECT DISTINCT file_id, name FROM upload_manifest) m USING (file_id)) WHERE contains(lower(name), 'local') OR contains(lower(name), 'court') ORDER BY score DESC, name, doc_id LIMIT 5)",
)
def v6n(spark, d):
    return Engine(spark, docs(spark, d), names=names(spark, d)).search("local court", "FILENAME_ONLY")


@query("v6_search_deep")
def v6d(spark, d):
    """Several sources, windows sampled: no SQL gives the same draws."""
    return Engine(spark, docs(spark, d), names=names(spark, d), catalog=summaries(spark, d), trees=trees(spark, d)).search(ASKED, "DEEP")


ROOTS = f"(SELECT DISTINCT p.file_id, p.name FROM {PATHS} p WHERE p.file_id IN (SELECT file_id FROM tree_nodes))"


@query(
    "i24_document_selection",
    f"WITH r AS (SELECT file_id, CASE WHEN contains(s, 'treaty') THEN 2.0 WHEN contains(s, 'trea') THEN 0.5 ELSE 0 END + CASE WHEN contains(s, 'court') THEN 2.0 WHEN contains(s, 'cour') THEN 0.5 ELSE 0 END + CASE WHEN contains(s, '2001') THEN 3.0 ELSE 0 END AS score FROM (SELECT file_id, regexp_replace(lower(name), '\\.[^.]+$', '') AS s FROM {ROOTS})), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE score >= 0.5) AS g FROM r)"
    " SELECT file_id FROM (SELECT file_id FROM r, c WHERE n <= 15 OR g = 0 OR score >= 0.5 ORDER BY CASE WHEN n > 15 THEN -score ELSE 0 END, file_id LIMIT 3)",
)
def i24(spark, d):
    """The documents with a tree whose names a query asks for."""
    roots = paths(spark, d).join(table(spark, d, "tree_nodes").select("file_id").distinct(), "file_id", "left_semi").select("file_id", "name").distinct()
    return ranking.select_documents(roots, "file_id", "name", "Which treaty and court of 2001?")


@query("u20_keyword_paths", f"SELECT doc_id, count(DISTINCT line_number) AS hits FROM {LINES} WHERE contains(lower(line), 'appeal') OR contains(lower(line), 'turbine') GROUP BY 1")
def u20(spark, d):
    return Engine(spark, docs(spark, d)).paths(["Appeal", "turbine"])


@query("u6_directory_ranking", f"SELECT file_id, folder, CASE WHEN contains(lower(name), 'court') OR contains(lower(name), 'treaty') THEN 'high' ELSE 'medium' END AS relevance FROM {PATHS} WHERE contains(lower(name), 'co') OR contains(lower(name), 'tr')")
def u6(spark, d):
    """A directory scan's files by their names' relevance, those of none left out."""
    own = paths(spark, d).select("file_id", "folder", ranking.relevance_tier("name", ["court", "treaty"]).alias("relevance"))
    return own.where("relevance != 'low'")


@query("u5_tree_tool", f"SELECT file_id, node_id, score, route FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, node_id) AS r FROM (SELECT file_id, node_id, 2 * contains(lower(coalesce(title, '')), 'profit')::BIGINT + contains(lower(coalesce(summary, '')), 'profit')::BIGINT AS score, CASE WHEN content_type = 'table' OR table_count > 0 THEN 'pages' WHEN a IS NULL OR b <= a OR b - a < 200 THEN 'summary' ELSE 'chars' END AS route FROM {TN}) WHERE score > 0) WHERE r <= 5")
def u5(spark, d):
    """The nodes that a query leads to, and how to read each."""
    from ..operators import structure

    n = nodes(spark, d)
    route = F.when((F.col("content_type") == "table") | (F.col("table_count") > 0), "pages").when(F.col("a").isNull() | (F.col("b") <= F.col("a")) | (F.col("b") - F.col("a") < 200), "summary").otherwise("chars")
    found = structure.navigate(n, "file_id", "node_id", ["profit"], 5).drop("r")
    return found.join(n.select("file_id", "node_id", route.alias("route")), ["file_id", "node_id"])


@query("u13_query_rewrite", f"SELECT id, CASE WHEN prev IS NOT NULL AND len(list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9]{{2,}}'), lambda w: NOT list_contains({list(ranking.STOP_WORDS)}, w)))) < 3 THEN concat(prev, ' ', query) ELSE query END AS rewritten FROM (SELECT id, query, lag(query) OVER (PARTITION BY kb_name ORDER BY created_at, id) AS prev FROM {SH} WHERE trim(query) <> '' AND created_at IS NOT NULL)")
def u13(spark, d):
    """A search of fewer than three telling words is joined to the one before it."""
    from pyspark.sql import Window

    h = history(spark, d).where("trim(query) != '' and created_at is not null").withColumn("prev", F.lag("query").over(Window.partitionBy("kb_name").orderBy("created_at", "id")))
    own = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda w: ~w.isin(*ranking.STOP_WORDS)))
    return h.select("id", F.when(F.col("prev").isNotNull() & (F.size(own) < 3), F.concat_ws(" ", "prev", "query")).otherwise(F.col("query")).alias("rewritten"))


@query("u18_key_phrases", "SELECT doc_id, phrase, times FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, phrase) AS r FROM (SELECT doc_id, phrase, count(*) AS times FROM (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) AS phrase FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE text IS NOT NULL)) GROUP BY 1, 2 HAVING count(*) >= 2)) WHERE r <= 5")
def u18(spark, d):
    return ranking.key_phrases(docs(spark, d), "doc_id", "text")


@query("f6_reusable", "SELECT vec_id, cos FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS cos FROM embeddings ORDER BY cos DESC, vec_id LIMIT 3) WHERE cos >= 0.85")
def f6(spark, d):
    """The nearest three, of those the ones near enough to be reused."""
    v = table(spark, d, "embeddings")
    return ranking.nearest(v, "vec_id", "embedding", list(v.where("vec_id = 7").select("embedding").first()[0]), 3, 0.85)


@query("f7_nearest_to_mean", "WITH c AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 3) GROUP BY 1)) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 5) AS cos FROM embeddings, c ORDER BY cos DESC, vec_id LIMIT 20")
def f7(spark, d):
    """The rows most like a group's mean."""
    v = table(spark, d, "embeddings")
    mean = v.where("label = 3").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("i").collect()  # one row a dimension
    best = v.select("vec_id", F.round(fn.cosine("embedding", F.array(*[F.lit(r["x"]) for r in mean])), 5).alias("cos"))
    return best.orderBy(F.desc("cos"), "vec_id").limit(20)


@query("m15_primary_files", "SELECT id, min(CASE WHEN json_valid(evidences) THEN array_to_string(list_sort(list_distinct(json_extract_string(evidences, '$[*].doc_id'))), ',') END) AS files FROM knowledge_clusters GROUP BY 1")
def m15(spark, d):
    k = table(spark, d, "knowledge_clusters").groupBy("id").agg(F.min(F.array_join(cl.primary_files(), ",")).alias("files"))
    return k


@query("m15_conflict_groups", "SELECT file, count(*) AS members FROM (SELECT DISTINCT id, unnest(json_extract_string(evidences, '$[*].doc_id')) AS file FROM knowledge_clusters WHERE json_valid(evidences)) WHERE file IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def m15c(spark, d):
    """Files that several clusters rest on."""
    k = table(spark, d, "knowledge_clusters").select("id", cl.primary_files().alias("files")).distinct()
    return cl.conflict_groups(k, "id", "files")


@query("v12_benchmark", f"WITH e AS (SELECT item_id, question_type, answer, {PREDICTED} AS p FROM eval_items), n AS (SELECT question_type, {NORM.format('p')} AS a, {NORM.format('answer')} AS b, {NUM.format('p')} AS x, {NUM.format('answer')} AS y, p FROM e), v AS (SELECT question_type, CASE WHEN p IS NULL OR length(trim(p)) < 1 OR contains(lower(left(p, 500)), 'cannot answer') OR contains(lower(left(p, 500)), 'not available') OR contains(lower(left(p, 500)), 'no information') OR contains(lower(left(p, 500)), 'unable to') OR contains(lower(left(p, 500)), 'n/a') THEN 'refused' WHEN a = b THEN 'exact' WHEN CASE WHEN abs(x) < 10 AND abs(y) < 10 THEN abs(x - y) <= 0.3 ELSE abs(x - y) <= 0.02 * greatest(abs(x), abs(y)) END THEN 'numeric' WHEN x IS NOT NULL AND y IS NOT NULL THEN 'wrong' ELSE 'undecided' END AS v FROM n) SELECT question_type, count(*) AS n, count(*) FILTER (WHERE v IN ('exact', 'numeric')) AS correct, count(*) FILTER (WHERE v = 'refused') AS refused, count(*) FILTER (WHERE v = 'undecided') AS undecided, round(avg((v IN ('exact', 'numeric'))::INT), 6) AS accuracy FROM v GROUP BY 1")
def v12(spark, d):
    """A batch of answers judged, by type of question."""
    e = table(spark, d, "eval_items").withColumn("predicted", F.expr(PREDICTED.replace("length(answer) // 2", "cast(length(answer) div 2 as int)")))
    return policies.benchmark(e, "item_id", "answer", "predicted", "question_type")


@query("v13_report")
def v13(spark, d):
    """The same as lines of text."""
    return policies.report(v12(spark, d), "question_type")


@query("a5_csv_round_trip", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def a5(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_acctbal", "c_mktsegment")

    def make(folder):
        tables.write_csv(c, folder, ";")
        return tables.read_csv(spark, folder, c.schema, ";")

    return in_folder(spark, make)


@query("a6_versions", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, 2::BIGINT AS version FROM nation WHERE n_regionkey > 1 UNION ALL SELECT n_nationkey::BIGINT, n_name, 1 FROM nation")
def a6(spark, d):
    """Each version of a replaced table stays readable for a stated time."""
    n = table(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("bigint"))

    def make(folder):
        store = tables.VersionedTable(spark, folder)
        first = store.write(n.select("n_nationkey", "n_name"))
        second = store.write(n.where("n_regionkey > 1").select("n_nationkey", "n_name"))
        return store.read(first).withColumn("version", F.lit(1).cast("bigint")).union(store.read(second).withColumn("version", F.lit(2).cast("bigint")))

    return in_folder(spark, make)


def _store(spark, d, folder, *own):
    store = catalog.Store(spark, folder)
    with store.transaction():
        for name in own:
            store.create(name, table(spark, d, name).schema)
            store.insert(name, table(spark, d, name))
    return store


@query("a7_store_load", "SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")
def a7(spark, d):
    """All tables of a store, loaded in one commit."""

    def make(folder):
        store = _store(spark, d, folder, "nation", "region", "supplier")
        out = None
        for name in store.tables():
            one = store.read(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
            out = one if out is None else out.union(one)
        return out

    return in_folder(spark, make)


@query("a8_backup_restore", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def a8(spark, d):
    """A store backed up, emptied and restored."""

    def make(folder):
        store = _store(spark, d, f"{folder}/a", "region", "nation")
        store.backup(f"{folder}/b")
        store.drop("region")
        store.delete("nation", "true")
        store.restore(f"{folder}/b")
        return store.read("region").withColumn("r_regionkey", F.col("r_regionkey").cast("bigint"))

    return in_folder(spark, make)


@query("a9_reload", "SELECT r_regionkey::BIGINT AS r_regionkey, concat(r_name, '!') AS r_name, true AS changed FROM region")
def a9(spark, d):
    """A reader that holds a version sees that another writer committed, and reads again."""

    def make(folder):
        store = _store(spark, d, folder, "region")
        held = store.version()
        catalog.Store(spark, folder).update("region", {"r_name": "concat(r_name, '!')"}, "true")
        return store.read("region").withColumns({"r_regionkey": F.col("r_regionkey").cast("bigint"), "changed": F.lit(store.changed(held))})

    return in_folder(spark, make)


@query("a16_metadata_round_trip", f"SELECT path, name, extension, size_bytes FROM {PATHS}")
def a16(spark, d):
    """Metadata saved as JSON lines in two parts and loaded with declared types."""
    p = paths(spark, d).select("path", "name", "extension", "size_bytes")

    def make(folder):
        files.save_metadata(p.where("size_bytes % 2 = 0"), folder)
        files.save_metadata(p.where("size_bytes % 2 != 0"), folder)
        return files.load_metadata(spark, folder, p.schema)

    return in_folder(spark, make)


@query("a22_html_text", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0))")
def a22(spark, d):
    """Every text as an HTML page, and the page's text again."""
    own = docs(spark, d).where(F.col("text").isNotNull() & ~F.contains(F.col("text"), F.lit("\x00"))).select(F.concat(F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), F.encode(files.as_html("text"), "utf-8").alias("content"))
    return files.extract(own).select(F.substring_index("path", ".", 1).cast("bigint").alias("doc_id"), "text")


@query("a21_image_sizes", "SELECT p_partkey, 'png' AS kind, p_size::BIGINT AS width, p_size::BIGINT + 7 AS height FROM part")
def a21(spark, d):
    """Pictures' sizes from their first bytes; here each part's size as the head of a PNG file."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("w"))
    word = lambda c: F.lpad(F.hex(c), 8, "0")
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word(F.col("w")), word(F.col("w") + 7)))
    own = files.extract(p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), head.alias("content")))
    return own.select(F.substring_index("path", ".", 1).cast("bigint").alias("p_partkey"), "kind", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"))


#: A PDF file of two pages with a title, and an outline of two levels; {0} is the title.
PDF = (
    "concat('%PDF-1.4', chr(10), '1 0 obj << /Type /Catalog /Pages 2 0 R /Outlines 5 0 R >> endobj', chr(10), '2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >> endobj', chr(10),"
    " '3 0 obj << /Type /Page /Parent 2 0 R >> endobj', chr(10), '4 0 obj << /Type /Page /Parent 2 0 R >> endobj', chr(10), '5 0 obj << /First 6 0 R >> endobj', chr(10),"
    " '6 0 obj << /Title (', n_name, ') /Dest [3 0 R /Fit] /First 7 0 R >> endobj', chr(10), '7 0 obj << /Title (Region ', n_regionkey, ') /Dest [4 0 R /Fit] >> endobj', chr(10),"
    " '8 0 obj << /Title (', n_name, ') /Author (N', n_nationkey, ') >> endobj', chr(10), 'trailer << /Root 1 0 R /Info 8 0 R >>', chr(10), 'startxref', chr(10), '0')"
)


def nation_pdfs(spark, d):
    return files.extract(table(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".pdf")).alias("path"), F.encode(F.expr(PDF), "utf-8").alias("content")))


@query("k6_pdf_outlines", "SELECT n_nationkey::BIGINT AS n_nationkey, 1::BIGINT AS level, n_name AS title, 1::BIGINT AS page FROM nation UNION ALL SELECT n_nationkey::BIGINT, 2, concat('Region ', n_regionkey), 2 FROM nation")
def k6(spark, d):
    h = nation_pdfs(spark, d).select(F.substring_index("path", ".", 1).cast("bigint").alias("n_nationkey"), F.explode("headings").alias("h"))
    return h.select("n_nationkey", F.col("h.level").cast("bigint").alias("level"), "h.title", F.col("h.part").cast("bigint").alias("page"))


@query("a25_pdf_metadata", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS title, concat('N', n_nationkey) AS author, 2::BIGINT AS n_parts FROM nation")
def a25(spark, d):
    return nation_pdfs(spark, d).select(F.substring_index("path", ".", 1).cast("bigint").alias("n_nationkey"), "title", "author", F.col("n_parts").cast("bigint").alias("n_parts"))


@query("b24_search_schema", "SELECT table_name, CAST(NULL AS VARCHAR) AS column_name FROM (VALUES ('nation'), ('region'), ('supplier')) t(table_name) WHERE contains(table_name, 'nation') UNION ALL SELECT * FROM (VALUES ('nation', 'n_nationkey'), ('supplier', 's_nationkey')) t(a, b)")
def b24(spark, d):
    return in_folder(spark, lambda folder: _store(spark, d, folder, "nation", "region", "supplier").search("NATION"))


@query("v1_describe", "SELECT table_name, column_name, position::BIGINT AS position FROM (VALUES ('nation', 'n_nationkey', 0), ('nation', 'n_name', 1), ('nation', 'n_regionkey', 2)) t(table_name, column_name, position)")
def v1(spark, d):
    """Tables made, dropped and made again."""

    def make(folder):
        store = _store(spark, d, folder, "nation", "region")
        store.drop("nation")
        store.create("nation", table(spark, d, "nation").schema)
        store.drop("region")
        return store.describe().select("table_name", "column_name", F.col("position").cast("bigint").alias("position"))

    return in_folder(spark, make)


@query("v2_insert", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def v2(spark, d):
    """Rows given as one dict, a list of dicts, a pandas frame and a frame."""

    def make(folder):
        n = table(spark, d, "nation")
        store = catalog.Store(spark, folder)
        store.create("nation", n.schema)
        rows = [r.asDict() for r in n.orderBy("n_nationkey").limit(6).collect()]
        store.insert("nation", rows[0])
        store.insert("nation", rows[1:4])
        store.insert("nation", n.where(F.col("n_nationkey").isin([r["n_nationkey"] for r in rows[4:]])).toPandas())
        store.insert("nation", n.where(~F.col("n_nationkey").isin([r["n_nationkey"] for r in rows])))
        store.vacuum()
        return store.read("nation").withColumns({c: F.col(c).cast("bigint") for c in ("n_nationkey", "n_regionkey")})

    return in_folder(spark, make)


@query("v3_analyze", "SELECT 'c_custkey' AS column_name, count(*) AS n, count(*) - count(c_custkey) AS nulls, min(c_custkey)::VARCHAR AS low, max(c_custkey)::VARCHAR AS high FROM customer UNION ALL SELECT 'c_name', count(*), count(*) - count(c_name), min(c_name), max(c_name) FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), min(c_mktsegment), max(c_mktsegment) FROM customer")
def v3(spark, d):
    """Statistics of a table sorted by range in place of an index."""

    def make(folder):
        store = _store(spark, d, folder, "customer")
        store.cluster("customer", ["c_custkey"], 4)
        stats = store.analyze("customer")
        rows = [(c, stats["rows"], s["nulls"], s["min"], s["max"]) for c, s in stats["columns"].items() if c in ("c_custkey", "c_name", "c_mktsegment")]
        return spark.createDataFrame(rows, "column_name string, n bigint, nulls bigint, low string, high string")

    return in_folder(spark, make)


@query("v4_transaction", "SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'region', 2 * count(*) FROM region")
def v4(spark, d):
    """Two tables changed together; what a failed block did isn't seen."""

    def make(folder):
        store = _store(spark, d, folder, "nation", "region")
        try:
            with store.transaction():
                store.delete("nation", "true")
                raise ValueError("rolled back")
        except ValueError:
            pass
        with store.transaction():
            store.insert("region", table(spark, d, "region"))
            store.update("nation", {"n_name": "upper(n_name)"}, "n_regionkey > 1")
        out = [store.read(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in store.tables()]
        return out[0].union(out[1])

    return in_folder(spark, make)


@query("v5_standard_tables", "SELECT table_name, n_columns::BIGINT AS n_columns FROM (VALUES ('chat_messages', 7), ('chat_sessions', 6), ('chunks', 7), ('documents', 9), ('knowledge_clusters', 25), ('search_history', 6), ('system_metrics', 6), ('user_activities', 6)) t(table_name, n_columns)")
def v5(spark, d):
    def make(folder):
        store = catalog.Store(spark, folder)
        store.create_standard()
        return store.overview().select("table_name", F.col("n_columns").cast("bigint").alias("n_columns"))

    return in_folder(spark, make)


@query("k18_tree_cache", "SELECT DISTINCT file_id, node_id, CASE WHEN level = 1 THEN concat('*', coalesce(title, '')) ELSE title END AS title FROM tree_nodes")
def k18(spark, d):
    """Trees kept by file in buckets: a changed tree replaces the old one, the others' buckets stay."""
    from ..operators.joins import upsert

    t = table(spark, d, "tree_nodes").select("file_id", "node_id", "title", "level", F.lit(0).alias("at")).distinct().withColumn("k", F.concat_ws("/", "file_id", "node_id"))
    changed = t.where("level = 1").withColumns({"title": F.concat(F.lit("*"), F.coalesce("title", F.lit(""))), "at": F.lit(1)})

    def make(folder):
        store = tables.KeyedTable(spark, folder, "file_id", 8)
        for part in (t, changed):
            store.merge(part, lambda base, new: new if base is None else upsert(base, new, "k", "at"))
        return store.read().select("file_id", "node_id", "title")

    return in_folder(spark, make)


@query("s2_periodic_flush", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def s2(spark, d):
    """Changes gathered and merged when enough rows wait: the last event of each user."""
    e = table(spark, d, "events").withColumn("o", F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0")))
    own = joins.upsert(e.limit(0), e, "event_id", "o").select("user_id", "event_id", "o")

    def make(folder):
        flusher = catalog.Flusher(tables.KeyedTable(spark, folder, "user_id", 4), "o", rows=2, seconds=1e9)
        for i in range(3):
            flusher.put(own.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i), 1)
        flusher.flush()
        return flusher.table.read().select("user_id", "event_id")

    return in_folder(spark, make)


__all__ = ["names", "clusters"]
