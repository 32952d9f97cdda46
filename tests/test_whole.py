"""Queries over whole tables on small fixtures with odd rows, against brute force."""

import hashlib
import re

from delvestone import plans


def run(spark, folder, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
    return [tuple(r) for r in plans.QUERIES[name](spark, str(folder)).collect()]


def test_preprocess_whole_texts(spark, tmp_path):
    texts = ["Crème brûlée, À LA carte!", "税务表\t2020年；合计", "a_b\r\n" + "Lot's of x. " * 60 + "END", "   ", "", "Ünḯ — 12,5 %", None]
    got = run(spark, tmp_path, "h13_preprocess", documents=(list(enumerate(texts)), "doc_id bigint, text string"))
    want = {i: " ".join(re.sub(r"[^\w\s一-龥]", " ", t.lower()).split()) for i, t in enumerate(texts) if t is not None}
    assert dict(got) == want and len(got) == len(want)


def test_places_of_all_hits(spark, tmp_path):
    docs = [(i, "\n".join(["report", "none", "a report and a report"])) for i in range(150)] + [(999, None)]
    got = run(spark, tmp_path, "w2_rerank_in_files", documents=(docs, "doc_id bigint, text string"))
    assert sorted(got) == sorted(x for i in range(150) for x in [(i, 3, 1), (i, 1, 2)])


def test_levels_of_all_prefixes(spark, tmp_path):
    titles = [f"p{i:03} x{j}" for i in range(70) for j in range(2 + i % 3)] + ["once only", " ", None]
    nodes = [("f", str(k), None, k, 1, t, "", [0, 1], [1, 1], 0, "x") for k, t in enumerate(titles)]
    schema = "file_id string, node_id string, parent_id string, ord int, level int, title string, summary string, char_range array<bigint>, page_range array<int>, table_count int, content_type string"
    got = run(spark, tmp_path, "w15_prefix_levels", tree_nodes=(nodes, schema))
    want = sorted((2 + i % 3, f"p{i:03}") for i in range(70))
    assert sorted(got) == sorted((p, n, k + 1) for k, (n, p) in enumerate(want))


def test_tiers_of_all_records(spark, tmp_path):
    made = [(f"{i:03}", ("STABLE", "emerging", "X", None)[i % 4]) for i in range(120)]
    rows = [(i, "n", "d", "c", 0.5, "L", 0.5, s, None, None, 1, 1) for i, s in made]
    schema = "id string, name string, description string, content string, confidence double, abstraction_level string, hotness double, lifecycle string, create_time timestamp, last_modified timestamp, version int, merge_count int"
    got = run(spark, tmp_path, "f4_tier_sort", knowledge_clusters=(rows, schema))
    tier = {"STABLE": 0, "EMERGING": 1}
    assert got == sorted(((i, tier.get((s or "").upper(), 2)) for i, s in made), key=lambda r: (r[1], r[0]))


def test_anchors_of_three_lengths(spark, tmp_path):
    e = "".join(f"{i:04}" for i in range(60))
    docs = [(1, f"é head\nxx {e[:80]} tail"), (2, f"{e[:50]}."), (3, f"a\n\nb {e[:30]}!"), (4, e[:29]), (5, f"{e[:30]} first\nthen {e[:60]}"), (6, None)]
    got = run(spark, tmp_path, "c15_anchor_lookup", documents=(docs, "doc_id bigint, text string"), eval_items=([(7, e), (8, None)], "item_id bigint, evidence_text string"))

    def brute(t):
        p = next((t.find(e[:n]) for n in (80, 50, 30) if e[:n] in t), -1)
        return t.rfind("\n", 0, p) + 2 if p >= 0 else None

    assert sorted(got) == sorted((7, i, brute(t)) for i, t in docs if t and brute(t))
    assert len(got) == 4


def test_last_pages(spark, tmp_path):
    pages = [(f, n, f"{f}{n}") for f, m in (("a", 12), ("b", 11), ("c", 1), ("d", 9)) for n in range(1, m + 1)]
    got = run(spark, tmp_path, "j11_interval_pages", page_contents=(pages, "file_id string, page_number int, content string"))
    assert sorted((f, n) for f, n, _ in got) == [("a", 1), ("a", 11), ("a", 12), ("b", 1), ("b", 11), ("c", 1), ("d", 1), ("d", 9)]


def test_tokens_of_queries_in_han(spark, tmp_path):
    queries = ["税务报表 2020 tax", "a税x, B!", "税", "Été_déjà", "", None]
    got = run(spark, tmp_path, "h11_tokens", search_history=(list(enumerate(queries)), "id bigint, query string"))

    def brute(q):
        words = re.findall(r"[^\W_]+", q.lower())
        return " ".join(sorted({*words, *(w[i : i + n] for w in words if re.search("[一-鿿]", w) for n in (2, 3) for i in range(len(w) - n + 1))}))

    assert dict(got) == {i: brute(q) for i, q in enumerate(queries) if q is not None}


def test_fingerprints_of_texts_of_any_length(spark, tmp_path):
    texts = ["", "ab", "x" * 16384, "x" * 16385, "é" * 8192 + "y" * 9000 + "税" * 5000, None]
    got = run(spark, tmp_path, "h1_fingerprint", documents=(list(enumerate(texts)), "doc_id bigint, text string"))

    def brute(b):
        return f"{hashlib.md5(b if len(b) <= 16384 else b[:8192] + b[-8192:]).hexdigest()}_{len(b)}"

    assert dict(got) == {i: brute(t.encode()) for i, t in enumerate(texts) if t is not None}


def test_tags_in_whole_texts(spark, tmp_path):
    texts = ["x" * 300 + "<NAME> a\n b \n</NAME><NAME>second</NAME>", "<title></title><CONTENT>\t<b>é</b> </CONTENT>", "<DESCRIPTION>open", "1 < 2", "", None]
    got = run(spark, tmp_path, "h5_tags", documents=(list(enumerate(texts)), "doc_id bigint, text string"))

    def brute(t, name):
        m = re.search(f"<{name}>(.*?)</{name}>", t, re.DOTALL)
        return m[1].strip() if m else ""

    assert sorted(got) == [(i, *(brute(t, n) for n in ("title", "NAME", "DESCRIPTION", "CONTENT"))) for i, t in enumerate(texts) if t is not None]


def test_sizes_of_all_files(spark, tmp_path):
    sizes = [0, 256, 1023, 1024, 1280, 1792, 2304, 1500, 1048575, 1048576, 1310720, 1835008, 5 << 30]
    files = [(f"f{n}", "x.md", None, n, "0") for n in sizes]
    got = run(spark, tmp_path, "h9_human_size", upload_manifest=(files, "file_id string, name string, collection string, size_bytes bigint, sha256 string"))
    want = {f"f{n}": f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB" for n in sizes}
    assert dict(got) == want
