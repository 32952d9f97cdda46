"""Operators on small fixtures: edges, nulls, ties, empty tables, clashing columns, and what SQL can't say."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from delvestone.functions import text as fn
from delvestone.operators import clusters, grep, joins, ranking, structure, windows
from delvestone.sources import tables
from delvestone.streaming import events


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_lines_and_grep_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a.b\nA.B\n\naxb", 0)], "doc_id int, text string, line int")
    own = grep.lines(df)
    assert own.count() == 5
    assert [r.line_number for r in grep.grep(own, "a.b").orderBy("line_number").collect()] == [1, 2]
    assert grep.grep(own, "a.b", ignore_case=False).count() == 1
    assert grep.grep(own, "a.b", literal=False, ignore_case=False).count() == 2
    assert grep.grep(own, "a", whole_word=True).count() == 2
    assert grep.lines(df.limit(0)).count() == 0


def test_glob_patterns(spark):
    df = spark.createDataFrame([("/a/b.txt",), ("/a/c/b.txt",), ("/a/b.md",)], "path string")
    assert rows(grep.glob_filter(df, ["/a/*.txt"], [])) == [("/a/b.txt",)]
    assert rows(grep.glob_filter(df, ["/a/**"], ["**.md"])) == [("/a/b.txt",), ("/a/c/b.txt",)]
    assert rows(grep.by_name(df, ["(", "b"], "path").select("path")) == rows(df)


def test_gap_prune_edges(spark):
    def kept(scores, **more):
        df = spark.createDataFrame([("g", i, float(s)) for i, s in enumerate(scores)], "g string, k int, s double")
        return [r.s for r in windows.gap_prune(df, ["g"], "s", "k", **more).orderBy("rank").collect()]

    assert kept([10, 5.1, 5.0, 3.0, 2.99]) == [10, 5.1, 5.0, 3.0]
    assert kept([10, 4.99, 4.9]) == [10]
    assert kept([10, 5.0]) == [10, 5.0]  # a drop of exactly half is no gap
    assert kept([0, 0, 0]) == [0, 0, 0]
    assert kept([7]) == [7]
    assert kept([10, 1, 1], least=2) == [10, 1]


def test_merge_windows(spark):
    df = spark.createDataFrame([(1, h) for h in (1, 2, 62, 63, 200)], "d int, n int")
    got = rows(windows.merge_windows(df, ["d"], "n", 30))
    assert got == [(1, 1, 93, 4), (1, 170, 230, 1)]
    apart = spark.createDataFrame([(1, 10), (1, 72)], "d int, n int")
    assert windows.merge_windows(apart, ["d"], "n", 30).count() == 2
    touching = spark.createDataFrame([(1, 40), (1, 101)], "d int, n int")
    assert rows(windows.merge_windows(touching, ["d"], "n", 30)) == [(1, 10, 131, 2)]


def test_budget(spark):
    df = spark.createDataFrame([(1, i, 10) for i in range(3)], "g int, k int, n int")
    for limit, want in ((20, [10, 10]), (25, [10, 10, 5]), (0, [])):
        assert [r.kept for r in windows.budget(df, ["g"], [F.col("k")], "n", limit).orderBy("k").collect()] == want


def test_parents_by_brute_force(spark):
    rng = random.Random(1)
    own = [(g, i, rng.choice([0, 1, 2, 3, 9, 40])) for g in range(3) for i in range(1, 40)]
    df = spark.createDataFrame(own, "g int, i bigint, level int")
    got = {(r.g, r.i): r.parent for r in windows.parents(df, ["g"], "i", "level").collect()}
    for g, i, level in own:
        before = [j for h, j, other in own if h == g and j < i and other < level]
        assert got[g, i] == (max(before) if before else None)


def test_runs(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 1, 0, 1, 1, 1])], "g int, i int, v int")
    assert rows(windows.runs(df, ["g"], "i", F.col("v") == 1, 3)) == [(1, 3, 5, 3)]
    assert windows.runs(df, ["g"], "i", F.col("v") == 1, 2).count() == 2


def test_change_set_and_upsert(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None), ("w", "3")], "k string, h string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("z", None), ("v", "4")], "k string, h string")
    assert dict(rows(joins.change_set(a, b, "k", "h"))) == {"x": "unchanged", "y": "modified", "z": "unchanged", "w": "deleted", "v": "added"}
    base = spark.createDataFrame([("a", 1), ("b", 5)], "k string, t int")
    new = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "k string, t int")
    assert rows(joins.upsert(base, new, "k", "t")) == [("a", 1), ("b", 5), ("c", None)]


def test_co_occurrence_of_a_hot_group(spark):
    pairs = [(i, "hot") for i in range(40)] + [(1, "g"), (2, "g"), (2, "g"), (None, "g"), (3, None)]
    df = spark.createDataFrame(pairs, "s int, g string")
    plain, cut = rows(joins.co_occurrence(df, "s", "g")), rows(joins.co_occurrence(df, "s", "g", most=7))
    assert plain == cut and len(plain) == 40 * 39 // 2
    assert (1, 2, 2, 0.5) in plain


def test_as_of_and_range(spark):
    r = spark.createDataFrame([("a", 5), ("a", 0), ("b", 3)], "k string, at int")
    p = spark.createDataFrame([("a", 1, "one"), ("a", 5, "five")], "k string, at int, v string")
    assert rows(joins.as_of(r, p, "k", "at", "v")) == [("a", 0, None), ("a", 5, "five"), ("b", 3, None)]
    spans = spark.createDataFrame([("a", 0, 100), ("a", 5, 6)], "k string, s int, e int")
    assert joins.range_join(r, spans, "k", "at", "s", "e", 10).count() == 3


def test_bm25_by_hand(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, None), (4, "")], "d int, t string")
    got = dict(rows(ranking.bm25(df, "d", "t", ["a", "a", "z"])))
    mean, n = 5 / 3, 3
    idf = math.log((n - 1 + 0.5) / 1.5 + 1)
    assert got == {1: round(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / mean)), 6)}


def test_fusion_edges(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 5.0), (3, None, None)], "k int, a double, b double")
    got = dict(rows(ranking.fuse(df, "k", {"a": 0.5, "b": 0.5})))
    assert got[1] == round(1 / (1 + math.exp(1.5)), 6)  # equal scores count 0, a missing one -3
    assert got[3] == round(1 / (1 + math.exp(3)), 6)


def test_mmr_prefers_unlike(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0.9), (2, [1.0, 0.01], 0.89), (3, [0.0, 1.0], 0.5)], "k int, v array<double>, s double")
    assert ranking.mmr(df, "k", "v", "s", 2, 0.5) == [1, 3]
    assert ranking.mmr(df.limit(0), "k", "v", "s", 2) == []
    rng = random.Random(2)
    many = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.random() if i < 600 else 0.5) for i in range(900)] + [(1000, None, 0.1), (1001, [0.0] * 4, None)]
    got = ranking.mmr(spark.createDataFrame(many, "k int, v array<double>, s double"), "k", "v", "s", 6, 0.3)
    vectors = {k: v for k, v, s in many if s is not None}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) if a and b else 0.0
    want: list = []
    for _ in range(6):
        left = [(0.3 * s - 0.7 * max((cos(vectors[k], vectors[c]) for c in want), default=0.0), -k) for k, v, s in many if s is not None and k not in want]
        want.append(-max(left)[1])
    assert got == want


def test_samples_are_stable_and_weighted(spark):
    df = spark.range(2000).withColumn("w", F.when(F.col("id") < 100, 50.0).otherwise(1.0))
    one, two = rows(ranking.weighted_sample(df, "id", "w", 100, 1)), rows(ranking.weighted_sample(df.repartition(7), "id", "w", 100, 1))
    assert one == two and len(one) == 100
    assert sum(r[0] < 100 for r in one) > 50


def test_roi_windows_find_the_hits(spark):
    text = "x" * 9000 + " appeal turbine " + "y" * 9000
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "appeal"), (5, "z" * 9000)], "d int, t string")
    run = lambda **more: rows(ranking.roi_windows(df, "d", "t", ["appeal", "turbine"], whole=1000, **more))
    got = {}
    for d, start, end, score in run():
        got[d] = max(score, got.get(d, 0.0))
        assert end - start == (500 if d == 1 else 6)
    assert got == {1: 10.0, 4: 5.0}
    assert run() == run() and run(least=6.0) == [r for r in run() if r[3] >= 6.0]


def test_drawn_windows_keep_apart_and_reach_far():
    import numpy as np

    rng = random.Random(6)
    text = "".join(rng.choice("ab ") for _ in range(60_000))
    found = ranking.windows_of("k", text, ["aab"], np, 3, 8, 500, 10**6, 2, -1.0, 99.0, 1000, 0)
    starts = sorted(a for a, _, _ in found)
    assert all(y - x >= 166 for x, y in zip(starts, starts[1:])) and len(starts) > 12
    assert starts[0] < 60_000 / 8 + 500 and starts[-1] > 60_000 * 7 / 8 - 1000
    assert all((("aab" in text[a:b]) == (s == 10.0)) for a, b, s in found)


@pytest.mark.parametrize("s,v", [("$1,577", 1577), ("1.577K", 1577), ("(1.5)", -1.5), ("15.3%", 0.153), ("2018", 2018), ("-$500", -500), ("", None), (None, None)])
def test_numbers(spark, s, v):
    got = spark.createDataFrame([(s,)], "s string").select(fn.number_of("s")).first()[0]
    assert got == v or abs(got - v) < 1e-9


def test_near(spark):
    df = spark.createDataFrame([(0.0, 0.0), (9.9, 9.7), (9.9, 9.5), (100.0, 101.9), (100.0, 103.0)], "a double, b double")
    assert [r[0] for r in df.select(fn.near("a", "b")).collect()] == [True, True, False, True, False]


def test_cjk_tokens_and_n_grams(spark):
    df = spark.createDataFrame([("税务表 Tax",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(fn.cjk_tokens("t")).collect()]
    assert sorted(got[0]) == sorted(["税务表", "tax", "税务", "务表"])
    assert got[1] == [] and got[2] is None
    assert spark.range(1).select(fn.n_grams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)).first()[0] == ["a b", "b c"]


def test_salvage_json(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('So: {"a": 1} end',), ("none",), ("{bad}",), (None,)], "t string")
    got = [r[0] for r in df.select(fn.salvage_json("t")).collect()]
    assert [json.loads(x) if x else x for x in got] == [{"a": 1}, {"a": 1}, None, None, None]


def test_fingerprint_of_a_long_text(spark):
    import hashlib

    text = "é" * 20_000
    b = text.encode()
    got = spark.createDataFrame([(text,), ("ab",)], "t string").select(fn.fingerprint("t")).collect()
    assert got[0][0] == f"{hashlib.md5(b[:8192] + b[-8192:]).hexdigest()}_{len(b)}"
    assert got[1][0] == f"{hashlib.md5(b'ab').hexdigest()}_2"


def test_headings_tables_and_depths(spark):
    text = "# One\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| x |\n## Two\n3.1 Numbered Part\nChapter IV begins"
    lines = grep.lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert [(r.kind, r.level, r.title) for r in structure.headings(lines, "doc_id").orderBy("line_number").collect()] == [("markdown", 1, "One"), ("markdown", 2, "Two"), ("numbered", 2, "3.1 Numbered Part"), ("structural", 1, "CHAPTER IV begins")]
    assert structure.cascade(structure.headings(lines, "doc_id"), "doc_id").count() == 2
    assert structure.outline(structure.headings(lines, "doc_id"), "doc_id").count() == 0  # two Markdown headings are no outline
    assert structure.outline(structure.headings(lines, "doc_id"), "doc_id", 2).count() == 2
    more = ["Item 1. Business", "EXHIBIT 4", "annex b", "Section 2: x", "Part I", "Parts of it", "2019 was good", "7." + "x" * 130, "##", "## ", "1.2.3 ", "item"]
    found = structure.headings(spark.createDataFrame([(1, i, x) for i, x in enumerate(more)], "doc_id int, line_number int, line string"), "doc_id")
    assert [(r.level, r.title) for r in found.orderBy("line_number").collect()] == [(2, "ITEM 1. Business"), (3, "EXHIBIT 4"), (3, "ANNEX b"), (2, "SECTION 2: x"), (1, "PART I"), (1, "2019 was good"), (2, "1.2 3")]
    digest = structure.table_digests(lines, "doc_id").first()
    assert (digest.n_cols, digest.header) == (2, "| a | b |")
    nodes = spark.createDataFrame([("f", "r", None), ("f", "a", "r"), ("f", "b", "a"), ("f", "lost", "nowhere"), ("f", "x", "y"), ("f", "y", "x")], "f string, n string, p string")
    assert rows(structure.depths(nodes, "f", "n", "p")) == [("f", "a", 1), ("f", "b", 2), ("f", "r", 0)]
    assert structure.depths(nodes.limit(0), "f", "n", "p").count() == 0


def test_a_tree_deeper_than_any_round_count(spark):
    chain = spark.range(200).selectExpr("'f' as f", "id as n", "case when id > 0 then id - 1 end as p", "concat('t', id) as t")
    assert rows(structure.depths(chain, "f", "n", "p")) == sorted((("f", i, i) for i in range(200)), key=lambda r: tuple((False, str(x)) for x in r))
    paths = {r.n: r.path for r in structure.title_paths(chain, "f", "n", "p", "t").collect()}
    assert paths[3] == "t0 > t1 > t2 > t3" and len(paths) == 200


def test_nodes_of_halved_texts(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("ab \n") for _ in range(n))) for i, n in enumerate((0, 1, 90, 101, 1500))] + [(9, None), (10, "x" * 300)]
    got = structure.recursive_tree(spark.createDataFrame(texts, "k int, t string"), "k", "t", leaf=100).collect()
    for k, t in texts:
        own = [r for r in got if r.k == k]
        inner = {r.parent_id for r in own}
        leaves = sorted((r.char_start, r.char_end) for r in own if r.node_id not in inner)
        assert all(b - a <= 100 for a, b in leaves)
        assert [x for a, b in leaves for x in range(a, b)] == list(range(len(t or "")))


def test_cluster_updates(spark):
    base = spark.createDataFrame([("a", "x", 1, 10), ("b", "y", None, 10)], "id string, name string, version int, last_modified int")
    changes = spark.createDataFrame([("a", None), ("b", "z"), ("q", "n")], "id string, name string")
    assert rows(clusters.update(base, changes, "id", ["name"], F.lit(99))) == [("a", "x", 2, 99), ("b", "z", 1, 99)]
    assert clusters.insert_new(base, base.limit(1), "id").count() == 2
    assert clusters.delete(base, changes, "id").count() == 0


def test_conform_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, extra string")
    schema = spark.createDataFrame([], "a bigint, b string, n bigint").schema
    assert rows(tables.conform(df, schema, {"n": 0})) == [(1, None, 0)]
    store = tables.VersionedTable(spark, str(tmp_path / "t"))
    assert store.read() is None
    for n in range(3):
        store.write(spark.range(n + 1))
        assert store.read().count() == n + 1
    before = store.read()
    store.write(before.union(before))  # reads what it replaces
    assert store.read().count() == 6
    held = store.version()
    store.write(spark.range(1), base=held)
    with pytest.raises(tables.Conflict):  # a second writer that started from the same version
        tables.VersionedTable(spark, str(tmp_path / "t")).write(spark.range(9), base=held)
    assert store.read().count() == 1 and store.changed(held) and store.read(held).count() == 6
    brief = tables.VersionedTable(spark, str(tmp_path / "t"), keep=0.0)
    brief.write(spark.range(2))
    assert len(brief.log.numbers()) == 1 and brief.read().count() == 2


def test_two_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = [tables.Log(spark, str(tmp_path / "l")) for _ in range(8)]

    def commit(i):
        try:
            log[i].commit(0, {"by": i})
            return i
        except tables.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [x for x in pool.map(commit, range(8)) if x is not None]
    assert len(won) == 1 and log[0].read(0)["by"] == won[0]


def test_a_merge_rewrites_only_touched_buckets(spark, tmp_path):
    store = tables.KeyedTable(spark, str(tmp_path / "k"), "id", 8)
    assert store.read() is None
    put = lambda df: store.merge(df, lambda base, new: new if base is None else joins.upsert(base, new, "id", "t"))
    assert put(spark.range(100).selectExpr("id", "0 as t")) == 8
    before = store.log.read(store.log.last())["folders"]
    assert put(spark.createDataFrame([(5, 1), (1000, 1)], "id bigint, t int")) <= 2
    after = store.log.read(store.log.last())["folders"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    assert rows(store.read().where("t = 1")) == [(1000, 1), (5, 1)] and store.read().count() == 101
    assert put(spark.createDataFrame([], "id bigint, t int")) == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a, "b"'), (2, "line")], "k int, t string")
    tables.write_csv(df, str(tmp_path / "c"), ";")
    assert rows(tables.read_csv(spark, str(tmp_path / "c"), df.schema, ";")) == [(1, 'a, "b"'), (2, "line")]
    assert tables.listing(spark, str(tmp_path / "c"), "*.csv").count() >= 1


def test_statements():
    assert tables.statements("select 1; -- a; b\nselect 'x;y';\n ;") == ["select 1", "select 'x;y'"]


def test_rate_limit_batch_and_stream(spark, tmp_path):
    base = 1_700_000_000
    hits = [("u", i, float(base + t)) for i, t in enumerate([0, 0.1, 0.2, 0.3, 0.4, 0.5, 1.05, 1.2])] + [("v", 100, float(base))]
    df = spark.createDataFrame(hits, "who string, k int, s double").select("who", "k", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("ts"))
    got = {r.k: r.allowed for r in events.rate_limit(df, "who", "ts", "k").collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 100: True}
    rng = random.Random(8)
    long = [(rng.choice("xyz"), i, base + 1000.0 * (i // 40) + rng.random() * 30) for i in range(400)] + [(None, 900, float(base))]
    many = spark.createDataFrame(long, "who string, k int, s double").select("who", "k", "s", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("ts"))
    allowed = {r.k: r.allowed for r in events.rate_limit(many, "who", "ts", "k", (1.0, 2), (60.0, 5)).collect()}
    for who in ("x", "y", "z", None):
        recent: list = []
        for t, k in sorted((int(s * 1e6) / 1e6, k) for w, k, s in long if w == who):
            recent = [x for x in recent if x > t - 60]
            assert allowed[k] == (sum(x > t - 1 for x in recent) < 2 and len(recent) < 5)
            recent += [t] if allowed[k] else []
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = events.rate_limit(stream, "who", "ts", "k").writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k: r.allowed for r in spark.table("limited").collect()} == got


def test_incremental_merge(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id int, t int, v string"
    handle = events.merge_into(store, "id", "t")
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).coalesce(1).write.mode("append").parquet(source)
    events.incremental(spark, source, schema, str(tmp_path / "cp"), handle)
    spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], schema).coalesce(1).write.mode("append").parquet(source)
    events.incremental(spark, source, schema, str(tmp_path / "cp"), handle)
    assert rows(tables.KeyedTable(spark, store, "id").read()) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


def test_streaming_windows_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, k string, v double"
    path = str(tmp_path / "in")
    day = lambda h, m: f"2024-01-01 {h:02d}:{m:02d}:00"

    def put(*r):
        spark.createDataFrame(r, "t string, k string, v double").select(F.to_timestamp("t").alias("ts"), "k", "v").coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = spark.readStream.schema(schema).parquet(path)
        q = events.tumbling(stream, "ts", "1 hour", ["k"], "v", "10 minutes").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    put((day(0, 5), "a", 1.0), (day(0, 50), "a", 2.0))
    run()
    put((day(3, 0), "a", 5.0))
    run()
    put((day(0, 10), "a", 100.0))  # late
    run()
    assert [(r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 3.0)]


def test_subpackage_is_optional():
    import pathlib

    import delvestone

    root = pathlib.Path(delvestone.__file__).parent
    for path in root.rglob("*.py"):
        if root / "llm" not in path.parents:
            assert "llm" not in path.read_text(), path


def test_policies(spark):
    from delvestone.operators import policies

    df = spark.createDataFrame([("I cannot answer that from the given texts.", "5"), ("$1,577.00", "1577"), ("15.2%", "15.3%"), ("**Yes**", "yes"), ("7", "90"), ("blue", "red"), (None, "x")], "p string, g string")
    assert [r[0] for r in df.select(policies.verdict("p", "g")).collect()] == ["refused", "numeric", "numeric", "exact", "wrong", "undecided", "refused"]
    assert [r[0] for r in spark.createDataFrame([("Hello!",), ("thanks",), ("hello, what is the margin?",), (None,)], "q string").select(policies.small_talk("q")).collect()] == [True, True, False, None]
    tools = policies.Tools()
    tools.register("n", lambda n: spark.range(n))
    tools.register("bad", lambda: 1 / 0)
    with pytest.raises(ValueError):
        tools.register("n", lambda n: spark.range(n))
    steps = iter([("n", {"n": 3}), ("bad", {}), ("missing", {}), None])
    history = policies.loop(tools, lambda h: next(steps))
    assert len(history) == 3 and [entry[1].split(":")[0] for entry in tools.log] == ["ok", "ZeroDivisionError", "KeyError"]
    assert policies.cascade(lambda: None, lambda: spark.range(0), lambda: spark.range(2)).count() == 2
    v = spark.createDataFrame([("a b a",), ("",)], "t string").select(policies.hashed_embedding("t", 16)).collect()
    assert abs(sum(x * x for x in v[0][0]) - 1) < 1e-9 and sum(v[1][0]) == 0
