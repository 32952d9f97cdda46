"""The search entry point, the store, file formats and anchors on small fixtures."""

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from delvestone.engine import Engine, Hooks, with_history, words_of
from delvestone.operators import anchors, ranking
from delvestone.sources import catalog, files, tables

DOCS = [
    (1, "Intro\n" + "filler line here\n" * 120 + "The appeal was heard.\n" + "more filler\n" * 120 + "An appeal report.\nEnd"),
    (2, "A report about turbines.\nReport two.\nreport three"), (3, None), (4, ""), (5, "Nothing to see."), (6, "appeal"),
]


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in DOCS], "doc_id bigint, text string, score string")
    names = spark.createDataFrame([(1, "court_2013.pdf"), (2, "Turbine_report.md"), (5, None), (6, "notes.txt")], "doc_id bigint, name string")
    catalog = spark.createDataFrame([(2, "Turbine report", "All about the turbine and its report"), (5, None, None)], "doc_id bigint, name string, summary string")
    return Engine(spark, docs, names=names, catalog=catalog, trees=spark.createDataFrame([(1,)], "doc_id bigint"))


def test_fast_search(spark, engine):
    plain = Engine(spark, engine.docs)
    got = plain.search("What does the appeal report?").orderBy("place").collect()
    assert [(r.doc_id, r.place, r.source) for r in got] == [(1, 1, "keywords"), (2, 2, "keywords")]  # the next one is worth less than half
    assert got[0].score == pytest.approx(1 + 0.693147 + 1, abs=1e-5)
    lines = got[0].evidence.split("\n")
    assert "The appeal was heard." in lines and "Intro" not in lines and len(lines) < 243
    assert got[0].reason == "coverage" and got[1].reason == "reject"
    for query in ("", "  ", "what is the", "zebra"):
        assert plain.search(query).count() == 0
    assert plain.search("appeal", scope=F.col("doc_id") > 1).collect()[0].doc_id == 6


def test_names_hints_and_chat(engine):
    assert [r.doc_id for r in engine.search("turbine report", "FILENAME_ONLY").collect()] == [2]
    assert [r.doc_id for r in engine.search("court", "FILENAME_ONLY", include=["*.pdf"]).collect()] == [1]
    assert engine.search("court", "FILENAME_ONLY", exclude=["*.pdf"]).count() == 0
    assert engine.search("Thanks!").first().source == "chat"
    with pytest.raises(ValueError):
        engine.search("x", "SLOW")
    assert words_of("What is the Total revenue of 2019?") == ["total", "revenue", "2019"]
    assert with_history("and profit?", [{"role": "user", "content": "revenue of court"}]) == "revenue of court and profit?"


def test_deep_search_goes_on_until_evidence_is_accepted(spark, engine):
    got = engine.search("Which court appeal and turbine?", "DEEP").orderBy("place").collect()
    assert {r.doc_id for r in got} >= {1, 2, 6} and [r.place for r in got] == list(range(1, len(got) + 1))
    assert "appeal" in got[0].evidence.lower()
    asked = []
    picky = Engine(spark, engine.docs, names=engine.names, hooks=Hooks(accept=lambda q, e: asked.append(e.count()) or True))
    assert {r.reason for r in picky.search("zebra turbines", "DEEP").collect()} == {"judged"} and asked == [1]


def test_reuse_of_a_near_cluster(spark, engine):
    stored = spark.createDataFrame([("c1", [1.0, 0.0], 2, "known answer"), ("c2", [0.0, 1.0], 1, "other")], "cluster string, vector array<double>, file bigint, content string")
    own = Engine(spark, engine.docs, clusters=stored, hooks=Hooks(embed=lambda q: [0.9, 0.1]))
    assert [(r.doc_id, r.evidence, r.reason) for r in own.search("anything at all").collect()] == [(2, "known answer", "reused")]
    far = Engine(spark, engine.docs, clusters=stored, hooks=Hooks(embed=lambda q: [0.7, 0.7]))
    assert far.search("appeal").first().source == "keywords"


def test_ranking_falls_back_on_names_then_on_the_catalogue(spark, engine):
    rank = lambda words, **more: [(r[0], r[1]) for r in ranking.rank_files(engine.docs, "doc_id", "text", words, query=" ".join(words), **more).collect()]
    assert rank(["court"], names=engine.names) == [(1, 0.0)]
    assert rank(["zebra"], names=engine.names) == []
    assert rank(["all"], names=engine.names.limit(0), catalog=engine.catalog)[0][0] == 2
    blended = dict(rank(["report"], catalog=engine.catalog, trees=engine.trees, probed=engine.trees, top_k=10))
    topic = 5 * (1 + 1) / (1 + 1) + 1.5
    assert blended[2] == pytest.approx(0.85 * 10 + 0.15 * topic, abs=1e-5)
    tf = 1 / (1 + 1.0986122886681098)
    assert blended[1] == pytest.approx(0.85 * 10 * tf + 0.15 * 0.5 + 3, abs=1e-5)


def test_documents_selected_by_name(spark):
    make = lambda n: spark.createDataFrame([(f"f{i:02}", f"court_{i}.pdf" if i % 7 == 0 else f"other_{1990 + i}.pdf") for i in range(n)], "k string, name string")
    pick = lambda n, **more: sorted(r[0] for r in ranking.select_documents(make(n), "k", "name", "the court of 2001", **more).collect())
    assert pick(3) == ["f00", "f01", "f02"] and pick(10) == ["f00", "f01", "f02"]
    assert pick(30) == ["f00", "f07", "f11"]  # the year counts most
    assert pick(30, choose=lambda rows: [1, 99]) == ["f00"] and pick(0) == []


def test_acceptance_branches(spark):
    long = "the revenue grew. " * 60
    rows = [(1, True, None, None), (2, None, True, "x"), (3, None, None, long), (4, None, None, "It was $ 5"), (5, False, False, "no number"), (6, None, None, "about 1,234 units"), (7, None, None, "x1234 %"), (8, None, None, "")]
    df = spark.createDataFrame(rows, "k int, c boolean, j boolean, e string")
    got = {r.k: r.r for r in df.select("k", ranking.acceptance(F.lit("What was total revenue?"), "e", F.col("c"), F.col("j")).alias("r")).collect()}
    assert got == {1: "complete", 2: "judged", 3: "coverage", 4: "numeric", 5: "reject", 6: "numeric", 7: "reject", 8: "reject"}
    assert df.select(ranking.acceptance(F.lit("Who won?"), "e").alias("r")).where("r = 'numeric'").count() == 0


def test_anchors_in_any_script(spark):
    head = "Überschrift 税务报表 of the year two thousand and one, which is long enough to be cut at eighty characters and more"
    docs = [(1, "x\n  " + head + " y"), (2, head[:50] + "!"), (3, head[:30]), (4, head[:29]), (5, None), (6, "😀\n" * 20 + head[:80]), (6, "😀\n" * 20 + head[:80])]
    items = [(7, head), (8, head), (9, None), (10, "short")]
    got = {tuple(r) for r in anchors.locate(spark.createDataFrame([(*r, "c") for r in docs], "d int, t string, at string"), spark.createDataFrame(items, "i int, a string"), "d", "t", "i", "a").collect()}
    assert got == {(i, d, at) for i in (7, 8) for d, at in ((1, 3), (2, 1), (3, 1), (6, 41))}


def test_store(spark, tmp_path):
    store = catalog.Store(spark, str(tmp_path / "s"))
    assert store.tables() == [] and store.describe().count() == 0
    store.create("t", "k int, v string")
    store.create("t", "k int")  # exists
    with pytest.raises(ValueError):
        store.create("t", "k int", if_not_exists=False)
    with pytest.raises(ValueError):
        store.create("no name", "k int")
    assert store.read("t").count() == 0
    store.insert("t", [{"k": 1}, {"k": None, "v": "x"}])
    store.insert("t", spark.createDataFrame([("y", 3, 9)], "v string, k bigint, extra int"))
    assert sorted((r.k, r.v) for r in store.read("t").collect() if r.k) == [(1, None), (3, "y")]
    store.update("t", {"v": "upper(v)"}, "k > 1")
    store.delete("t", "k = 1")
    assert {(r.k, r.v) for r in store.read("t").collect()} == {(None, "x"), (3, "Y")}
    assert store.analyze("t") == {"rows": 2, "columns": {"k": {"nulls": 1, "min": "3", "max": "3"}, "v": {"nulls": 0, "min": "Y", "max": "x"}}}
    other = catalog.Store(spark, str(tmp_path / "s"))
    with pytest.raises(tables.Conflict), store.transaction():
        store.drop("t")
        other.insert("t", {"k": 5})  # commits first
    assert store.read("t").count() == 3 and [tuple(r) for r in store.search("V").collect()] == [("t", "v")]
    brief = catalog.Store(spark, str(tmp_path / "s"), keep=0.0)
    brief.vacuum()
    assert brief.read("t").count() == 3 and len(brief.log.numbers()) == 1


def test_flusher(spark, tmp_path):
    now = [0.0]
    table = tables.KeyedTable(spark, str(tmp_path / "k"), "k", 2)
    f = catalog.Flusher(table, "o", rows=3, seconds=60, clock=lambda: now[0])
    row = lambda k, o: spark.createDataFrame([(k, o)], "k int, o int")
    assert not f.put(row(1, 1), 1) and table.read() is None
    assert f.put(row(1, 2), 2) and [tuple(r) for r in table.read().collect()] == [(1, 2)]
    now[0] = 61.0
    assert f.put(row(2, 1), 1) and table.read().count() == 2 and not f.flush()


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


CORE = "<c xmlns:dc='d'><dc:title>Title</dc:title><dc:creator>Author</dc:creator></c>"


def a_pdf(compressed=True):
    stream = b"BT (Hello \\(page\\)) Tj 0 -12 Td <576f726c64> Tj ET"
    body = zlib.compress(stream) if compressed else stream
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R /Outlines 6 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", b"<< /Type /Page /Parent 2 0 R >>",
        b"<< /Length %d %s >>\nstream\n" % (len(body), b"/Filter /FlateDecode" if compressed else b"") + body + b"\nendstream",
        b"<< /First 7 0 R >>", b"<< /Title (One) /Dest [3 0 R /Fit] /First 8 0 R /Next 9 0 R >>", b"<< /Title <feff00dc> /Dest [4 0 R /Fit] >>", b"<< /Title (Two) >>",
        b"<< /Title (The title) /Author (Me) >>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R /Info 10 0 R >>\nstartxref\n0\n%%EOF"


def test_files_of_many_formats(spark):
    w = "xmlns:w='w'"
    docx = zipped(
        word__document_xml=f"<w:d {w}><w:p><w:pPr><w:pStyle w:val='H1'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body </w:t><w:t>text</w:t></w:r></w:p></w:d>",
        word__styles_xml=f"<w:s {w}><w:style w:styleId='H1'><w:name w:val='heading 2'/></w:style></w:s>", docProps__core_xml=CORE,
    )
    slide = "<p:s xmlns:p='p' xmlns:a='a'><p:sp><p:ph type='title'/><a:p><a:t>Slide {0}</a:t></a:p></p:sp><p:sp><a:p><a:t>Point</a:t></a:p></p:sp></p:s>"
    pptx = zipped(**{f"ppt__slides__slide{i}_xml": slide.format(i) for i in (10, 2)})
    xlsx = zipped(
        xl__workbook_xml="<w><sheet name='Sales'/></w>", xl__sharedStrings_xml="<s><si><t>region</t></si><si><t>amount</t></si><si><t>north</t></si></s>",
        xl__worksheets__sheet1_xml="<w><row><c r='A1' t='s'><v>0</v></c><c r='C1' t='s'><v>1</v></c></row><row><c r='A2' t='s'><v>2</v></c><c r='C2'><v>5.5</v></c></row><row><c r='C3'><v>-2</v></c></row></w>",
    )
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 30, 20)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 7, 9)
    given = {
        "a.docx": docx, "b.pptx": pptx, "c.xlsx": xlsx, "d.pdf": a_pdf(), "e.pdf": a_pdf(False), "f.png": png, "g.gif": b"GIF89a" + struct.pack("<HH", 4, 5), "h.jpg": jpeg,
        "i.html": b"<html><head><title>T</title><meta name=author content=Me><style>x</style></head><body><h2>One <b>b</b></h2><p>a &lt; b</p></body></html>",
        "j.md": "# Käse\n\ntext".encode(), "k.txt": "old".encode("utf-16"), "l.txt": b"caf\xe9", "m.docx": b"PK broken", "n.bin": None, "o.txt": b"", "p.pdf": b"%PDF-1.4 nothing",
    }
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None, "clash") for k, v in given.items()], "path string, content binary, text string")
    got = {r.path: r for r in files.extract(df).collect()}
    heads = lambda k: [tuple(h) for h in got[k].headings]
    assert (got["a.docx"].text, got["a.docx"].title, got["a.docx"].author) == ("Head\nBody text", "Title", "Author") and heads("a.docx") == [(2, "Head", 0)]
    assert got["b.pptx"].n_parts == 2 and heads("b.pptx") == [(1, "Slide 2", 1), (1, "Slide 10", 2)]
    assert "| region |  | amount |" in got["c.xlsx"].text and "amount: -2 to 5.5" in got["c.xlsx"].text and heads("c.xlsx") == [(1, "Sales", 1)]
    for k in ("d.pdf", "e.pdf"):
        assert got[k].n_parts == 2 and got[k].title == "The title" and got[k].author == "Me" and got[k].text.startswith("Hello (page)\nWorld")
        assert heads(k) == [(1, "One", 1), (2, "Ü", 2), (1, "Two", 0)]
    assert [(got[k].width, got[k].height) for k in ("f.png", "g.gif", "h.jpg")] == [(30, 20), (4, 5), (9, 7)]
    assert (got["i.html"].text, got["i.html"].title, got["i.html"].author) == ("One b\na < b", "T", "Me") and heads("i.html") == [(2, "One b", 0)]
    assert got["j.md"].title == "Käse" and got["k.txt"].text == "old" and got["l.txt"].text == "café" and got["o.txt"].text == ""
    assert got["m.docx"].error and got["m.docx"].text is None and got["n.bin"].error == "no content" and got["p.pdf"].n_parts == 0
    assert files.extract(df.limit(0)).count() == 0
