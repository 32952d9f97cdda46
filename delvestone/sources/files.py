"""Text and metadata of files of many formats, from their bytes.

Formats that the standard library can read: plain text, Markdown, CSV, JSON,
HTML; DOCX, PPTX and XLSX (zipped XML); PDF (page count, document information,
outline, and the text of pages in simple encodings); PNG, GIF and JPEG sizes.
Files are read with Spark's binary source and handled one by one in Arrow
batches; a broken file gives a row with its error and no text.
"""

from __future__ import annotations


import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, kind string, text string, title string, author string, n_parts int, headings array<struct<level:int,title:string,part:int>>, width int, height int, error string"
_NAMES = [c.split()[0] for c in re.split(r", (?![^<]*>)", SCHEMA)]


def kind_of(name: str, data: bytes) -> str:
    """The format, by the first bytes where they tell, else by the name."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if data[:5] == b"%PDF-":
        return "pdf"
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if data[:3] == b"GIF":
        return "gif"
    if data[:2] == b"\xff\xd8":
        return "jpeg"
    if data[:2] == b"PK":
        return ext if ext in ("docx", "pptx", "xlsx") else "zip"
    if ext in ("html", "htm") or data[:200].lstrip()[:9].lower().startswith((b"<!doctype", b"<html")):
        return "html"
    return {"md": "markdown", "markdown": "markdown", "csv": "csv", "json": "json"}.get(ext, "text")


def decoded(data: bytes) -> str:
    """Text by byte order mark, else UTF-8, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


class _Html(HTMLParser):
    BLOCKS = {"p", "div", "br", "li", "tr", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "title", "blockquote", "pre"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.headings: list[tuple[int, str, int]] = []
        self.title = self.author = ""
        self.skip = 0
        self.own: list[tuple[str, int]] = []

    def handle_starttag(self, tag, attributes):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "meta" and dict(attributes).get("name", "").lower() == "author":
            self.author = dict(attributes).get("content") or ""
        if tag in self.BLOCKS:
            self.out.append("\n")
        if tag == "title" or re.match(r"(?:h[1-6])\Z", tag):
            self.own.append((tag, len(self.out)))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if self.own and self.own[-1][0] == tag:
            _, at = self.own.pop()
            text = " ".join("".join(self.out[at:]).split())
            if tag == "title":
                self.title = text
                del self.out[at:]
            elif text:
                self.headings.append((int(tag[1]), text, 0))
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def _from_html(data: bytes) -> dict:
    p = _Html()
    p.feed(decoded(data))
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
    return {"text": "\n".join(x for x in lines if x), "title": p.title, "author": p.author, "n_parts": 1, "headings": p.headings}


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attribute(e, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), "")


def _core(z: zipfile.ZipFile) -> dict:
    root = _xml(z, "docProps/core.xml")
    own = {_tag(e): (e.text or "").strip() for e in root} if root is not None else {}
    return {"title": own.get("title", ""), "author": own.get("creator", "")}


def _text(e) -> str:
    return "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_tag(x), "") for x in e.iter())


def _from_docx(data: bytes) -> dict:
    """Paragraphs; those of a heading style, by its name, are headings."""
    z = zipfile.ZipFile(io.BytesIO(data))
    styles = _xml(z, "word/styles.xml")
    named = {}
    for s in styles if styles is not None else ():
        if _tag(s) == "style":
            named[_attribute(s, "styleId")] = next((_attribute(x, "val") for x in s if _tag(x) == "name"), "")
    lines, heads = [], []
    for p in _xml(z, "word/document.xml").iter():
        if _tag(p) != "p":
            continue
        line = _text(p).strip()
        style = next((_attribute(x, "val") for x in p.iter() if _tag(x) == "pStyle"), "")
        m = re.match(r"heading ?(\d)\Z", named.get(style, style), re.I)
        if line:
            lines.append(line)
            if m or named.get(style, style).lower() == "title":
                heads.append((int(m[1]) if m else 1, line, 0))
    return {"text": "\n".join(lines), "n_parts": 1, "headings": heads} | _core(z)


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.match(pattern + r"\Z", n))]
    return [n for _, n in sorted(found)]


def _from_pptx(data: bytes, most: int = 20) -> dict:
    """Slides; the titles of the first ``most`` are headings."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names, lines, heads = _numbered(z, r"ppt/slides/slide(\d+)\.xml"), [], []
    for i, name in enumerate(names, 1):
        for shape in _xml(z, name).iter():
            if _tag(shape) != "sp":
                continue
            line = "\n".join(t for p in shape.iter() if _tag(p) == "p" and (t := _text(p).strip()))
            kind = next((_attribute(x, "type") for x in shape.iter() if _tag(x) == "ph"), "")
            if line:
                lines.append(line)
                if kind in ("title", "ctrTitle") and len(heads) < most:
                    heads.append((1, " ".join(line.split()), i))
    return {"text": "\n".join(lines), "n_parts": len(names), "headings": heads} | _core(z)


def sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cell texts) of the sheets of a workbook."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = _xml(z, "xl/sharedStrings.xml")
    strings = [_text(s) for s in shared if _tag(s) == "si"] if shared is not None else []
    book = _xml(z, "xl/workbook.xml")
    titles = [_attribute(s, "name") for s in book.iter() if _tag(s) == "sheet"] if book is not None else []
    out = []
    for i, name in enumerate(_numbered(z, r"xl/worksheets/sheet(\d+)\.xml")):
        rows = []
        for r in _xml(z, name).iter():
            if _tag(r) != "row":
                continue
            row: list[str] = []
            for c in r:
                letters = re.match("[A-Z]*", _attribute(c, "r"))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                row += [""] * (max(at, len(row) + 1) - len(row) - 1)
                value = next((x.text or "" for x in c if _tag(x) == "v"), "")
                if _attribute(c, "t") == "s":
                    value = strings[int(value)] if value.isdigit() and int(value) < len(strings) else ""
                elif _attribute(c, "t") == "inlineStr":
                    value = _text(c)
                row.append(value)
            rows.append(row)
        out.append((titles[i] if i < len(titles) else f"Sheet{i + 1}", rows))
    return out


def sheet_digest(data: bytes, most: int = 10, rows: int = 100, least: int = 3, greatest: int = 50) -> str:
    """Markdown of the first rows of up to ``most`` sheets, the row budget shared out between them, with the numbers' ranges by column."""
    own = [s for s in sheets(data) if s[1]][:most]
    share = max(least, min(greatest, rows // max(1, len(own))))
    out = []
    for name, body in own:
        width = max(map(len, body))
        head, *rest = [r + [""] * (width - len(r)) for r in body]
        table = [head, ["---"] * width, *rest[:share]]
        out.append(f"## {name}\n" + "\n".join("| " + " | ".join(c.replace("|", "/") for c in r) + " |" for r in table))
        for j, title in enumerate(head):
            numbers = [float(r[j]) for r in rest if re.match(r"(?:-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\Z", r[j])]
            if numbers:
                out.append(f"{title}: {min(numbers):g} to {max(numbers):g}")
    return "\n".join(out)


def _from_xlsx(data: bytes) -> dict:
    own = sheets(data)
    return {"text": sheet_digest(data), "n_parts": len(own), "headings": [(1, n, i) for i, (n, _) in enumerate(own, 1)]} | _core(zipfile.ZipFile(io.BytesIO(data)))


class Pdf:
    """The objects of a PDF file that are readable without decryption."""

    def __init__(self, data: bytes) -> None:
        self.objects: dict[int, bytes] = {int(m[1]): m[2] for m in re.finditer(rb"(?s)(\d+)\s+\d+\s+obj\b(.*?)endobj", data)}
        self.trailer = b"".join(re.findall(rb"(?s)trailer(.*?)startxref", data))
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                plain = self.stream(body)
                n, first = (int(m[1]) if (m := re.search(rb"/" + k + rb"\s+(\d+)", body)) else 0 for k in (b"N", b"First"))
                heads = plain[:first].split()
                places = [(int(heads[2 * i]), int(heads[2 * i + 1])) for i in range(min(n, len(heads) // 2))]
                for (number, at), after in zip(places, [*[p[1] for p in places[1:]], len(plain) - first]):
                    self.objects.setdefault(number, plain[first + at : first + after])

    @staticmethod
    def stream(body: bytes) -> bytes:
        m = re.search(rb"(?s)stream\r?\n(.*?)\r?\n?endstream", body)
        if not m:
            return b""
        try:
            return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body else m[1]
        except zlib.error:
            return b""

    def follow(self, body: bytes, name: str) -> bytes:
        """What a reference under a name points to."""
        m = re.search(rb"/" + name.encode() + rb"\s+(\d+)\s+\d+\s+R", body)
        return self.objects.get(int(m[1]), b"") if m else b""

    @staticmethod
    def string(body: bytes, name: str) -> str:
        m = re.search(rb"(?s)/" + name.encode() + rb"\s*(?:\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>)", body)
        return Pdf.plain(m[1], m[2]) if m else ""

    @staticmethod
    def plain(literal: bytes | None, hexed: bytes | None) -> str:
        if hexed is not None:
            digits = re.sub(rb"\s", b"", hexed)
            raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            named = {b"n": b"\n", b"r": b"\r", b"t": b"\t"}
            raw = re.sub(rb"(?s)\\(\d{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else named.get(m[1], m[1]), literal or b"")
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")

    def pages(self) -> list[int]:
        """Object numbers of the pages, in the page tree's order."""
        root = self.follow(self.trailer, "Root") or next((b for b in self.objects.values() if b"/Catalog" in b), b"")
        out: list[int] = []

        def walk(number: int, seen: set[int]) -> None:
            if number in seen:
                return
            seen.add(number)
            body = self.objects.get(number, b"")
            if m := re.search(rb"(?s)/Kids\s*\[(.*?)\]", body):
                for kid in re.findall(rb"(\d+)\s+\d+\s+R", m[1]):
                    walk(int(kid), seen)
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(number)

        if m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root):
            walk(int(m[1]), set())
        return out or sorted(n for n, b in self.objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", b))

    def page_text(self, number: int) -> str:
        body = self.objects.get(number, b"")
        m = re.search(rb"(?s)/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", body)
        content = b"\n".join(self.stream(self.objects.get(int(n), b"")) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1] or m[2])) if m else b""
        out: list[str] = []
        token = rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT[*dDJjm]|['\"]"
        for t in re.findall(token, content):
            if t[:1] == b"(":
                out.append(self.plain(t[1:-1], None))
            elif t[:1] == b"<":
                out.append(self.plain(None, t[1:-1]))
            elif t in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"'):
                out.append("\n")
        return "\n".join(x for x in (" ".join(line.split()) for line in "".join(out).split("\n")) if x)

    def outline(self) -> list[tuple[int, str, int]]:
        """(level, title, page) of the bookmarks, in their order; page 0 where none is named."""
        pages = {n: i for i, n in enumerate(self.pages(), 1)}
        root = self.follow(self.follow(self.trailer, "Root") or next((b for b in self.objects.values() if b"/Catalog" in b), b""), "Outlines")
        out: list[tuple[int, str, int]] = []
        seen: set[int] = set()

        def walk(body: bytes, level: int) -> None:
            m = re.search(rb"/First\s+(\d+)\s+\d+\s+R", body)
            while m and int(m[1]) not in seen:
                seen.add(int(m[1]))
                own = self.objects.get(int(m[1]), b"")
                target = re.search(rb"/(?:Dest|D)\s*\[\s*(\d+)\s+\d+\s+R", own)
                if title := self.string(own, "Title").strip():
                    out.append((level, title, pages.get(int(target[1]), 0) if target else 0))
                walk(own, level + 1)
                m = re.search(rb"/Next\s+(\d+)\s+\d+\s+R", own)

        walk(root, 1)
        return out


def _from_pdf(data: bytes) -> dict:
    pdf = Pdf(data)
    info, pages = pdf.follow(pdf.trailer, "Info"), pdf.pages()
    text = "\n\f\n".join(pdf.page_text(n) for n in pages)
    return {"text": text, "title": pdf.string(info, "Title"), "author": pdf.string(info, "Author"), "n_parts": len(pages), "headings": pdf.outline()}


def _size(data: bytes, kind: str) -> dict:
    """Width and height of a picture."""
    if kind == "png":
        w, h = struct.unpack(">II", data[16:24])
    elif kind == "gif":
        w, h = struct.unpack("<HH", data[6:10])
    else:
        at = 2
        while data[at + 1] not in (0xC0, 0xC1, 0xC2):
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        h, w = struct.unpack(">HH", data[at + 5 : at + 9])
    return {"width": w, "height": h}


def _from_text(data: bytes) -> dict:
    text = decoded(data)
    heads = [(len(m[1]), m[2].strip(), 0) for m in re.finditer(r"(?m)^(#{1,6})[ \t]+(.+)$", text)]
    first = next((x.strip() for x in text.split("\n") if x.strip()), "")
    return {"text": text, "title": heads[0][1] if heads else first[:120], "n_parts": 1, "headings": heads}


READERS: dict[str, Callable[[bytes], dict]] = {"html": _from_html, "docx": _from_docx, "pptx": _from_pptx, "xlsx": _from_xlsx, "pdf": _from_pdf}


def extract_one(path: str, data: bytes | None) -> dict:
    """One file's row; an unreadable one has an error."""
    out: dict = {"path": path, "kind": None, "text": None, "title": None, "author": None, "n_parts": None, "headings": [], "width": None, "height": None, "error": None}
    if data is None:
        return out | {"error": "no content"}
    out["kind"] = kind = kind_of(path, data)
    try:
        if kind in ("png", "gif", "jpeg"):
            out |= _size(data, kind)
        elif kind != "zip":
            out |= READERS.get(kind, _from_text)(data)
    except Exception as error:  # noqa: BLE001  whatever a broken file raises
        out["error"] = f"{type(error).__name__}: {error}"[:200]
    out["headings"] = [{"level": a, "title": b, "part": c} for a, b, c in out["headings"]]
    for c in ("text", "title", "author"):
        if out[c] is not None:
            out[c] = out[c].replace("\x00", "").encode("utf-8", "replace").decode("utf-8")
    return out


def extract(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Text and metadata of files given as (path, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = pa.list_(pa.struct([("level", pa.int32()), ("title", pa.string()), ("part", pa.int32())]))
        kinds = [pa.string()] * 5 + [pa.int32(), head, pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # files may be large
                part = batch.slice(i, 64)
                rows = [extract_one(p, d) for p, d in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(_NAMES, kinds)], names=_NAMES)

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Text and metadata of the files in a folder and those below it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return extract(reader.load(folder).select("path", "content"))


def save_metadata(rows: DataFrame, path: str) -> None:
    """Append metadata rows as JSON lines."""
    rows.write.mode("append").json(path)


def load_metadata(spark: SparkSession, path: str, schema) -> DataFrame:
    """Metadata rows saved before, with their declared types."""
    return spark.read.schema(schema).json(path)


def as_html(column: str):
    """A text as an HTML page of one paragraph a line; the reverse of reading it."""
    escaped = F.replace(F.replace(F.replace(F.col(column), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<html><head><title>T</title></head><body><p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))


__all__ = ["Pdf", "as_html", "extract", "extract_one", "kind_of", "load_metadata", "read_files", "save_metadata", "sheet_digest", "sheets"]
