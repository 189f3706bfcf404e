"""Elements of office files (zips of XML): paragraphs and tables of texts, slides with tables and notes, sheets of workbooks.

Files come as (path, content), such as Spark's binaryFile source gives from any store that it reads; each is parsed in the task that holds it,
part after part, and a file gives a row for each element. What can't be read (not a zip, a broken part) gives one row of kind "error".
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: XML namespaces of office files.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
ENDINGS = (".docx", ".docm", ".pptx", ".xlsx")
CELL_TEXT = 20_000
#: Files that a task holds as Python objects at a time.
SLICE = 64
FIELDS = [("path", pa.string()), ("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("slide_number", pa.int32()), ("sheet_name", pa.string()), ("row_number", pa.int32())]
SCHEMA = "path string, position int, kind string, text string, slide_number int, sheet_name string, row_number int"
Element = tuple[str, str, int | None, str | None, int | None]


def clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _related(z: zipfile.ZipFile, part: str, kind: str) -> dict[str, str]:
    """id -> part of a part's relations of one kind."""
    folder, _, name = part.rpartition("/")
    at = f"{folder}/_rels/{name}.rels"
    if at not in z.namelist():
        return {}
    out = {}
    for rel in ElementTree.fromstring(z.read(at)).iter(f"{RELS}Relationship"):
        if rel.get("Type", "").endswith("/" + kind):
            steps = rel.get("Target", "").lstrip("/").split("/") if rel.get("Target", "").startswith("/") else [*folder.split("/"), *rel.get("Target", "").split("/")]
            path: list[str] = []
            for step in steps:
                path = path[:-1] if step == ".." else [*path, step] if step not in ("", ".") else path
            out[rel.get("Id")] = "/".join(path)
    return out


def _said(frame, paragraph: str = f"{A}p", run: str = f"{A}t") -> str:
    lines = [clean("".join(t.text or "" for t in p.iter(run))) for p in frame.iter(paragraph)]
    return "\n".join(x for x in lines if x)


def slides(z: zipfile.ZipFile) -> Iterator[Element]:
    """For each slide, in the presentation's order: tables and their rows, then the text of its frames with the speaker's notes."""
    known = _related(z, "ppt/presentation.xml", "slide")
    ordered = [known[s.get(f"{R}id")] for s in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{P}sldId") if s.get(f"{R}id") in known]
    for number, part in enumerate(ordered, 1):
        texts = []
        for shape in ElementTree.fromstring(z.read(part)).iter():
            if shape.tag == f"{P}sp":
                texts += [_said(body) for body in shape.findall(f"{P}txBody")]
            elif shape.tag == f"{A}tbl":
                yield "table", f"Slide {number} table", number, None, None
                for k, row in enumerate(shape.findall(f"{A}tr"), 1):
                    yield "table_row", " | ".join(_said(cell).replace("\n", " ") for cell in row.findall(f"{A}tc"))[:CELL_TEXT], number, None, k
        for notes in _related(z, part, "notesSlide").values():
            bodies = [s for s in ElementTree.fromstring(z.read(notes)).iter(f"{P}sp") if any(x.get("type") == "body" for x in s.iter(f"{P}ph"))]
            texts += [f"Speaker notes: {said}" for s in bodies if (said := _said(s))]
        if text := "\n".join(x for x in texts if x):
            yield "text", text, number, None, None


def paragraphs(z: zipfile.ZipFile) -> Iterator[Element]:
    """Paragraphs and table rows of a text, in order."""
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    for part in body if body is not None else []:
        if part.tag == f"{W}p":
            if text := clean("".join(t.text or "" for t in part.iter(f"{W}t"))):
                yield "text", text, None, None, None
        elif part.tag == f"{W}tbl":
            for k, row in enumerate(part.iter(f"{W}tr"), 1):
                cells = [clean("".join(t.text or "" for t in c.iter(f"{W}t"))) for c in row.iter(f"{W}tc")]
                if any(cells):
                    yield "table_row", " | ".join(cells)[:CELL_TEXT], None, None, k


def sheets(z: zipfile.ZipFile) -> Iterator[Element]:
    """The rows of each sheet that hold something, cells in place; shared and inline strings, numbers as they are written."""
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
    known = _related(z, "xl/workbook.xml", "worksheet")
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
        if sheet.get(f"{R}id") not in known:
            continue
        name = sheet.get("name")
        yield "table", f"Workbook sheet: {name}", None, name, None
        for row in ElementTree.fromstring(z.read(known[sheet.get(f"{R}id")])).iter(f"{S}row"):
            cells: dict[int, str] = {}
            for k, cell in enumerate(row.findall(f"{S}c")):
                value, kind = cell.findtext(f"{S}v"), cell.get("t")
                text = "".join(t.text or "" for t in cell.iter(f"{S}t")) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else value
                cells[_column(cell.get("r")) if cell.get("r") else k] = clean(text or "")
            if any(cells.values()):
                yield "table_row", " | ".join(cells.get(k, "") for k in range(max(cells) + 1))[:CELL_TEXT], None, name, int(row.get("r") or 0) or None


def _column(place: str) -> int:
    """The number, from 0, of the column of a place such as AB12."""
    n = 0
    for letter in re.match("[A-Z]+", place).group():
        n = 26 * n + ord(letter) - 64
    return n - 1


PARSERS = {".docx": paragraphs, ".docm": paragraphs, ".pptx": slides, ".xlsx": sheets}


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of up to SLICE rows, so that a task makes or opens so many files at a time, however many its batches hold."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def elements(files: DataFrame) -> DataFrame:
    """path, position, kind (text, table, table_row, error), text, slide_number, sheet_name, row_number of files (path, content) with one of ENDINGS; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(BytesIO(content or b"")) as z:
                        rows += PARSERS[path[path.rfind(".") :].lower()](z)
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as problem:
                    rows.append(("error", f"{type(problem).__name__}: {problem}", None, None, None))
                columns = [[path] * len(rows), list(range(len(rows))), *map(list, zip(*rows))] if rows else [[]] * len(FIELDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], names=[n for n, _ in FIELDS])

    wanted = F.lower("path").rlike("(?:" + "|".join(re.escape(e) for e in ENDINGS) + ")$")
    return files.where(wanted).select("path", "content").mapInArrow(run, SCHEMA)


def office_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the office files under a folder of any store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,docm,pptx,xlsx,DOCX,PPTX,XLSX}").load(root)
    return files.select("path", "content")


# ---- writing ------------------------------------------------------------------------------------------------------


def _zipped(parts: dict[str, str]) -> bytes:
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)  # without times, so that equal parts give equal bytes
    return out.getvalue()


def _rels(entries: list[tuple[str, str, str]]) -> str:
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return f'<Relationships xmlns="{RELS[1:-1]}">' + "".join(f'<Relationship Id="{i}" Type="{kind}/{t}" Target="{to}"/>' for i, t, to in entries) + "</Relationships>"


def presentation(pages: list[tuple[str, list[list[str]], str]]) -> bytes:
    """A presentation of slides (text, table, notes): what `slides` reads, for exports and tests."""
    names, said = f'xmlns:a="{A[1:-1]}" xmlns:p="{P[1:-1]}" xmlns:r="{R[1:-1]}"', lambda x: "".join(f"<a:p><a:r><a:t>{escape(line)}</a:t></a:r></a:p>" for line in x.split("\n"))
    parts = {"ppt/presentation.xml": f"<p:presentation {names}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + k}" r:id="s{k}"/>' for k in range(len(pages))) + "</p:sldIdLst></p:presentation>"}
    parts["ppt/_rels/presentation.xml.rels"] = _rels([(f"s{k}", "slide", f"slides/slide{k + 1}.xml") for k in range(len(pages))])
    for k, (text, table, notes) in enumerate(pages, 1):
        rows = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{said(c)}</a:txBody></a:tc>" for c in row) + "</a:tr>" for row in table)
        drawn = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>" if table else ""
        parts[f"ppt/slides/slide{k}.xml"] = f"<p:sld {names}><p:cSld><p:spTree><p:sp><p:txBody>{said(text)}</p:txBody></p:sp>{drawn}</p:spTree></p:cSld></p:sld>"
        if notes:
            parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = _rels([("n1", "notesSlide", f"../notesSlides/notesSlide{k}.xml")])
            parts[f"ppt/notesSlides/notesSlide{k}.xml"] = f'<p:notes {names}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody>{said(notes)}</p:txBody></p:sp></p:spTree></p:cSld></p:notes>'
    return _zipped(parts)


def text_document(texts: list[str], table: list[list[str]]) -> bytes:
    """A text document of paragraphs and, after them, a table."""
    said = lambda x: f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{said(c)}</w:tc>" for c in row) + "</w:tr>" for row in table)
    body = "".join(map(said, texts)) + (f"<w:tbl>{rows}</w:tbl>" if table else "")
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'})


def workbook(pages: list[tuple[str, list[list[str]]]]) -> bytes:
    """A workbook of sheets (name, rows of cells), with inline strings."""
    names = f'xmlns="{S[1:-1]}" xmlns:r="{R[1:-1]}"'
    parts = {"xl/workbook.xml": f"<workbook {names}><sheets>" + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="w{k}"/>' for k, (n, _) in enumerate(pages, 1)) + "</sheets></workbook>"}
    parts["xl/_rels/workbook.xml.rels"] = _rels([(f"w{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(pages) + 1)])
    for k, (_, rows) in enumerate(pages, 1):
        told = "".join(f'<row r="{n}">' + "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in row) + "</row>" for n, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {names}><sheetData>{told}</sheetData></worksheet>"
    return _zipped(parts)
