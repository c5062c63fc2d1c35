"""DOCX, XLSX and PPTX: pages of text out of bytes, by a table function joined laterally, and bytes out of lines.

The formats are zipped XML, which the standard library reads. A file that cannot be
read gives one row with a status and the error, no page and no failure of the job.
Tables in DOCX are not read; a sheet's first row names its columns; a slide's title
line, shapes, groups, tables and speaker notes follow each other.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

KINDS = ("docx", "xlsx", "pptx")
SCHEMA = "page_number int, n_lines int, text string, title string, author string, status string, error string"
#: A part that unpacks to more than this is not read: status too_large.
LARGEST = 512 << 20

# Namespaces of the formats.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DC = "{http://purl.org/dc/elements/1.1/}"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


class _TooLarge(Exception):
    pass


class _Parts:
    """The XML parts of a zipped file."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def __call__(self, name: str) -> ElementTree.Element | None:
        if name not in self.names:
            return None
        if self.zip.getinfo(name).file_size > LARGEST:
            raise _TooLarge(name)
        return ElementTree.fromstring(self.zip.read(name))

    def links(self, name: str) -> dict[str, tuple[str, str]]:
        """Target and kind of each relation of a part, by id."""
        folder, _, base = name.rpartition("/")
        found = self(f"{folder}/_rels/{base}.rels")
        out = {}
        for x in found if found is not None else ():
            steps = [] if x.get("Target", "").startswith("/") else folder.split("/")
            for step in x.get("Target", "").strip("/").split("/"):
                steps = steps[:-1] if step == ".." else [*steps, step]
            out[x.get("Id")] = "/".join(steps), x.get("Type", "").rpartition("/")[2]
        return out


def _docx(parts: _Parts) -> list[list[str]]:
    body = parts("word/document.xml").find(f"{_W}body")
    lines = []
    for paragraph in body.findall(f"{_W}p"):
        text = "".join((x.text or "") if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else "" for x in paragraph.iter())
        if text.strip():
            lines.append(text)
    return [lines[i : i + 50] for i in range(0, len(lines), 50)]


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    value = cell.find(f"{_S}v")
    if cell.get("t") == "inlineStr":
        return "".join(x.text or "" for x in cell.iter(f"{_S}t"))
    if value is None or value.text is None:
        return ""
    return shared[int(value.text)] if cell.get("t") == "s" else value.text


def _column(name: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", name or "").group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _xlsx(parts: _Parts) -> list[list[str]]:
    strings = parts("xl/sharedStrings.xml")
    shared = ["".join(x.text or "" for x in item.iter(f"{_S}t")) for item in strings] if strings is not None else []
    links, lines = parts.links("xl/workbook.xml"), []
    for sheet in parts("xl/workbook.xml").iter(f"{_S}sheet"):
        rows = []
        for row in parts(links[sheet.get(f"{_R}id")][0]).iter(f"{_S}row"):
            values: list[str] = []
            for i, cell in enumerate(row.findall(f"{_S}c")):
                at = _column(cell.get("r")) if cell.get("r") else i
                values += [""] * (at + 1 - len(values))
                values[at] = _cell(cell, shared)
            rows.append(values)
        head = rows[0] if rows else []
        lines += [""] * bool(lines) + [f"=== Sheet: {sheet.get('name')} ===", "", "Columns: " + ", ".join(head), ""]
        lines += [f"Row {n}: " + " | ".join(f"{c}: {v}" for c, v in zip(head, row + [""] * len(head))) for n, row in enumerate(rows[1:], 1)]
    return [lines[i : i + 50] for i in range(0, len(lines), 50)]


def _paragraphs(at: ElementTree.Element) -> list[str]:
    """Lines of a slide's shapes in order; the cells of a table's row are one line."""
    if at.tag == f"{_A}tr":
        cells = [" ".join(_paragraphs(c)) for c in at.findall(f"{_A}tc")]
        return [" | ".join(c for c in cells if c)] if any(cells) else []
    if at.tag == f"{_A}p":
        text = "".join(x.text or "" for x in at.iter(f"{_A}t")).strip()
        return [text] if text else []
    return [line for x in at for line in _paragraphs(x)]


def _pptx(parts: _Parts) -> list[list[str]]:
    links, out = parts.links("ppt/presentation.xml"), []
    for n, item in enumerate(parts("ppt/presentation.xml").iter(f"{_P}sldId"), 1):
        name = links[item.get(f"{_R}id")][0]
        lines = _paragraphs(parts(name))
        for target, kind in parts.links(name).values():
            if kind == "notesSlide":
                for shape in parts(target).iter(f"{_P}sp"):
                    place = next(shape.iter(f"{_P}ph"), None)
                    lines += [f"[Speaker note] {x}" for x in _paragraphs(shape)] if place is not None and place.get("type") == "body" else []
        if lines:
            out.append([f"--- Slide {n} ---", *lines])
    return out


_READERS = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}


def read(content: bytes | None, extension: str | None) -> Iterator[tuple]:
    """Rows of SCHEMA: a page each; one row with a status where there is none."""
    title = author = None
    try:
        if extension not in _READERS:
            yield None, None, None, None, None, "unsupported", f"extension {extension}"
            return
        parts = _Parts(content or b"")
        core = parts("docProps/core.xml")
        if core is not None:
            title, author = (core.findtext(f"{_DC}{x}") or None for x in ("title", "creator"))
        pages = _READERS[extension](parts)
    except _TooLarge as e:
        yield None, None, None, None, None, "too_large", str(e)
        return
    except Exception as e:  # whatever a broken file brings about is its status
        yield None, None, None, None, None, "corrupt", f"{type(e).__name__}: {e}"[:200]
        return
    if not pages:
        yield 1, 0, "", title, author, "empty", None
    for n, lines in enumerate(pages, 1):
        yield n, len(lines), "\n".join(lines), title, author, "ok", None


class OfficePages:
    def eval(self, content: bytes, extension: str) -> Iterator[tuple]:
        yield from read(content, extension)


def office_pages(files: DataFrame) -> DataFrame:
    """files(content, extension, ...) with a row for each page: page_number, n_lines, text, title, author, status, error."""
    pages = F.udtf(OfficePages, returnType=SCHEMA)
    return files.lateralJoin(pages(F.col("content").outer(), F.col("extension").outer())).drop("content")


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(zipfile.ZipInfo(name), f'<?xml version="1.0" encoding="UTF-8"?>{xml}'.encode())
    return out.getvalue()


def _rels(links: list[tuple[str, str]]) -> str:
    inner = "".join(f'<Relationship Id="r{i}" Type="{_LINKS}/{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(links, 1))
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


def _safe(text: str) -> str:
    return escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", text), {"\r": "&#13;"})


def write(kind: str, lines: list[str], title: str = "", per_slide: int = 5) -> bytes:
    """A minimal file of these lines: paragraphs, rows of a sheet with their numbers, or slides with a note each."""
    core = f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="{_DC[1:-1]}"><dc:title>{_safe(title)}</dc:title></cp:coreProperties>'
    parts = {"docProps/core.xml": core}
    if kind == "docx":
        inner = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_safe(x)}</w:t></w:r></w:p>' for x in lines)
        parts["word/document.xml"] = f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{inner}</w:body></w:document>'
    elif kind == "xlsx":
        strings = ["n", "line", *lines]
        rows = "".join(f'<row r="{i + 1}"><c r="A{i + 1}"><v>{i}</v></c><c r="B{i + 1}" t="s"><v>{i + 1}</v></c></row>' for i in range(1, len(lines) + 1))
        parts["xl/workbook.xml"] = f'<workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets><sheet name="Lines" sheetId="1" r:id="r1"/></sheets></workbook>'
        parts["xl/_rels/workbook.xml.rels"] = _rels([("worksheet", "worksheets/sheet1.xml")])
        parts["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="{_S[1:-1]}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>{rows}</sheetData></worksheet>'
        parts["xl/sharedStrings.xml"] = f'<sst xmlns="{_S[1:-1]}">' + "".join(f'<si><t xml:space="preserve">{_safe(x)}</t></si>' for x in strings) + "</sst>"
    elif kind == "pptx":
        space = f'xmlns:a="{_A[1:-1]}" xmlns:p="{_P[1:-1]}" xmlns:r="{_R[1:-1]}"'
        shape = lambda x, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{_safe(y)}</a:t></a:r></a:p>" for y in x)}</p:txBody></p:sp>'
        slides = [lines[i : i + per_slide] for i in range(0, len(lines), per_slide)]
        parts["ppt/presentation.xml"] = f"<p:presentation {space}><p:sldIdLst>" + "".join(f'<p:sldId id="{255 + n}" r:id="r{n}"/>' for n in range(1, len(slides) + 1)) + "</p:sldIdLst></p:presentation>"
        parts["ppt/_rels/presentation.xml.rels"] = _rels([("slide", f"slides/slide{n}.xml") for n in range(1, len(slides) + 1)])
        for n, part in enumerate(slides, 1):
            parts[f"ppt/slides/slide{n}.xml"] = f"<p:sld {space}><p:cSld><p:spTree>{shape(part)}</p:spTree></p:cSld></p:sld>"
            parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = _rels([("notesSlide", f"../notesSlides/notesSlide{n}.xml")])
            body = shape([f"note {n}"], '<p:ph type="body"/>')
            parts[f"ppt/notesSlides/notesSlide{n}.xml"] = f"<p:notes {space}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:notes>"
    else:
        raise ValueError(kind)
    return _zipped(parts)


@F.pandas_udf(BinaryType())
def office_bytes(kind: pd.Series, lines: pd.Series, title: pd.Series) -> pd.Series:
    """A file of this kind with these lines."""
    return pd.Series([write(k, list(x), t or "") for k, x, t in zip(kind, lines, title)])
