"""Texts of delimited tables, Word files and slides, with the standard library alone (the last two are XML in zip files)."""

from __future__ import annotations

import csv
import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Bytes to which one part of a zip file may unpack.
LARGEST = 256 << 20


def csv_text(text: str, sep: str = ",", max_rows: int | None = None, header: bool = True) -> str:
    """``k: v`` of a table's cells that aren't blank, a line for each row, under a line that names the columns.

    Rows without such a cell give no line but count for ``max_rows``. Cells beyond the header are left out."""
    rows = (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r)
    names = next(rows, [])
    out = [f"Columns: {', '.join(names)}\n"] if header and names else []
    for n, row in enumerate(rows):
        if n == max_rows:
            break
        cells = dict(zip(names, row))
        said = ", ".join(f"{k}: {v}" for k, v in cells.items() if v.strip())
        if said:
            out.append(said)
    return "\n".join(out)


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if z.getinfo(name).file_size > LARGEST:
        raise ValueError(f"{name} unpacks to more than {LARGEST} bytes")
    return ElementTree.fromstring(z.read(name))


def _paragraph(p: ElementTree.Element) -> str:
    said = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    runs = (x for r in p if r.tag in (f"{_WORD}r", f"{_WORD}hyperlink") for x in r.iter())
    return "".join(x.text or "" if x.tag == f"{_WORD}t" else said.get(x.tag, "") for x in runs)


def docx_text(data: bytes) -> str:
    """The paragraphs of a Word file's body, then its tables: a line for each row, cells between tabs; blank ones go."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _part(z, "word/document.xml").find(f"{_WORD}body")
    if body is None:
        return ""
    out = [_paragraph(p).strip() for p in body.findall(f"{_WORD}p")]
    for row in (r for t in body.findall(f"{_WORD}tbl") for r in t.findall(f"{_WORD}tr")):
        cells = ("\n".join(map(_paragraph, c.findall(f"{_WORD}p"))).strip() for c in row.findall(f"{_WORD}tc"))
        out.append("\t".join(c for c in cells if c))
    return "\n".join(x for x in out if x)


def _slides(z: zipfile.ZipFile) -> Iterator[ElementTree.Element]:
    """Slides in the order in which the presentation shows them."""
    at = {r.get("Id"): r.get("Target") for r in _part(z, "ppt/_rels/presentation.xml.rels")}
    for s in _part(z, "ppt/presentation.xml").iter(f"{_SLIDE}sldId"):
        yield _part(z, posixpath.normpath(posixpath.join("/ppt", at[s.get(_LINK)])).lstrip("/"))


def pptx_text(data: bytes) -> str:
    """The text of each slide's shapes, a line for each paragraph, under ``--- Slide N ---``; slides without any go."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n, slide in enumerate(_slides(z), 1):
            shapes = (b for s in slide.findall(f".//{_SLIDE}spTree/{_SLIDE}sp") for b in s.findall(f"{_SLIDE}txBody"))
            lines = ["".join(t.text or "" for t in p.findall(f"{_DRAW}r/{_DRAW}t")).strip() for b in shapes for p in b.findall(f"{_DRAW}p")]
            if any(lines):
                out.append(f"--- Slide {n} ---\n\n" + "\n".join(x for x in lines if x))
    return "\n\n".join(out)
