import io
import zipfile

import pytest

from tessera.sources import loaders
from tessera.sources.office import csv_text, docx_text, pptx_text

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in ("one", " ", "two")) + "</w:tr>"
    return zipped({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{p("First")}<w:tbl>{row}</w:tbl>{p(" ")}{p("Last &amp; least")}</w:body></w:document>'})


def pptx():
    slide = lambda *lines: f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree><p:sp><p:txBody>' + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines) + "</p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
    parts = {
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r3"/><p:sldId id="258" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/><Relationship Id="r3" Target="/ppt/slides/slide3.xml"/></Relationships>',
        "ppt/slides/slide1.xml": slide("shown last"), "ppt/slides/slide2.xml": slide("shown first", " ", "again"), "ppt/slides/slide3.xml": slide(" "),
    }
    return zipped(parts)


def test_delimited_tables():
    assert csv_text('a,b\n1,"x, y"\n\n , \n2\n3,4,5\n') == "Columns: a, b\n\na: 1, b: x, y\na: 2\na: 3, b: 4"
    assert csv_text("a\tb\n1\t2\n3\t4", "\t", max_rows=1, header=False) == "a: 1, b: 2"
    assert csv_text("a,b\n , \n3,4", max_rows=1, header=False) == ""
    assert csv_text("") == ""


def test_word_files_and_slides():
    assert docx_text(docx()) == "First\nLast & least\none\ttwo"
    assert pptx_text(pptx()) == "--- Slide 1 ---\n\nshown first\nagain\n\n--- Slide 3 ---\n\nshown last"
    with pytest.raises(zipfile.BadZipFile):
        docx_text(b"no zip file")


def test_they_load_by_suffix(spark, tmp_path):
    for name, data in (("a.csv", b"k,v\n1,2"), ("b.tsv", b"k\tv\n1\t2"), ("c.docx", docx()), ("d.pptx", pptx()), ("e.docx", b"bad"), ("f.pdf", b"x")):
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rpartition("/")[2]: r for r in loaders.load(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert rows["a.csv"].text == rows["b.tsv"].text == "Columns: k, v\n\nk: 1, v: 2"
    assert rows["c.docx"].text.startswith("First") and rows["d.pptx"].text.startswith("--- Slide 1 ---")
    assert rows["e.docx"].text is None and rows["e.docx"].error.startswith("BadZipFile")
    assert rows["f.pdf"].error == "no reader installed for .pdf" and len(rows) == 6
