import zipfile

import pytest

from lorestream.sources import office as O


@pytest.mark.parametrize("kind", O.KINDS)
def test_lines_come_back(kind):
    lines = [f"line {i} <&> é\t\"x\"" for i in range(120)]
    pages = list(O.read(O.write(kind, lines, "T & t"), kind))
    assert {(p[3], p[5]) for p in pages} == {("T & t", "ok")} and [p[0] for p in pages] == list(range(1, len(pages) + 1))
    text = "\n".join(p[2] for p in pages).split("\n")
    if kind == "docx":
        assert text == lines and [p[1] for p in pages] == [50, 50, 20]
    elif kind == "xlsx":
        assert text[:4] == ["=== Sheet: Lines ===", "", "Columns: n, line", ""] and text[4:] == [f"Row {i}: n: {i} | line: {x}" for i, x in enumerate(lines, 1)]
    else:
        assert len(pages) == 24 and text[:7] == ["--- Slide 1 ---", *lines[:5], "[Speaker note] note 1"]


def test_odd_parts():
    w = O._W[1:-1]
    body = '<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>'
    made = O._zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'})
    assert [r[:3] for r in O.read(made, "docx")] == [(1, 1, "a\tb\n")]  # tables are not read
    a, p = O._A[1:-1], O._P[1:-1]
    line = lambda x: f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>"
    slide = f'<p:sld xmlns:a="{a}" xmlns:p="{p}"><p:grpSp><p:sp>{line("in a group")}</p:sp></p:grpSp><a:tbl><a:tr><a:tc>{line("x")}</a:tc><a:tc>{line("y")}</a:tc></a:tr></a:tbl></p:sld>'
    parts = {"ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" xmlns:r="{O._R[1:-1]}"><p:sldId r:id="r1"/></p:presentation>', "ppt/_rels/presentation.xml.rels": O._rels([("slide", "slides/slide1.xml")]), "ppt/slides/slide1.xml": slide}
    assert [r[2] for r in O.read(O._zipped(parts), "pptx")] == ["--- Slide 1 ---\nin a group\nx | y"]


def test_statuses(monkeypatch):
    good = O.write("docx", ["x"])
    assert [r[5] for r in O.read(O.write("docx", []), "docx")] == ["empty"]
    assert [r[5] for x in (good[: len(good) // 2], b"", None, O.write("pptx", ["x"])) for r in O.read(x, "docx")] == ["corrupt"] * 4
    assert [r[5] for r in O.read(good, "pdf")] == ["unsupported"] == [r[5] for r in O.read(good, None)]
    monkeypatch.setattr(O, "LARGEST", 10)
    assert [r[5] for r in O.read(good, "docx")] == ["too_large"]


def test_files_in_a_folder(spark, tmp_path):
    from lorestream.sources import files

    for kind in O.KINDS:
        (tmp_path / f"a.{kind}").write_bytes(O.write(kind, ["one", "two"]))
    (tmp_path / "b.docx").write_bytes(b"PK not a zip")
    out = O.office_pages(files.listing(spark, str(tmp_path)).select("path", "extension", "content")).collect()
    assert sorted((r.path[-6:], r.status, r.n_lines) for r in out) == [("a.docx", "ok", 2), ("a.pptx", "ok", 4), ("a.xlsx", "ok", 6), ("b.docx", "corrupt", None)]
    assert zipfile.is_zipfile(tmp_path / "a.docx")
