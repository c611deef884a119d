"""PDF files made here: classic and packed ones, odd and broken ones, and how Spark reads them."""

import zlib

import pytest

from almanac.plans import papers
from almanac.sources import ingest, pdf


def classic(content, font="<</Type/Font/Subtype/Type1/BaseFont/Helvetica/FirstChar 32/Widths[500]>>", more="", extra=b""):
    parts = [b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj", b"2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 600 800]>> endobj",
        b"3 0 obj <</Type/Page/Parent 2 0 R/MediaBox[0 0 600 800]/Resources<</Font<</F1 4 0 R>>" + more.encode() + b">>/Contents 5 0 R>> endobj", b"4 0 obj " + font.encode() + b" endobj",
        b"5 0 obj <</Length %d>>\nstream\n" % len(content) + content + b"\nendstream endobj", extra, b"trailer <</Root 1 0 R>>"]
    return b"\n".join(parts)


def shown(data):
    return [(w.page, w.word) for w in pdf.words(data)]


def test_text_operators():
    body = rb"""BT /F1 10 Tf 50 700 Td (Hello w\157rld) Tj 0 -20 Td [(Spl) 20 (it) -2000 (gap \(a\))] TJ 12 TL T* (next) Tj (again) ' ET
% a comment
q 1 0 0 1 100 0 cm BT /F1 10 Tf 1 0 0 1 0 600 Tm (moved) Tj ET Q BT /F1 10 Tf 10 500 Td <4869> Tj ET"""
    found = pdf.words(classic(body))
    assert [w.word for w in found] == ["Hello", "world", "Split", "gap", "(a)", "next", "again", "moved", "Hi"]
    assert (found[0].x, found[0].y) == (50, 100) and found[2].y == 120 and found[5].y == 132 and found[6].y == 144
    assert (found[7].x, found[7].y) == (100, 200) and found[1].x == 80


def test_latin_and_mapped_letters():
    assert shown(classic(b"BT /F1 9 Tf (\xe9t\xe9 \x96) Tj ET")) == [(1, "été"), (1, "–")]
    cmap = b"6 0 obj <</Length 99>>\nstream\n2 beginbfchar <01> <0041> <02> <00660069> endbfchar 1 beginbfrange <03> <05> <0061> endbfrange\nendstream endobj"
    assert shown(classic(b"BT /F1 9 Tf <0102030405> Tj ET", "<</Type/Font/Subtype/Type1/ToUnicode 6 0 R>>", extra=cmap)) == [(1, "Afiabc")]


def test_forms_are_read():
    form = b"6 0 obj <</Type/XObject/Subtype/Form/Length 30>>\nstream\nBT /F1 9 Tf 5 5 Td (inner) Tj ET\nendstream endobj"
    assert shown(classic(b"/X Do", more="/XObject<</X 6 0 R>>", extra=form)) == [(1, "inner")]


def packed():
    """Objects in an object stream, packed with the Up predictor, and a cross-reference stream in place of a table."""
    inner = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R]/Count 1>>"), (3, b"<</Type/Page/Parent 2 0 R/Contents[5 0 R]/Resources<</Font<</F1 4 0 R>>>>>>"), (4, b"<</Type/Font/Subtype/TrueType>>")]
    heads, bodies = b"", b""
    for n, body in inner:
        heads += b"%d %d " % (n, len(bodies))
        bodies += body + b" "
    plain = heads + bodies
    plain += b" " * (-len(plain) % 16)
    above, rows = bytes(16), b""
    for at in range(0, len(plain), 16):
        row = plain[at : at + 16]
        rows += b"\2" + bytes((a - b) % 256 for a, b in zip(row, above, strict=True))
        above = row
    data, content = zlib.compress(rows), zlib.compress(b"BT /F1 10 Tf (packed words) Tj ET")
    return b"%%PDF-1.5\n5 0 obj <</Filter/FlateDecode/Length %d>> stream\n" % len(content) + content + (
        b"\nendstream endobj\n7 0 obj <</Type/ObjStm/N 4/First %d/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 16>>/Length %d>> stream\n" % (len(heads), len(data))
    ) + data + b"\nendstream endobj\n8 0 obj <</Type/XRef/Root 1 0 R/Length 0>> stream\n\nendstream endobj startxref 0 %%EOF"


def test_object_streams():
    assert shown(packed()) == [(1, "packed"), (1, "words")]


def test_later_objects_replace_earlier_ones():
    update = b"5 0 obj <</Length 30>>\nstream\nBT /F1 10 Tf (new) Tj ET\nendstream endobj"
    assert shown(classic(b"BT /F1 10 Tf (old) Tj ET", extra=update)) == [(1, "new")]


@pytest.mark.parametrize("data", [b"", b"text", b"%PDF-1.4\n", packed()[:120], b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[2 0 R]>> endobj", classic(b"BT (x) Tj ET", extra=b"trailer <</Encrypt 9 0 R>>")])
def test_files_that_cannot_be_read(data):
    with pytest.raises(ValueError):
        pdf.words(data)


def test_made_files_come_back():
    texts = ["#1\nab cd\nef", "", "#3\nzażółć 漢字 😀 x"]
    assert [w for _, w in shown(papers.made(texts).encode())] == ["#1", "ab", "cd", "ef", "#3", "zażółć", "漢字", "😀", "x"]
    assert {p for p, _ in shown(papers.made(texts).encode())} == {1, 3}


def test_folder_with_good_bad_and_blank_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(papers.made(["one two\nthree", "", "four"]).encode())
    (tmp_path / "b.PDF").write_bytes(b"no pdf")
    (tmp_path / "c.pdf").write_bytes(papers.made([""]).encode())
    (tmp_path / "d.txt").write_bytes(b"other")
    files = ingest.pdf_files(spark, str(tmp_path))
    got = {r["source_file"]: (r["text"], r["error"]) for r in ingest.texts(files).collect()}
    assert set(got) == {"a.pdf", "b.PDF", "c.pdf"}
    assert [" ".join(p.split()) for p in got["a.pdf"][0].split("\f")] == ["one two three", "", "four"]
    assert got["b.PDF"] == (None, "ValueError: not a PDF file") and got["c.pdf"] == ("", None)
    assert [r["path"][-5:] for r in ingest.pdf_files(spark, str(tmp_path), 2).orderBy("path").collect()] == ["a.pdf", "b.PDF"]
    assert len(ingest.texts(ingest.pdf_files(spark, str(tmp_path), 1)).collect()) == 1


def test_paths_alone_decode_nothing(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    plan = ingest.documents(ingest.pdf_files(spark, str(tmp_path))).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema: struct<path:string>" in plan
