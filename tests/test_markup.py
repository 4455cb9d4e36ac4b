"""Documents are turned into rows a piece of the file at a time: texts across its seams stay one, and rows come before the end is read."""

import io
import zipfile

from attesta.plans import registry
from attesta.sources import markup
from tests.test_oracles import DATA


def test_a_long_text_of_a_cell_stays_whole(spark):
    """Longer than the parser's buffer and than a piece of the file, with a character of two bytes on a seam."""
    word = "x" * 8_999 + "\u00e9" * 70_000
    article = f"<article><body><sec><title>R</title><table-wrap><label>L</label><table><tr><td>{word}</td><td>b</td></tr></table></table-wrap></sec></body></article>"
    got = markup.article_segments(spark.createDataFrame([("a", bytearray(article.encode()))], "document_id string, content binary")).collect()
    assert [(r["locator"], r["text"], r["section"], r["status"]) for r in got] == [("xml:block=1", f"L ; {word} | b", "R", "ok")]


def test_rows_come_in_pieces_and_a_bad_end_gives_none():
    data = b"<a>" + b"<p>x</p>" * 100_000
    rows = markup.rows_of(data + b"</a>", {"p": ("", None)})
    first = next(rows)
    rest = list(rows)
    assert first[:5] == (2, 1, "p", [], "x") and len(rest) == 100_000 and rest[-1][:3] == (1, None, "a")
    try:
        next(markup.rows_of(data, {"p": ("", None)}))
        raise AssertionError("a document without its end was read")
    except ValueError as e:
        assert "malformed" in str(e)


def packed(**members) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return bytearray(out.getvalue())


def test_a_file_of_any_size_is_read_and_a_failure_says_so(spark):
    """A trusted file over the bytes that others may have; a file over them and one with broken bytes fail by status."""
    large = packed(**{"word/document.xml": "<w:document xmlns:w='u'><w:body><w:p><w:t>a</w:t></w:p>" + " " * (49 << 20) + "<w:p><w:t>b</w:t></w:p></w:body></w:document>"})
    broken = packed(**{"word/document.xml": "<w:document xmlns:w='u'><w:p><w:t>" + "".join(map(str, range(9_999))) + "</w:t></w:p></w:document>"})
    broken[2_000:2_100] = bytes(100)
    files = spark.createDataFrame([("large", large), ("broken", broken)], "document_id string, content binary")
    got = lambda df: sorted((r["document_id"], r["locator"], r["text"], r["status"]) for r in df.collect())
    failed = ("broken", None, None, "failed")
    assert got(markup.word_segments(files)) == [failed, ("large", None, None, "failed")]
    assert got(markup.word_segments(files, most_expanded=None)) == [failed, ("large", "docx:paragraph=1", "a", "ok"), ("large", "docx:paragraph=2", "b", "ok")]
    assert "status" in registry.queries()["word_segments"](spark, DATA).columns  # before: a failed file was a row like any other


def test_a_workbook_that_leads_nowhere_fails(spark):
    row = '<row r="1"><c r="A1" t="s"><v>0</v></c></row>'
    parts = {"xl/workbook.xml": '<workbook xmlns:r="u"><sheets><sheet name="M" r:id="i"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="i" Target="s.xml"/></Relationships>', "xl/sharedStrings.xml": "<sst><si><t>N</t></si></sst>", "xl/s.xml": f"<worksheet><sheetData>{row}</sheetData></worksheet>"}
    made = {
        "ok": parts, "string": parts | {"xl/s.xml": parts["xl/s.xml"].replace("</sheetData>", row.replace("1", "2").replace("0", "7") + "</sheetData>")}, "part": {k: v for k, v in parts.items() if k != "xl/s.xml"}, "book": {k: v for k, v in parts.items() if k != "xl/workbook.xml"},
        "row": parts | {"xl/s.xml": parts["xl/s.xml"].replace(' r="1"', "")}, "large": parts | {"xl/s.xml": parts["xl/s.xml"].replace("</sheetData>", " " * (49 << 20) + "</sheetData>")},
    }
    files = spark.createDataFrame([(k, packed(**v)) for k, v in made.items()], "document_id string, content binary")
    got = lambda df: {r["document_id"]: (r["text"], r["status"], r["error"]) for r in df.collect()}
    good = ("A1=N", "ok", None)
    want = {"ok": good, "string": (None, "failed", "a shared string that is not there"), "part": (None, "failed", "a sheet without its part"), "book": (None, "failed", "no workbook"), "row": (None, "failed", "a row without its number")}
    assert got(markup.workbook_segments(files)) == want | {"large": (None, "failed", "archive over its limits")}
    assert got(markup.workbook_segments(files, most_expanded=None)) == want | {"large": good}
    assert "status" in registry.queries()["workbook_segments"](spark, DATA).columns
