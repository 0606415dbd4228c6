"""Parts of messages and documents, written by the standard library and read back."""

import io
import zipfile
from email.message import EmailMessage
from xml.sax.saxutils import escape

from paperlode.sources import messages as M

SCHEMA = "id bigint, raw binary"


def test_nested_messages(rows):
    inner = EmailMessage()
    inner["Subject"] = "inner"
    inner.set_content("Grüße\nline", charset="iso-8859-1", cte="quoted-printable")
    inner.add_alternative("<p>日本</p>", subtype="html")
    outer = EmailMessage()
    outer.set_content("see below")
    outer.add_attachment(inner)
    outer.add_attachment(b"\x00\xff\x01", maintype="application", subtype="octet-stream", filename="bild é.bin")
    odd = b"Content-Type: text/plain; charset=klingon\r\n\r\n\xe9x"
    wrong = b"Content-Type: text/plain; charset=utf-8\r\n\r\n\xe9x"
    cut = b'Content-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\n\r\nonly part'
    deep = b"".join(b'Content-Type: multipart/mixed; boundary="b%d"\r\n\r\n--b%d\r\n' % (i, i) for i in range(3000)) + b"\r\nx"
    df = rows([(1, outer.as_bytes()), (2, odd), (3, wrong), (4, b""), (5, None), (6, cut), (7, deep)], SCHEMA)
    found = {}
    for r in M.mime_parts(df, "id", "raw").collect():
        found.setdefault(r.id, []).append(r)
    assert [(r.part, r.content_type, r.charset, r.filename, r.text, r.n_bytes) for r in found[1]] == [
        ("1", "text/plain", "utf-8", None, "see below\n", 10),
        ("2.1.1", "text/plain", "iso-8859-1", None, "Grüße\nline\n", 11),
        ("2.1.2", "text/html", "utf-8", None, "<p>日本</p>\n", 14),
        ("3", "application/octet-stream", None, "bild é.bin", None, 3),
    ]
    assert [(r.text, r.error) for r in found[2] + found[3]] == [("�x", "charset")] * 2
    assert [(r.part, r.text, r.n_bytes) for r in found[4]] == [("1", "", 0)]
    assert 5 not in found
    assert [(r.part, r.text) for r in found[6]] == [("1", "only part")]
    assert len(found[7]) == 1


def docx(paragraphs):
    body = "".join(
        "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "")
        + "".join(f'<w:r><w:t xml:space="preserve">{escape(run)}</w:t></w:r>' for run in runs) + "</w:p>"
        for style, runs in paragraphs
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents(rows, monkeypatch):
    long = docx([(None, [f"line {i}"]) for i in range(20_000)])
    files = [(1, docx([("Heading1", ["Title & <é>"]), (None, ["one ", "two"]), (None, [])])), (2, b"no zip"), (3, None), (4, docx([])), (5, long), (6, long[:5000])]
    found = {}
    for r in M.docx_paragraphs(rows(files, SCHEMA), "id", "raw").collect():
        found.setdefault(r.id, []).append((r.paragraph_no, r.style, r.text, r.readable))
    assert found[1] == [(0, "Heading1", "Title & <é>", True), (1, None, "one two", True), (2, None, "", True)]
    assert found[2] == found[3] == found[6] == [(0, None, None, False)]
    assert 4 not in found and [x[2] for x in found[5]] == [f"line {i}" for i in range(20_000)]


def test_documents_of_a_table(spark):
    """Names written as one document for each size, read back in order."""
    from pyspark.sql import functions as F

    from paperlode.sources.tables import load_table
    from tests.conftest import SMALL

    names = load_table(spark, SMALL, "part").groupBy("p_size").agg(F.array_sort(F.collect_list("p_name")).alias("names"))
    made = F.udf(lambda names: docx([(None, [n]) for n in names]), "binary")
    found = M.docx_paragraphs(names.select("p_size", made("names").alias("raw")), "p_size", "raw")
    got = {}
    for r in found.orderBy("p_size", "paragraph_no").collect():
        got.setdefault(r.p_size, []).append(r.text)
    assert got == {r.p_size: r.names for r in names.collect()}
