"""Parts of messages and of word-processor documents, from their bytes."""

from __future__ import annotations

import io
import zipfile
from email import message_from_bytes, policy
from email.message import Message
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The main text of a document may have so many bytes when unpacked; a larger one is an error, not a task out of memory.
UNPACKED_BYTES = 256 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

PART = "array<struct<part:string,content_type:string,charset:string,filename:string,text:string,n_bytes:bigint,error:string>>"
PARAGRAPH = "array<struct<style:string,text:string>>"


def _walk(message: Message, path: str):
    """(path, part) of every part that is not made of parts, numbered like sections: 1, 1.2, 2."""
    waiting = [(path, message)]
    while waiting:
        at, part = waiting.pop()
        if part.is_multipart():
            inner = part.get_payload()
            waiting += [(f"{at}.{k + 1}" if at else str(k + 1), p) for k, p in reversed(list(enumerate(inner)))]
        else:
            yield at or "1", part


def _part(path: str, part: Message) -> dict:
    content = part.get_payload(decode=True) or b""
    charset = part.get_content_charset() or ("us-ascii" if part.get_content_maintype() == "text" else None)
    text, error = None, None
    if part.get_content_maintype() == "text":
        try:
            text = content.decode(charset)
        except (LookupError, UnicodeDecodeError):
            text, error = content.decode("utf-8", "replace"), "charset"
    if part.defects:
        error = type(part.defects[0]).__name__
    return {"part": path, "content_type": part.get_content_type(), "charset": charset, "filename": part.get_filename(),
            "text": text, "n_bytes": len(content), "error": error}


def _message_parts(raw: bytes) -> list[dict]:
    try:
        return [_part(*found) for found in _walk(message_from_bytes(raw, policy=policy.compat32), "")]
    except RecursionError:
        return [{"part": "1", "content_type": None, "charset": None, "filename": None, "text": None, "n_bytes": len(raw), "error": "nesting"}]


def _per_row(of, kind: str):
    """An Arrow column function of bytes, one row at a time; null stays null."""

    def apply(content: Column) -> Column:
        returned = T._parse_datatype_string(kind)
        arrow = _arrow(returned)

        @F.arrow_udf(returned)
        def run(batch: pa.Array) -> pa.Array:
            return pa.array([None if b is None else of(b.as_py()) for b in (x if x.is_valid else None for x in batch)], arrow)

        return run(content)

    return apply


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return pa.int64() if isinstance(kind, T.LongType) else pa.string()


def mime_parts(df: DataFrame, row_id: str, content: str) -> DataFrame:
    """(id, part, content_type, charset, filename, text, n_bytes, error): the leaves of the part tree of each message (RFC 2045).

    Transfer encodings are undone; `text` is there for text parts, decoded by their character set, `n_bytes` is the size of
    the decoded content. `part` numbers the way to the leaf ("2.1"); messages inside of messages are opened as well.
    `error` names a charset that is unknown or does not fit (the text then has replacement characters), the first defect of the
    part's own head or body, or nesting too deep to parse. A null message has no parts, an empty one has one empty part.
    """
    found = _per_row(_message_parts, PART)(F.col(content).cast("binary"))
    return df.select(F.col(row_id), F.inline(found))


def _paragraphs(raw: bytes) -> list[dict]:
    """Paragraphs of the main text, with their style; tabs and breaks are kept as characters."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        entry = archive.getinfo("word/document.xml")
        if entry.file_size > UNPACKED_BYTES:
            raise ValueError("too large")
        out, style, parts = [], None, []
        with archive.open(entry) as source:
            for event, node in ElementTree.iterparse(source, events=("start", "end")):
                if event == "start":
                    if node.tag == _W + "p":
                        style, parts = None, []
                elif node.tag == _W + "pStyle":
                    style = node.get(_W + "val")
                elif node.tag == _W + "t":
                    parts.append(node.text or "")
                elif node.tag == _W + "tab":
                    parts.append("\t")
                elif node.tag in (_W + "br", _W + "cr"):
                    parts.append("\n")
                elif node.tag == _W + "p":
                    out.append({"style": style, "text": "".join(parts)})
                    node.clear()
        return out


def _readable_paragraphs(raw: bytes) -> list[dict] | None:
    try:
        return _paragraphs(raw)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, NotImplementedError, RuntimeError, EOFError):
        return None


def docx_paragraphs(df: DataFrame, row_id: str, content: str) -> DataFrame:
    """(id, paragraph_no, style, text, readable) of the main text of DOCX files (a zip archive with XML, ISO 29500).

    Empty paragraphs keep their number. A file that is null, no such archive, damaged or too large to unpack is
    one row that is not readable.
    """
    found = _per_row(_readable_paragraphs, PARAGRAPH)(F.col(content))
    rows = df.select(F.col(row_id), found.alias("found"))
    one = F.when(F.col("found").isNull(), F.array(F.struct(F.lit(None).cast("string").alias("style"), F.lit(None).cast("string").alias("text"))))
    rows = rows.select(row_id, F.col("found").isNotNull().alias("readable"), F.posexplode(F.coalesce("found", one)).alias("paragraph_no", "p"))
    return rows.select(row_id, "paragraph_no", "p.style", "p.text", "readable")
