"""The parsers as Arrow functions of columns.  No exception leaves a row: errors are values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

from quillworks.kernel import Unreadable, article, decode, doc, office, rtf
from quillworks.options import ExtractOptions, WebOptions

_SLIDES = "array<struct<n:int,path:string,blocks:array<string>,notes:array<string>>>"
PARSED = f"struct<sniffed:string,raw:string,text:string,encoding:string,legacy:boolean,body:array<string>,footnotes:array<string>,endnotes:array<string>,headers:array<string>,slides:{_SLIDES},slide_count:int,expanded:bigint,warnings:array<struct<code:string,message:string>>,code:string,reason:string>"
PAGE = "struct<title:string,site:string,author:string,language:string,published:string,drafts:array<struct<kind:string,level:int,text:string>>,code:string,reason:string>"
_TEXT = {"plainText", "markdown", "srt", "vtt", "html"}
_EMPTY = {"sniffed": None, "raw": None, "text": None, "encoding": None, "legacy": None, "body": None, "footnotes": None, "endnotes": None, "headers": None, "slides": None, "slide_count": None, "expanded": None, "warnings": None, "code": None, "reason": None}


#: In place of a format: find it by content.
SNIFF = "?"


def _source(data: bytes) -> str | None:
    """The decoded source of a format that has a parser of its own; null where it can't be decoded."""
    try:
        return decode.decode(data)[0]
    except Unreadable:
        return None


def parse_one(fmt: str | None, data: bytes | None, options: ExtractOptions) -> dict:
    """What a document holds, or the code and reason of an error."""
    if fmt is None or data is None:
        return _EMPTY
    if fmt == SNIFF:
        found = office.sniff(data, options)
        return parse_one(found, data, options) | {"sniffed": found}
    try:
        if fmt in _TEXT:
            text, encoding, legacy = decode.decode(data)
            return _EMPTY | {"text": text, "encoding": encoding, "legacy": legacy}
        if fmt == "rtf":
            return _EMPTY | {"text": rtf.text(data), "raw": _source(data)}
        if fmt == "doc":
            return _EMPTY | {"text": doc.text(data)}
        p = {"docx": office.docx, "odt": office.odt, "pptx": office.pptx}[fmt](data, options)
        return _EMPTY | {"body": p.body, "footnotes": p.footnotes, "endnotes": p.endnotes, "headers": p.headers, "slides": [{"n": n, "path": path, "blocks": b, "notes": notes} for n, path, b, notes in p.slides], "slide_count": p.slide_count, "expanded": p.expanded, "warnings": [{"code": c, "message": m} for c, m in p.warnings]}
    except Unreadable as e:
        return _EMPTY | {"code": e.code, "reason": e.reason}
    except Exception as e:  # a parser's own fault must not end the job
        return _EMPTY | {"code": "invalidDocument", "reason": f"Could not parse {fmt} document ({type(e).__name__})."}


_ARROW = pa.struct([("sniffed", pa.string()), ("raw", pa.string()), ("text", pa.string()), ("encoding", pa.string()), ("legacy", pa.bool_()), *((k, pa.list_(pa.string())) for k in ("body", "footnotes", "endnotes", "headers")), ("slides", pa.list_(pa.struct([("n", pa.int32()), ("path", pa.string()), ("blocks", pa.list_(pa.string())), ("notes", pa.list_(pa.string()))]))), ("slide_count", pa.int32()), ("expanded", pa.int64()), ("warnings", pa.list_(pa.struct([("code", pa.string()), ("message", pa.string())]))), ("code", pa.string()), ("reason", pa.string())])


def _clean(x):
    """Strings without lone surrogates, which Arrow can't hold."""
    if isinstance(x, str):
        return x if x.isascii() else x.encode("utf-8", "replace").decode()
    if isinstance(x, list):
        return [_clean(i) for i in x]
    return {k: _clean(v) for k, v in x.items()} if isinstance(x, dict) else x


def parse(fmt: Column, content: Column, options: ExtractOptions = ExtractOptions()) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for f, c in batches:
            yield pa.array([_clean(parse_one(a.as_py(), b.as_py(), options)) for a, b in zip(f, c)], _ARROW)

    return _arrow(run, PARSED)(fmt, content)


def _arrow(run, kind: str):
    import warnings

    from pyspark.sql.pandas.functions import ArrowUDFType, arrow_udf

    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)  # the type hints here are strings
        return arrow_udf(run, kind, ArrowUDFType.SCALAR_ITER)


_PAGE_ARROW = pa.struct([*((k, pa.string()) for k in ("title", "site", "author", "language", "published")), ("drafts", pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))), ("code", pa.string()), ("reason", pa.string())])


def page_one(data: bytes | None, options: WebOptions) -> dict | None:
    if data is None:
        return None
    none = dict.fromkeys(("title", "site", "author", "language", "published", "drafts", "code", "reason"))
    try:
        p = article.read(decode.decode_web(data), options)
        return none | {"title": p.title, "site": p.site, "author": p.author, "language": p.language, "published": p.published, "drafts": [{"kind": k, "level": v, "text": t} for k, v, t in p.drafts]}
    except Unreadable as e:
        return none | {"code": e.code, "reason": e.reason}
    except Exception as e:
        return none | {"code": "unreadableArticle", "reason": type(e).__name__}


def read_page(html: Column, options: WebOptions = WebOptions()) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in batches:
            yield pa.array([_clean(page_one(b.as_py(), options)) for b in c], _PAGE_ARROW)

    return _arrow(run, PAGE)(html)
