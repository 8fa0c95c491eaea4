"""Queries that build containers from the test tables and read them again, with their SQL equivalents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillworks.options import ExtractOptions
from quillworks.plans.extract import extract

Q = Callable[[SparkSession, str], DataFrame]
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_O = 'xmlns:office="urn:o" xmlns:text="urn:t" xmlns:table="urn:b"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_ODT = "application/vnd.oasis.opendocument.text"


def zipped(files: dict[str, str]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(name, files[name])
    return b.getvalue()


def _run(t: str) -> str:
    return f"<w:r><w:t>{escape(t)}</w:t></w:r>"


def _p(t: str, level: int | None = None, num: int = 1) -> str:
    props = "" if level is None else f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr></w:pPr>'
    return f"<w:p>{props}{_run(t)}</w:p>"


def _word(body: str, **parts: str) -> bytes:
    return zipped({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>"} | {f"word/{k}.xml": v for k, v in parts.items()})


def _numbering(levels: list[tuple[str, str]], starts: dict[int, int] | None = None) -> str:
    defined = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>' for i, (f, t) in enumerate(levels))
    over = "".join(f'<w:lvlOverride w:ilvl="{i}"><w:startOverride w:val="{n}"/></w:lvlOverride>' for i, n in (starts or {}).items())
    return f'<w:numbering {_W}><w:abstractNum w:abstractNumId="0">{defined}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/>{over}</w:num></w:numbering>'


def _open(body: str) -> bytes:
    return zipped({"mimetype": _ODT, "content.xml": f"<office:document-content {_O}><office:body>{body}</office:body></office:document-content>"})


def _slide(*texts: str, number: bool = False) -> str:
    shape = lambda inner, frame="": f"<p:sp>{frame}<a:p><a:r><a:t>{inner}</a:t></a:r></a:p></p:sp>"
    last = shape("7", '<p:nvPr><p:ph type="sldNum"/></p:nvPr>') if number else ""
    return f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a">{"".join(shape(escape(t)) for t in texts)}{last}</p:sld>'


def _deck(slides: list[str], notes: dict[int, str] | None = None, order: list[int] | None = None, targets: dict[int, str] | None = None) -> bytes:
    relation = lambda i, kind, to: f'<Relationship Id="rId{i}" Type="{_REL}/{kind}" Target="{to}"/>'
    files = {"[Content_Types].xml": "<Types/>", "ppt/presentation.xml": '<p:presentation xmlns:p="urn:p" xmlns:r="urn:r"><p:sldIdLst>' + "".join(f'<p:sldId id="{300 + i}" r:id="rId{i}"/>' for i in order or range(len(slides))) + "</p:sldIdLst></p:presentation>"}
    files["ppt/_rels/presentation.xml.rels"] = "<Relationships>" + "".join(relation(i, "slide", (targets or {}).get(i, f"slides/slide{i}.xml")) for i in range(len(slides))) + "</Relationships>"
    files |= {f"ppt/slides/slide{i}.xml": s for i, s in enumerate(slides)}
    for i, x in (notes or {}).items():
        files[f"ppt/notesSlides/notes{i}.xml"] = x
        files[f"ppt/slides/_rels/slide{i}.xml.rels"] = "<Relationships>" + relation(1, "notesSlide", f"../notesSlides/notes{i}.xml") + "</Relationships>"
    return zipped(files)


# Suppliers of a nation: its name and "key|name|number" of each, in order of key.


def _docx_table(head: str, rows: list[str]) -> bytes:
    return _word(_p(head) + "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_p(c)}</w:tc>" for c in r.split("|")[:2]) + "</w:tr>" for r in rows) + "</w:tbl>")


def _docx_nested(head: str, rows: list[str]) -> bytes:
    """Each row: a cell with two paragraphs, and a cell with a table in it; then a text box in a paragraph."""
    cell = lambda *inner: f"<w:tc>{''.join(inner)}</w:tc>"
    table = "".join("<w:tr>" + cell(_p(k), _p(n)) + cell("<w:tbl><w:tr>" + cell(_p("tel")) + cell(_p(t)) + "</w:tr></w:tbl>") + "</w:tr>" for k, n, t in (r.split("|") for r in rows))
    return _word(f"<w:tbl>{table}</w:tbl><w:p>{_run(head)}<w:r><w:txbxContent>{_p(' boxed')}</w:txbxContent></w:r></w:p>")


def _docx_numbered(head: str, rows: list[str]) -> bytes:
    body = "".join(_p(n, 0) + _p(k, 1) + _p(t, 1) for k, n, t in (r.split("|") for r in rows))
    return _word(_p(head) + body, numbering=_numbering([("upperRoman", "%1."), ("lowerLetter", "%1-%2)")]))


def _docx_notes(head: str, rows: list[str]) -> bytes:
    deleted = "<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del>" + _run(head) + "<w:r><w:instrText>PAGE</w:instrText></w:r><w:ins>" + _run(" added") + "</w:ins><w:r><w:tab/></w:r>" + _run("x") + "</w:p>"
    note = lambda kind: f"<w:{kind}s {_W}>" + f'<w:{kind} w:id="-1">{_p("line")}</w:{kind}><w:{kind} w:id="0">{_p("more")}</w:{kind}>' + "".join(f'<w:{kind} w:id="{i}">{_p(kind + " " + r.split("|")[1])}</w:{kind}>' for i, r in enumerate(rows, 2)) + f"</w:{kind}s>"
    margin = lambda tag, t: f"<w:{tag} {_W}>{_p(t)}{_p('Both')}</w:{tag}>"
    return _word(deleted, footnotes=note("footnote"), endnotes=note("endnote"), header1=margin("hdr", "Head " + head), footer1=margin("ftr", "Foot"))


def _docx_odd_parts(head: str, rows: list[str]) -> bytes:
    """Parts that can't be parsed: a warning each, and the body stays."""
    return _word(_p(head, 0), numbering="<w:x", footnotes="<w:x", endnotes="<w:x")


def _odt_list(head: str, rows: list[str]) -> bytes:
    return _open(f"<text:h>{escape(head)}</text:h><text:list>" + "".join(f"<text:list-item><text:p>{escape('|'.join(r.split('|')[:2]))}</text:p></text:list-item>" for r in rows) + "</text:list>")


def _odt_spacing(head: str, rows: list[str]) -> bytes:
    cell = lambda t, name="table-cell": f"<table:{name}>{f'<text:p>{escape(t)}</text:p>' if t else ''}</table:{name}>"
    table = "<table:table>" + "".join("<table:table-row>" + cell(k) + cell("", "covered-table-cell") + cell(n) + "</table:table-row>" for k, n, _ in (r.split("|") for r in rows)) + "</table:table>"
    first = f'<text:p>{escape(head)}<text:s text:c="4"/>a<text:tab/>b<text:line-break/>c<office:annotation><text:p>hidden</text:p></office:annotation><text:note><text:p>note</text:p></text:note></text:p>'
    return _open(f"<text:tracked-changes><text:p>old</text:p></text:tracked-changes>{first}{table}")


def _pptx_deck(head: str, rows: list[str]) -> bytes:
    return _deck([_slide(t) for t in [head, *("|".join(r.split("|")[:2]) for r in rows)]])


def _pptx_notes(head: str, rows: list[str]) -> bytes:
    """Slides declared in reverse order; the number is kept on slides and left out of notes."""
    slides = [_slide(n, number=True) for _, n, _ in (r.split("|") for r in rows)]
    return _deck(slides, {i: _slide("Call " + r.split("|")[2], number=True) for i, r in enumerate(rows)}, list(range(len(slides)))[::-1])


def _pptx_broken(head: str, rows: list[str]) -> bytes:
    """The last slide's target leads out of the container, or nowhere, or the deck has no slide."""
    n = len(rows)
    if n % 3 == 0:
        return _deck([])
    return _deck([_slide(head)] * n, targets={n - 1: "../../x.xml" if n % 3 == 1 else "slides/none.xml"})


def lists(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    g = s.groupBy("n_nationkey", "n_name").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("x"))
    return g.select("n_nationkey", "n_name", F.transform("x", lambda x: F.concat_ws("|", x["s_suppkey"].cast("string"), x["s_name"], (x["s_suppkey"] * 7).cast("string"))).alias("rows"))


def _built(make: Callable[[str, list[str]], bytes]):
    def column(head: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([make(h, list(r)) for h, r in zip(head, rows)])

    return F.pandas_udf(column, "binary")


def _read(make, name: str | None, options: ExtractOptions = ExtractOptions(), *more: str) -> Q:
    def q(spark: SparkSession, d: str) -> DataFrame:
        rows = lists(spark, d).select("n_nationkey", _built(make)("n_name", "rows").alias("content"), F.lit(name).cast("string").alias("file_name"))
        return extract(rows, options=options).select("n_nationkey", "document.text", F.size("document.segments").cast("bigint").alias("segments"), *(F.expr(m) for m in more))

    return q


def container_sniffed(spark: SparkSession, d: str) -> DataFrame:
    """Containers without a name, of three formats, and an archive of none."""
    make = [_docx_table, _odt_list, _pptx_deck, lambda head, rows: zipped({"a.txt": head})]
    column = F.pandas_udf(lambda k, h, r: pd.Series([make[int(i) % 4](x, list(y)) for i, x, y in zip(k, h, r)]), "binary")
    rows = lists(spark, d).select("n_nationkey", column("n_nationkey", "n_name", "rows").alias("content"), F.lit(None).cast("string").alias("file_name"))
    return extract(rows).select("n_nationkey", "document.format", "error.code")


def number_labels(spark: SparkSession, d: str) -> DataFrame:
    """Part sizes as list numbers of Word documents, in letters and in Roman numerals."""
    def column(n: pd.Series) -> pd.Series:
        return pd.Series([_word(_p("x", 0) + _p("y", 1), numbering=_numbering([("lowerLetter", "%1"), ("lowerRoman", "%2")], {0: int(i), 1: int(i)})) for i in n])

    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.pandas_udf(column, "binary")("p_size").alias("content"), F.lit("x.docx").alias("file_name"))
    parts = F.split("document.text", "\n\n")
    return extract(rows).select("p_partkey", F.substring_index(parts[0], " ", 1).alias("letters"), F.substring_index(parts[1], " ", 1).alias("roman"))


LIMIT = 900


def queries() -> dict[str, Q]:
    warned = ("array_join(array_sort(transform(document.warnings, w -> w.code)), ',') as warnings",)
    failed = ("error.code", "error.reason")
    return {
        "docx_text": _read(_docx_table, "x.docx"), "docx_nested": _read(_docx_nested, "x.docx"), "docx_numbering": _read(_docx_numbered, "x.docx", ExtractOptions(), *warned),
        "docx_notes": _read(_docx_notes, "x.docx", ExtractOptions(include_docx_headers_and_footers=True), "document.metadata['footnoteParagraphs'] as footnotes", "document.metadata['headerFooterParagraphs'] as margins"),
        "docx_body_only": _read(_docx_notes, "x.docx", ExtractOptions(include_docx_footnotes=False, include_docx_endnotes=False)), "docx_odd_parts": _read(_docx_odd_parts, "x.docx", ExtractOptions(), *warned),
        "archive_limit": _read(_docx_table, "x.docx", ExtractOptions(max_archive_entry_bytes=LIMIT), *failed), "archive_entries": _read(_docx_notes, "x.docx", ExtractOptions(max_archive_entry_count=4), *failed),
        "odt_text": _read(_odt_list, "x.odt"), "odt_spacing": _read(_odt_spacing, "x.odt"), "odt_wrong_type": _read(_docx_table, "x.odt", ExtractOptions(), *failed),
        "pptx_slides": _read(_pptx_deck, "x.pptx"), "pptx_notes": _read(_pptx_notes, "x.pptx", ExtractOptions(), "document.metadata['slideCount'] as slides"), "pptx_without_notes": _read(_pptx_notes, "x.pptx", ExtractOptions(include_pptx_speaker_notes=False)), "pptx_broken": _read(_pptx_broken, "x.pptx", ExtractOptions(), *failed),
        "container_sniffed": container_sniffed, "number_labels": number_labels,
    }


def oracle_sql() -> dict[str, str]:
    nn = "chr(10) || chr(10)"
    base = "with l as (select n_nationkey, n_name, list({'k': s_suppkey, 'n': s_name, 't': s_suppkey * 7} order by s_suppkey) as r from supplier join nation on s_nationkey = n_nationkey group by all)"
    each = lambda e: f"array_to_string(list_transform(r, lambda x: {e}), {nn})"
    indexed = lambda e: f"array_to_string(list_transform(range(1, len(r) + 1), lambda i: {e}), {nn})"
    digits = lambda n, a, b, c: f"['', '{a}', '{a * 2}', '{a * 3}', '{a}{b}', '{b}', '{b}{a}', '{b}{a * 2}', '{b}{a * 3}', '{a}{c}'][{n} % 10 + 1]"
    large, small = ["M", "C", "D", "M", "X", "L", "C", "I", "V", "X"], ["m", "c", "d", "m", "x", "l", "c", "i", "v", "x"]
    rom = lambda n, x: f"repeat('{x[0]}', ({n} // 1000)::bigint) || {digits(f'({n} // 100)', x[1], x[2], x[3])} || {digits(f'({n} // 10)', x[4], x[5], x[6])} || {digits(n, x[7], x[8], x[9])}"
    table = f"n_name || {nn} || {each('x.k || chr(9) || x.n')}"
    wrap = len(f"<w:document {_W}><w:body></w:body></w:document>") + len(_p("")) + len("<w:tbl></w:tbl>")
    row = len("<w:tr></w:tr>") + 2 * (len("<w:tc></w:tc>") + len(_p("")))
    escaped = lambda c: f"octet_length(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')::blob)"
    size = f"({wrap} + {escaped('n_name')} + list_sum(list_transform(r, lambda x: {row} + {escaped('x.k::varchar')} + {escaped('x.n')})))::bigint"
    main = "n_name || ' added' || chr(9) || 'x'"
    return {
        "docx_text": f"{base} select n_nationkey, {table} as text, 0::bigint as segments from l",
        "docx_nested": f"{base} select n_nationkey, {each("x.k || ' ' || x.n || chr(9) || 'tel ' || x.t")} || {nn} || n_name || ' boxed' as text, 0::bigint as segments from l",
        "docx_numbering": f"{base} select n_nationkey, n_name || {nn} || {indexed(f"{rom('i', large)} || '. ' || r[i].n || {nn} || {rom('i', large)} || '-a) ' || r[i].k || {nn} || {rom('i', large)} || '-b) ' || r[i].t")} as text, 0::bigint as segments, '' as warnings from l",
        "docx_notes": f"{base} select n_nationkey, {main} || {nn} || {each("'footnote ' || x.n")} || {nn} || {each("'endnote ' || x.n")} || {nn} || 'Foot' || {nn} || 'Both' || {nn} || 'Head ' || n_name as text, 0::bigint as segments, len(r)::varchar as footnotes, '3' as margins from l",
        "docx_body_only": f"{base} select n_nationkey, {main} as text, 0::bigint as segments from l",
        "docx_odd_parts": f"{base} select n_nationkey, n_name as text, 0::bigint as segments, 'skippedDOCXEndnotes,skippedDOCXFootnotes,unsupportedDOCXFeature' as warnings from l",
        "archive_limit": f"{base}, s as (select *, {size} as size from l) select n_nationkey, case when size <= {LIMIT} then {table} end as text, case when size <= {LIMIT} then 0::bigint end as segments, case when size > {LIMIT} then 'invalidDocument' end as code, case when size > {LIMIT} then 'DOCX archive entry exceeds maxArchiveEntryBytes: word/document.xml expands to ' || size || ' bytes, max {LIMIT}.' end as reason from s",
        "archive_entries": f"{base} select n_nationkey, null::varchar as text, null::bigint as segments, 'invalidDocument' as code, 'DOCX archive contains too many entries; max 4.' as reason from l",
        "odt_text": f"{base} select n_nationkey, n_name || {nn} || {each("'• ' || x.k || '|' || x.n")} as text, 0::bigint as segments from l",
        "odt_spacing": f"{base} select n_nationkey, n_name || ' a' || chr(9) || 'b' || chr(10) || 'c note' || {nn} || {each("x.k || chr(9) || chr(9) || x.n")} as text, 0::bigint as segments from l",
        "odt_wrong_type": f"{base} select n_nationkey, null::varchar as text, null::bigint as segments, 'invalidDocument' as code, 'Missing ODT mimetype entry.' as reason from l",
        "pptx_slides": f"{base} select n_nationkey, n_name || {nn} || {each("x.k || '|' || x.n")} as text, (len(r) + 1)::bigint as segments from l",
        "pptx_notes": f"{base} select n_nationkey, array_to_string(list_reverse(list_transform(r, lambda x: x.n || {nn} || '7' || {nn} || 'Call ' || x.t)), {nn}) as text, len(r)::bigint as segments, len(r)::varchar as slides from l",
        "pptx_without_notes": f"{base} select n_nationkey, array_to_string(list_reverse(list_transform(r, lambda x: x.n || {nn} || '7')), {nn}) as text, len(r)::bigint as segments from l",
        "pptx_broken": f"{base} select n_nationkey, null::varchar as text, null::bigint as segments, 'invalidDocument' as code, case len(r) % 3 when 0 then 'PPTX presentation contains no slides.' when 1 then 'Could not resolve PPTX slide relationship: rId' || (len(r) - 1) || '.' else 'Missing PPTX slide entry: ppt/slides/none.xml.' end as reason from l",
        "container_sniffed": f"{base} select n_nationkey, ['docx', 'odt', 'pptx', null][n_nationkey % 4 + 1] as format, case when n_nationkey % 4 = 3 then 'unsupportedFileType' end as code from l",
        "number_labels": f"select p_partkey, case when p_size <= 26 then chr((96 + p_size)::int) else chr((96 + (p_size - 1) // 26)::int) || chr((97 + (p_size - 1) % 26)::int) end as letters, {rom('p_size', small)} as roman from part",
    }
