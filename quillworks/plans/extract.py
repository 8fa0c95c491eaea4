"""Bytes to documents: limits, dispatch, decode, format transform, normalise, assemble.

One projection with a CASE over the format.  Python sees each row once, to decode or to parse its
container; everything else is expressions.  Every row gives a document or an error, never a failed
task; ``strict`` raises the first error instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillworks.functions.html import html_text
from quillworks.functions.markdown import markdown_text
from quillworks.functions.subtitles import cues, segments, subtitle_text, time_warnings
from quillworks.functions.text import normalize, normalize_cells, trim_all
from quillworks.functions.titles import base_name, title
from quillworks.operators.kernels import SNIFF, parse
from quillworks.options import ExtractOptions
from quillworks.plans.registry import Registry
from quillworks.schema import DOCUMENT, ERROR, SEGMENT, WARNING

_TEXT = ("plainText", "markdown", "srt", "vtt", "html")


def error(code: str | Column, message: Column, **more: Column) -> Column:
    fields = {"code": F.lit(code) if isinstance(code, str) else code, "message": message}
    kinds = {"file_name": "string", "actual_bytes": "bigint", "max_bytes": "bigint", "reason": "string", "format": "string"}
    fields |= {k: more.get(k, F.lit(None)).cast(t) for k, t in kinds.items()}
    return F.struct(*(c.alias(k) for k, c in fields.items())).cast(ERROR)


def _parts(blocks: Column, options: ExtractOptions) -> Column:
    return F.filter(F.transform(F.coalesce(blocks, F.array().cast("array<string>")), lambda b: normalize_cells(b, options)), lambda b: b != "")


def _map(**entries: Column) -> Column:
    return F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))))


def extract(df: DataFrame, content: str = "content", name: str = "file_name", url: str | None = None, options: ExtractOptions = ExtractOptions(), registry: Registry = Registry(), strict: bool = False) -> DataFrame:
    """The input's columns but the content, with ``document`` and ``error``, one of which is null.

    Null content counts as empty.  Columns of the input named document or error are replaced.
    """
    kept = [c for c in df.columns if c not in (content, "document", "error")]
    # The input's own columns travel in one struct, so that none can clash with a working column.
    whole = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(None)
    rows = df.select(whole.alias("_row"), F.coalesce(F.col(content), F.lit(b"")).alias("_content"), F.col(name).alias("_name"), (F.col(url) if url else F.lit(None).cast("string")).alias("_url"))
    size = F.octet_length("_content").cast("bigint")
    too_large = size > options.max_input_bytes
    named = registry.by_name(F.coalesce(F.col("_name"), F.col("_url")))
    zipped = named.isNull() & ~too_large & (F.hex(F.substring("_content", 1, 2)) == "504B")
    own = {x.format: x.text for x in registry.extractors if x.text}
    wanted = F.when(~too_large, F.col("_content"))
    asked = F.when(named.isNotNull() & (~named.isin(*own) if own else F.lit(True)), named).when(zipped, SNIFF)
    rows = rows.withColumn("_size", size).withColumn("_p", parse(F.when(wanted.isNotNull(), asked), wanted, options))
    rows = rows.withColumn("_format", F.coalesce(named, registry.by_content(F.col("_content"), F.col("_name"), F.col("_p.sniffed"))))
    # RTF keeps its decoded source where it can be decoded.
    rows = rows.withColumn("_raw", F.when(F.col("_format").isin(*_TEXT), F.col("_p.text")).when(F.col("_format") == "rtf", F.col("_p.raw")))
    rows = _with_text(rows, options, own)
    document = F.struct(title(F.col("_url"), F.col("_name")).alias("title"), F.col("_url").alias("source_url"), F.col("_format").alias("format"), F.col("_text").alias("text"), F.col("_raw").alias("raw_text"), F.col("_segments").alias("segments"), F.col("_metadata").alias("metadata"), F.col("_warnings").alias("warnings")).cast(DOCUMENT)
    shown = base_name(F.coalesce(F.col("_name"), F.col("_url")))
    parsed = ~F.col("_format").isin(*own) if own else F.lit(True)
    reason, code = F.col("_p.reason"), F.when(parsed, F.col("_p.code"))
    empty = (trim_all(F.coalesce("_text", F.lit(""))) == "") & (F.size("_segments") == 0)
    failure = (
        F.when(F.col("_size") > options.max_input_bytes, error("fileTooLarge", F.concat(F.lit("File is too large: "), F.col("_size").cast("string"), F.lit(f" bytes, max: {options.max_input_bytes} bytes")), actual_bytes=F.col("_size"), max_bytes=F.lit(options.max_input_bytes)))
        .when(F.col("_format").isNull(), error("unsupportedFileType", F.concat(F.lit("Unsupported file type: "), F.coalesce(shown, F.lit("unknown"))), file_name=shown))
        .when(code == "unreadableTextEncoding", error("unreadableTextEncoding", F.concat(F.lit("Could not decode text encoding for "), F.coalesce(shown, F.lit("document")), F.lit(".")), file_name=shown))
        .when(code.isNotNull(), error("invalidDocument", F.concat(F.lit("Invalid document: "), reason), reason=reason))
        .when(empty, error("emptyDocument", F.lit("The document did not contain readable text.")))
    )
    out = rows.withColumn("error", failure).withColumn("document", F.when(F.col("error").isNull(), document))
    if strict:
        out = out.withColumn("document", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("error.code"), F.lit(": "), F.col("error.message"))).cast(DOCUMENT)).otherwise(F.col("document")))
    return out.select(*(F.col("_row")[c].alias(c) for c in kept), "document", "error")


def _with_text(rows: DataFrame, o: ExtractOptions, own: dict) -> DataFrame:
    """Adds _text, _segments, _metadata and _warnings by format."""
    joiner = o.paragraph_separator if o.preserve_paragraphs else " "
    p, fmt, raw = (lambda k: F.col(f"_p.{k}")), F.col("_format"), F.col("_p.text")
    rows = rows.withColumn("_cues", F.when(fmt == "srt", cues(raw, "srt", o)).when(fmt == "vtt", cues(raw, "vtt", o)))
    none = F.array().cast(f"array<{SEGMENT}>")
    body, foot, end = _parts(p("body"), o), _parts(p("footnotes"), o), _parts(p("endnotes"), o)
    head = F.array_distinct(_parts(p("headers"), o))
    rows = rows.withColumn("_body", body).withColumn("_foot", foot).withColumn("_end", end).withColumn("_head", head)

    def slide(s: Column) -> Column:
        notes = trim_all(F.array_join(_parts(s["notes"], o), joiner))
        parts = F.concat(_parts(s["blocks"], o), F.filter(F.array(notes), lambda x: x != ""))
        n = s["n"].cast("string")
        return F.struct(F.concat(F.lit("slide-"), n).alias("id"), trim_all(F.array_join(parts, joiner)).alias("text"), F.lit(None).cast("double").alias("start_time"), F.lit(None).cast("double").alias("end_time"), _map(slideIndex=n, sourcePath=s["path"], speakerNotesIncluded=F.when(notes != "", "true").otherwise("false")).alias("metadata"))

    slides = F.filter(F.transform(p("slides"), slide), lambda s: s["text"] != "")
    segs = F.when(fmt == "srt", segments(F.col("_cues"), "srt", o)).when(fmt == "vtt", segments(F.col("_cues"), "vtt", o)).when(fmt == "pptx", slides)
    rows = rows.withColumn("_segments", F.coalesce(segs.cast(f"array<{SEGMENT}>"), none))
    said = F.transform("_segments", lambda s: s["text"])
    text = None
    for f, make in own.items():
        value = make(F.col("_content"), F.col("_name"))
        text = F.when(fmt == f, value) if text is None else text.when(fmt == f, value)
    text = text if text is not None else F
    text = (
        text.when(fmt == "plainText", normalize(raw, o))
        .when(fmt == "markdown", markdown_text(raw, o))
        .when(fmt == "html", html_text(raw, o))
        .when(fmt.isin("srt", "vtt"), subtitle_text(F.col("_segments"), o))
        .when(fmt.isin("rtf", "doc"), normalize(raw, o))
        .when(fmt == "pptx", trim_all(F.array_join(said, joiner)))
        .when(fmt.isin("docx", "odt"), trim_all(F.array_join(F.concat("_body", "_foot", "_end", "_head"), joiner)))
    )
    n = lambda c: F.size(c).cast("string")
    meta = (
        F.when(fmt == "docx", _map(container=F.lit("OOXML"), expandedArchiveBytes=p("expanded"), footnoteParagraphs=n("_foot"), endnoteParagraphs=n("_end"), headerFooterParagraphs=n("_head")))
        .when(fmt == "odt", _map(container=F.lit("OpenDocument"), mimeType=F.lit("application/vnd.oasis.opendocument.text"), expandedArchiveBytes=p("expanded")))
        .when(fmt == "pptx", _map(container=F.lit("Office Open XML Presentation"), slideCount=p("slide_count"), expandedArchiveBytes=p("expanded")))
        .when(fmt == "doc", _map(container=F.lit("OLE2")))
        .when(fmt == "plainText", _map(encoding=p("encoding")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    legacy = F.when((fmt == "plainText") & p("legacy"), F.array(F.struct(F.lit("lossyEncodingFallback").alias("code"), F.concat(F.lit("Decoded text using legacy encoding "), p("encoding"), F.lit(".")).alias("message"))))
    warned = F.coalesce(legacy, F.when(F.col("_cues").isNotNull(), time_warnings(F.col("_cues"))), p("warnings"), F.array().cast(f"array<{WARNING}>"))
    # Generated columns can't be folded into a later filter: the text is made once, whatever is asked of it.
    made = F.struct(text.alias("_text"), F.col("_segments").alias("_said"), meta.alias("_metadata"), warned.alias("_warnings"))
    return rows.select(*rows.columns, F.inline(F.array(made))).drop("_segments").withColumnRenamed("_said", "_segments")


def explode_segments(documents: DataFrame, keys: list[str]) -> DataFrame:
    """One row a segment, with its place."""
    return documents.select(*keys, F.posexplode("document.segments").alias("position", "segment")).select(*keys, "position", "segment.*")


def warnings_by_code(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode("document.warnings").alias("w")).groupBy(F.col("w.code").alias("code")).count()


def errors_by_code(documents: DataFrame) -> DataFrame:
    return documents.filter("error is not null").groupBy(F.col("error.code").alias("code")).count()


def formats(spark: SparkSession, registry: Registry = Registry()) -> DataFrame:
    return registry.frame(spark)
