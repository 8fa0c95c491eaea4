"""Queries over the test tables for the extraction operators, with their SQL equivalents.

Every query runs over whole tables and counts a key once, however often it was delivered.  Containers
are in ``catalog_containers``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillworks import catalog_containers
from quillworks.functions.html import decode_entities, html_text, strip_tags
from quillworks.functions.markdown import markdown_text, strip_fences
from quillworks.functions.subtitles import cues, seconds, segments
from quillworks.functions.text import join_paragraphs, normalize, normalize_cells
from quillworks.functions.titles import extension, strip_site, title
from quillworks.operators.kernels import parse
from quillworks.options import ExtractOptions, WebOptions
from quillworks.plans.articles import extract_articles, from_json, render_blocks, to_json, validate_article
from quillworks.plans.extract import errors_by_code as count_errors, extract, warnings_by_code as count_warnings
from quillworks.plans.registry import Extractor, Registry

Q = Callable[[SparkSession, str], DataFrame]
FLAT, PLAIN = ExtractOptions(preserve_paragraphs=False), ExtractOptions(normalize_whitespace=False)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _once(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose first is its key, each key once; its deliveries have equal values."""
    return _t(spark, d, name).select(*columns).dropDuplicates([columns[0]])


def _raw(fmt: str, make: Callable[[Column], Column], out: str = "text") -> Q:
    """A column function over the sources of one format."""
    return lambda spark, d: _t(spark, d, "extracted_docs").filter((F.col("doc_format") == fmt) & F.col("raw_text").isNotNull()).select("document_id", make(F.col("raw_text")).alias(out)).dropDuplicates(["document_id"])


def _texts(make: Callable[[Column], Column]) -> Q:
    return lambda spark, d: _t(spark, d, "extracted_docs").select("document_id", make(F.col("text")).alias("text")).dropDuplicates(["document_id"])


def _cues(fmt: str) -> Q:
    def q(spark: SparkSession, d: str) -> DataFrame:
        rows = _raw(fmt, lambda c: cues(c, fmt), "c")(spark, d)
        return rows.select("document_id", F.explode("c").alias("c")).select("document_id", F.col("c.n").cast("bigint").alias("n"), "c.source_id", "c.start_time", "c.end_time", "c.text")

    return q


def _segments(fmt: str) -> Q:
    def q(spark: SparkSession, d: str) -> DataFrame:
        rows = _raw(fmt, lambda c: cues(c, fmt), "c")(spark, d).select("document_id", F.inline(F.array(F.struct("c"))))
        return rows.select("document_id", segments(F.col("c"), fmt).alias("s")).select("document_id", F.posexplode("s").alias("position", "s")).select("document_id", F.col("position").cast("bigint").alias("position"), "s.id", "s.text")

    return q


def timestamp_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Event times written as cue times and read again."""
    stamp = F.date_format("ts", "HH:mm:ss','SSS")
    return _t(spark, d, "events").select("event_id", seconds(stamp).alias("seconds"))


def dispatch(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "decoded_texts", "document_id", "path").select("document_id", extension(F.col("path")).alias("extension"), Registry().by_name(F.col("path")).alias("format"))


def size_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", F.col("raw_bytes").alias("content"), F.lit("page.bin").alias("file_name"))
    done = extract(rows, options=ExtractOptions(max_input_bytes=2000))
    return done.select("doc_id", "error.code", "error.actual_bytes", "error.max_bytes")


def errors_by_code(spark: SparkSession, d: str) -> DataFrame:
    """Document texts as files of the names that decoded_texts has; blank texts and unknown names are errors."""
    docs = _t(spark, d, "extracted_docs").select("document_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")).dropDuplicates(["document_id"])
    names = _t(spark, d, "decoded_texts").select("document_id", "file_name").dropDuplicates(["document_id"])
    rows = docs.join(names, "document_id", "left").withColumn("file_name", F.when(F.lower("file_name").rlike("\\.(?:txt|text)$"), F.col("file_name")))
    return count_errors(extract(rows))


def document_title(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "decoded_texts", "document_id", "file_name").select("document_id", title(F.lit(None).cast("string"), F.col("file_name")).alias("title"))


def _decoded(codec: str) -> Q:
    def q(spark: SparkSession, d: str) -> DataFrame:
        rows = _t(spark, d, "documents").select("doc_id", parse(F.lit("plainText"), F.encode("text", codec)).alias("p"))
        return rows.select("doc_id", "p.encoding", "p.text", "p.legacy")

    return q


def decode_pages(spark: SparkSession, d: str) -> DataFrame:
    """How the page bytes read: encoding and characters."""
    rows = _t(spark, d, "documents").select("doc_id", parse(F.lit("html"), F.col("raw_bytes")).alias("p"))
    return rows.select("doc_id", "p.encoding", "p.legacy", F.length("p.text").alias("characters"), "p.code")


def decode_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Document texts and addresses in an encoding for each remainder of their number, back through the cascade."""
    b = lambda x: F.unhex(F.lit(x))
    url, text = F.coalesce("url", F.lit("https://x.example/")), F.coalesce("text", F.lit("-"))
    ways = [b(""), F.concat(b("EFBBBF"), F.encode(text, "UTF-8")), F.concat(b("FFFE"), F.encode(text, "UTF-16LE")), F.concat(b("FEFF"), F.encode(text, "UTF-16BE")), F.encode(url, "UTF-16LE"), F.encode(url, "UTF-16BE"), F.encode(url, "UTF-8"), F.concat(F.encode(url, "UTF-8"), b("E9")), F.concat(F.encode(url, "UTF-8"), b("E981")), b("89504E470D0A1A0AFF"), b("255044462DFF"), F.concat(F.encode(url, "UTF-8"), b("00FF")), F.concat(b("FFFE"), F.encode(text, "UTF-16LE"), b("41"))]
    content = F.element_at(F.array(*ways), (F.pmod("doc_id", F.lit(len(ways))) + 1).cast("int"))
    rows = _t(spark, d, "documents").select("doc_id", parse(F.lit("plainText"), content).alias("p"))
    return rows.select("doc_id", "p.encoding", "p.text", "p.legacy", "p.code")


_SUFFIX = {"plainText": "txt", "markdown": "md", "srt": "srt", "vtt": "vtt", "html": "html", "rtf": "rtf"}


def _files(spark: SparkSession, d: str, *formats: str) -> DataFrame:
    """The sources of these formats as files, some twice.

    What is made of them is counted once afterwards: the work stays in the tasks of the scan, and
    only its results are shuffled.
    """
    suffix = F.element_at(F.create_map(*(F.lit(x) for pair in _SUFFIX.items() for x in pair)), F.col("doc_format"))
    rows = _t(spark, d, "extracted_docs").filter(F.col("raw_text").isNotNull() & F.col("doc_format").isin(*formats))
    return rows.select("document_id", F.concat("title", F.lit("."), suffix).alias("file_name"), F.encode("raw_text", "UTF-8").alias("content"))


def extract_documents(spark: SparkSession, d: str) -> DataFrame:
    """Sources through the whole pipeline; what RTF gives is in extract_rtf."""
    done = extract(_files(spark, d, "plainText", "markdown", "srt", "vtt", "html"))
    return done.select("document_id", "document.format", "document.title", "document.text", F.size("document.segments").cast("bigint").alias("segments"), "document.metadata", "error.code").dropDuplicates(["document_id"])


def extract_rtf(spark: SparkSession, d: str) -> DataFrame:
    return extract(_files(spark, d, "rtf")).select("document_id", "document.format", "document.text", F.length("document.raw_text").alias("source_characters"), "error.code").dropDuplicates(["document_id"])


def warnings_by_code(spark: SparkSession, d: str) -> DataFrame:
    return count_warnings(extract(_files(spark, d, "srt", "vtt")).dropDuplicates(["document_id"]))


def article_pages(spark: SparkSession, d: str) -> DataFrame:
    """Crawled pages as articles."""
    rows = _t(spark, d, "documents").select("doc_id", "url", F.col("raw_bytes").alias("html"))
    return extract_articles(rows).select("doc_id", "article.title", F.size("article.blocks").alias("blocks"), F.length("article.text").alias("characters"), "article.metadata", "error.code")


def article_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Pages built from the blocks of web_articles, and read as articles again."""
    e = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    around = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))
    tags = {"paragraph": "p", "quote": "blockquote", "code": "pre", "caption": "figcaption", "preservedContent": "div"}

    def html(b: Column) -> Column:
        level, x = F.substring(b["kind"], 9, 1), e(b["text"])
        out = F.when(b["kind"].startswith("heading"), F.concat(F.lit("<h"), level, F.lit(">"), x, F.lit("</h"), level, F.lit(">"))).when(b["kind"] == "listItem", F.concat(F.lit("<ul><li>"), x, F.lit("</li></ul>")))
        for kind, tag in tags.items():
            out = out.when(b["kind"] == kind, around(tag, x))
        return out.otherwise(F.concat(F.lit("<table><tr><td>"), x, F.lit("</td></tr></table>")))

    page = F.concat(F.lit("<html lang='xx'><head><title>"), e(F.col("title")), F.lit("</title><script>var x = '<p>no</p>';</script></head><body><nav><p>Menu of the site, with many words in it</p></nav><article>"), F.array_join(F.transform("blocks", html), "\n"), F.lit("</article><aside><p>Something else, at some length</p></aside></body></html>"))
    rows = _once(spark, d, "web_articles", "article_id", "source_url", "title", "blocks").select("article_id", F.lit("https://a.example/x").alias("url"), F.encode(page, "UTF-8").alias("html"))
    return extract_articles(rows).select("article_id", "article.title", F.size("article.blocks").cast("bigint").alias("blocks"), F.array_join(F.transform("article.blocks", lambda b: F.concat(b["kind"], F.coalesce(b["level"].cast("string"), F.lit("")))), ",").alias("kinds"), "article.text", F.col("article.metadata")["language"].alias("language"), "error.code")


def article_gates(spark: SparkSession, d: str) -> DataFrame:
    """A page for each remainder of the number: addresses, bytes and bodies that the gates let through or refuse."""
    b = lambda x: F.unhex(F.lit(x))
    body = F.concat(F.lit("<html><body><article><p>Words of page "), F.col("doc_id").cast("string"), F.lit(", enough of them to be an article.</p></article></body></html>"))
    good = F.encode(body, "UTF-8")
    short, menu = F.encode(F.lit("<article><p>Too short.</p></article>"), "UTF-8"), F.encode(F.lit("<nav><a href='x'>Home of the site</a></nav><footer>Words at the foot of it, more than forty of letters</footer>"), "UTF-8")
    pages = [good, good, good, b(""), b("FF00FE00"), short, menu, F.concat(b("FFFE"), F.encode(body, "UTF-16LE")), F.concat(b("EFBBBF"), good), F.concat(good, F.lit(" " * 5000).cast("binary")), F.concat(good, b("E9"))]
    urls = ["https://h.example/a", "ftp://h.example/a", None, *["HTTP://h.example"] * 8]
    at = (F.pmod("doc_id", F.lit(len(pages))) + 1).cast("int")
    rows = _t(spark, d, "documents").select("doc_id", F.element_at(F.array(*(F.lit(u) for u in urls)), at).alias("url"), F.element_at(F.array(*pages), at).alias("html"))
    return extract_articles(rows, options=WebOptions(max_input_bytes=4000)).select("doc_id", "article.title", "article.text", "error.code", "error.max_bytes")


def own_format(spark: SparkSession, d: str) -> DataFrame:
    """An extractor of one's own, asked before the default ones."""
    own = Extractor("log", ("log", "txt"), lambda content, name: F.concat(name, F.lit(": "), F.octet_length(content).cast("string")))
    registry = Registry((own, *Registry().extractors))
    suffix = F.element_at(F.array(*(F.lit(x) for x in ("log", "txt", "text", "zzz"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    rows = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("x."), suffix).alias("file_name"), F.encode("url", "UTF-8").alias("content"))
    return extract(rows, registry=registry).select("doc_id", "document.format", "document.text", "error.code", "error.file_name")


def _model(rows: DataFrame) -> DataFrame:
    """web_articles as articles of the model: kinds of heading:N parted into kind and level."""
    kind = lambda b: F.split(b["kind"], ":")
    blocks = F.transform("blocks", lambda b: F.struct(b["id"].alias("id"), kind(b)[0].alias("kind"), F.get(kind(b), F.lit(1)).cast("int").alias("level"), b["text"].alias("text")))
    return rows.select("article_id", F.struct("title", "source_url", blocks.alias("blocks"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), render_blocks(blocks).alias("text")).alias("article"))


def article_text(spark: SparkSession, d: str) -> DataFrame:
    return _model(_once(spark, d, "web_articles", "article_id", "source_url", "title", "blocks", "metadata")).select("article_id", "article.text")


def article_rules(spark: SparkSession, d: str) -> DataFrame:
    return _model(_once(spark, d, "web_articles", "article_id", "source_url", "title", "blocks", "metadata")).select("article_id", validate_article(F.col("article")).alias("rule"))


def article_json(spark: SparkSession, d: str) -> DataFrame:
    """Articles through their serialised form and back."""
    rows = _model(_once(spark, d, "web_articles", "article_id", "source_url", "title", "blocks", "metadata")).withColumn("back", from_json(to_json(F.col("article"))))
    return rows.select("article_id", "back.title", "back.text", F.size("back.blocks").cast("bigint").alias("blocks"))


def site_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Titles branded with the site's name, and unbranded again."""
    site = F.col("metadata")["siteName"]
    return _once(spark, d, "web_articles", "article_id", "title", "metadata").select("article_id", strip_site(F.concat("title", F.lit(" | "), F.upper(F.coalesce(site, F.lit("Other")))), site).alias("title"))


def registry_formats(spark: SparkSession, d: str) -> DataFrame:
    return Registry().frame(spark)


def join_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "web_articles", "article_id", "blocks").select("article_id", join_paragraphs(F.transform("blocks", lambda b: b["text"]), "\n").alias("text"))


def queries() -> dict[str, Q]:
    return {
        "html_text": _raw("html", html_text),
        "html_text_flat": _raw("html", lambda c: html_text(c, FLAT)),
        "html_strip_tags": _raw("html", strip_tags),
        "html_entities": _texts(decode_entities),
        "normalize_default": _texts(normalize),
        "normalize_flat": _texts(lambda c: normalize(c, FLAT)),
        "normalize_raw": _texts(lambda c: normalize(c, PLAIN)),
        "normalize_cells": _texts(normalize_cells),
        "markdown_readable": _raw("markdown", markdown_text),
        "markdown_raw": _raw("markdown", lambda c: markdown_text(c, ExtractOptions(markdown_mode="raw"))),
        "markdown_fences": _raw("markdown", strip_fences),
        "srt_cues": _cues("srt"), "vtt_cues": _cues("vtt"), "srt_segments": _segments("srt"), "vtt_segments": _segments("vtt"),
        "timestamp_seconds": timestamp_seconds, "dispatch": dispatch, "size_limit": size_limit, "errors_by_code": errors_by_code, "document_title": document_title, "registry_formats": registry_formats,
        "decode_utf16": _decoded("UTF-16"), "decode_utf8": _decoded("UTF-8"), "decode_pages": decode_pages,
        "decode_cascade": decode_cascade, "extract_documents": extract_documents, "extract_rtf": extract_rtf,
        "article_pages": article_pages, "article_blocks": article_blocks, "article_gates": article_gates, "own_format": own_format, "article_text": article_text, "article_rules": article_rules, "article_json": article_json, "site_suffix": site_suffix, "join_blocks": join_blocks, "warnings_by_code": warnings_by_code,
    } | catalog_containers.queries()


# SQL ------------------------------------------------------------------------------------------

_WS = "\\t-\\r\\x{85}\\p{Z}"
#: White space and digits of the patterns that are stated with Unicode classes.
_S, _D = "[\\t\\n\\f\\r\\p{Z}]", "\\p{Nd}"
_DOCS = "(select distinct on (document_id) * from extracted_docs)"
_READ = "(select distinct on (document_id) * from decoded_texts)"
_ARTICLES = "(select distinct on (article_id) * from web_articles)"
# Fixed values, written out here once more so that the SQL doesn't take them from what it checks.
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "copy": "©", "reg": "®", "trade": "™"}
_BLOCK_ENDS = "p|div|section|article|header|footer|main|aside|nav|h[1-6]|li|tr|blockquote|pre"
_FORMATS = "0 plainText txt|0 plainText text|1 markdown md|1 markdown markdown|1 markdown mdown|1 markdown mkd|2 srt srt|3 vtt vtt|3 vtt webvtt|4 rtf rtf|5 html html|5 html htm|6 doc doc|7 docx docx|8 odt odt|9 pptx pptx"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{_WS}]+', ''), '[{_WS}]+$', '')"


def _sql_normalize(x: str, flat: bool = False, plain: bool = False) -> str:
    x = f"regexp_replace(replace(replace(regexp_replace({x}, '\\r\\n?|[\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(160), ' '), chr(8203), ''), '[\\x00-\\x08\\x0b-\\x1f]', '', 'g')"
    if plain:
        return _trim(x)
    lines = f"list_transform(string_split(regexp_replace({x}, '[ \\t]+', ' ', 'g'), chr(10)), lambda l: regexp_replace(l, '^[\\p{{Zs}}\\t]+|[\\p{{Zs}}\\t]+$', '', 'g'))"
    joined = f"array_to_string({lines}, {"' '" if flat else 'chr(10)'})"
    return _trim(f"regexp_replace({joined}, '[\\t\\n\\f\\r\\p{{Z}}]+', ' ', 'g')" if flat else f"regexp_replace({joined}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _sql_entities(x: str) -> str:
    pat = "&(?:#x[0-9A-Fa-f]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);"
    named = " ".join(f"when '&{k};' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in _NAMED.items())
    number = "case when e like '&#x%' then try_cast('0x' || e[4:-2] as bigint) when e like '&#%' then try_cast(e[3:-2] as bigint) end"
    one = f"case when e like '&#%' then case when {number} > 0 and {number} <= 1114111 and not {number} between 55296 and 57343 then chr(({number})::int) else e end else case e {named} else e end end"
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{pat}'), list_transform(regexp_extract_all({x}, '{pat}'), lambda e: {one})), lambda z: z[1] || coalesce(z[2], '')), '')"


def _sql_tags(x: str) -> str:
    q = "(?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*"
    return f"regexp_replace(regexp_replace({x}, '<[\\p{{L}}/!?]{q}>', ' ', 'g'), '<[\\p{{L}}/!?]{q}(?:\"[^\"]*|''[^'']*)?$', '')"


def _sql_html(flat: bool = False) -> str:
    mark = "\\x{f0000}"
    m, x = "chr(983040)", "raw_text"
    for pattern, to in (("(?s)<!--.*?-->", "chr(10)"), ("(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>", "chr(10)"), ("(?i)<br\\b[^>]*>", "chr(10)"), (f"(?i)<hr\\b[^>]*>|</(?:{_BLOCK_ENDS})\\s*>", m), ("(?i)<li\\b[^>]*>", "chr(10)"), ("(?i)</t[dh]\\s*>", "chr(9)")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    ws = f"[ \\t\\n\\r\\x{{2028}}\\x{{2029}}{mark}]"
    steps = f"with a as (select document_id, {_sql_tags(x)} as t from {_DOCS} where doc_format = 'html' and raw_text is not null), b as (select document_id, {_sql_entities('t')} as t from a), c as (select document_id, regexp_replace(regexp_replace(t, '^{ws}*{mark}{ws}*', ''), '{ws}*{mark}{ws}*$', '') as t from b), d as (select document_id, regexp_replace(t, '{ws}*{mark}{ws}*', {'chr(10)' if flat else 'chr(10) || chr(10)'}, 'g') as t from c)"
    return f"{steps} select document_id, {_sql_normalize('t', flat)} as text from d"


def _sql_markdown() -> str:
    fence = "(?ms)^[\\p{Zs}\\t]*```[^\\n]*\\n(?:.*?\\n)?[\\p{Zs}\\t]*```[^\\n]*"
    x = "regexp_replace(raw_text, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)^---\\n.*?\\n---\\n', '')"
    x = f"regexp_replace(regexp_replace({x}, '{fence}', chr(10), 'g'), '(?ms)^[\\p{{Zs}}\\t]*```.*\\z', '')"
    x = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: not regexp_matches(l, '^(?:    |\\t)')), chr(10))"
    for p, to in (("!\\[([^\\]]*)\\]\\([^\\n)]*\\)", "\\1"), ("\\[([^\\]]+)\\]\\([^\\n)]*\\)", "\\1"), ("\\[([^\\]]+)\\]\\[[^\\]]*\\]", "\\1"), ("(?i)<https?://[^>]+>", ""), ("(?i)<mailto:([^>]+)>", "\\1")):
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    s = "l"
    for p in (f"^{_S}{{0,3}}#{{1,6}}{_S}+", f"^{_S}*(?:>{_S}*)+", f"^{_S}*[-*+]{_S}+\\[[ xX]\\]{_S}+", f"^{_S}*[-*+]{_S}+", f"^{_S}*{_D}+[.)]{_S}+"):
        s = f"regexp_replace({s}, '{p}', '')"
    blank = f"regexp_matches(l, '^{_S}{{0,3}}\\[[^\\]]+\\]:{_S}*[^\\t\\n\\f\\r\\p{{Z}}]+') or regexp_matches(l, '^{_S}{{0,3}}(?:=+|-+){_S}*$') or regexp_matches(l, '^{_S}*\\|?{_S}*:?-{{3,}}:?{_S}*(?:\\|{_S}*:?-{{3,}}:?{_S}*)+\\|?{_S}*$')"
    x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: case when {blank} then '' else {s} end), chr(10))"
    for p, to in (("`+([^`\\n]*?)`+", "\\1"), ("\\*\\*(.*?)\\*\\*|__(.*?)__", "\\1\\2"), ("\\*(.*?)\\*|_(.*?)_", "\\1\\2"), ("~~(.*?)~~", "\\1"), ("\\\\([\\\\`*_{}\\[\\]()#+\\-.!>])", "\\1")):
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    x = _sql_tags(f"replace({x}, '|', ' ')")
    return f"with a as (select document_id, {x} as t from {_DOCS} where doc_format = 'markdown' and raw_text is not null), b as (select document_id, {_sql_entities('t')} as t from a) select document_id, {_sql_normalize('t')} as text from b"


def _sql_cues(fmt: str) -> str:
    num = "[0-9]+(?:\\.[0-9]*)?"

    def secs(t: str) -> str:
        p = f"string_split({t}, ':')"
        return f"case when regexp_full_match({t}, '[0-9]+:{num}') and {p}[2]::double < 60 then {p}[1]::double * 60 + {p}[2]::double when regexp_full_match({t}, '[0-9]+:[0-9]+:{num}') and {p}[2]::double < 60 and {p}[3]::double < 60 then {p}[1]::double * 3600 + {p}[2]::double * 60 + {p}[3]::double end"

    skip = "and not regexp_matches(upper(string_split(b, chr(10))[1]), '^(?:WEBVTT|NOTE|STYLE|REGION)')" if fmt == "vtt" else ""
    body = _sql_entities("t")
    return f"""
        with docs as (select row_number() over () as rid, document_id, regexp_replace(raw_text, '\\r\\n?', chr(10), 'g') as r from {_DOCS} where doc_format = '{fmt}' and raw_text is not null),
        blocks as (select rid, document_id, k, {_trim("x[k]")} as b from (select rid, document_id, string_split_regex(r, '\\n{_S}*\\n') as x from docs), lateral (select unnest(range(1, len(x) + 1)) as k)),
        lined as (select rid, document_id, k, list_filter(list_transform(string_split(b, chr(10)), lambda y: {_trim('y')}), lambda y: y <> '') as l, list_position(list_transform(list_filter(list_transform(string_split(b, chr(10)), lambda y: {_trim('y')}), lambda y: y <> ''), lambda y: contains(y, '-->')), true) as pos from blocks where b <> '' {skip}),
        parts as (select rid, document_id, k, string_split(l[pos], '-->') as s, case when pos > 1 then {_trim("l[pos - 1]")} end as source_id, regexp_replace(regexp_replace(array_to_string(l[pos + 1:], chr(10)), '<[^>]+>', '', 'g'), '\\{{[^}}]+\\}}', '', 'g') as t from lined where pos > 0),
        read as (select rid, document_id, k, nullif(source_id, '') as source_id, replace({_trim("s[1]")}, ',', '.') as a, replace(regexp_extract({_trim("array_to_string(s[2:], '-->')")}, '^[^\\s\\p{{Z}}]*'), ',', '.') as z, {body} as t from parts),
        said as (select rid, document_id, k, source_id, {secs("a")} as start_time, {secs("z")} as end_time, {_sql_normalize("t")} as text from read)
        select rid, document_id, row_number() over (partition by rid order by k) as n, source_id, start_time, end_time, text from said where text <> ''"""


def _sql_segments(fmt: str) -> str:
    words = lambda x: f"list_filter(string_split_regex({x}, '[{_WS}]+'), lambda w: w <> '')"
    return f"""
        with c as ({_sql_cues(fmt)}),
        w as (select *, {words('text')} as cw, {words("lag(text) over (partition by rid order by n)")} as pw, lag(text) over (partition by rid order by n) as prior from c),
        l as (select *, list_transform(cw, lambda x: lower(x)) as cl, list_transform(pw, lambda x: lower(x)) as pl from w),
        o as (select *, case when prior is null then 0 else coalesce(list_max(list_filter(range(1, least(len(pl), len(cl)) + 1), lambda k: pl[len(pl) - k + 1:] = cl[1:k])), 0) end as k from l),
        s as (select document_id, rid, n, case when prior is null or k = 0 then text when k < len(cw) then array_to_string(cw[k + 1:], ' ') end as text from o)
        select document_id, row_number() over (partition by rid order by n) - 1 as position, '{fmt}-' || n as id, text from s where text is not null"""


def _sql_fences() -> str:
    """Line by line: an open fence is remembered by its sign and length."""
    trimmed = "regexp_replace(line, '^[\\p{Zs}\\t]+', '')"
    opener = f"regexp_extract({trimmed}, '^(`{{3,}}|~{{3,}})')"
    return f"""
        with recursive docs as (select document_id, string_split(raw_text, chr(10)) as x from {_DOCS} where doc_format = 'markdown' and raw_text is not null),
        lines as (select document_id, n, x[n] as line, {opener.replace('line', 'x[n]')} as mark from docs, lateral (select unnest(range(1, len(x) + 1)) as n)),
        run as (
            select document_id, 0::bigint as n, '' as inside, ''::varchar as said, false as kept from docs
            union all
            select l.document_id, l.n, case when r.inside = '' then l.mark when l.mark[1:1] = r.inside[1:1] and len(l.mark) >= len(r.inside) then '' else r.inside end, case when r.inside = '' and l.mark = '' then l.line else '' end, r.inside = '' or l.mark[1:1] = r.inside[1:1] and len(l.mark) >= len(r.inside)
            from run r join lines l on l.document_id = r.document_id and l.n = r.n + 1)
        select document_id, coalesce(string_agg(said, chr(10) order by n) filter (where kept), '') as text from run where n > 0 group by 1"""


def _sql_documents() -> str:
    name = "regexp_extract(title || '.' || s.suffix, '[^/]*$')"
    suffixes = ", ".join(f"('{f}', '{x}')" for f, x in (("plainText", "txt"), ("markdown", "md"), ("srt", "srt"), ("vtt", "vtt"), ("html", "html")))
    said = lambda f: f"select document_id, {_sql_normalize("array_to_string(list(text order by position), chr(10) || chr(10))")} as text, count(*) as segments from ({_sql_segments(f)}) group by 1"
    return f"""
        with s(fmt, suffix) as (values {suffixes}),
        made as (
            select document_id, text, 0::bigint as segments from ({_sql_html()}) union all select document_id, text, 0 from ({_sql_markdown()})
            union all select document_id, {_sql_normalize('raw_text')}, 0 from {_DOCS} where doc_format = 'plainText' and raw_text is not null
            union all {said('srt')} union all {said('vtt')}),
        d as (select document_id, doc_format, coalesce(nullif({_trim(f"regexp_replace({name}, '[.][^.]*$', '')")}, ''), 'Untitled') as name, coalesce(made.text, '') as text, coalesce(made.segments, 0) as segments from {_DOCS} as docs join s on s.fmt = doc_format left join made using (document_id) where raw_text is not null),
        e as (select *, {_trim('text')} = '' and segments = 0 as bad from d)
        select document_id, case when not bad then doc_format end as format, case when not bad then name end as title, case when not bad then text end as text, case when not bad then segments end as segments,
            case when not bad then case when doc_format = 'plainText' then map {{'encoding': 'utf-8'}} else map([]::varchar[], []::varchar[]) end end as metadata, case when bad then 'emptyDocument' end as code from e"""


def _sql_article_blocks() -> str:
    squeezed = f"trim(regexp_replace(coalesce(b.text, ''), '[{_WS}\\x1c-\\x1f]+', ' ', 'g'))"
    return f"""
        with m as (select article_id, {_trim(f"regexp_replace(title, '[{_WS}]+', ' ', 'g')")} as title, list_filter(list_transform(blocks, lambda b: {{'kind': replace(b.kind, ':', ''), 'text': case when b.kind = 'code' then {_trim("coalesce(b.text, '')")} else {squeezed} end}}), lambda b: b.text <> '') as bs from {_ARTICLES}),
        h as (select *, list_filter(bs, lambda b: b.kind = 'heading1')[1].text as first, coalesce(list_sum(list_transform(list_filter(bs, lambda b: b.kind not like 'heading%'), lambda b: length(b.text))), 0) as n from m),
        o as (select *, case when first is null and coalesce(title, '') <> '' then list_prepend({{'kind': 'heading1', 'text': title}}, bs) else bs end as x from h)
        select article_id, case when n >= 40 then coalesce(first, nullif(title, ''), 'a.example') end as title, case when n >= 40 then len(x) end as blocks, case when n >= 40 then array_to_string(list_transform(x, lambda b: b.kind), ',') end as kinds, case when n >= 40 then array_to_string(list_transform(x, lambda b: b.text), chr(10) || chr(10)) end as text, case when n >= 40 then 'xx' end as language, case when n < 40 then 'unreadableArticle' end as code from o"""


def _sql_decode_pages() -> str:
    legacy = "case when regexp_matches(hex(raw_bytes), '^(..)*?(81|8D|8F|90|9D)') then 'iso-8859-1' else 'windows-1252' end"
    return f"select doc_id, case when coalesce(octet_length(raw_bytes), 0) = 0 then case when raw_bytes is not null then 'empty' end when try(decode(raw_bytes)) is not null then 'utf-8' else {legacy} end as encoding, case when raw_bytes is not null then octet_length(raw_bytes) > 0 and try(decode(raw_bytes)) is null end as legacy, case when octet_length(raw_bytes) = 0 then 0 when try(decode(raw_bytes)) is not null then length(decode(raw_bytes)) else octet_length(raw_bytes) end as characters, null::varchar as code from documents"


def _sql_decode_cascade() -> str:
    names = "['empty', 'utf-8-bom', 'utf-16le-bom', 'utf-16be-bom', 'utf-16le-inferred', 'utf-16be-inferred', 'utf-8', 'windows-1252', 'iso-8859-1']"
    return f"with d as (select doc_id, doc_id % 13 as k, coalesce(text, '-') as t, coalesce(url, 'https://x.example/') as u from documents) select doc_id, case when k < 9 then {names}[k + 1] end as encoding, case when k = 0 then '' when k < 4 then t when k < 7 then u when k = 7 then u || 'é' when k = 8 then u || 'é' || chr(129) end as text, case when k < 9 then k in (7, 8) end as legacy, case when k >= 9 then 'unreadableTextEncoding' end as code from d"


def oracle_sql() -> dict[str, str]:
    texts = f"from {_DOCS}"
    model = "list_transform(blocks, lambda b: b.text)"
    joined = f"array_to_string({model}, chr(10) || chr(10))"
    rule = f"""case when list_bool_or(list_transform(blocks, lambda b: {_trim("coalesce(b.id, '')")} = '')) then 'emptyBlockIdentifier'
        when list_bool_or(list_transform(blocks, lambda b: {_trim("coalesce(b.text, '')")} = '')) then 'emptyBlockText'
        when list_bool_or(list_transform(blocks, lambda b: b.kind like 'heading%' and not coalesce(try_cast(b.kind[9:] as int) between 1 and 6, false))) then 'invalidHeadingLevel'
        when {_trim("coalesce(title, '')")} = '' then 'emptyTitle' when coalesce(len(blocks), 0) = 0 then 'emptyBlocks'
        when len(list_distinct(list_transform(blocks, lambda b: b.id))) < len(blocks) then 'duplicateBlockIdentifier' end"""
    return {
        "html_text": _sql_html(),
        "html_text_flat": _sql_html(True),
        "html_strip_tags": f"select document_id, {_sql_tags('raw_text')} as text from {_DOCS} where doc_format = 'html' and raw_text is not null",
        "html_entities": f"select document_id, {_sql_entities('text')} as text {texts}",
        "normalize_default": f"select document_id, {_sql_normalize('text')} as text {texts}",
        "normalize_flat": f"select document_id, {_sql_normalize('text', flat=True)} as text {texts}",
        "normalize_raw": f"select document_id, {_sql_normalize('text', plain=True)} as text {texts}",
        "normalize_cells": f"select document_id, case when contains(text, chr(9)) then {_trim(f'array_to_string(list_transform(string_split(text, chr(9)), lambda c: {_sql_normalize('c')}), chr(9))')} else {_sql_normalize('text')} end as text {texts}",
        "markdown_readable": _sql_markdown(),
        "markdown_raw": f"select document_id, {_sql_normalize('raw_text')} as text from {_DOCS} where doc_format = 'markdown' and raw_text is not null",
        **{f"{f}_cues": f"select document_id, n, source_id, start_time, end_time, text from ({_sql_cues(f)})" for f in ("srt", "vtt")},
        **{f"{f}_segments": _sql_segments(f) for f in ("srt", "vtt")},
        "timestamp_seconds": "select event_id, extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(millisecond from ts)) / 1000 as seconds from events",
        "dispatch": "with e as (select document_id, lower(nullif(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]+)$', 1), '')) as extension from (select distinct on (document_id) * from decoded_texts)) select document_id, extension, case when extension in ('txt', 'text') then 'plainText' when extension in ('md', 'markdown', 'mdown', 'mkd') then 'markdown' when extension = 'srt' then 'srt' when extension in ('vtt', 'webvtt') then 'vtt' when extension = 'rtf' then 'rtf' when extension in ('html', 'htm') then 'html' when extension in ('doc', 'docx', 'odt', 'pptx') then extension end as format from e",
        "size_limit": "select doc_id, case when coalesce(octet_length(raw_bytes), 0) > 2000 then 'fileTooLarge' else 'unsupportedFileType' end as code, case when octet_length(raw_bytes) > 2000 then octet_length(raw_bytes) end as actual_bytes, case when octet_length(raw_bytes) > 2000 then 2000::bigint end as max_bytes from documents",
        "errors_by_code": f"with d as (select document_id, any_value(text) as text from extracted_docs group by 1), n as (select document_id, any_value(file_name) as f from decoded_texts group by 1), j as (select case when f is null or not regexp_matches(lower(f), '\\.(?:txt|text)$') then 'unsupportedFileType' when {_sql_normalize("coalesce(text, '')")} = '' then 'emptyDocument' end as code from d left join n using (document_id)) select code, count(*) as count from j where code is not null group by 1",
        "document_title": f"select document_id, coalesce(nullif({_trim("regexp_replace(file_name, '^(.+)\\.[^.]+$', '\\1')")}, ''), 'Untitled') as title from {_READ}",
        "decode_utf16": "select doc_id, 'utf-16be-bom' as encoding, text, false as legacy from documents",
        "decode_utf8": "select doc_id, case when text = '' then 'empty' else 'utf-8' end as encoding, text, false as legacy from documents",
        "article_text": f"select article_id, {joined} as text from {_ARTICLES}",
        "article_rules": f"select article_id, {rule} as rule from {_ARTICLES}",
        "article_json": f"select article_id, case when ({rule}) is null and source_url is not null then {_trim('title')} end as title, case when ({rule}) is null and source_url is not null then {joined} end as text, case when ({rule}) is null and source_url is not null then len(blocks) end as blocks from {_ARTICLES}",
        "site_suffix": f"select article_id, case when {_trim("coalesce(metadata['siteName'], '')")} <> '' and {_trim('title')} <> '' then {_trim('title')} else title || ' | ' || upper(coalesce(metadata['siteName'], 'Other')) end as title from {_ARTICLES}",
        "join_blocks": f"select article_id, array_to_string(list_filter(list_transform({model}, lambda t: {_trim('t')}), lambda t: t <> ''), chr(10)) as text from {_ARTICLES}",
        "warnings_by_code": f"select 'malformedSubtitleTimestamp' as code, count(*) as count from (select * from ({_sql_cues('srt')}) union all select * from ({_sql_cues('vtt')})) where start_time is null or end_time is null group by all having count(*) > 0",
        "registry_formats": "select * from (values " + ", ".join("({}, '{}', '{}')".format(*x.split(" ")) for x in _FORMATS.split("|")) + ") as t(position, format, extension)",
        "markdown_fences": _sql_fences(), "decode_pages": _sql_decode_pages(), "decode_cascade": _sql_decode_cascade(), "extract_documents": _sql_documents(), "article_blocks": _sql_article_blocks(),
        "article_gates": "with d as (select doc_id, doc_id % 11 as k, 'Words of page ' || doc_id || ', enough of them to be an article.' as t from documents) select doc_id, case when k in (0, 7, 8, 10) then 'h.example' end as title, case when k in (0, 7, 8, 10) then t end as text, [null, 'invalidSourceURL', 'invalidSourceURL', 'unreadableArticle', 'unreadableEncoding', 'unreadableArticle', 'unreadableArticle', null, null, 'inputTooLarge', null][k + 1] as code, case when k = 9 then 4000::bigint end as max_bytes from d",
        "own_format": "with d as (select doc_id, url, ['log', 'txt', 'text', 'zzz'][doc_id % 4 + 1] as x from documents) select doc_id, case when x in ('log', 'txt') then 'log' when x = 'text' then 'plainText' end as format, case when x in ('log', 'txt') then 'x.' || x || ': ' || octet_length(coalesce(url, '')::blob) when x = 'text' then url end as text, case when x = 'zzz' then 'unsupportedFileType' end as code, case when x = 'zzz' then 'x.zzz' end as file_name from d",
    } | catalog_containers.oracle_sql()
