import json

import pytest
from pyspark.sql import functions as F

from quillworks.options import ExtractOptions, WebOptions
from quillworks.plans.articles import explode_blocks, extract_articles, from_json, to_json, validate_article
from quillworks.plans.extract import errors_by_code, explode_segments, extract, warnings_by_code
from quillworks.plans.registry import Extractor, Registry
from quillworks.sources.files import extract_files, read_files, write_documents
from quillworks.streaming.files import extract_stream
from tests.helpers import docx, numbered, odt, pptx, slide, wp
from tests.test_kernels import LONG, word_file

FILES = [
    ("a.txt", b"Hello\r\nworld"), ("b.md", b"# Head\n\n**x**"), ("c.srt", b"1\n00:00:01,000 --> bad\nHi\n"), ("d.vtt", b"WEBVTT\n\n00:01.000 --> 00:02.000\nHey"), ("e.rtf", b"{\\rtf1 Hi\\par}"), ("f.HTM", b"<p>a</p><p>b</p>"),
    ("g.docx", docx(wp("x\ty") + wp("z"))), (None, odt("<text:p>o</text:p>")), ("noext", pptx({"r1": slide("s")})), ("h.doc", word_file("Old\rtext")), ("i.xyz", b"?"), ("j.txt", b" \n"), ("k.txt", b"\x89PNG\xff"), ("l.docx", b"PK"), ("m.txt", b"caf\xe9"), ("n.txt", None), (None, b"text"), ("o.srt", b""),
]


def run(spark, rows, **k):
    return extract(spark.createDataFrame(rows, "file_name string, content binary"), **k).collect()


def test_every_format(spark):
    rows = run(spark, FILES)
    assert len(rows) == len(FILES) and all((r.document is None) != (r.error is None) for r in rows)
    d = [r.document for r in rows if r.document]
    assert [(x.format, x.title, x.text) for x in d] == [("plainText", "a", "Hello\nworld"), ("markdown", "b", "Head\n\nx"), ("srt", "c", "Hi"), ("vtt", "d", "Hey"), ("rtf", "e", "Hi"), ("html", "f", "a\n\nb"), ("docx", "g", "x\ty\n\nz"), ("odt", "Untitled", "o"), ("pptx", "noext", "s"), ("doc", "h", "Old\ntext"), ("plainText", "m", "café")]
    by = {x.format: x for x in d}
    assert by["docx"].raw_text is None and by["markdown"].raw_text == "# Head\n\n**x**" and by["rtf"].raw_text == "{\\rtf1 Hi\\par}"
    assert by["pptx"].segments[0].id == "slide-1" and by["pptx"].metadata["slideCount"] == "1" and by["pptx"].segments[0].metadata["speakerNotesIncluded"] == "false"
    assert by["docx"].metadata["footnoteParagraphs"] == "0" and [w.code for w in by["srt"].warnings] == ["malformedSubtitleTimestamp"] and [w.code for w in d[-1].warnings] == ["lossyEncodingFallback"]
    e = [(r.error.code, r.error.message) for r in rows if r.error]
    assert e == [("unsupportedFileType", "Unsupported file type: i.xyz"), ("emptyDocument", "The document did not contain readable text."), ("unreadableTextEncoding", "Could not decode text encoding for k.txt."), ("invalidDocument", "Invalid document: Could not open DOCX ZIP archive."), ("emptyDocument", "The document did not contain readable text."), ("unsupportedFileType", "Unsupported file type: unknown"), ("emptyDocument", "The document did not contain readable text.")]


def test_size_limit_is_inclusive(spark):
    for n, code in ((5, None), (4, "fileTooLarge")):
        r = run(spark, [("a.txt", b"12345")], options=ExtractOptions(max_input_bytes=n))[0]
        assert (r.error.code if r.error else None) == code
    assert (r.error.actual_bytes, r.error.max_bytes) == (5, 4)


def test_separators(spark):
    data = [("a.docx", docx(wp("a") + wp("b")))]
    assert run(spark, data, options=ExtractOptions(paragraph_separator="\n\n\n"))[0].document.text == "a\n\n\nb"
    assert run(spark, data, options=ExtractOptions(preserve_paragraphs=False))[0].document.text == "a b"


def test_own_extractor_and_order(spark):
    mine = Extractor("csvText", ("txt",), lambda content, name: F.concat(F.lit("mine:"), F.decode(content, "UTF-8")))
    r = run(spark, [("a.txt", b"x"), ("b.md", b"y")], registry=Registry((mine, Extractor("plainText", ("txt", "md")))))
    assert [(x.document.format, x.document.text) for x in r] == [("csvText", "mine:x"), ("plainText", "y")]
    assert Registry().formats()[0] == "plainText" and "mdown" in Registry().extensions() and Registry().frame(spark).count() == 16


def test_strict(spark):
    with pytest.raises(Exception, match="unsupportedFileType"):
        run(spark, [("a.xyz", b"x")], strict=True)


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("a.txt", b"x", "old", "t", 1)], "file_name string, content binary, document string, _text string, text int")
    r = extract(df).first()
    assert r.document.text == "x" and r.text == 1


def test_mutations_give_errors_not_failures(spark):
    seeds = [c for _, c in FILES if c] + [docx(numbered("n"), numbering="<x/>")]
    names = [n or "x.odt" for n, c in FILES if c] + ["n.docx"]
    rows = []
    for n, c in zip(names, seeds):
        for cut in (c[: len(c) // 4], c[: len(c) // 2], c[:-1], c[:10] + b"\x00\xff\x1b" + c[10:], c[:8] + c[4:8] + c[8:], b""):
            rows.append((n, cut))
            rows.append((None, cut))
    assert all((r.document is None) != (r.error is None) for r in run(spark, rows))


def test_reports(spark):
    df = extract(spark.createDataFrame(FILES, "file_name string, content binary"))
    assert {r.code: r["count"] for r in errors_by_code(df).collect()} == {"unsupportedFileType": 2, "emptyDocument": 3, "unreadableTextEncoding": 1, "invalidDocument": 1}
    assert {r.code for r in warnings_by_code(df).collect()} == {"malformedSubtitleTimestamp", "lossyEncodingFallback"}
    assert explode_segments(df, ["file_name"]).count() == 3


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "file_name string, content binary")).count() == 0
    assert extract_articles(spark.createDataFrame([], "url string, html binary")).count() == 0


def test_files_and_stream(spark, tmp_path):
    for n, c in FILES[:10]:
        (tmp_path / (n or "u.odt")).write_bytes(c)
    got = {r.path.rsplit("/", 1)[1]: r for r in extract_files(spark, str(tmp_path), ExtractOptions(max_input_bytes=2000)).collect()}
    assert len(got) == 10 and got["a.txt"].document.source_url.endswith("/a.txt") and got["h.doc"].error.code == "fileTooLarge"
    assert "LessThanOrEqual(length,2000)" in read_files(spark, str(tmp_path)).filter("length <= 2000").select("path")._jdf.queryExecution().toString()
    q = extract_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("docs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "_c")).start()
    q.awaitTermination(120)
    assert spark.table("docs").filter("document is not null").count() == 10
    write_documents(extract_files(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("document is not null").count() == 10


PAGE = f"<html lang='en'><head><title>Story - Site</title><meta property='og:site_name' content='Site'></head><body><article><p>{LONG}</p></article></body></html>"


def articles(spark, rows, **k):
    return extract_articles(spark.createDataFrame(rows, "url string, html binary"), **k).collect()


def test_articles(spark):
    r = articles(spark, [("https://x.example/a", PAGE.encode())])[0].article
    assert r.title == "Story" and [(b.id, b.kind, b.level, b.text) for b in r.blocks] == [("block-000001", "heading", 1, "Story"), ("block-000002", "paragraph", None, LONG)]
    assert r.text == f"Story\n\n{LONG}" and r.metadata == {"siteName": "Site", "language": "en"}
    no_title = articles(spark, [("https://X.example/a", f"<article><p>{LONG}</p></article>".encode())])[0].article
    assert no_title.title == "X.example" and len(no_title.blocks) == 1


@pytest.mark.parametrize("url,html,options,code", [
    ("file:///x", PAGE, {}, "invalidSourceURL"), ("ftp://x.y/", PAGE, {}, "invalidSourceURL"), (None, PAGE, {}, "invalidSourceURL"), ("http:///x", PAGE, {}, "invalidSourceURL"), ("http://x.y/", "", {}, "unreadableArticle"), ("http://x.y/", PAGE, {"max_input_bytes": 10}, "inputTooLarge"), ("http://x.y/", "\0", {}, "unreadableEncoding"),
    ("http://x.y/", PAGE, {"max_blocks": 1}, "tooManyBlocks"), ("http://x.y/", PAGE, {"max_dom_elements": 1}, "tooManyDOMElements"), ("http://x.y/", "<article><h1>A title that is far longer than forty characters in all</h1><p>short</p></article>", {}, "unreadableArticle"), ("http://x.y/", "<body><nav>Home</nav></body>", {}, "unreadableArticle"),
])
def test_article_errors(spark, url, html, options, code):
    assert articles(spark, [(url, html.encode())], options=WebOptions(**options))[0].error.code == code


def test_model_rules_and_json(spark):
    df = extract_articles(spark.createDataFrame([("https://x.example/a", PAGE.encode())], "url string, html binary"))
    r = df.select("article", to_json(F.col("article")).alias("j"), from_json(to_json(F.col("article"))).alias("back"), validate_article(F.col("article")).alias("rule")).first()
    assert r.back == r.article and r.rule is None and set(json.loads(r.j)) == {"title", "sourceURL", "blocks", "metadata"}
    assert explode_blocks(df, ["url"]).count() == 2
    j = lambda **k: json.dumps({"title": "t", "sourceURL": "http://x", "blocks": [{"id": "1", "kind": {"type": "paragraph"}, "text": "a"}]} | k)
    cases = [(j(), True), (j(title=" "), False), (j(blocks=[]), False), ("{", False), (j(blocks=[{"id": "1", "kind": {"type": "heading", "level": 9}, "text": "a"}]), False), (j(blocks=[{"id": "1", "kind": {"type": "quote"}, "text": "a"}] * 2), False), (j(blocks=[{"id": "", "kind": {"type": "quote"}, "text": "a"}]), False), (j(blocks=[{"id": "1", "kind": {"type": "quote"}, "text": " "}]), False), (None, False)]
    got = spark.createDataFrame(cases, "j string, ok boolean").select("ok", from_json(F.col("j")).alias("a")).collect()
    assert [r.a is not None for r in got] == [ok for _, ok in cases] and got[0].a.metadata == {} and got[0].a.text == "a"


def test_running_work_can_be_cancelled(spark):
    import threading
    import time

    from pyspark.sql import functions as F

    from quillworks.session import cancel, cancellable

    ended = []

    def work():
        with cancellable(spark, "slow-pages"):
            try:
                spark.range(8, numPartitions=8).select(F.pandas_udf(_slow, "bigint")("id").alias("x")).agg(F.sum("x")).collect()
            except Exception as e:
                ended.append(str(e))

    t = threading.Thread(target=work)
    t.start()
    for _ in range(120):
        time.sleep(0.5)
        cancel(spark, "slow-pages")
        if not t.is_alive():
            break
    t.join(60)
    assert ended and "cancel" in ended[0].lower()


def _slow(x):
    import time

    time.sleep(90)
    return x
