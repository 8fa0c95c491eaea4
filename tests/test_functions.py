import random

import pytest
from pyspark.sql import functions as F

from quillworks.functions import html, markdown, subtitles, text, titles
from quillworks.options import ExtractOptions


def run(spark, make, values):
    df = spark.createDataFrame(list(enumerate(values)), "k int, x string")
    return [r.y for r in df.select("k", make(F.col("x")).alias("y")).orderBy("k").collect()]


@pytest.mark.parametrize("options,cases", [
    (ExtractOptions(), {" a \t b \r\nc\r\rd e ": "a b\nc\n\nd\ne", "x  y​z": "x yz", "a\x00b\x0b\tc\x7f": "ab c\x7f", "a\n\n\n\n b": "a\n\nb", "　wide　\n line ": "wide\nline", "": "", None: None}),
    (ExtractOptions(preserve_paragraphs=False), {"a\n\n b\tc d": "a b c d"}),
    (ExtractOptions(normalize_whitespace=False), {"  a   b \n\n\n c\r\n": "a   b \n\n\n c"}),
])
def test_normalize(spark, options, cases):
    assert run(spark, lambda c: text.normalize(c, options), cases) == list(cases.values())


def test_cells_and_paragraphs(spark):
    assert run(spark, text.normalize_cells, [" a \t  b  b\t", "plain  x", "\t\t"]) == ["a\tb b", "plain x", ""]
    df = spark.createDataFrame([([" a ", "", "b"],)], "x array<string>")
    assert df.select(text.join_paragraphs(F.col("x"), "--").alias("y")).first().y == "a--b"


HTML = {
    "<h1>Title</h1><p>One <b>bold</b> word.</p><p>Two</p>": "Title\n\nOne bold word.\n\nTwo",
    "<ul><li>a</li><li>b</li></ul>": "a\n\nb",
    "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>": "1 2\n\n3",
    "a<br>b<BR/>c<hr>d": "a\nb\nc\n\nd",
    "<script>x<y</script>a<!-- <p>no</p> -->b<style>p{}</style>": "a\nb",
    '<a title="x > y">t</a> 1 < 2 <unended': "t 1 < 2",
    "&lt;b&gt; &amp;lt; &#65;&#x42;&nbsp;&bogus;&#0;&#xD800;&#1114112; &copy": "<b> &lt; AB &bogus;&#0;&#xD800;&#1114112; &copy",
    "<div><section><p>x</p></section></div>y": "x\n\ny",
}


def test_html(spark):
    assert run(spark, html.html_text, HTML) == list(HTML.values())
    assert run(spark, lambda c: html.html_text(c, ExtractOptions(preserve_paragraphs=False)), ["<p>a</p><p>b</p>"]) == ["a b"]
    assert run(spark, lambda c: html.html_text(c, ExtractOptions(paragraph_separator="\n---\n")), ["<p>a</p><p>b</p>c"]) == ["a\n---\nb\n---\nc"]


def scan_tags(s):
    out, i = "", 0
    while i < len(s):
        if s[i] == "<" and i + 1 < len(s) and (s[i + 1].isalpha() or s[i + 1] in "/!?"):
            j, quote = i + 1, None
            while j < len(s) and (quote or s[j] != ">"):
                quote = None if s[j] == quote else quote or (s[j] if s[j] in "\"'" else None)
                j += 1
            if j == len(s):
                return out
            out, i = out + " ", j + 1
        else:
            out, i = out + s[i], i + 1
    return out


def test_tags_against_a_scanner(spark):
    rnd = random.Random(1)
    cases = ["".join(rnd.choice("<>ab/!\"' é") for _ in range(rnd.randint(0, 24))) for _ in range(3000)]
    assert run(spark, html.strip_tags, cases) == [scan_tags(c) for c in cases]


def test_long_input_does_not_overflow(spark):
    n = 100_000
    cases = ["<b>" * n, "a</p>" * n, "&amp;" * n, "<" * n, "\n" * n, "`" * n, "**a" * 50_000, " \t" * n, "```\n" + "x\n" * 200_000 + "```", "　" * n + "x", "<p '" + "y" * n]
    assert all(r is not None for r in run(spark, html.html_text, cases) + run(spark, markdown.markdown_text, cases) + run(spark, text.normalize, cases))


MARKDOWN = {
    "---\ntitle: x\n---\n# Head #\n\nText": "Head #\n\nText",
    "---\n---\nx": "x",
    "a\n```py\ncode\n```\nb\n~~~\nmore\n~~~~ tail\nc": "a\n\nb\n\nc",
    "a\n````\n```\nx\n````\nb": "a\n\nb",
    "a\n```\nopen": "a",
    "    indented\n\ttabbed\nkept": "kept",
    "![alt](u) [label](u) [ref][1] <https://x.y> <mailto:a@b.c>\n[1]: http://z": "alt label ref a@b.c",
    "Head\n====\nx\n---\n| a | b |\n|---|:---:|\n| 1 | 2 |": "Head\n\nx\n\na b\n\n1 2",
    "> - quoted item\n* [x] done\n1. one\n2) two\n+ plus": "quoted item\ndone\none\ntwo\nplus",
    "**b** __b__ *i* _i_ ~~s~~ `c` \\*no\\* snake_case_name": "b b i i s c *no* snakecasename",
    "<b>x</b> &amp; y": "x & y",
}


def test_markdown(spark):
    assert run(spark, markdown.markdown_text, MARKDOWN) == list(MARKDOWN.values())
    assert run(spark, lambda c: markdown.markdown_text(c, ExtractOptions(markdown_mode="raw")), ["# a  b"]) == ["# a b"]
    assert run(spark, lambda c: markdown.markdown_text(c, ExtractOptions(drop_markdown_code_blocks=False)), ["    in\nout"]) == ["in\nout"]


def test_fences_against_a_scanner(spark):
    def scan(s):
        out, fence = [], None
        for line in s.split("\n"):
            t = line.strip(" \t")
            mark = t[:1] if t[:3] in ("```", "~~~") else None
            n = len(t) - len(t.lstrip(mark)) if mark else 0
            if fence is None and mark:
                fence = (mark, n)
                out.append("")
            elif fence and mark == fence[0] and n >= fence[1]:
                fence = None
                out.append("")
            elif fence is None:
                out.append(line)
        return out

    rnd = random.Random(3)
    lines = ["a", "", "```", "~~~", "````", " ```py", "~~~~", "``", "b c"]
    cases = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 9))) for _ in range(1500)]
    squeeze = lambda parts: "\n".join(p for p in parts if p)
    assert [squeeze(r.split("\n")) for r in run(spark, markdown.strip_fences, cases)] == [squeeze(scan(c)) for c in cases]


def test_times(spark):
    cases = {"00:00:01,500": 1.5, "01:02:03.250": 3723.25, "75:10.5": 4510.5, "00:60:00": None, "00:00:60": None, "1": None, "a:b": None, "00:01:02:03": None, "-1:00": None, " 00:01.000 ": 1.0, "": None, None: None}
    assert run(spark, subtitles.seconds, cases) == list(cases.values())


SRT = "﻿".strip("﻿") + "1\r\n00:00:01,000 --> 00:00:02,000 align:start\r\n<i>Hello</i> {\\an8}there\r\nfriend\r\n\r\n2\n00:00:02,000 --> bad\nHello there friend and more\n\nno time line\n\n3\n00:00:04,000 --> 00:00:05,000\n\n\n4\n00:00:06,000 --> 00:00:07,000\nand more to say"


def parsed(spark, source, fmt, options=ExtractOptions()):
    df = spark.createDataFrame([(source,)], "x string").select(F.inline(F.array(F.struct(subtitles.cues(F.col("x"), fmt, options).alias("c")))))
    return df.select("c", subtitles.segments(F.col("c"), fmt, options).alias("s"), subtitles.time_warnings(F.col("c")).alias("w")).first()


def test_subtitles(spark):
    r = parsed(spark, SRT, "srt")
    assert [(c.n, c.source_id, c.start_time, c.end_time, c.text) for c in r.c] == [(1, "1", 1.0, 2.0, "Hello there\nfriend"), (2, "2", 2.0, None, "Hello there friend and more"), (3, "4", 6.0, 7.0, "and more to say")]
    assert [(s.id, s.text, s.metadata) for s in r.s] == [("srt-1", "Hello there\nfriend", {"format": "srt", "sourceCueID": "1"}), ("srt-2", "and more", {"format": "srt", "sourceCueID": "2"}), ("srt-3", "to say", {"format": "srt", "sourceCueID": "4"})]
    assert [w.message for w in r.w] == ["Could not parse subtitle timestamp for cue 2."]
    kept = parsed(spark, SRT, "srt", ExtractOptions(remove_duplicate_subtitle_lines=False))
    assert [s.text for s in kept.s][1] == "Hello there friend and more"


def test_vtt(spark):
    r = parsed(spark, "WEBVTT\n\nNOTE x\n\nSTYLE\na{}\n\nid-1\n00:01.000 --> 00:02.000\nHi &amp; bye\n\n00:03.000 --> 00:04.000\nhi & BYE", "vtt")
    assert [(s.id, s.text) for s in r.s] == [("vtt-1", "Hi & bye")]


def test_rolling_captions_against_a_loop(spark):
    rnd = random.Random(9)
    words = "a b c A d".split()
    docs = []
    for _ in range(200):
        texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) for _ in range(12)]
        docs.append(texts)
    source = ["\n\n".join(f"00:00:0{i % 9},000 --> 00:00:09,000\n{t}" for i, t in enumerate(d)) for d in docs]
    df = spark.createDataFrame(list(enumerate(source)), "k int, x string").select("k", F.inline(F.array(F.struct(subtitles.cues(F.col("x"), "srt").alias("c")))))
    got = {r.k: [s.text for s in r.s] for r in df.select("k", subtitles.segments(F.col("c"), "srt").alias("s")).collect()}
    for k, d in enumerate(docs):
        want, prior = [], None
        for t in d:
            w = t.split()
            low, n = [x.lower() for x in w], 0
            if prior is not None:
                n = next((i for i in range(min(len(prior), len(low)), 0, -1) if prior[-i:] == low[:i]), 0)
            if n < len(w):
                want.append(t if not n else " ".join(w[n:]))
            prior = low
        assert got[k] == want


def test_names_and_titles(spark):
    cases = {"/a/b/Report.Final.DOCX": "docx", "x": None, ".md": None, "a.": None, "dir.x/file": None, "a.b": "b", None: None}
    assert run(spark, titles.extension, cases) == list(cases.values())
    df = spark.createDataFrame([("file:///x/One%20.md", "two.txt"), (None, "two.tar.gz"), (None, None), (None, ".md"), (None, "  ")], "u string, n string")
    assert [r.t for r in df.select(titles.title(F.col("u"), F.col("n")).alias("t")).collect()] == ["One%20", "two.tar", "Untitled", ".md", "Untitled"]
    cases = [("Field Notes | Trail", "Trail", "Field Notes"), ("Field Notes - TRAIL", "trail", "Field Notes"), ("A | B | Trail", "Trail", "A | B"), ("Notes | Other", "Trail", "Notes | Other"), ("x | Trail", None, "x | Trail"), ("Trail", "Trail", "Trail"), ("| Trail", "Trail", "| Trail")]
    df = spark.createDataFrame(cases, "t string, s string, w string")
    assert all(r.y == r.w for r in df.select("w", titles.strip_site(F.col("t"), F.col("s")).alias("y")).collect())


def test_numbers():
    from quillworks.kernel import office

    assert [office.letters(n) for n in (1, 26, 27, 52, 702, 703)] == ["a", "z", "aa", "az", "zz", "aaa"]
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    for n in range(1, 4000):
        signs = [value[x] for x in office.roman(n)]
        assert sum(-a if b > a else a for a, b in zip(signs, [*signs[1:], 0])) == n
    assert (office.roman(1994), office.roman(0), office.roman(4000)) == ("mcmxciv", None, None)


def test_unicode_spaces_in_markdown(spark):
    got = run(spark, markdown.markdown_text, ["#\u00a0Title", "-\u2003item", "\u0661. one", ">\u00a0said", "\u00a0[a]:\u2003http://x", "---\u00a0"])
    assert got == ["Title", "item", "one", "said", "", ""]


def test_unicode_blank_lines_and_padding_in_subtitles(spark):
    source = "1\n00:00:01,000 --> 00:00:02,000\n  hello \u00a0\n\u2003\n world\n \u00a0\n2\n00:00:03,000 --> 00:00:04,000\nthere"
    got = run(spark, lambda c: subtitles.cues(c, "srt", ExtractOptions(normalize_whitespace=False, subtitle_cue_separator=" / ")), [source])[0]
    assert [c.text for c in got] == ["hello", "there"]
    got = run(spark, lambda c: subtitles.cues(c, "srt", ExtractOptions(normalize_whitespace=False, subtitle_cue_separator=" / ")), ["1\n00:00:01,000 --> 00:00:02,000\n  hello \u00a0\n  world "])[0]
    assert [c.text for c in got] == ["hello / world"]


def test_the_boundary_mark_in_the_input_stays(spark):
    m, a = html.MARK, html._ASIDE
    assert run(spark, html.html_text, [f"<p>a{m}b</p><p>{a}2{a}</p>", f"x&#{ord(m)};y&#x{ord(m):X};"]) == [f"a{m}b\n\n{a}2{a}", f"x{m}y{m}"]
