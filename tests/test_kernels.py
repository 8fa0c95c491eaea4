import struct
import time

import pytest

from quillworks.kernel import Unreadable, article, decode, doc, office, rtf
from quillworks.kernel.flow import WORD, BadXml, blocks
from quillworks.options import MIB, ExtractOptions, WebOptions
from tests.helpers import W, docx, numbered, odt, pptx, slide, wp, zipped

O = ExtractOptions()


def test_decoding_order():
    assert decode.decode(b"") == ("", "empty", False)
    assert decode.decode("é".encode("utf-8-sig")) == ("é", "utf-8-bom", False)
    assert decode.decode(b"\xff\xfe" + "é".encode("utf-16-le")) == ("é", "utf-16le-bom", False)
    assert decode.decode(b"\xfe\xff" + "é".encode("utf-16-be")) == ("é", "utf-16be-bom", False)
    assert decode.decode("hello".encode("utf-16-le"))[1] == "utf-16le-inferred"
    assert decode.decode("hello".encode("utf-16-be"))[1] == "utf-16be-inferred"
    assert decode.decode("naïve".encode())[1] == "utf-8" and decode.decode(b"a\0b")[1] == "utf-8"
    assert decode.decode(b"caf\xe9 \x93x\x94") == ("café “x”", "windows-1252", True)
    assert decode.decode(b"caf\xe9\x81") == ("café\x81", "iso-8859-1", True)


@pytest.mark.parametrize("data", [b"\xff\xfea", b"\x89PNG\r\n\x1a\n\xff", b"%PDF-1\xff", b"PK\x03\x04\xff", b"\xff\x00\x01", b"\xff" + b"\x01" * 9])
def test_what_is_no_text(data):
    with pytest.raises(Unreadable) as e:
        decode.decode(data)
    assert e.value.code == "unreadableTextEncoding"


def test_word_semantics():
    body = wp("One  two") + "<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>kept</w:t></w:r></w:ins><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:tab/><w:t>x</w:t><w:br/><w:t>y</w:t></w:r></w:p>"
    body += f"<w:tbl><w:tr><w:tc>{wp('a')}{wp('b')}</w:tc><w:tc>{wp('c')}<w:tbl><w:tr><w:tc>{wp('in')}</w:tc></w:tr></w:tbl></w:tc></w:tr><w:tr><w:tc/><w:tc>{wp('d')}</w:tc></w:tr></w:tbl>"
    body += "<w:p><w:r><w:t>out</w:t></w:r><w:r><w:p><w:r><w:t>box</w:t></w:r></w:p></w:r></w:p>"
    assert office.docx(docx(body), O).body == ["One two", "kept\tx\ny", "a b\tc in", "d", "outbox"]


def test_word_numbering():
    levels = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>' for i, (f, t) in enumerate([("decimal", "%1."), ("lowerLetter", "%1.%2)"), ("upperRoman", "%3"), ("bullet", "")]))
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="0">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>'
    body = numbered("a") + numbered("b", level=1) + numbered("c", level=1) + numbered("d") + numbered("e", level=1) + numbered("f", "2") + numbered("g", level=3) + numbered("h", level=2) + numbered("i", "9")
    p = office.docx(docx(body, numbering=numbering), O)
    assert p.body == ["1. a", "1.a) b", "1.b) c", "2. d", "2.a) e", "5. f", "• g", "I h", "i"]
    assert p.warnings == [("unsupportedDOCXFeature", office.NO_LABELS)]
    bad = office.docx(docx(numbered("a"), numbering="<w:x"), O)
    assert bad.body == ["a"] and bad.warnings == [("unsupportedDOCXFeature", office.NO_NUMBERING)]
    assert office.docx(docx(numbered("a")), O).warnings == []


def test_word_notes_and_headers():
    notes = f'<w:footnotes {W}><w:footnote w:id="-1">{wp("sep")}</w:footnote><w:footnote w:id="2">{wp("note")}</w:footnote></w:footnotes>'
    head = f"<w:hdr {W}>{wp('Head')}</w:hdr>"
    data = docx(wp("body"), footnotes=notes, endnotes="<bad", header1=head, header2=head, footer1="<bad")
    p = office.docx(data, O)
    assert (p.body, p.footnotes, p.endnotes, p.headers) == (["body"], ["note"], [], []) and p.warnings == [("skippedDOCXEndnotes", "Could not parse DOCX endnotes.")]
    p = office.docx(data, ExtractOptions(include_docx_headers_and_footers=True, include_docx_footnotes=False))
    assert p.headers == ["Head", "Head"] and not p.footnotes and ("skippedDOCXFooter", "Could not parse word/footer1.xml.") in p.warnings


def test_open_document():
    body = '<text:h>Head</text:h><text:p>a<text:s text:c="3"/>b<text:tab/>c<text:line-break/>d</text:p><text:list><text:list-item><text:p>i</text:p><text:list><text:list-item><text:p>j</text:p></text:list-item></text:list></text:list-item></text:list>'
    body += "<table:table><table:table-row><table:table-cell><text:p>1</text:p></table:table-cell><table:covered-table-cell/><table:table-cell><text:p>2</text:p></table:table-cell></table:table-row></table:table><text:tracked-changes><text:p>old</text:p></text:tracked-changes><text:p>x<text:note><text:p>n</text:p></text:note></text:p>"
    assert office.odt(odt(body), O).body == ["Head", "a b\tc\nd", "• i", "• j", "1\t\t2", "x n"]
    for data in (zipped({"content.xml": "<a/>"}), odt("<text:p>x</text:p>", "text/plain"), zipped({"mimetype": office.ODT_TYPE}), zipped({"mimetype": office.ODT_TYPE, "content.xml": "<a"})):
        with pytest.raises(Unreadable):
            office.odt(data, O)


def test_slides():
    hidden = '<p:sp><p:nvPr><p:ph type="sldNum"/></p:nvPr><a:p><a:r><a:t>7</a:t></a:r></a:p></p:sp>'
    p = office.pptx(pptx({"r1": slide("One", extra=hidden), "r2": slide("Two")}, order=["r2", "r1"], notes={"r1": slide("Said", extra=hidden)}), O)
    assert p.slides == [(1, "ppt/slides/r2.xml", ["Two"], []), (2, "ppt/slides/r1.xml", ["One", "7"], ["Said"])] and p.slide_count == 2
    assert office.pptx(pptx({"r1": slide("a")}, notes={"r1": slide("b")}), ExtractOptions(include_pptx_speaker_notes=False)).slides[0][3] == []
    for bad in (pptx({"r1": slide("a")}, order=["r9"]), pptx({}, order=[]), pptx({"r1": "<bad"}), pptx({"r1": slide("a")}, notes={"r1": "<bad"}), pptx({"r1": slide("a")}, rels=f'<R><Relationship Id="r1" Type="x/slide" Target="http://e" TargetMode="External"/></R>')):
        with pytest.raises(Unreadable):
            office.pptx(bad, O)


def test_paths():
    r = office.resolve
    assert (r("slides/a.xml", "ppt/p.xml"), r("../x/./b.xml", "ppt/slides/s.xml"), r("/ppt\\c.xml", "q/r"), r("../../../e", "ppt/s/x"), r("", "x")) == ("ppt/slides/a.xml", "ppt/x/b.xml", "ppt/c.xml", None, None)


def test_archive_budget():
    data = docx(wp("x" * 1000))
    size = len(f"<w:document {W}><w:body>{wp('x' * 1000)}</w:body></w:document>")
    assert office.docx(data, ExtractOptions(max_archive_entry_bytes=size, max_expanded_archive_bytes=size, max_archive_entry_count=1)).expanded == size
    for o in (ExtractOptions(max_archive_entry_bytes=size - 1), ExtractOptions(max_expanded_archive_bytes=size - 1), ExtractOptions(max_archive_entry_count=0)):
        with pytest.raises(Unreadable):
            office.docx(data, o)


def test_entities_in_xml_are_refused():
    with pytest.raises(BadXml):
        blocks(b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', WORD)


def test_sniffing():
    assert [office.sniff(d, O) for d in (docx(wp("a")), odt(""), pptx({"r": slide("a")}), zipped({"a": "b"}), b"PK", b"text")] == ["docx", "odt", "pptx", None, None, None]


def test_sniffing_looks_past_the_entry_limit():
    files = {"word/document.xml": f"<w:document {W}><w:body>{wp('x')}</w:body></w:document>"} | {f"x/{i}": "" for i in range(2100)}
    assert office.sniff(zipped(files), O) == "docx"
    with pytest.raises(Unreadable):
        office.docx(zipped(files), O)
    assert office.sniff(zipped({"mimetype": office.ODT_TYPE, "content.xml": "<a/>"} | {f"x/{i}": "" for i in range(2100)}), O) == "odt"


def test_deep_xml():
    body = "<w:x>" * 20_000 + wp("deep") + "</w:x>" * 20_000
    assert office.docx(docx(body), O).body == ["deep"]


def test_numbering_goes_on_and_starts_again():
    level = lambda i, f, t: f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>'
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="7">{level(0, "upperLetter", "%1)")}{level(1, "decimalZero", "%1-%2")}{level(2, "lowerRoman", "(%3)")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
    body = numbered("a", level=2) + numbered("b") + numbered("c", level=2) + numbered("d", level=2) + numbered("e", level=1) + numbered("f", level=2) + numbered("g") + wp("") + numbered("") + numbered("h", level=1)
    assert office.docx(docx(body, numbering=numbering), O).body == ["(i) a", "A) b", "(i) c", "(ii) d", "A-1 e", "(i) f", "B) g", "B-1 h"]


def test_rtf_binary_data_and_code_pages():
    assert rtf.text(rb"{\rtf1 a{\bin3 }}{}b}") == "ab"
    assert rtf.text(rb"{\rtf1\ansicpg932 \'82\'b1\'83A!}") == "こア!"
    assert rtf.text(rb"{\rtf1\ansi\deff0{\fonttbl{\f0\fcharset0 A;}{\f1\fcharset204 B;}{\f2\fcharset134 C;}}\'e9 {\f1 \'e8}{\f2 \'c4\'e3}\f1\'e8\plain\'e8}") == "é и你иè"


def test_rtf():
    data = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\generator X;}{\info{\title T}}Caf\'e9 {\b bold}\par \u8364 ?5\tab x\line y\{z\}\~w {\field{\*\fldinst HYPERLINK}{\fldrslt link}}\uc2\u233??.}"
    assert rtf.text(data) == "Café bold\n€5\tx\ny{z}\xa0w linké."
    for bad in (b"", b"plain", b"{\\rtf1 open"):
        with pytest.raises(Unreadable):
            rtf.text(bad)


def word_file(text, wide=False, table="1Table"):
    """A minimal compound file with a one-piece document."""
    body = text.encode("utf-16-le" if wide else "cp1252")
    at = 0x600
    word = bytearray(at + len(body))
    struct.pack_into("<H", word, 0, 0xA5EC)
    struct.pack_into("<H", word, 10, 0x0200 if table == "1Table" else 0)
    struct.pack_into("<I", word, 0x4C, len(text))
    clx = b"\x02" + struct.pack("<I", 4 * 2 + 8) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, at if wide else (at * 2) | 0x40000000, 0)
    struct.pack_into("<II", word, 0x1A2, 0, len(clx))
    word[at:] = body
    pad = lambda b: bytes(b) + bytes(-len(b) % 512)
    streams = [pad(word.ljust(4096, b"\0")), pad(clx.ljust(4096, b"\0"))]
    sizes = [max(4096, len(word)), 4096]
    fat, starts, sectors = [0xFFFFFFFD, 0xFFFFFFFE], [], b""
    for s in streams:
        first, n = len(fat), len(s) // 512
        starts.append(first)
        fat += [*range(first + 1, first + n), 0xFFFFFFFE]
        sectors += s
    entry = lambda name, kind, start, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + struct.pack("<III", *[0xFFFFFFFF] * 3) + bytes(36) + struct.pack("<IQ", start, size)
    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("WordDocument", 2, starts[0], sizes[0]) + entry(table, 2, starts[1], sizes[1]) + bytes(128)
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    table_of_sectors = struct.pack("<128I", *(fat + [0xFFFFFFFF] * (128 - len(fat))))
    return head + table_of_sectors + directory + sectors


def test_word_97():
    assert doc.text(word_file("Héllo\rworld\x13 HYPERLINK x \x14link\x15\x07")) == "Héllo\nworldlink\t"
    assert doc.text(word_file("Привет\r", wide=True, table="0Table")) == "Привет\n"
    good = word_file("abc")
    for bad in (b"", b"x" * 600, good[:700], good[:512] + bytes(512) + good[1024:]):
        with pytest.raises(Unreadable):
            doc.text(bad)


def page(html, o=WebOptions()):
    return article.read(html, o)


LONG = "This sentence, which is long enough to count as content, tells of a mill by the river and of its keeper."


def test_article_blocks():
    html = f"""<html lang="en"><head><title>T | S</title><meta property="og:site_name" content="S"><meta name="author" content="A"></head><body><nav>Home | About</nav>
    <article><header><h1>Story</h1><p class="byline">By B</p></header><p>{LONG} <b>bold</b><p>Unclosed
    <ul><li><p>Parent.</p><div><ul><li>Child.</li></ul></div></li><li><p>One.</p><p>Two.</p><li>Three</ul>
    <blockquote><p>Quoted.</p></blockquote><pre><code>a
  b</code></pre><table><tr><th>x<th>y<tr><td>1<td>2</table><figure><figcaption>Cap</figcaption></figure><div>Loose <em>text</em></div><dl><dt>t<dd>d</dl><script>no()</script><form><input></form></article>
    <aside><p>{LONG}</p></aside><footer>Terms</footer></body></html>"""
    p = page(html)
    assert p.drafts == [("heading", 1, "Story"), ("paragraph", None, LONG + " bold"), ("paragraph", None, "Unclosed"), ("listItem", None, "Parent."), ("listItem", None, "Child."), ("listItem", None, "One. Two."), ("listItem", None, "Three"), ("quote", None, "Quoted."), ("code", None, "a\n  b"), ("table", None, "x\ty\n1\t2"), ("caption", None, "Cap"), ("preservedContent", None, "Loose text"), ("listItem", None, "t"), ("listItem", None, "d")]
    assert (p.title, p.site, p.author, p.language) == ("T | S", "S", "A", "en")


def test_content_without_article_element():
    html = f"<body><div id='menu'><a href='/'>Home</a></div><div class='wrap'><div class='story'><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div></div></body>"
    assert page(html).drafts == [("paragraph", None, LONG)] * 2
    with pytest.raises(Unreadable):
        page("<body><a href='/'>a</a><a href='/b'>b</a></body>")


def test_page_limits():
    html = f"<article><div><div><p>{LONG}</p><p>{LONG}</p></div></div></article>"
    for o, code in ((WebOptions(max_dom_elements=2), "tooManyDOMElements"), (WebOptions(max_dom_depth=1), "domTooDeep"), (WebOptions(max_blocks=1), "tooManyBlocks")):
        with pytest.raises(Unreadable) as e:
            page(html, o)
        assert e.value.code == code
    deep = "<div>" * 20_000 + LONG
    with pytest.raises(Unreadable):
        page("<article>" + deep)


def test_web_decoding():
    for data, code in ((b"", "unreadableArticle"), (b"\0\0", "unreadableEncoding")):
        with pytest.raises(Unreadable) as e:
            decode.decode_web(data)
        assert e.value.code == code
    assert decode.decode_web("é".encode("utf-16")) == decode.decode_web(b"\xe9") == decode.decode_web("é".encode("utf-8-sig")) == "é"
    assert MIB == 1 << 20


@pytest.mark.parametrize("page", ["<body>" + "<div class='x'>" * 20_000 + "word, " * 9, "<body>" + "<article><p>Some words here, that count.</p></article>" * 10_000, "<body>" + "<span>" * 12_000 + "<p>a" * 12_000, "<body><p><button>" + "<b>" * 12_000 + "<div></b>x</div>" * 12_000, "<body>" + "<div class='menu'>" * 15_000 + "</i>" * 15_000])
def test_articles_take_time_in_proportion(page):
    start = time.perf_counter()
    try:
        article.read(page, WebOptions())
    except Unreadable:
        pass
    assert time.perf_counter() - start < 8
