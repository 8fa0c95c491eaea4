import io
import zipfile

W = 'xmlns:w="urn:w"'
TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(name, files[name])
    return b.getvalue()


def wp(text, props=""):
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def numbered(text, num="1", level=0):
    return wp(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>')


def docx(body, **parts):
    files = {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"}
    return zipped(files | {f"word/{k}.xml": v for k, v in parts.items()})


def odt(body, mime="application/vnd.oasis.opendocument.text"):
    return zipped({"mimetype": mime, "content.xml": f'<o:doc xmlns:o="o" xmlns:text="t" xmlns:table="b">{body}</o:doc>'})


def slide(*texts, extra=""):
    shapes = "".join(f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>" for t in texts)
    return f'<p:sld xmlns:p="p" xmlns:a="a">{shapes}{extra}</p:sld>'


def pptx(slides, order=None, notes=None, rels=None):
    ids = order or list(slides)
    files = {"[Content_Types].xml": "<Types/>", "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst>' + "".join(f'<p:sldId id="9" r:id="{i}"/>' for i in ids) + "</p:sldIdLst></p:presentation>"}
    files["ppt/_rels/presentation.xml.rels"] = rels or "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{TYPE}/slide" Target="slides/{i}.xml"/>' for i in slides) + "</Relationships>"
    files |= {f"ppt/slides/{i}.xml": x for i, x in slides.items()}
    for i, x in (notes or {}).items():
        files[f"ppt/notesSlides/n{i}.xml"] = x
        files[f"ppt/slides/_rels/{i}.xml.rels"] = f'<Relationships><Relationship Id="r1" Type="{TYPE}/notesSlide" Target="../notesSlides/n{i}.xml"/></Relationships>'
    return zipped(files)
