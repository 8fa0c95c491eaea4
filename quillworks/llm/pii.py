"""Personal information inside free text: found and replaced by typed placeholders.

Candidate gradient boosting: generators with high recall propose overlapping spans of five kinds
(email, phone, idnum, address, name), boosted trees score each by its format and context, thresholds
calibrated for each kind on held-out examples select, and of overlapping selections the surest stays.

The trees are trained on the driver on labelled examples from ``pii_examples`` (``EXAMPLES`` texts,
made by templates, so the bound is that number).  How name-like a word is comes from the corpus itself:
all its texts give for each word how often it stands where only names stand (after a title, "signed
by", ...).  A lexicon of up to ``MOST_WORDS`` words goes to every worker; a larger one stays
distributed, and each text is joined with its own words of it.  Both give the same results.

Defined results: null text stays null without spans; empty texts and texts without candidates come
back unchanged; repeated rows stay; spans never overlap; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillworks.llm.boost import Boosted, calibrated_threshold
from quillworks.llm.lineage import checkpointed

EXAMPLES, MOST_WORDS = 2400, 200_000
#: Words counted in a worker before their counts are passed on.
COUNTED = 100_000
#: Share of its uses that a word has in certain names, for the lexicon to hold it.
LEAST_RATIO = 0.08
KINDS = ("email", "phone", "idnum", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

_AT = r"(?:[@＠]|\s?[\[({<]\s?(?:at|AT|arroba|ät)\s?[\])}>]\s?|\s+(?:at|AT|arroba)\s+)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|punto|ponto|punkt)\s?[\])}>]\s?|\s+(?:dot|DOT|punto|ponto|punkt)\s+)"
_EMAIL = re.compile(rf"(?<![\w.+-])[\w](?:[\w.+'-]*[\w])?{_AT}[\w](?:[\w-]*[\w])?(?:{_DOT}[\w](?:[\w-]*[\w])?){{1,4}}")
_EMAIL_HINT = re.compile(r"[@＠]|[\[({<\s](?:at|AT|arroba|ät)[\])}>\s]")
_PHONE = re.compile(r"(?<![\w.,/@+:$€£-])(?:\+\d{1,3}[ .-]?|\d{1,2} (?=\())?(?:\(\d{1,5}\)[ .-]?)?\d{1,11}(?:(?:[ .\-/]|\) )\d{1,8}){0,6}(?![\w@]|[.,:/-]\d)")
_IDNUM = re.compile(r"(?<![\w.,/@+:$€£-])(?:[A-Z]{1,3}[ -]?)?\d{2,10}(?:[-. ]\d{1,6}){0,3}(?:[-. ]?[A-Z]{1,2})?(?![\w@]|[.,:/-]\d)")
_CAP = r"[A-ZÀ-ÖØ-ÞŒŠŽА-ЯЁ]"
_WORD = r"[^\W\d_]+(?:[’'-][^\W\d_]+)*"
_NUMBER = r"\d{1,5}[A-Za-zА-Яа-я]?(?!\w)"
_STREET_EN = r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Way|Row|Drive|Dr\.?|Close|Court|Ct\.?|Square|Sq\.?|Boulevard|Blvd\.?|Terrace|Crescent|Grove|Hill|Place|Alley|Quay|Mews)(?!\w)"
_DE = "(?:straße|strasse|str\\.|gasse|weg|graben|platz|allee|ring|damm|ufer|markt|hof)"
#: (signs of which a text has one, compared in lower case; pattern)
_ADDRESS = [
    (("street", "st.", "st ", "ave", "road", "rd", "lane", "ln", "way", "row", "drive", "close", "court", "square", "boulevard", "terrace", "crescent", "grove", "hill", "place", "alley", "quay", "mews"), re.compile(rf"(?<![\w.,/-])\d{{1,5}}[A-Z]?,? (?!bis |ter )(?:{_CAP}[\w’'-]* ){{1,3}}{_STREET_EN}(?:,? (?:(?:Apt|Flat|Suite|Unit)\.? ?\d+\w?|\d+(?:st|nd|rd|th) floor))?", re.I)),
    (("quai", "avenue", "rue", "boulevard", "place", "allée", "chemin", "impasse", "cours", "route"), re.compile(rf"(?<![\w.,/-])\d{{1,5}}[A-Z]?(?: (?:bis|ter|quater))?,? (?:quai|avenue|rue|boulevard|place|allée|chemin|impasse|cours|route)(?: (?:du|de la|de l’|des|de|d’|le|la))? ?{_WORD}", re.I)),
    (("calle", "aven", "av", "rua", "travessa", "pla", "pra", "paseo", "camino", "carrera", "largo", "estrada", "via"), re.compile(rf"(?<!\w)(?:Calle|Avenida|Av\.|Avda\.|Rua|Travessa|Plaza|Praça|Paseo|Camino|Carrera|Largo|Estrada|Via|Viale|Piazza)(?: (?:del|de la|de los|de las|de|das|dos|da|do))? {_WORD}(?: {_WORD})?,? (?:nº ?|n\.º ?|n° ?)?{_NUMBER}", re.I)),
    (("straße ", "strasse ", "str. ", "gasse ", "weg ", "graben ", "platz ", "allee ", "ring ", "damm ", "ufer ", "markt ", "hof "), re.compile(rf"(?:(?<!\w)(?:Am|An der|Auf dem|Im|Zum|Zur|Unter den) )?(?<!\w)[^\W\d_]*{_DE} {_NUMBER}", re.I)),
    (("ул", "пр", "пер", "наб", "пл"), re.compile(rf"(?<!\w)(?:ул\.|улица|пр\.|просп\.|проспект|пер\.|переулок|наб\.|пл\.) ?{_WORD},? ?(?:д\. ?|дом )?{_NUMBER}", re.I)),
    (("переулок", "улица", "проспект", "площадь", "бульвар", "набережная", "шоссе"), re.compile(rf"(?<!\w){_WORD} (?:переулок|улица|проспект|площадь|бульвар|набережная|шоссе),? ?(?:д\. ?|дом )?{_NUMBER}", re.I)),
]
_DIGIT = re.compile(r"\d+")
_LOWER = re.compile(r"(?<![\w@.+-])[^\W\d_]{2,}(?:-[^\W\d_]+)?(?![\w@])")
_TOKEN = re.compile(rf"(?<![\w@.+-])(?:{_CAP}\.|{_CAP}[^\W\d_]+(?:[’'-]{_CAP}[^\W\d_]+)*)(?![\w@])")
_TITLE = re.compile(r"(?:(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Mme|Mlle|Herr|Frau|Señor|Señora|Monsieur|Madame|Senhor|Senhora|г-н|г-жа)\.? )\Z", re.I)
_CUE = re.compile(
    r"(?:signed by|written by|posted by|reported by|photo by|words by|interview with|ask for|regards,|sincerely,|thanks,|present:|attending:|author:|contact person:|"
    r"assinado por|escrito por|firmado por|autor:|autora:|signé ?:|signé par|écrit par|auteur ?:|verfasst von|geschrieben von|autor:|unterzeichnet:?|автор:|подпись:)\s*\Z", re.I)
#: Names in small letters stand after a cue.
_SMALL = re.compile(rf"(?:signed by|written by|posted by|ask for|regards,|thanks,|present:|author:|assinado por|escrito por|firmado por|autora?:|signé ?:|écrit par|verfasst von|geschrieben von|автор:)\s*((?:mr|mrs|ms|dr|prof)\. )?({_WORD}(?:,? (?:[^\W\d_]\.|{_WORD}))?)", re.I)
_PRIVATE = re.compile(r"\d|[@＠]|(?i:\Wat\W)")
_FIELD = re.compile(rf"(?:(?<=\n)|(?<=[.!?»”。] )|^)((?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? )?)((?:[^\W\d_]\. ?){{0,2}}{_WORD}(?:,? (?:[^\W\d_]\.|{_WORD})){{0,2}})(?= ?[|/;] )", re.I | re.M)
_WORDS = {
    "phone": r"tel|tél|phone|telephone|telefon|telefone|teléfono|call|ring|mobile|cell|fax|appelez|rufen|llame|ligue|тел|звоните|desk answers|reach|dial|evenings|hotline|whatsapp",
    "idnum": r"\bid\b|identi\w*|passport|passeport|pasaporte|passaporte|паспорт|ausweis\w*|personalausweis|licen[cs]e|social security|ssn|dni|nif|documento|bilhete|carte|reisepass|снилс|инн|expired|left at the counter|cédula|national",
    "address": r"address|adresse|anschrift|dirección|morada|endereço|адрес|live at|lives at|come to|deliver\w*|meeting is at|wohne\w*|visit|located at",
    "email": r"e-?mail|mail|courriel|write to|reply-to|contact|questions|send|escriba|escreva|écrivez|schreiben|пишите|correo",
    "goods": r"order|invoice|catalogue|catalog|isbn|part|version|total|scores?|host|room|seat|rule|opened|page|item|sku|serial|model|build|lot|batch|ticket|tracking|price|pedido|factura|fatura|facture|commande|bestellung|rechnung|заказ|счёт|bestellnummer|artikel\w*|article|ref|bus|flight|train|platform|error|port|ip|date|updated",
    "place": r"mount|lake|river|cape|fort|port|saint|north|south|east|west|island|valley|bay|county|the",
}
_BEFORE = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)", re.I) for k, v in _WORDS.items()}
_CLEAN = re.compile(r"\W+")
_LETTERS = re.compile(r"[^\W\d_]+")
N_FEATURES = 56


#: The same cues and titles as plain ends of what stands before.
_CUE_ENDS = ("signed by", "written by", "posted by", "reported by", "photo by", "words by", "interview with", "ask for", "regards,", "sincerely,", "thanks,", "present:", "attending:", "author:", "contact person:", "assinado por", "escrito por", "firmado por", "autor:", "autora:", "signé :", "signé:", "signé par", "écrit par", "auteur :", "auteur:", "verfasst von", "geschrieben von", "unterzeichnet:", "автор:", "подпись:")
_TITLES = {"mr", "mrs", "ms", "dr", "prof", "sr", "sra", "mme", "mlle", "herr", "frau", "señor", "señora", "monsieur", "madame", "senhor", "senhora", "г-н", "г-жа"}


_CERTAIN = re.compile(rf"(?:(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor|Señora)\.? |(?:signed by|posted by|written by|ask for|assinado por|firmado por|signé ?:|verfasst von|автор:|present:|thanks,) ?)({_CAP}[^\W\d_]+(?:(?:, | |-){_CAP}[^\W\d_]+)?)", re.I)
#: How a match of it starts, in lower case; letters beyond those that match them too.
_OPENINGS = [*(t + e for t in ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "señor", "señora") for e in (" ", ". ")), "signed by", "posted by", "written by", "ask for", "assinado por", "firmado por", "signé:", "signé :", "verfasst von", "автор:", "present:", "thanks,"]
_FOLDED = re.compile("[\u0130\u0131\u017f\u212a\u1c80-\u1c88]")
_USES = re.compile(r"(?<![\w@.＠+-])[^\W\d_]+(?![\w@＠]|\.\w)")


class Lexicon:
    """How often words stand where only names stand, among their capitalised and all uses."""

    def __init__(self, ratio: dict[str, float]) -> None:
        self.ratio = ratio
        self.sure = {w for w, r in ratio.items() if r >= 0.3 and w not in _TITLES}

    @staticmethod
    def of(texts: list[str]) -> Lexicon:
        strong, every = name_counts(texts)
        return Lexicon({w: n / (every[w] + 1) for w, n in strong.items() if n >= 2 and n / (every[w] + 1) >= LEAST_RATIO})


def name_counts(texts: list[str]) -> tuple[Counter, Counter]:
    """How often each word stands in certain names, and at all outside addresses of mail and hosts."""
    strong, every, parts = Counter(), Counter(), Counter()
    for text in texts:
        parts.update(text.split())  # no use goes across white space, so each different part is read once
        for spot, _, _ in certain_names(text):
            for w in re.findall(r"[^\W\d_]{2,}", spot):
                strong[w.casefold()] += 1
    for part, n in parts.items():
        for w in _USES.findall(part):
            every[w.casefold()] += n
    return strong, every


def certain_names(text: str) -> Iterator[tuple[str, int, str]]:
    """Spans where hardly anything but a name stands: after titles and name cues, and in contact lines."""
    for m in _cued(text):
        if m.group(1)[0].isupper():
            yield m.group(1), m.start(1), "cue"
    for m in _fields(text):
        rest = text[m.end() : m.end() + 90].split("\n")[0]
        if re.search(r"\d{3}|[@＠]|\(at\)|\d+[AB]? ", rest):
            yield m.group(2), m.start(2), "field"


def _cued(text: str) -> Iterator[re.Match]:
    """What ``_CERTAIN.finditer`` gives, tried only where the text has one of its openings."""
    small = text.lower()
    if len(small) != len(text) or _FOLDED.search(text):  # other letters than the lower-case ones can match
        yield from _CERTAIN.finditer(text)
        return
    starts, last = set(), 0
    for x in _OPENINGS:
        at = small.find(x)
        while at >= 0:
            starts.add(at)
            at = small.find(x, at + 1)
    for at in sorted(starts):
        if at >= last and (m := _CERTAIN.match(text, at)):
            yield m
            last = m.end()


def _flag(x) -> float:
    return 1.0 if x else 0.0


def candidates(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """Overlapping spans (start, end, kind)."""
    out: list[tuple[int, int, str]] = []
    for h in _EMAIL_HINT.finditer(text):
        at = max(0, h.start() - 64)
        out += [(at + m.start(), at + m.end(), "email") for m in _EMAIL.finditer(text[at : h.end() + 96]) if at + m.start() < h.start() and (m.start() or not at)]
    digits = [m.start() for m in _DIGIT.finditer(text)]
    if digits:
        small = text.lower()
        for signs, p in _ADDRESS:
            if any(x in small for x in signs):
                for a, b in _windows(text, digits):
                    out += [(a + m.start(), a + m.end(), "address") for m in p.finditer(text[a:b])]
        for m in _PHONE.finditer(text):
            if 6 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
        for m in _IDNUM.finditer(text):
            if 6 <= sum(map(str.isdigit, m.group())) <= 14:
                out.append((m.start(), m.end(), "idnum"))
                if " " in m.group() and m.group().partition(" ")[0].isalpha():  # the letters may be a word before it
                    out.append((m.start() + m.group().index(" ") + 1, m.end(), "idnum"))
                if re.search(r" [A-Z]+\Z", m.group()):  # or the start of the next sentence
                    out.append((m.start(), m.start() + m.group().rindex(" "), "idnum"))
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    ratio = lexicon.ratio
    if not lexicon.sure.isdisjoint(_CLEAN.split(text)):  # names in small letters
        words = [(m.start(), m.end(), m.group()) for m in _LOWER.finditer(text)]
        for (s, e, a), (s2, e2, b) in zip(words, words[1:]):
            if s2 - e <= 2 and (a in lexicon.sure or b in lexicon.sure) and (a in lexicon.sure) + (b.split("-")[0] in lexicon.sure) == 2:
                out.append((s, e2, "name"))
    known = [any(w in ratio for w in _CLEAN.split(t.casefold())) for _, _, t in tokens]
    for i, (s, e, t) in enumerate(tokens):
        cued = False
        if not known[i] and s and text[s - 1] in " \n":
            before = text[max(0, s - 28) : s].rstrip().lower()
            cued = before.endswith(_CUE_ENDS) or before[-1:] not in ",:;|/" and before.rstrip(".").rpartition(" ")[2] in _TITLES
        near = known[i] or cued
        for k in range(i, min(i + 3, len(tokens))):
            if k > i:
                gap = text[tokens[k - 1][1] : tokens[k][0]]
                if gap not in (" ", ", "):
                    break
                near = near or known[k]
            if near and not (k == i and t.endswith(".")):
                out.append((s, tokens[k][1], "name"))
    for m in _SMALL.finditer(text):
        if m.group(2)[0].islower():
            s, words = m.start(2), m.group(2)
            out += [(s, m.end(2), "name"), (s, s + len(words.split()[0].rstrip(",")), "name")]
    out += [(m.start(2), m.end(2), "name") for m in _fields(text)]
    return list(dict.fromkeys(out))


def _windows(text: str, digits: list[int]) -> list[tuple[int, int]]:
    """Parts of the text around digits, grown to whole words, in which an address can lie."""
    out: list[tuple[int, int]] = []
    for d in digits:
        a, b = max(0, d - 70), min(len(text), d + 90)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            while a and text[a - 1].isalnum():
                a -= 1
            out.append((a, b))
    return out


def _fields(text: str) -> Iterator[re.Match]:
    """First fields of contact lines: what stands before a bar, slash or semicolon at a line's or sentence's start."""
    at = 0
    for line in text.split("\n"):
        if ("| " in line or "/ " in line or "; " in line) and _PRIVATE.search(line):
            for m in _FIELD.finditer(text, at, at + len(line)):
                yield m
        at += len(line) + 1


def features(text: str, spans: list[tuple[int, int, str]], lexicon: Lexicon) -> np.ndarray:
    x = np.zeros((len(spans), N_FEATURES))
    solid = [(s, e) for s, e, k in spans if k != "name"]
    for i, (s, e, kind) in enumerate(spans):
        t = text[s:e]
        line = text.rfind("\n", 0, s) + 1
        left = text[max(line, s - 34) : s]
        stop = text.find("\n", e)
        right = text[e : min(e + 24, stop if stop >= 0 else len(text))]
        last = left[-1:] or "\n"
        f = x[i]
        f[KINDS.index(kind)] = 1
        f[5], f[6] = len(t), sum(map(str.isdigit, t))
        f[7], f[8] = _flag(s == line), _flag(not right)
        f[9], f[10], f[11] = _flag(last in "(["), _flag(left.rstrip()[-1:] in "|/;"), _flag(left.rstrip()[-1:] in (":", "："))
        f[12], f[13] = _flag(right.lstrip()[:1] in ("|", "/", ";")), _flag(right[:1] in ".,!?)")
        for k, name in enumerate(("phone", "idnum", "address", "email", "goods")):
            f[14 + k] = _flag(_BEFORE[name].search(left))
            f[19 + k] = _flag(_BEFORE[name].search(right)) if kind != "name" else 0
        if kind in ("phone", "idnum"):
            groups = [len(g) for g in re.findall(r"\d+", t)]
            f[24] = len(groups)
            for k, g in enumerate(groups[:5]):
                f[25 + k] = g
            f[30], f[31], f[32] = _flag(t[0] == "+"), _flag(t[0] == "0"), _flag(t[:2] == "00")
            f[33], f[34], f[35], f[36] = _flag("(" in t), t.count("-"), t.count("."), t.count(" ")
            f[37], f[38] = _flag(t[0].isalpha()), _flag(t[-1].isalpha())
            f[39] = groups[-1]
            f[40] = _flag(re.match(r"(?:19|20)\d\d[-./]\d\d?[-./]\d\d?", t))
            f[55] = _flag("/" in t)
        elif kind == "email":
            f[41], f[42] = _flag("@" in t or "＠" in t), _flag(re.search(r"[\[({<]", t))
            f[43], f[44] = _flag(re.search(r"\.\w{2,}\Z|(?i:dot)", t)), _flag(re.search(r"\s(?:at|AT)\s", t) and not re.search(r"(?i:dot)|[\[({<]", t))
        elif kind == "address":
            f[45] = _flag(re.match(r"\d", t))
            f[46] = len(t.split())
        else:
            words = [w for w in _CLEAN.split(t.casefold()) if len(w) > 1]
            r = [lexicon.ratio.get(w, 0.0) for w in words] or [0.0]
            f[24], f[25], f[26], f[27], f[28] = len(words), min(r), max(r), r[0], r[-1]
            f[29] = _flag(re.search(r"(?<![^\W\d_])[^\W\d_]\.", t))
            f[30], f[31] = _flag("," in t), _flag(t.isupper())
            f[32], f[33] = _flag(_CUE.search(left)), _flag(_TITLE.search(left))
            before, after = re.search(r"([^\W\d_]{2,}|[^\W\d_]\.?)(,?[ -])\Z", left), re.match(r"(,? |-)([^\W\d_]+)", right)
            f[34] = lexicon.ratio.get(before.group(1).strip(".").casefold(), 0.0) if before else 0
            f[35] = lexicon.ratio.get(after.group(2).casefold(), 0.0) if after else 0
            f[36] = _flag(before and before.group(1)[0].isupper())
            f[37] = _flag(after and after.group(2)[0].isupper())
            f[38] = _flag(after and after.group(2)[0].islower())
            f[39] = _flag(re.match(r"(?: [^\W\d_]+)? " + _STREET_EN, right, re.I))
            f[40] = _flag(before and _BEFORE["place"].fullmatch(before.group(1).strip(".")))
            f[47] = _flag(any(a < e and s < b for a, b in solid))
            f[48] = _flag(any(0 <= a - e <= 4 for a, _ in solid))
            f[49] = _flag(t[0].islower())
            f[55] = _flag(_SMALL.search(text, max(0, s - 28), e) and t[0].islower())
            f[50] = _flag(re.match(r" ?[|/;] ", right))
            f[51] = _flag(re.search(r"(?<![^\W\d_])[^\W\d_]\. ?\Z", left))
            f[52] = _flag(t.endswith("."))
            f[53] = _flag(re.match(r",? [^\W\d_]\.(?!\w)", right))
            f[54] = _flag(re.search(r"\W(?:mr|mrs|ms|dr|prof|herr|frau|mme|sr|sra)\.? ?\Z", " " + t[: t.find(" ") + 1].casefold()))
    return x


@lru_cache(maxsize=2)
def model(examples: int = EXAMPLES) -> tuple[Boosted, dict[str, float]]:
    """Trees trained on three quarters of the examples, thresholds calibrated on the rest."""
    from quillworks.llm.pii_examples import labelled

    made = labelled(examples)
    lexicon = Lexicon.of([t for t, _ in made])
    xs, ys, kinds, held = [], [], [], []
    for i, (text, truth) in enumerate(made):
        spans = candidates(text, lexicon)
        if spans:
            xs.append(features(text, spans, lexicon))
            ys += [s in truth for s in spans]
            kinds += [k for _, _, k in spans]
            held += [i % 4 == 0] * len(spans)
    x, y, held, kinds = np.concatenate(xs), np.array(ys, dtype=float), np.array(held), np.array(kinds)
    trees = Boosted.fit(x[~held], y[~held])
    p = trees.probability(x[held])
    return trees, {k: min(0.9, max(0.1, calibrated_threshold(p[kinds[held] == k], y[held][kinds[held] == k]))) for k in KINDS}


def select(spans: list[tuple[int, int, str]], p: np.ndarray, thresholds: dict[str, float]) -> list[tuple[int, int, str]]:
    """Spans above their threshold without overlap, the surest first, of equal ones the longer."""
    chosen: list[tuple[int, int, str]] = []
    taken = []
    for i in sorted(range(len(spans)), key=lambda i: (-round(float(p[i]), 3), spans[i][0] - spans[i][1], spans[i])):
        s, e, k = spans[i]
        if p[i] >= thresholds[k] and all(e <= a or b <= s for a, b in taken):
            taken.append((s, e))
            chosen.append(spans[i])
    return sorted(chosen)


def find_batch(texts: list[str | None], lexicon: Lexicon, trees: Boosted, thresholds: dict[str, float]) -> list[list[tuple[int, int, str]]]:
    """Selected spans of each text; one pass of the trees over all candidates of the batch."""
    spans = [candidates(t, lexicon) if t else [] for t in texts]
    xs = [features(t, s, lexicon) for t, s in zip(texts, spans) if s]
    if not xs:
        return [[] for _ in texts]
    p, at, out = trees.probability(np.concatenate(xs)), 0, []
    for s in spans:
        out.append(select(s, p[at : at + len(s)], thresholds))
        at += len(s)
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, k in spans:
        out += [text[at:s], PLACEHOLDER[k]]
        at = e
    return "".join(out) + text[at:]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())]))


def _batches(keys: list[str], lexicon: Lexicon | None, trees: Boosted, thresholds: dict[str, float], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = b.column("text").to_pylist()
                known = lexicon if lexicon is not None else Lexicon({w["word"]: w["ratio"] for words in b.column("words").to_pylist() for w in words or []})
                found = find_batch(texts, known, trees, thresholds)
                spans = pa.array([[{"kind": k, "start_pos": s + 1, "end_pos": e} for s, e, k in f] for f in found], _SPAN)
                text = [pa.array([None if t is None else redacted(t, f) for t, f in zip(texts, found)], pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *text, spans], [*keys, *["redacted"] * with_text, "spans"])

    return run


def corpus_words(df: DataFrame, text: str) -> DataFrame:
    """``word, ratio``: the words of the lexicon, counted over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strong, every = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            words = list(every.keys() | strong.keys())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([strong[w] for w in words], pa.int64()), pa.array([every[w] for w in words], pa.int64())], ["word", "strong", "every"])

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                s, e = name_counts(whole.column("text").slice(at, 500).to_pylist())
                strong.update(s)
                every.update(e)
                if len(every) > COUNTED:
                    yield counted()
                    strong, every = Counter(), Counter()
        yield counted()

    counts = df.select(F.col(text).alias("text")).filter("text is not null").mapInArrow(count, "word string, strong bigint, every bigint")
    sums = counts.groupBy("word").agg(F.sum("strong").alias("strong"), (F.sum("every") + 1).alias("every")).filter("strong >= 2")
    return checkpointed(sums.select("word", (F.col("strong") / F.col("every")).alias("ratio")).filter(F.col("ratio") >= LEAST_RATIO))


def lookups(text: str) -> set[str]:
    """All words of a text that candidates and features can look up in a lexicon."""
    small = text.casefold()
    out = {w for w in _CLEAN.split(small) if len(w) > 1}
    for w in _LETTERS.findall(small) + [w.casefold() for w in _LETTERS.findall(text)]:
        out.add(w)
        if len(w) > 20:  # features see 24 characters after a span and 34 before it
            out |= {w[:22], w[:23], w[-32:], w[-33:]}
    return out


def own_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with ``words``, the part of the lexicon that each text can look up.

    Texts meet their words by hash; where two texts share one, each has the words of both, which
    changes nothing.
    """

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                got = [(h, w) for h, t in zip(b.column("same").to_pylist(), b.column("text").to_pylist()) for w in lookups(t)]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in got], pa.int64()), pa.array([w for _, w in got], pa.string())], ["same", "word"])

    rows = rows.withColumn("same", F.xxhash64("text"))
    pairs = rows.filter("text is not null").select("same", "text").mapInArrow(looked_up, "same bigint, word string")
    own = pairs.join(words, "word").groupBy("same").agg(F.collect_set(F.struct("word", "ratio")).alias("words"))
    return rows.join(own, "same", "left").drop("same")


def find_personal(df: DataFrame, keys: list[str], text: str, with_text: bool = True, most_words: int = MOST_WORDS) -> DataFrame:
    """``keys + redacted, spans``; spans is an array of (kind, start_pos, end_pos), positions from 1."""
    if taken := {"text", "redacted", "spans", "words", "same"} & set(keys):
        raise ValueError(f"key columns can't be named {sorted(taken)}")
    words = corpus_words(df, text)
    few = words.limit(most_words + 1).collect()  # bounded by the parameter
    lexicon = Lexicon({r["word"]: r["ratio"] for r in few}) if len(few) <= most_words else None
    trees, thresholds = model()
    rows = df.select(*keys, F.col(text).alias("text"))
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *["redacted string"] * with_text, "spans array<struct<kind:string,start_pos:bigint,end_pos:bigint>>"])
    if lexicon is None:
        rows = own_words(rows, words)
    return rows.mapInArrow(_batches(keys, lexicon, trees, thresholds, with_text), schema)
