"""Labelled examples of personal information, made by templates with invented words.

Each example is a short page: lines with entities whose spans are known, lines with look-alikes that
are none (order numbers, places, dates, versions), and plain prose.  The same seed gives the same examples.
"""

from __future__ import annotations

import random

_SYL = "ba be bri cal cor da del dra el en fa fen gal gri ha hol is ja jo ka kel la len lo mar mel mi mor na ne ni ol or pa per ra re ro sa sel sha ta tam te tor ul va vel vi wen ya yor za zel".split()
_END_G = "a e o n k l is us in el ie y as".split()
_END_S = "son berg wick more vaar stone ley by ham lund mann sen eau oux ini escu ska ton".split()
_CYR = "ба ве го да ел жи ка ли ма но ол по ра са та ун фе ха ши яр".split()
_PROSE = {
    "en": ["The old bridge crossed the river after the storm.", "Nobody opened the quiet window near the mill.", "When the lamp turned green, the baker closed the door.", "The market opens in spring.", "A keeper and a painter mended seven boats behind the harbour.", "He said the weather would hold."],
    "de": ["Die alte Brücke führt über den Fluss.", "Für die Gärten öffnet man das Tor.", "Große Türme hinter Wäldern", "Der Müller schließt die Tür am Abend.", "Kühle Nächte über Dächern"],
    "fr": ["La vieille maison garde la clé.", "L’été, une rivière traverse la ville.", "Belle journée derrière la gare", "Le marché ouvre au printemps."],
    "es": ["La vieja casa guarda la llave.", "¿Quién abrió la ventana? Nadie lo supo.", "Última estación detrás del puente", "El mercado abre en primavera."],
    "pt": ["A velha casa guarda a chave.", "Não abriu a janela da cozinha.", "Próxima estação além da ponte", "O mercado abre na primavera."],
    "ru": ["Старый мост ведёт через реку.", "Здесь рынок открывает двери.", "Тихий сад около реки", "Новости | О нас | Контакты"],
}
_NAME_CUES = {
    "en": ["The letter was signed by {}.", "Posted by {}", "Written by {}", "Ask for {} at the desk.", "Thanks, {}", "Present: {}", "{} told the council that the road would open.", "{} said the roof was sound.", "Regards, {}", "Author: {}", "{} wrote the report.", "{}"],
    "de": ["Verfasst von {}", "Geschrieben von {}", "{} öffnet die Tür.", "Autor: {}", "{} schließt das Tor."],
    "fr": ["Signé : {}", "Écrit par {}", "{} préfère la mer.", "{} ouvre la porte."],
    "es": ["Firmado por {}", "Escrito por {}", "{} abrió la puerta.", "Autor: {}"],
    "pt": ["Assinado por {}", "Escrito por {}", "{} abriu a porta.", "Autor: {}"],
    "ru": ["Автор: {}", "{} открывает дверь.", "Подпись: {}"],
}
_CUES = {
    "phone": ["Call {} before noon.", "Phone {} for the tickets.", "Tel: {}", "Tél. {}", "Telefon: {}", "Telefone: {}", "Teléfono {}", "Тел.: {}", "{} (evenings)", "ring me {}", "The office answers on {}.", "Appelez le {}.", "Rufen Sie {} an.", "Llame al {}", "Mobile {}", "Fax: {}", "{}", "You can reach us at {} all day.", "{} is the number to dial."],
    "idnum": ["Passport {}", "National ID: {}", "identity card {}", "Her identity card {} has expired.", "social security number {}", "driving licence {}", "Ausweisnummer {}", "Personalausweis Nr. {}", "Passeport {}", "Carte d’identité {}", "Documento de identidad {}", "Bilhete de identidade {}", "Паспорт {}", "{} was left at the counter.", "SSN {}", "DNI {}", "ID no. {}"],
    "address": ["Address: {}", "Adresse : {}", "Anschrift: {}", "Dirección: {}", "Morada: {}", "Адрес: {}", "I still live at {}", "Come to {}; knock twice.", "Deliveries go to {}.", "The meeting is at {} on Monday.", "Wir wohnen {}.", "{}"],
    "email": ["Contact: {}", "E-Mail: {}", "Courriel : {}", "Reply-To: {}", "Write to {} before Friday.", "Questions? {}", "({})", "send a copy to {} please", "Escriba a {}.", "Escreva para {}.", "Écrivez à {}.", "Schreiben Sie an {}.", "Пишите на {}.", "{}"],
}


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        word = lambda n, ends: ("".join(self.r.choice(_SYL) for _ in range(n)) + self.r.choice(ends)).capitalize()
        self.given = [word(1 + i % 2, _END_G) for i in range(60)] + ["Zoë", "René", "José", "Jörg", "Inês", "Anne"]
        self.family = [word(2, _END_S) for _ in range(80)] + ["Müller", "Núñez", "Lefèvre", "Sørensen"]
        self.given += [(self.r.choice(_SYL) + self.r.choice("vnrlms")).capitalize() for _ in range(15)]
        self.family += [word(1, _END_S) for _ in range(20)]
        cyr = lambda e: ("".join(self.r.choice(_CYR) for _ in range(2)) + e).capitalize()
        self.given_ru, self.family_ru = [cyr("") for _ in range(20)], [cyr(self.r.choice(["ов", "ин", "ская"])) for _ in range(20)]
        self.street = [word(2, ["gate", "field", "stone", "wood", "brook"]) for _ in range(30)]

    def name(self, lang: str) -> tuple[str, str]:
        """A form of address (may be empty) and a name."""
        r = self.r
        g, f = (r.choice(self.given_ru), r.choice(self.family_ru)) if lang == "ru" and r.random() < 0.7 else (r.choice(self.given), r.choice(self.family))
        form = r.random()
        title = r.choice(["Mr. ", "Ms ", "Dr. ", "Prof. ", "Mrs. ", "Herr ", "Mme "]) if r.random() < 0.18 else ""
        if form < 0.5:
            n = f"{g} {f}"
        elif form < 0.58:
            n = f"{f}, {g}"
        elif form < 0.66:
            n = f"{g[0]}. {f}"
        elif form < 0.72:
            n = f"{g} {f[0]}."
        elif form < 0.78:
            n = f"{g} {r.choice(self.family)}-{f}" if lang != "ru" else f"{g} {f}"
        elif form < 0.84:
            n = f"{g} {r.choice('ABCDJKLM')}. {f}"
        elif title:
            n = f
        else:
            n = f"{g} {f}"
        if not title and r.random() < 0.06:
            n = n.upper()
        return title, n

    def phone(self) -> str:
        d = lambda n: "".join(self.r.choice("0123456789") for _ in range(n))
        a = d(3)
        return self.r.choice([f"+1 {a} {d(3)} {d(4)}", f"+1-{a}-{d(3)}-{d(4)}", f"+1{d(10)}", f"({a}) {d(3)}-{d(4)}", f"{a}.{d(3)}.{d(4)}", f"{a}-{d(3)}-{d(4)}", f"{d(3)}-{d(4)}", f"+44 20 {d(4)} {d(4)}", f"(020) {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"0044 {d(4)} {d(6)}", f"+49 30 {d(5)} {d(3)}", f"0{d(2)}/{d(8)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+7 {a} {d(3)}-{d(2)}-{d(2)}", f"8 ({a}) {d(3)}-{d(2)}-{d(2)}", f"+351 {d(3)} {d(3)} {d(3)}", f"+34 {d(3)} {d(3)} {d(3)}"])

    def idnum(self) -> str:
        d = lambda n: "".join(self.r.choice("0123456789") for _ in range(n))
        u = self.r.choice
        return u([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{u('LXKM')}{d(8)}", f"{u('LXKM')}{d(3)}-{d(4)}-{d(4)}", f"{u(['QQ', 'AB', 'KE'])}{d(6)}{u('ABCD')}", f"{d(2)}.{d(3)}.{d(3)}-{u('XYZ1')}", f"{d(4)}-{d(6)}-{d(1)}", f"{d(8)}{u('ABTX')}", f"{d(4)} {d(6)}", f"{u(['QQ', 'AB', 'KE'])} {d(2)} {d(2)} {d(2)} {u('ABCD')}"])

    def address(self, lang: str) -> str:
        r, s = self.r, self.r.choice(self.street)
        n = f"{r.randint(1, 240)}{r.choice(['', '', 'A', 'B'])}"
        if lang == "en":
            return f"{n} {s} {r.choice(['Street', 'St.', 'Avenue', 'Ave', 'Road', 'Rd', 'Lane', 'Way', 'Row'])}{r.choice(['', '', f', Apt {r.randint(1, 40)}', ', 2nd floor'])}"
        if lang == "de":
            return r.choice([f"{s}{r.choice(['straße', 'gasse', 'weg', 'graben'])} {n}", f"Am {s}{r.choice(['graben', 'weg', 'platz'])} {n}"])
        if lang == "fr":
            return f"{n}{r.choice(['', ' bis', ','])}{r.choice([' rue des ', ' avenue ', ', quai ', ' boulevard '])}{s}".replace(",,", ",")
        if lang == "es":
            return f"{r.choice(['Calle del ', 'Avenida ', 'Calle '])}{s}{r.choice([' ', ', '])}{n}"
        if lang == "pt":
            return f"{r.choice(['Rua das ', 'Travessa ', 'Avenida '])}{s}{r.choice([' ', ', '])}{n}"
        return r.choice([f"ул. {r.choice(self.family_ru)}, д. {n}", f"{r.choice(self.family_ru)} переулок, {n}", f"улица {r.choice(self.family_ru)}, {n}"])

    def email(self) -> str:
        r = self.r
        g, f = r.choice(self.given[:60]).lower(), r.choice(self.family[:80]).lower()
        local = r.choice([f"{g}.{f}", f"{g}-{f}", f"{g[0]}{f}", f"{f}_{r.randint(1, 99)}", f"{g}+list", "info", "desk", "office"])
        host = r.choice([f"{f}.example", f"mail.{g}.example", f"{g}.test", f"{f}.invalid", f"{g}{f}.com"])
        at, dot = r.choice([("@", ".")] * 6 + [("＠", "."), (" (at) ", " (dot) "), ("[at]", "."), (" AT ", " DOT "), (" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot ")])
        mail = local + at + host.replace(".", dot)
        return mail.upper() if r.random() < 0.04 and at == "@" else mail

    def trap(self, lang: str) -> str:
        r = self.r
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        s, f, g = r.choice(self.street), r.choice(self.family), r.choice(self.given)
        return r.choice([
            f"Order {d(4)}-{d(6)}-{d(1)} ships on Tuesday.", f"Invoice {d(3)}-{d(2)}-{d(4)} is paid.", f"Invoice {d(8)} is open.", f"Catalogue number 978-{d(1)}-{d(2)}-{d(4)}-{d(1)}.", f"Part no. QX-{d(4)}-B", f"Version {d(1)}.{d(2)}.{d(3)}",
            f"Scores: {d(3)}-{d(3)}, {d(3)}-{d(3)}.", f"Opened 20{d(2)}-0{r.randint(1, 9)}-1{d(1)} 10:{d(2)}.", f"The host 192.0.{d(1)}.{d(2)} did not answer.", f"Total: {d(1)},{d(3)}.50", f"Seat {d(2)}A, row {d(1)}", f"Room {d(2)} is closed.", f"© 20{d(2)} {s} Post. All rights reserved.", f"Error {d(3)}", f"Follow @{s.lower()}club for dates.",
            f"The {s} Lane bus runs hourly.", f"Mount {s} and Lake {f} froze early.", f"{s} Street was closed all week.", f"You are here: News › {s} Post", f"Printed from {s} Review, 20{d(2)}", f"ISBN 978{d(10)}", f"Ticket {d(7)} was used.", f"Rule #{d(1)} and rule #{d(2)} disagree.", f"Phone lines opened in 20{d(2)}.", "Call before noon.", "Contact | Home | Weather", "We met at noon.", f"serial number {d(4)}-{d(4)}", f"Tracking {d(4)} {d(4)} {d(4)}", f"Order {d(8)} is late.", f"Model {g[0]}{d(3)}-{d(4)} is sold out.",
            f"The {f} family of ferns grows here.", f"It was signed by the council of {s}.", "Posted by the editors", "Signed by all members.", "Written by hand in winter.", "Thanks, everyone", "Ask for help at the desk.", "Ask for the keeper at the desk.", f"{s} Corner", f"{s} Notes | Home | Contact", f"Population: {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(3)} copies were sold.", f"Share {d(3)}-{d(4)} of the lot was sold.",
        ])

    def example(self) -> tuple[str, set[tuple[int, int, str]]]:
        r = self.r
        lang = r.choice(list(_PROSE))
        text, truth = "", set()

        def put(line: str, *entities: tuple[str, str]) -> None:
            """Add a line whose {} stand for the entities, given as (kind, text)."""
            nonlocal text
            if text:
                text += r.choice(["\n", "\n", "\n\n", " "])
            parts = line.split("{}")
            text += parts[0]
            for (kind, what), rest in zip(entities, parts[1:]):
                title = ""
                if kind == "name" and what.startswith("\0"):
                    title, what = what[1:].split("\0")
                text += title
                truth.add((len(text), len(text) + len(what), kind))
                text += what + rest

        for _ in range(r.randint(3, 9)):
            what = r.random()
            if what < 0.24:
                put(r.choice(_PROSE[lang]))
            elif what < 0.42:
                put(self.trap(lang))
            elif what < 0.55:
                title, n = self.name(lang)
                cue = r.choice(_NAME_CUES[r.choice([lang, lang, "en"])])
                if r.random() < 0.08 and not title:
                    n = n.lower()
                put(cue, ("name", f"\0{title}\0{n}"))
            elif what < 0.67:
                title, n = self.name(lang)
                if r.random() < 0.1:
                    n = n.lower() if not title else n
                fields = [("name", f"\0{title}\0{n}")] + r.sample([("address", self.address(lang)), ("phone", self.phone()), ("email", self.email())], r.randint(1, 3))
                line = "{}"
                for _ in fields[1:]:
                    line += r.choice([" | ", " / ", "; "]) + "{}"
                put(line, *fields)
            else:
                kind = r.choice(["phone", "idnum", "address", "email"])
                value = {"phone": self.phone, "idnum": self.idnum, "email": self.email}.get(kind, lambda: self.address(lang))()
                put(r.choice(_CUES[kind]), (kind, value))
        return text, truth


def labelled(n: int, seed: int = 7) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """n texts with their true spans (start, end, kind), positions from 0."""
    m = _Maker(seed)
    return [m.example() for _ in range(n)]
