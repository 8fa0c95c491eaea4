import pytest

from quillworks.llm.encoding import repair, repair_texts

GOOD = ["Die schöne Straße führt über die Brücke.", "L’été, une forêt protège l’allée étroite.", "Старый мост ведёт через реку. Здесь сад.", "¿Quién abrió la canción? Añadió una montaña."]


@pytest.mark.parametrize("text", GOOD + ["plain ascii", "", "SÃO BENTO and MAÇÃS ÂMBAR", "McDonald said “yes” — 5 °C …", "ÜBER ALLEN GIPFELN"])
def test_clean_text_stays(text):
    assert repair(text) == (text, False, [])


@pytest.mark.parametrize("text", GOOD)
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "cp1251", "mac_roman"])
def test_utf8_read_as_another_is_restored(text, wrong):
    try:
        bad = text.encode().decode(wrong)
    except UnicodeDecodeError:
        pytest.skip("the bytes have no characters in this encoding")
    fixed, garbled, _ = repair(bad)
    assert garbled and fixed == text


def test_two_layers():
    text = GOOD[0]
    bad = text.encode().decode("latin-1").encode().decode("latin-1")
    assert repair(bad)[:2] == (text, True)


def _misread(text, codec):
    """UTF-8 bytes as a reader shows them that passes on bytes without a character."""
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode())


@pytest.mark.parametrize("letter", "é ö ß ü ñ и".split())
@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman"])
@pytest.mark.parametrize("layers", [1, 2, 3, 4, 5])
def test_layers(letter, codec, layers):
    around = "мдр" if letter == "и" else "xyz"
    for text in (f"{around[0]}{letter}{around[1:]}", f"Das {letter} und {letter}.", letter):
        bad = text
        for _ in range(layers):
            bad = _misread(bad, codec)
        assert repair(bad)[:2] == (text, True), bad


@pytest.mark.parametrize("layers", [3, 5])
def test_whole_lines_of_several_layers(layers):
    for text in GOOD:
        bad = text
        for k in range(layers):
            bad = _misread(bad, ("cp1252", "latin-1")[k % 2])
        assert repair(bad)[:2] == (text, True)


@pytest.mark.parametrize("codec", ["cp1252", "mac_roman", "cp437", "cp850", "koi8-r", "cp1251"])
def test_punctuation_alone(codec):
    text = "The oak — it stood.\n“The mill turned” he said."
    assert repair(_misread(text, codec))[:2] == (text, True)


@pytest.mark.parametrize("written,read", [("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("mac_roman", "cp1252")])
def test_single_byte(written, read):
    text = GOOD[0] if written == "mac_roman" else "Старый мост открывает сад через реку\nЗдесь маяк"
    bad = text.encode(written).decode(read)
    assert repair(bad)[:2] == (text, True)


def test_part_of_a_text_and_lost_characters():
    text = "Good line — here.\n" + "Straße für Älteste".encode().decode("cp1252")
    assert repair(text)[0] == "Good line — here.\nStraße für Älteste"
    assert repair("caf� au lait")[1]


def test_parts_garbled_in_different_ways():
    """No pair has most of the gain, and the text is flagged with both."""
    line = "Straße für alle"
    fixed, garbled, layers = repair("\n".join(line.encode().decode(c) for c in ("cp1252", "mac_roman", "cp437")))
    assert fixed == "\n".join([line] * 3) and garbled and len(layers) == 3


def test_unrecoverable_text_is_flagged():
    assert repair("CORAÇÃO «MANHû e «IRMû.")[1] is False
    assert repair("Ð„\u2603Ð‰\u2603")[1]


def test_frame(spark):
    bad = GOOD[0].encode().decode("latin-1")
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, bad, "c"), (3, bad, "c"), (4, "x" * 100_000, "d"), (None, "ok", "e")], "id int, t string, garbled2 string")
    rows = repair_texts(df, ["id"], "t").collect()
    assert len(rows) == 6 and {r.text for r in rows if r.id == 3} == {GOOD[0]} and sum(r.garbled for r in rows) == 2
    named = repair_texts(df, ["id"], "t", reports=df.selectExpr("id", "'windows-1252' as read_as")).collect()
    assert sorted(map(str, named)) == sorted(map(str, rows))
    assert repair_texts(df.limit(0), ["id"], "t").count() == 0
