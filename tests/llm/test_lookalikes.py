import unicodedata as U

import re
import sys

from pyspark.sql import functions as F

from quillworks.llm import lookalikes
from quillworks.llm.lookalikes import PLACES, _patterns, _tables, normalize_texts, same_looking

SAME = [
    ["The oak café", "Thе оak café", "The oak cafe\u0301", "Ｔｈｅ oak café", "The\u00a0oak\u2009café", "T\u200bhe oak\u2060 caf\u00ade\u0301"],
    ["Старый мост", "Cтарый мост", "Стapый мост", "Старый\u3000мост"],
    ["ﬂat oﬃce", "flat office"],
    ["Å ångström", "A\u030a a\u030angstro\u0308m", "\u212b ångström"],
    ["ガラス", "カ\u3099ラス", "ｶﾞﾗｽ"],
    ["⑴ a", "⑴\u200b a", "(1) a"],
    ["\u1f71b", "\u03acb", "\u1f71\u200bb", "α\u0301b"],
    ["한국 각", "\u1112\u1161\u11ab\u1100\u116e\u11a8 \u1100\u1161\u11a8", "한국 가\u11a8", "한\u200b국 각"],
    ["Հայ օր", "Հայ oր", "Հայ օր\u00ad"],
    ["а лодка, о маяк", "a лодка, o маяк"],
    ["ệ q\u0323\u0307", "e\u0323\u0302 q\u0307\u0323", "e\u0302\u0323 q\u0323\u0307"],
]
APART = ["The oak cafe", "the oak café", "The oak café 1", "x2", "x²", "Ab", "АБ", "l1", "I1", "don't", "don’t", "ㄱㅏ", "가"]


def test_one_form_for_one_look(spark):
    rows = [(k, i, t) for k, g in enumerate(SAME) for i, t in enumerate(g)] + [(100 + k, 0, t) for k, t in enumerate(APART)]
    got = {(r.a, r.b): r.normal for r in normalize_texts(spark.createDataFrame(rows, "a int, b int, t string"), ["a", "b"], "t").collect()}
    assert len(got) == len(rows)
    for k, g in enumerate(SAME):
        forms = {got[(k, i)] for i in range(len(g))}
        assert len(forms) == 1, forms
        assert U.normalize("NFC", forms.pop()) == got[(k, 0)]
    assert got[(0, 0)] == "The oak café" and got[(1, 1)] == "Старый мост" and got[(2, 0)] == "flat office"
    assert len({got[(100 + k, 0)] for k in range(len(APART))} | {got[(0, 0)]}) == len(APART) + 1


def test_every_changed_code_point_is_admitted_alone():
    """No code point that the tables change passes as plain, and each one's table row is what the Unicode database says."""
    plain = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), _patterns()["plain"]))
    rows, _, changed = _tables()
    assert all(plain.match(chr(c)) for c in range(0x20, 0x7F)) and all(plain.match(x) for x in "éßñАяё、漢한")
    for c in changed:
        assert not plain.match(chr(c)), hex(c)
    to = {}
    for ch, _, x, *_ in rows:
        to[ch] = to.get(ch, "") + x
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if plain.match(ch):
            assert U.normalize("NFC", to.get(ch, ch)) == ch, hex(c)


def test_pairs_and_edge_cases(spark):
    rows = [("d", k, t) for k, t in enumerate(SAME[0] + SAME[0][:1] * 3)] + [("d", 50, None), ("d", 51, ""), ("d", 52, "\u200b"), ("d", 53, "\u00a0"), ("d", None, "Thе"), ("e", 0, SAME[0][0]), ("d", 0, SAME[0][0]), ("d", 60, "word " * 20_000 + "\u00a0"), ("d", 61, "word " * 20_000 + " ")]
    df = spark.createDataFrame(rows, "tbl string, id long, t string").withColumnsRenamed({}).selectExpr("*", "1 as look")
    got = {tuple(r) for r in same_looking(df, "tbl", "id", "t").collect()}
    want = {("d", a, b) for a, x in enumerate(SAME[0] + SAME[0][:1] * 3) for b, y in enumerate(SAME[0] + SAME[0][:1] * 3) if a < b and x != y} | {("d", 60, 61)}
    assert got == want
    assert same_looking(df.limit(0), "tbl", "id", "t").count() == 0


def test_tasks_are_sized_by_code_points(spark, monkeypatch):
    """Chunks of few compressed bytes but many code points don't end up in one task, where they would be sorted at once."""
    original, tasks = lookalikes.normal_chunks, []

    def watched(chunks):
        out = original(chunks)
        tasks.extend(r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.sum(F.length("normal")).alias("n")).collect())
        return out

    monkeypatch.setattr(lookalikes, "normal_chunks", watched)
    texts = spark.range(1500).select("id", F.concat(F.repeat(F.lit("e\u0301"), 400), F.col("id").cast("string")).alias("t"))
    got = normalize_texts(texts, ["id"], "t")
    assert got.filter(F.col("normal") == F.concat(F.repeat(F.lit("é"), 400), F.col("id").cast("string"))).count() == 1500
    assert sum(tasks) > 600_000 and max(tasks) < 0.5 * sum(tasks), tasks


def test_places_hold_every_mapping():
    assert max(i for _, i, *_ in _tables()[0]) < PLACES
