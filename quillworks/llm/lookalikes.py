"""Visually identical text with different characters, brought to one form.

The form: compatibility widths and ligatures spelled out, accents composed with their letters, jamo with their
syllables, every kind of space a plain space, invisible characters gone, and look-alike letters in the script that the
rest of their word shows.  Letter case, accents, digits, punctuation and line breaks stay.

One scan marks the texts that need work: those with a character outside the plain ranges (ranges of
frequent blocks without the characters that the tables change, so derived from the tables), with scripts
mixed in a word, or with a word of another script's doubles.  Their odd chunks (up to a space, line end or
ideograph), each different one once, are exploded to positioned code points, which are joined with one broadcast
table of decompositions and doubles (built by rule from the Unicode database, so its size is
fixed); combining marks are ordered by class, letters and marks recomposed, and the chunk rebuilt.
The rebuilt chunks then go back into their texts.  Texts without odd chunks are never shuffled.

A look-alike goes to the script of its word's letters that have no double in another script; a word of
nothing but doubles goes to the script most such letters of the whole text have.  Both depend on
what a reader sees, so texts that look the same come out the same.

Defined results: null stays null; empty stays empty; a text of invisible characters comes out
empty; repeated rows stay; rows with a null key are left out; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata as U
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quillworks.llm.lineage import checkpointed

# Letters that look like Latin ones, in the order of the Latin ones, by script.
DOUBLES = {
    "C": ("ABCEHIJKMOPSTXYaceijopsxyhdqwGQWVvIl", "АВСЕНІЈКМОРЅТХУасеіјорѕхуһԁԛԝԌԚԜѴѵӀӏ"),
    "G": ("ABEZHIKMNOPTYXovpuiaxJj", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρυιαχͿϳ"),
    "A": ("OSULounhgqj", "ՕՏՍԼօսոհցզյ"),
    "K": ("DRTiAJEWMHGZSVLCPKB", "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴ"),
    "L": ("ag", "ɑɡ"),
}
#: Scripts with doubles: the name the Unicode database gives them, a bit, and the letters as a character class.
SCRIPTS = {"L": ("LATIN", 1, "A-Za-zÀ-ɏ"), "C": ("CYRILLIC", 2, "Ѐ-ԯ"), "G": ("GREEK", 4, "Ͱ-Ͽἀ-῿"), "A": ("ARMENIAN", 8, "Ա-֏"), "K": ("CHEROKEE", 16, "Ꭰ-Ᏽ")}
#: Compatibility mappings that a reader doesn't see; others, such as superscripts, are visible.
UNSEEN = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>"}
#: Blocks whose unchanged characters count as plain.
BLOCKS = ((0x00, 0x24F), (0x370, 0x52F), (0x2010, 0x2052), (0x3001, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
#: Jamo that follow a leading one, and those that close a syllable.
_VOWELS, _FINALS = (0x1161, 0x1175), (0x11A8, 0x11C2)
#: Places for the letters that one code point stands for (7 at most; tested).
PLACES = 64


def _map(ch: str) -> str:
    """What a code point stands for: fully decomposed, widths and ligatures spelled out.

    Syllables stay whole, and so do compatibility jamo, which stand side by side to a reader.
    """
    c, cat = ord(ch), U.category(ch)
    if ch == "\n" or 0xAC00 <= c <= 0xD7A3 or 0x3131 <= c <= 0x318E:
        return ch
    if cat == "Zs" or ch == "\t":
        return " "
    if cat in ("Cc", "Cf") or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or ch in "͏ㅤ":
        return ""
    if ch in "‐‑":
        return "-"
    d = U.decomposition(ch).split()
    if not d:
        return ch
    if d[0].startswith("<"):
        if d[0] not in UNSEEN:
            return ch
        d = d[1:]
    return "".join(_map(chr(int(x, 16))) for x in d)


def _joins(ch: str) -> bool:
    """Whether a code point belongs to the one before it."""
    return U.combining(ch) > 0 or _VOWELS[0] <= ord(ch) <= _VOWELS[1] or _FINALS[0] <= ord(ch) <= _FINALS[1]


@lru_cache(maxsize=1)
def _tables() -> tuple[list[tuple], list[tuple], list[int]]:
    """Mappings (ch, sub, to, ccc, joins, bit, form in each script), compositions (parts, whole), and the code points that change."""
    latin = {o: x for _, (xs, os) in DOUBLES.items() for x, o in zip(xs, os)}
    latin |= {x: x for xs, _ in DOUBLES.values() for x in xs}
    as_script = {s: {} for s in SCRIPTS}
    for s, (xs, os) in DOUBLES.items():
        for x, o in zip(xs, os):
            as_script[s].setdefault(x, x if s == "L" else o)
    settled = {form for forms in as_script.values() for form in forms.values()} | set(latin.values())
    rows, comp, changed = [], [], []
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if U.category(ch) in ("Cn", "Co", "Lo", "So", "Sm") and not U.decomposition(ch) and not 0x1100 <= c < 0x1200 and ch not in latin and ch != "ㅤ":
            continue  # stands for itself
        to = _map(ch)
        if to != ch and len(to) > 1 and U.normalize("NFC", U.normalize("NFD", ch)) == ch and U.normalize("NFD", ch) == to:
            comp.append((to, ch))
        if U.normalize("NFC", to) != ch or _joins(ch) or 0x1100 <= c <= 0x1112 or ch in latin and ch not in settled:
            changed.append(c)
        for i, x in enumerate(to) if to else ((0, ""),):
            name = U.name(x, "").split(" ")[0] if x and U.category(x)[0] == "L" else ""
            bit = next((b for n, b, _ in SCRIPTS.values() if n == name), 0)
            key = latin.get(x)
            if to != ch or bit or _joins(x):
                forms = [None if key is None else as_script[s].get(key, key) for s in SCRIPTS]
                rows.append((ch, i, x, U.combining(x) if x else 0, bool(x) and _joins(x), bit, 0 if key else bit, *forms))
    return rows, comp, changed


@lru_cache(maxsize=1)
def _patterns() -> dict[str, str]:
    changed = set(_tables()[2])
    plain = []
    for a, b in BLOCKS:
        for c in range(a, b + 1):
            if c not in changed:
                if plain and plain[-1][1] == c - 1:
                    plain[-1][1] = c
                else:
                    plain.append([c, c])
    plain_class = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in plain)
    every = "".join(r for _, _, r in SCRIPTS.values())
    mix = "|".join(f"[{r}][{''.join(x for _, _, x in SCRIPTS.values() if x != r)}]" for _, _, r in SCRIPTS.values())
    lone = {}
    for home in "LCG":
        other = "".join(os for s, (_, os) in DOUBLES.items() if s not in (home, "L")) + ("" if home == "L" else "".join(dict.fromkeys("".join(xs for xs, _ in DOUBLES.values()))))
        lone[home] = f"(?<!\\p{{L}})[{other}]+(?!\\p{{L}})"
    return {"plain": f"^[{plain_class}]*+$", "other": f"[{every.replace(SCRIPTS['L'][2], '')}]", "mix": mix, **lone}


#: Letters without a double, by which a text's main script is told; the same to any reader.
_CLEAR = {"L": "[bfgklmnrtz]+", "C": "[бгджзилмнптцчшщ-ю]+", "G": "[βγδθλμξπσφψω]+"}
#: Where pieces of a text end: after a space, line end or sign of its kind, and after a run of ideographs.
_ENDS = "(?<=[ \\n、。])|(?<=[\\u3400-\\u9fff])(?![\\u3400-\\u9fff])"


def _frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows, comp, _ = _tables()
    f = spark.createDataFrame
    # The forms are a letter each, so one string has them in the order of the scripts.
    rows = [(*r[:7], r[7] and "".join(r[7:])) for r in rows]
    return F.broadcast(f(rows, "ch string, sub int, to string, ccc int, joins boolean, bit int, clear int, forms string")), F.broadcast(f(comp, "parts string, whole string"))


def _syllable(parts: Column) -> Column:
    """A leading jamo or a syllable with the jamo that follow it, as one syllable."""
    code = lambda i: F.ascii(F.substring(parts, i, 1))
    letter = lambda n: F.decode(F.unhex(F.hex(n)), "UTF-16BE")
    final = F.when(F.length(parts) == 3, code(3) - 0x11A7).otherwise(0)
    made = letter(0xAC00 + ((code(1) - 0x1100) * 21 + code(2) - 0x1161) * 28 + final)
    closed = letter(code(1) + code(2) - 0x11A7)
    return F.when(parts.between("ᄀ", "힤"), F.when(parts.rlike("^[\\u1100-\\u1112][\\u1161-\\u1175][\\u11a8-\\u11c2]?$"), made).when(parts.rlike("^[\\uac00-\\ud7a3][\\u11a8-\\u11c2]$") & ((code(1) - 0xAC00) % 28 == 0), closed))


def normal_chunks(chunks: DataFrame) -> DataFrame:
    """``cid, normal`` of rows (cid, home, chunk) with different cid.

    Code points carry the digest of their chunk, never the chunk, so a long chunk costs its length.  They take many
    times the bytes of the chunks, so they are spread anew once they are there: what a task sorts is sized by them.
    """
    table, comp = _frames(chunks.sparkSession)
    cps = chunks.select("cid", "home", F.posexplode(F.split("chunk", "")).alias("pos", "ch")).filter("ch <> ''").repartition("cid")
    zero = lambda c: F.coalesce(c, F.lit(0))
    # The rows that are sorted are narrow: a place, the letter, and its forms with the one of the text's script behind them.
    at = {s: k + 1 for k, s in enumerate(SCRIPTS)}
    home = F.create_map(*(F.lit(x) for pair in at.items() for x in pair))[F.col("home")]
    cps = cps.join(table, "ch", "left").select("cid", (F.col("pos").cast("bigint") * PLACES + zero("sub")).alias("pos"), F.coalesce("to", "ch").alias("to"), zero("ccc").alias("ccc"), F.coalesce("joins", F.lit(False)).alias("joins"), zero("bit").alias("bit"), zero("clear").alias("clear"), F.concat("forms", F.substr("forms", home, F.lit(1))).alias("forms")).filter("to <> ''")
    w = W.partitionBy("cid").orderBy("pos")
    cps = cps.withColumn("unit", F.sum((~F.col("joins")).cast("int")).over(w)).withColumn("word", F.sum(((F.col("bit") == 0) & ~F.col("joins")).cast("int")).over(w))
    cps = cps.withColumn("seen", F.bit_or("clear").over(W.partitionBy("cid", "word")))
    # One script alone decides; none: the text's script; several: each letter's Latin double.
    script = F.when(F.col("seen") == 0, len(at) + 1)
    for s, (_, bit, _) in SCRIPTS.items():
        script = script.when(F.col("seen") == bit, at[s])
    to = F.coalesce(F.substr("forms", script.otherwise(at["L"]), F.lit(1)), "to")
    # A letter and its marks, the marks in order of their class, are one unit.
    units = cps.groupBy("cid", "unit").agg(F.array_sort(F.collect_list(F.struct("ccc", "pos", to.alias("to")))).alias("m"))
    parts = F.array_join(F.transform("m", lambda x: x["to"]), "")
    units = units.withColumn("parts", parts).withColumn("more", F.expr("if(size(m) > 2, array_join(transform(slice(m, 3, size(m)), x -> x.to), ''), null)")).withColumn("two", F.expr("if(size(m) > 2, concat(m[0].to, m[1].to), null)"))
    units = units.join(comp, "parts", "left").join(comp.select(F.col("parts").alias("two"), F.col("whole").alias("first")), "two", "left")
    whole = F.coalesce("whole", F.concat("first", "more"), _syllable(F.col("parts")), "parts")
    out = units.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("unit", whole.alias("s")))).alias("u"))
    return out.select("cid", F.array_join(F.transform("u", lambda x: x["s"]), "").alias("normal"))


def _home(text: Column) -> Column:
    """The text's main script: that of most letters without a double; Latin if there is no other."""
    n = {k: F.length(text) - F.length(F.regexp_replace(text, v, "")) for k, v in _CLEAR.items()}
    c, g = F.greatest(n["C"], n["G"]), n["L"]
    return F.when(~text.rlike(_patterns()["other"]), "L").when(c <= g, "L").when(n["C"] >= n["G"], "C").otherwise("G")


def _is_odd(text: Column, home: Column) -> Column:
    """Whether anything in a text or chunk needs work, by cheap tests first."""
    p = _patterns()
    lone = F.when(home == "L", text.rlike(p["L"])).when(home == "C", text.rlike(p["C"])).otherwise(text.rlike(p["G"]))
    other = (F.length(text) != F.octet_length(text)) & text.rlike(p["other"])
    return ~text.rlike(p["plain"]) | other & text.rlike(p["mix"]) | ((home != "L") | other) & lone


def _scanned(df: DataFrame, keys: list[str], text: str, *more: Column) -> DataFrame:
    """``keys, text, home, odd`` and more; the text's script and its oddity are worked out once."""
    rows = df.select(*keys, F.col(text).alias("text")).dropna(subset=keys)
    rows = rows.select(*keys, "text", F.explode(F.array(_home(F.col("text")))).alias("home"))
    return rows.select(*keys, "text", "home", F.explode(F.array(F.coalesce(_is_odd(F.col("text"), F.col("home")), F.lit(False)))).alias("odd"), *more)


def _rebuilt(odd: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, normal`` of rows (keys, text, home), which are read three times."""
    pieces = F.split("text", _ENDS)
    chunks = F.filter(F.transform(pieces, lambda p, i: F.struct(i.alias("at"), p.alias("chunk"))), lambda x: (x["chunk"] != "") & _is_odd(x["chunk"], F.col("home")))
    each = odd.select(*keys, "home", F.explode(chunks).alias("x")).select(*keys, "home", "x.*")
    cid = F.unhex(F.md5(F.concat("home", "chunk"))).alias("cid")
    normal = normal_chunks(each.select("home", "chunk").distinct().select(cid, "home", "chunk"))
    back = each.select(*keys, "at", cid).join(normal, "cid", "left").groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("at", F.coalesce("normal", F.lit("")).alias("normal")))).alias("n"))
    # The pieces between the odd ones, joined to runs, and the odd ones' normal forms by turns.
    joined = F.expr("""if(n is null, text, concat(
        array_join(transform(n, (x, k) -> concat(array_join(slice(pieces, if(k = 0, 0, n[k - 1].at + 1) + 1, x.at - if(k = 0, 0, n[k - 1].at + 1)), ''), x.normal)), ''),
        array_join(slice(pieces, n[size(n) - 1].at + 2, size(pieces)), '')))""")
    both = odd.join(back, keys, "left").select(*keys, "text", "n", F.explode(F.array(F.struct(pieces.alias("pieces")))).alias("x"))  # split once a text
    return both.select(*keys, "text", "n", "x.pieces").select(*keys, "text", joined.alias("normal"))


def normalize_texts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys + text, normal``.  Rows with one key must have one text; rows with a null key are left out."""
    if taken := {"text", "normal", "home", "odd", "at", "chunk", "x", "n", "pieces", "cid"} & set(keys):
        raise ValueError(f"key columns can't be named {sorted(taken)}")
    rows = _scanned(df, keys, text)
    # The odd texts are used three times; they are kept in the shared folder.
    odd = checkpointed(rows.filter("odd").select(*keys, "text", "home"))
    plain = rows.filter("not odd")
    return _rebuilt(odd, keys).unionByName(plain.select(*keys, "text", F.col("text").alias("normal")))


#: Lists of the records of one form are as many as this at most, each with its share of them.
SHARES = 1024


def same_looking(df: DataFrame, tbl: str, rec_id: str, text: str) -> DataFrame:
    """``tbl, id_a, id_b``: pairs of records that look the same but differ in their code points.

    Texts are read once: plain ones go on as digests, odd ones with their text until it is rebuilt.
    The different forms of a look are paired first, then expanded to the records that have them,
    so the work is that of the result; exact copies are never paired with each other.  The records
    of a form come in up to ``SHARES`` lists, so a hot form is spread over as many keys.
    """
    named = df.select(F.col(tbl).alias("tbl"), F.col(rec_id).cast("bigint").alias("rec_id"), F.col(text).alias("text"))
    rows = _scanned(named, ["tbl", "rec_id"], "text", F.md5("text").alias("form")).filter(F.col("text").rlike("[^ \\n]"))
    kept = checkpointed(rows.select("tbl", "rec_id", "form", "odd", F.when(F.col("odd"), F.col("text")).alias("text"), F.when(F.col("odd"), F.col("home")).alias("home")))
    rebuilt = _rebuilt(kept.filter("odd").select("tbl", "rec_id", "text", "home"), ["tbl", "rec_id"]).filter(F.col("normal").rlike("[^ \\n]"))
    looks = rebuilt.select("tbl", "rec_id", F.md5("normal").alias("look"), F.md5("text").alias("form")).unionByName(kept.filter("not odd").select("tbl", "rec_id", F.col("form").alias("look"), "form"))
    n = checkpointed(looks)  # ids and digests only
    several = n.groupBy("tbl", "look").agg(F.min("form").alias("a"), F.max("form").alias("b")).filter("a <> b").select("tbl", "look")
    lists = n.join(several, ["tbl", "look"], "left_semi").groupBy("tbl", "look", "form", F.pmod(F.xxhash64("rec_id"), F.lit(SHARES)).alias("share")).agg(F.collect_set("rec_id").alias("ids"))
    forms = lists.groupBy("tbl", "look", "form").agg(F.collect_set("share").alias("shares"))

    def named_as(x: str) -> DataFrame:
        return forms.select("tbl", "look", F.col("form").alias(f"f{x}"), F.col("shares").alias(f"shares_{x}"))

    def with_ids(pairs: DataFrame, x: str) -> DataFrame:
        return pairs.join(lists.select("tbl", "look", F.col("form").alias(f"f{x}"), F.col("share").alias(f"share_{x}"), F.col("ids").alias(f"ids_{x}")), ["tbl", "look", f"f{x}", f"share_{x}"])

    pairs = named_as("a").join(named_as("b"), ["tbl", "look"]).filter("fa < fb")
    pairs = pairs.withColumn("share_a", F.explode("shares_a")).withColumn("share_b", F.explode("shares_b")).drop("shares_a", "shares_b")
    found = with_ids(with_ids(pairs, "a"), "b").withColumn("ra", F.explode("ids_a")).withColumn("rb", F.explode("ids_b"))
    return found.select("tbl", F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b"))
