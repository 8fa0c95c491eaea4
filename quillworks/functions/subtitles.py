"""SRT and WebVTT as arrays inside the row: no shuffle, no state between rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillworks.functions.html import decode_entities
from quillworks.functions.text import S, normalize, rx, trim_all
from quillworks.options import ExtractOptions


def seconds(time: Column) -> Column:
    """Seconds of ``[HH:]MM:SS[.,mmm]``; null for anything else.  Minutes without hours have no bound."""
    t = F.translate(trim_all(time), ",", ".")
    parts = F.split(t, ":", -1)
    number = "[0-9]+(?:\\.[0-9]*)?"
    ok2, ok3 = t.rlike(f"\\A[0-9]+:{number}\\z"), t.rlike(f"\\A[0-9]+:[0-9]+:{number}\\z")
    n = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    two = F.when(n(1) < 60, n(0) * 60 + n(1))
    three = F.when((n(1) < 60) & (n(2) < 60), n(0) * 3600 + n(1) * 60 + n(2))
    return F.when(ok2, two).when(ok3, three)


def cue_blocks(col: Column, vtt: bool) -> Column:
    """Blocks between blank lines, as arrays of lines; WebVTT's header and notes left out."""
    lined = rx(col, "\\r\\n?", "\n")
    blocks = F.filter(F.transform(F.split(lined, f"\\n{S}*\\n", -1), trim_all), lambda b: b != "")
    if vtt:
        blocks = F.filter(blocks, lambda b: ~F.upper(F.split(b, "\n", 2)[0]).rlike("\\A(?:WEBVTT|NOTE|STYLE|REGION)"))
    return F.transform(blocks, lambda b: F.filter(F.transform(F.split(b, "\n", -1), trim_all), lambda x: x != ""))


def cue_text(lines: Column, options: ExtractOptions) -> Column:
    s = F.array_join(lines, options.subtitle_cue_separator)
    s = rx(rx(s, "<[^>]++>"), "\\{[^}]++\\}")
    return normalize(decode_entities(s), options)


def cues(col: Column, fmt: str, options: ExtractOptions = ExtractOptions()) -> Column:
    """Array of (n, source_id, start_time, end_time, bad, text), numbered before anything is dropped."""
    def one(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("-->"))), True)
        time = F.get(lines, (at - 1).cast("int"))
        sides = F.split(time, "-->", 2)
        start = seconds(sides[0])
        end = seconds(F.get(F.split(trim_all(F.get(sides, F.lit(1))), "[\\s\\p{Z}]+", -1), F.lit(0)))
        source = F.when(at > 1, trim_all(F.get(lines, (at - 2).cast("int"))))
        text = cue_text(F.slice(lines, (at + 1).cast("int"), F.size(lines)), options)
        return F.when(at > 0, F.struct(F.when(source != "", source).alias("source_id"), start.alias("start_time"), end.alias("end_time"), text.alias("text")))

    found = F.filter(F.transform(cue_blocks(col, fmt == "vtt"), one), lambda c: c.isNotNull() & (c["text"] != ""))
    return F.transform(found, lambda c, i: F.struct((i + 1).alias("n"), c["source_id"].alias("source_id"), c["start_time"].alias("start_time"), c["end_time"].alias("end_time"), c["text"].alias("text")))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\t-\\r\\x85\\p{Z}]+", -1), lambda w: w != "")


def _heard(c: Column) -> Column:
    """A cue with its words, as written and in lower case: split once, not for each comparison."""
    return F.struct(c["n"].alias("n"), c["source_id"].alias("source_id"), c["start_time"].alias("start_time"), c["end_time"].alias("end_time"), c["text"].alias("text"), _words(c["text"]).alias("words"), F.transform(_words(c["text"]), F.lower).alias("low"))


def _new_words(c: Column, prior: Column) -> Column:
    """What a cue says beyond the one before it; null if nothing.  Words compare without case."""
    most = F.least(F.size(prior["low"]), F.size(c["low"]))
    same = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: F.slice(prior["low"], -k, k) == F.slice(c["low"], F.lit(1), k))
    k = F.when(most > 0, F.coalesce(F.array_max(same), F.lit(0))).otherwise(0)
    rest = F.array_join(F.slice(c["words"], k + 1, F.greatest(F.size(c["words"]) - k, F.lit(0))), " ")
    return F.when(prior.isNull() | (k == 0), c["text"]).when(k < F.size(c["words"]), rest)


def segments(found: Column, fmt: str, options: ExtractOptions = ExtractOptions()) -> Column:
    """Segments of cues; with removal on, rolling captions say each word once.

    ``found`` should be a column, not an expression: it is read three times.
    """
    heard = F.transform(found, _heard)
    before = F.slice(F.concat(F.array(F.when(F.lit(False), F.get(heard, F.lit(0)))), heard), 1, F.size(found))

    def one(c: Column, prior: Column) -> Column:
        text = _new_words(c, prior) if options.remove_duplicate_subtitle_lines else c["text"]
        source = F.when(c["source_id"].isNotNull(), F.create_map(F.lit("sourceCueID"), c["source_id"])).otherwise(F.create_map().cast("map<string,string>"))
        return F.struct(F.concat(F.lit(f"{fmt}-"), c["n"].cast("string")).alias("id"), text.alias("text"), c["start_time"].alias("start_time"), c["end_time"].alias("end_time"), F.map_concat(F.create_map(F.lit("format"), F.lit(fmt)), source).alias("metadata"))

    return F.filter(F.zip_with(heard, before, one), lambda s: s["text"].isNotNull())


def time_warnings(found: Column) -> Column:
    bad = F.filter(found, lambda c: c["start_time"].isNull() | c["end_time"].isNull())
    return F.transform(bad, lambda c: F.struct(F.lit("malformedSubtitleTimestamp").alias("code"), F.concat(F.lit("Could not parse subtitle timestamp for cue "), F.coalesce(c["source_id"], c["n"].cast("string")), F.lit(".")).alias("message")))


def subtitle_text(segs: Column, options: ExtractOptions = ExtractOptions()) -> Column:
    return normalize(F.array_join(F.transform(segs, lambda s: s["text"]), options.paragraph_separator), options)
