"""The pN_ queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quillworks.llm.boilerplate import separate_pages
from quillworks.llm.cues import collapse_runs
from quillworks.llm.encoding import repair_texts
from quillworks.llm.lookalikes import normalize_texts, same_looking
from quillworks.llm.markup import clean_markup, marked_up
from quillworks.llm.mixing import mix_sources, share_report
from quillworks.llm.packing import fill_report, pack_items
from quillworks.llm.pii import find_personal
from quillworks.llm.pieces import split_items


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _limit(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    """Capacity and overlap of one row of size_limits (a table of three rows)."""
    r = _table(spark, d, "size_limits").filter(F.col("limit_name") == name).first()
    return int(r["capacity"]), int(r["overlap"])


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Document texts (pos 0) and block texts (pos from 1)."""
    docs = _table(spark, d, "extracted_docs").select(F.lit("extracted_docs").alias("tbl"), F.col("document_id").alias("rec_id"), F.lit(0).cast("bigint").alias("pos"), "text")
    blocks = _table(spark, d, "web_articles").select(F.col("article_id").alias("rec_id"), F.posexplode(F.transform("blocks", lambda b: b["text"])).alias("pos", "text"))
    return docs.unionByName(blocks.select(F.lit("web_articles").alias("tbl"), "rec_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Items the splitter cut: those with a second piece."""
    limit, overlap = _limit(spark, d, "piece")
    return split_items(_items(spark, d), ["tbl", "rec_id", "pos"], "text", limit, overlap, only_oversized=True).filter("piece_no = 2").select("tbl", "rec_id", "pos")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = _limit(spark, d, "piece")
    return split_items(_items(spark, d), ["tbl", "rec_id", "pos"], "text", limit, overlap)


def p1_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each item give back: the text without the repeated parts, their largest size, gaps and overlaps."""
    before = F.lag("end_pos", 1, 0).over(W.partitionBy("tbl", "rec_id", "pos").orderBy("piece_no"))
    pieces = p1_pieces(spark, d).withColumn("before", before)
    fresh = F.substring("text", (F.col("before") - F.col("start_pos") + 2).cast("int"), F.length("text"))
    limit, overlap = _limit(spark, d, "piece")
    right = (F.col("start_pos") <= F.col("before") + 1) & (F.col("before") - F.col("start_pos") + 1 <= 2 * overlap) & (F.length("text") <= limit) & (F.col("end_pos") > F.col("before"))
    g = pieces.withColumn("fresh", fresh).groupBy("tbl", "rec_id", "pos").agg(F.array_sort(F.collect_list(F.struct("piece_no", "fresh"))).alias("x"), F.min(right | (F.col("end_pos") == 0)).alias("right"))
    return g.select("tbl", "rec_id", "pos", F.md5(F.array_join(F.transform("x", lambda x: x["fresh"]), "")).alias("text_md5"), "right")


def _named(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "extracted_docs").select(F.lit("extracted_docs").alias("tbl"), F.col("document_id").alias("rec_id"), "text")
    return docs.unionByName(_table(spark, d, "web_articles").select(F.lit("web_articles").alias("tbl"), F.col("article_id").alias("rec_id"), F.col("title").alias("text")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return same_looking(_named(spark, d), "tbl", "rec_id", "text")


def p2_normalized(spark: SparkSession, d: str) -> DataFrame:
    return normalize_texts(_named(spark, d), ["tbl", "rec_id"], "text").dropDuplicates(["tbl", "rec_id"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(_table(spark, d, "segments"), "document_id", "seq", "text", "start_time", "end_time", repeated_only=True).select(F.col("entity").alias("document_id"), "first_seq", "last_seq")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(_table(spark, d, "segments"), "document_id", "seq", "text", "start_time", "end_time").withColumnRenamed("entity", "document_id")


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each document: they hold every cue once, and don't overlap."""
    after = F.lead("first_seq").over(W.partitionBy("document_id").orderBy("first_seq"))
    runs = p3_runs(spark, d).withColumn("apart", F.coalesce(F.col("last_seq") < after, F.lit(True)))
    return runs.groupBy("document_id").agg(F.sum("n_events").alias("cues"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.min("apart").alias("apart"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Web articles and page sources with the name of their site as host (sites is a table of 60 rows)."""
    sites = _table(spark, d, "sites").select("site_id", "site_name")
    articles = _table(spark, d, "web_articles").join(F.broadcast(sites), "site_id", "left").select(F.lit("web_articles").alias("tbl"), F.col("article_id").alias("rec_id"), F.coalesce("site_name", F.col("metadata")["siteName"]).alias("host"), F.lit(None).cast("string").alias("source"), "blocks")
    sources = _table(spark, d, "extracted_docs").filter("doc_format = 'html' and raw_text is not null").select(F.lit("extracted_docs").alias("tbl"), F.col("document_id").alias("rec_id"), F.col("metadata")["siteName"].alias("host"), F.col("raw_text").alias("source"))
    return articles.unionByName(sources.withColumn("blocks", F.lit(None).cast(dict(articles.dtypes)["blocks"])))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return separate_pages(_pages(spark, d)).select("tbl", "rec_id", F.explode("furniture").alias("pos"))


def p4_main(spark: SparkSession, d: str) -> DataFrame:
    """Positions of the pieces that make up the article, in order."""
    return separate_pages(_pages(spark, d)).select("tbl", "rec_id", "kept")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """How each document's bytes were read; a reader that fell back without a name read Windows-1252."""
    name = F.coalesce("encoding_name", F.when(F.col("used_legacy_fallback"), "windows-1252"))
    return _table(spark, d, "decoded_texts").select("document_id", name.alias("read_as"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repair_texts(_table(spark, d, "extracted_docs"), ["document_id"], "text", only_suspicious=True, reports=_readings(spark, d)).filter("garbled").select("document_id").distinct()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Both texts of each document, a row for each that isn't null."""
    both = _table(spark, d, "extracted_docs").select("document_id", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("body")) for c in ("text", "raw_text")))).alias("x")).select("document_id", "x.*").filter("body is not null")
    return repair_texts(both, ["document_id", "field"], "body", reports=_readings(spark, d)).dropDuplicates(["document_id", "field"])


def _subtitles() -> F.Column:
    return F.col("doc_format").isin("srt", "vtt")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text has at least one piece of markup."""
    return marked_up(_table(spark, d, "extracted_docs"), ["document_id"], "text", _subtitles()).distinct()


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_markup(_table(spark, d, "extracted_docs"), ["document_id"], "text", _subtitles()).dropDuplicates(["document_id"])


def p6_page_text(spark: SparkSession, d: str) -> DataFrame:
    """The dense part of each page source, by the line-block distribution."""
    pages = _table(spark, d, "extracted_docs").filter("doc_format = 'html'").dropDuplicates(["document_id"])
    return clean_markup(pages, ["document_id"], "raw_text", page=True)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = _table(spark, d, "size_limits").filter("unit = 'tokens'").collect()  # a table of three rows
    return pack_items(_table(spark, d, "documents"), "doc_id", "text", {r["limit_name"]: int(r["capacity"]) for r in sizes})


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("item_id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(_packed(spark, d))


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    """For each container kind: texts packed, texts whose tokens aren't each in one place, containers over capacity, and texts cut without need."""
    packed = _packed(spark, d)
    texts = packed.groupBy("limit_name", "capacity", "item_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.min("start_token").alias("start"), F.countDistinct("start_token").alias("starts"))
    whole = (F.col("starts") == F.col("parts")) & (F.col("end") - F.col("start") == F.col("tokens"))
    of_texts = texts.groupBy("limit_name").agg(F.count("*").alias("texts"), F.sum((~whole).cast("bigint")).alias("broken"), F.sum(((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity"))).cast("bigint")).alias("cut_without_need"))
    full = packed.groupBy("limit_name", "capacity", "container").agg(F.sum("n_tokens").alias("used")).groupBy("limit_name").agg(F.sum((F.col("used") > F.col("capacity")).cast("bigint")).alias("overfull"))
    return of_texts.join(full, "limit_name")


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """For each source of the targets: its share, whether its tokens are within two texts of it, and whether no text is used too often."""
    everything = W.partitionBy(F.lit(0))  # the rows of the target table
    t = p8_shares(spark, d).withColumn("all", F.sum("n_tokens").over(everything)).withColumn("most", F.max("longest").over(everything))
    return t.select("source", "target_share", (F.abs(F.col("n_tokens") - F.col("target_share") * F.col("all")) <= 2 * F.col("most")).alias("met"), (F.col("most_uses") <= F.col("max_repeats")).alias("within"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(_table(spark, d, "documents"), _table(spark, d, "mix_targets"), "doc_id", "text", "source").withColumnRenamed("item_id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = _table(spark, d, "mix_targets")
    return share_report(mix_sources(_table(spark, d, "documents"), targets, "doc_id", "text", "source"), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    spans = find_personal(_table(spark, d, "documents"), ["doc_id"], "text", with_text=False).select("doc_id", F.explode("spans").alias("s"))
    return spans.select("doc_id", F.col("s.kind").alias("pii_kind"), F.col("s.start_pos").alias("start_pos"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(_table(spark, d, "documents"), ["doc_id"], "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_rejoined, p2_found, p2_normalized, p3_found, p3_runs, p3_totals, p4_found, p4_main, p5_found, p5_repaired, p6_found, p6_clean, p6_page_text, p7_containers, p7_fill, p7_totals, p8_mixture, p8_shares, p8_totals, p9_found, p9_redacted)}


def oracle_sql() -> dict[str, str]:
    items = """
        select 'extracted_docs' as tbl, document_id as rec_id, 0::bigint as pos, text from extracted_docs
        union all
        select 'web_articles', article_id, p::bigint, blocks[p].text
        from web_articles, lateral (select unnest(range(1, len(blocks) + 1)) as p)"""
    return {
        "p1_found": f"select distinct tbl, rec_id, pos from ({items}) where length(text) > (select capacity from size_limits where limit_name = 'piece')",
        "p1_rejoined": f"select tbl, rec_id, pos, md5(any_value(text)) as text_md5, true as \"right\" from ({items}) where text is not null group by 1, 2, 3",
        "p3_totals": "select document_id, count(distinct seq)::bigint as cues, min(seq) as first_seq, max(seq) as last_seq, true as apart from segments group by 1",
        "p7_totals": "select limit_name, (select count(*) from documents where text <> '')::bigint as texts, 0::bigint as broken, 0::bigint as cut_without_need, 0::bigint as overfull from size_limits where unit = 'tokens'",
        "p8_totals": "select source, target_share, true as met, true as within from mix_targets",
    }
