"""Web pages to articles: gates, title, blocks, metadata, text, and the model's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillworks.functions.text import trim_all
from quillworks.functions.titles import strip_site
from quillworks.operators.kernels import read_page
from quillworks.options import WebOptions
from quillworks.plans.extract import error
from quillworks.schema import ARTICLE, BLOCK


def render_blocks(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")


def _some(c: Column) -> Column:
    return F.nullif(trim_all(c), F.lit(""))


def url_host(url: Column) -> Column:
    """The host of an http or https address, as written; null for anything else."""
    ok = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https")
    return F.when(ok, F.nullif(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def assemble(page: Column, url: Column, options: WebOptions) -> tuple[Column, Column]:
    """(article, body characters) of a parsed page."""
    first = F.get(F.filter(page["drafts"], lambda d: (d["kind"] == "heading") & (d["level"] == 1)), F.lit(0))["text"]
    page_title = _some(page["title"])
    shown = F.coalesce(first, strip_site(page_title, _some(page["site"])), url_host(url))
    head = F.struct(F.lit("heading").alias("kind"), F.lit(1).alias("level"), shown.alias("text"))
    drafts = F.when(first.isNull() & page_title.isNotNull(), F.concat(F.array(head), page["drafts"])).otherwise(page["drafts"])
    blocks = F.transform(drafts, lambda d, i: F.struct(F.format_string("block-%06d", i + 1).alias("id"), d["kind"].alias("kind"), d["level"].alias("level"), d["text"].alias("text")))
    count = F.aggregate(F.transform(F.filter(drafts, lambda d: d["kind"] != "heading"), lambda d: F.length(d["text"])), F.lit(0), lambda a, b: a + b)
    pairs = {"author": page["author"], "siteName": page["site"], "language": page["language"], "publishedTime": page["published"]}
    meta = F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), _some(v)))), lambda _, v: v.isNotNull())
    article = F.struct(trim_all(shown).alias("title"), url.alias("source_url"), blocks.alias("blocks"), meta.alias("metadata"), render_blocks(blocks).alias("text"))
    return article.cast(ARTICLE), count


def extract_articles(df: DataFrame, html: str = "html", url: str = "url", options: WebOptions = WebOptions(), strict: bool = False) -> DataFrame:
    """The input's columns but the page, with ``article`` and ``error``, one of which is null."""
    kept = [c for c in df.columns if c not in (html, "article", "error")]
    whole = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(None)
    rows = df.select(whole.alias("_row"), F.coalesce(F.col(html), F.lit(b"")).alias("_html"), F.col(url).alias("_url"))
    size = F.octet_length("_html").cast("bigint")
    bad_url, large = url_host(F.col("_url")).isNull(), size > options.max_input_bytes
    rows = rows.withColumn("_size", size).withColumn("_page", read_page(F.when(~bad_url & ~large, F.col("_html")), options))
    article, count = assemble(F.col("_page"), F.col("_url"), options)
    made = F.struct(F.when(F.col("_page.drafts").isNotNull(), article).alias("_article"), count.alias("_count"))
    rows = rows.select(*rows.columns, F.inline(F.array(made)))  # made once; later filters can't fold it in
    failure = (
        F.when(url_host(F.col("_url")).isNull(), error("invalidSourceURL", F.lit("The source URL must be http or https with a host.")))
        .when(F.col("_size") > options.max_input_bytes, error("inputTooLarge", F.lit("The page is too large."), actual_bytes=F.col("_size"), max_bytes=F.lit(options.max_input_bytes)))
        .when(F.col("_page.code").isNotNull(), error(F.col("_page.code"), F.concat(F.lit("Could not read the page: "), F.col("_page.code")), reason=F.col("_page.reason")))
        .when(F.coalesce(F.col("_count"), F.lit(0)) < options.minimum_readable_characters, error("unreadableArticle", F.lit("The page has no readable article.")))
        .when(F.size("_article.blocks") > options.max_blocks, error("tooManyBlocks", F.lit("The article has too many blocks."), reason=F.lit(str(options.max_blocks))))
    )
    out = rows.withColumn("error", failure).withColumn("article", F.when(F.col("error").isNull(), F.col("_article")))
    if strict:
        out = out.withColumn("article", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("error.code"), F.lit(": "), F.col("error.message"))).cast(ARTICLE)).otherwise(F.col("article")))
    return out.select(*(F.col("_row")[c].alias(c) for c in kept), "article", "error")


def explode_blocks(articles: DataFrame, keys: list[str]) -> DataFrame:
    return articles.select(*keys, F.posexplode("article.blocks").alias("position", "block")).select(*keys, "position", "block.*")


def validate_article(article: Column) -> Column:
    """Null, or the first rule an article breaks."""
    blocks = article["blocks"]
    blank = lambda c: trim_all(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(F.exists(blocks, lambda b: blank(b["id"])), "emptyBlockIdentifier")
        .when(F.exists(blocks, lambda b: blank(b["text"])), "emptyBlockText")
        .when(F.exists(blocks, lambda b: (b["kind"] == "heading") & ~F.coalesce(b["level"].between(1, 6), F.lit(False))), "invalidHeadingLevel")
        .when(blank(article["title"]), "emptyTitle")
        .when(blocks.isNull() | (F.size(blocks) == 0), "emptyBlocks")
        .when(F.size(F.array_distinct(F.transform(blocks, lambda b: b["id"]))) < F.size(blocks), "duplicateBlockIdentifier")
    )


def to_json(article: Column) -> Column:
    """The serialised form: title, sourceURL, blocks, metadata; the text is made again on reading."""
    blocks = F.transform(article["blocks"], lambda b: F.struct(b["id"].alias("id"), F.struct(b["kind"].alias("type"), b["level"].alias("level")).alias("kind"), b["text"].alias("text")))
    return F.to_json(F.struct(article["title"].alias("title"), article["source_url"].alias("sourceURL"), blocks.alias("blocks"), article["metadata"].alias("metadata")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def from_json(text: Column) -> Column:
    """The article of its serialised form; null where it can't be read or breaks a rule.  Absent metadata is empty."""
    raw = F.from_json(text, "title string, sourceURL string, blocks array<struct<id:string,kind:struct<type:string,level:int>,text:string>>, metadata map<string,string>", {"mode": "PERMISSIVE"})

    def article(raw: Column) -> Column:
        blocks = F.transform(raw["blocks"], lambda b: F.struct(b["id"].alias("id"), b["kind"]["type"].alias("kind"), b["kind"]["level"].alias("level"), b["text"].alias("text"))).cast(f"array<{BLOCK}>")
        made = F.struct(trim_all(raw["title"]).alias("title"), raw["sourceURL"].alias("source_url"), blocks.alias("blocks"), F.coalesce(raw["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"), render_blocks(blocks).alias("text")).cast(ARTICLE)
        return F.when(raw["title"].isNotNull() & raw["sourceURL"].isNotNull(), _let(made, lambda a: F.when(validate_article(a).isNull(), a)))

    return _let(raw, article)
