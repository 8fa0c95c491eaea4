"""Formats, their extensions, and the order in which extractors are asked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillworks.functions.titles import extension

#: The default formats in their order, with their extensions.
DEFAULT = (
    ("plainText", ("txt", "text")),
    ("markdown", ("md", "markdown", "mdown", "mkd")),
    ("srt", ("srt",)),
    ("vtt", ("vtt", "webvtt")),
    ("rtf", ("rtf",)),
    ("html", ("html", "htm")),
    ("doc", ("doc",)),
    ("docx", ("docx",)),
    ("odt", ("odt",)),
    ("pptx", ("pptx",)),
)


@dataclass(frozen=True)
class Extractor:
    """A format of one's own: text from content, as a column function, for rows of its extensions or that it sniffs."""

    format: str
    extensions: tuple[str, ...]
    text: Callable[[Column, Column], Column] | None = None  # (content, file name) to text; None: built in
    sniff: Callable[[Column, Column], Column] | None = None


@dataclass(frozen=True)
class Registry:
    """Extractors in the order they are asked; a list given replaces the default."""

    extractors: tuple[Extractor, ...] = field(default_factory=lambda: tuple(Extractor(f, e) for f, e in DEFAULT))

    def formats(self) -> list[str]:
        return [x.format for x in self.extractors]

    def extensions(self) -> list[str]:
        return sorted({e for x in self.extractors for e in x.extensions})

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, x.format, e) for i, x in enumerate(self.extractors) for e in x.extensions], "position int, format string, extension string")

    def by_name(self, name: Column) -> Column:
        """The first format that has the name's extension."""
        ext, out = extension(name), None
        for x in self.extractors:
            if x.extensions:
                out = F.when(ext.isin(*x.extensions), x.format) if out is None else out.when(ext.isin(*x.extensions), x.format)
        return out if out is not None else F.lit(None).cast("string")

    def by_content(self, content: Column, name: Column, sniffed: Column) -> Column:
        """The first format whose sniffer takes the content; text formats have none."""
        out = None
        for x in self.extractors:
            test = x.sniff(content, name) if x.sniff else (sniffed == x.format if x.text is None and x.format in ("docx", "odt", "pptx") else None)
            if test is not None:
                out = F.when(test, x.format) if out is None else out.when(test, x.format)
        return out if out is not None else F.lit(None).cast("string")
