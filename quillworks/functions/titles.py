"""File names, titles and site suffixes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillworks.functions.text import rx, trim_all


def base_name(path: Column) -> Column:
    return F.element_at(F.split(rx(path, "/+\\z"), "/", -1), -1)


def extension(name: Column) -> Column:
    """Last extension in lower case; null if there is none (a leading dot starts a name, no extension)."""
    return F.lower(F.nullif(F.regexp_extract(base_name(name), "(?s)\\A.+\\.([^./]+)\\z", 1), F.lit("")))


def stem(name: Column) -> Column:
    b = base_name(name)
    return F.when(extension(name).isNull(), b).otherwise(rx(b, "\\.[^.]*\\z"))


def title(url: Column, name: Column) -> Column:
    """From the source address's last part, else the file name, else Untitled; never from content."""
    full = lambda c: F.nullif(trim_all(stem(c)), F.lit(""))
    return F.coalesce(full(url), full(name), F.lit("Untitled"))


#: What parts a title from the site's name, the first that fits counts.
SEPARATORS = (" | ", " — ", " – ", " - ")


def strip_site(page_title: Column, site: Column) -> Column:
    """The page title without a separator and the site's name at its end, if something is left."""
    named = site.isNotNull() & (trim_all(site) != "")
    without = [trim_all(F.substr(page_title, F.lit(1), F.length(page_title) - F.length(site) - len(sep))) for sep in SEPARATORS]
    fits = [named & F.endswith(F.lower(page_title), F.lower(F.concat(F.lit(sep), site))) for sep in SEPARATORS]
    return F.coalesce(*(F.when(f, F.nullif(w, F.lit(""))) for f, w in zip(fits, without)), page_title)
