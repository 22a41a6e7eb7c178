"""Metadata in the head of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DC = r"""<meta name=['"]DC\.([^'"]+)['"] content=['"]([^'"]+)['"]\s*/?>"""


def dublin_core(html: Column) -> Column:
    """A map of the DC elements of a page, without their prefix; of a repeated one the last counts. A null page: null."""
    tags = F.regexp_extract_all(html, F.lit(_DC), 0)
    pair = lambda t: F.struct(F.regexp_extract(t, _DC, 1), F.regexp_extract(t, _DC, 2))
    later = lambda t, i: ~F.exists(F.slice(tags, i + 2, F.size(tags)), lambda x: F.regexp_extract(x, _DC, 1) == F.regexp_extract(t, _DC, 1))
    return F.map_from_entries(F.transform(F.filter(tags, later), pair))


def record(html: Column) -> Column:
    """What a document of the index takes from its DC elements: authors, titles, date (a year), and the rest as it is."""
    m = dublin_core(html)
    one = lambda k: F.when(m[k].isNotNull(), F.array(m[k])).otherwise(F.array().cast("array<string>"))
    year = F.when(m["date"].rlike("^[0-9]{4}$"), F.concat(m["date"], F.lit("-01-01T00:00:00Z"))).otherwise(m["date"])
    return F.struct(one("creator").alias("author"), one("title").alias("title"), year.alias("date"), F.map_filter(m, lambda k, v: ~k.isin("creator", "title", "date")).alias("other"))


def title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def language(html: Column) -> Column:
    return F.regexp_extract(html, '<html lang="([^"]*)"', 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/]+)", 1)
