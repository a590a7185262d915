"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate if more than a given share of its host's pages contain it besides the page it is on: so a line
that one page alone has is none, be the host as small as it may. Lines are taken from a page once, and counted by
digest, once for each page; only the boilerplate lines of a host, of which a page's mean number of lines divided by
the ratio bounds the count, are joined back to its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.scratch import free_name, stored
from brindle.llm.url_filter import host_of

#: A line is dropped if the host's other pages that hold it are over RATIO per cent of all its pages.
RATIO_PCT = 30
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>"
_BLOCK = r"(?i)</?(p|div|li|ul|ol|h[1-6]|nav|header|footer|article|aside|section|main|table|tr|td|th|br|form|body|html|head)\b[^>]*>"


def html_lines(html: Column) -> Column:
    """The visible text of a page with a line for each block; character references stay as they are."""
    text = F.regexp_replace(F.regexp_replace(html, _HIDDEN, " "), _BLOCK, "\n")
    return F.regexp_replace(text, "<[^>]*>", "")


def split_lines(text: Column) -> Column:
    """The lines of a text that have a word, with white space collapsed; null has none."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09\x0B-\x0D]+", " "), "\n")
    return F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: s != "")


def boilerplate(df: DataFrame, host: str, lines: str, ratio_pct: int = RATIO_PCT) -> DataFrame:
    """(host, digests): the boilerplate lines of each host that has some. Hosts must not be null."""
    pages = df.groupBy(host).agg(F.count("*").alias("pages"))
    digests = F.array_distinct(F.transform(lines, lambda s: F.unhex(F.md5(s))))
    on = df.select(host, F.explode(digests).alias("digest")).groupBy(host, "digest").agg(F.count("*").alias("on_pages"))
    common = on.filter(F.col("on_pages") > 1).join(pages, host).filter((F.col("on_pages") - 1) * 100 > F.col("pages") * ratio_pct)
    return common.groupBy(host).agg(F.collect_list("digest").alias("digests"))


def drop_lines(df: DataFrame, host: Column, text: Column, ratio_pct: int = RATIO_PCT, name: str = "lines", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with a struct column: host, n_lines, n_dropped, text (the lines that stay, joined by newlines).

    A null host is the empty host. A null or empty text has no lines and stays empty; a text of any length is read
    whole. A line that a page holds twice counts once, and all its places are dropped. Repeated rows count as pages.
    Columns of any name are carried along; if one is called ``name``, underscores are put in front. An empty table
    gives an empty table.
    """
    keep = df.columns if keep is None else keep
    held = df.select(*(F.col(f"`{c}`") for c in keep))
    name = free_name(held, name)
    at, spot, gone = (free_name(held, c) for c in ("host_of_row", "lines_of_row", "digests_of_host"))
    rows = stored(df.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(host, F.lit("")).alias(at), split_lines(text).alias(spot)), "lines")
    common = stored(boilerplate(rows.select(F.col(at).alias("host"), F.col(spot).alias("lines")), "host", "lines", ratio_pct), "boilerplate")
    rows = rows.join(common.select(F.col("host").alias(at), F.col("digests").alias(gone)), at, "left")
    stay = F.when(F.col(gone).isNull(), F.col(spot)).otherwise(F.filter(spot, lambda s: ~F.array_contains(gone, F.unhex(F.md5(s)))))
    size = lambda c: F.size(c).cast("long")
    made = F.transform(F.array(stay), lambda x: F.struct(F.col(at).alias("host"), size(F.col(spot)).alias("n_lines"), (size(F.col(spot)) - size(x)).alias("n_dropped"), F.array_join(x, "\n").alias("text")))
    return rows.select(*(F.col(f"`{c}`") for c in keep), F.get(made, F.lit(0)).alias(name))


def drop_page_lines(pages: DataFrame, url: str = "url", html: str = "html", with_html: bool = True, **options) -> DataFrame:
    """``drop_lines`` for the visible lines of pages, by the host of their URL; ``with_html`` says whether ``html`` is kept."""
    return drop_lines(pages, host_of(F.col(url)), html_lines(F.col(html)), keep=None if with_html else [c for c in pages.columns if c != html], **options)
