"""Text, links and keyword hits of web pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import squashed

_HIDDEN = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->"
_TAG = r"(?s)<[^>]*>"
# Character references that are resolved.
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain(html: Column, between: str = " ") -> Column:
    """Visible text of a page."""
    text = F.regexp_replace(F.regexp_replace(html, _HIDDEN, between), _TAG, between)
    for a, b in _REFERENCES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def page_text(html: Column, most: int) -> Column:
    """struct(text, full_length, truncated)"""
    return squashed(plain(html), most)


def links(pages: DataFrame, scanned: int = 20) -> DataFrame:
    """(page_id, n, href, text): of the first `scanned` anchors of a page those with a target and a text, the text cut to 100 characters."""
    anchors = F.slice(F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*>.*?</a\s*>)"), 1), 1, scanned)
    rows = pages.select("page_id", F.posexplode(anchors).alias("n", "a"))
    href = F.regexp_extract("a", r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)
    text = F.trim(F.regexp_replace(plain(F.col("a"), ""), r"(?U)\s+", " "))
    return rows.select("page_id", "n", href.alias("href"), F.left(text, F.lit(100)).alias("text")).where("href <> '' AND text <> ''")


def keyword_hits(pages: DataFrame, word: str, most: int = 5) -> DataFrame:
    """(page_id, n, text): the first `most` pieces of text between tags that contain the word in any case, cut to 200 characters."""
    pieces = F.split(F.regexp_replace(F.regexp_replace("html", _HIDDEN, "\x00"), _TAG, "\x00"), "\x00")
    hits = F.slice(F.filter(F.transform(pieces, lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " "))), lambda p: F.contains(F.lower(p), F.lit(word.lower()))), 1, most)
    return pages.select("page_id", F.posexplode(hits).alias("n", "text")).select("page_id", "n", F.left("text", F.lit(200)).alias("text"))


# Addresses of a search engine's own pages, which are no results.
OWN_PAGES = ("bing.com/ck/a", "bing.com/search", "microsoft.com/bing", "go.microsoft.com")


def _results(pages: DataFrame, parts: Column, least: int) -> DataFrame:
    """(page_id, n, url, title, snippet) of parts of a page: the first link to another site in each, if its text is long enough, with the first paragraph after it."""
    rows = pages.select("page_id", F.posexplode(parts).alias("n", "p"))
    anchor = F.regexp_extract("p", r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']https?://.*?</a\s*>", 0)
    url = F.regexp_extract(anchor, r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)
    text = lambda c: F.trim(F.regexp_replace(plain(c, ""), r"(?U)\s+", " "))
    snippet = F.regexp_extract("p", r"(?is)</a\s*>.*?<p\b[^>]*>(.*?)</p\s*>", 1)
    found = rows.select("page_id", "n", url.alias("url"), text(anchor).alias("title"), text(snippet).alias("snippet"))
    own = reduce(Column.__or__, (F.contains("url", F.lit(a)) for a in OWN_PAGES))
    return found.where((F.col("url") != "") & ~own & (F.length("title") >= least))


def heading_results(pages: DataFrame) -> DataFrame:
    """The results under second-level headings, in order."""
    parts = F.slice(F.split("html", r"(?i)<h2\b"), 2, 1 << 30)
    return _results(pages, F.transform(parts, lambda p: F.regexp_replace(p, r"(?is)</li\s*>.*", "")), 6)


def search_results(pages: DataFrame, most: int = 10) -> DataFrame:
    """(page_id, n, url, title, snippet): links to other sites, each target once, the first `most`; the title cut to 150 characters, the snippet to 300.

    Those under second-level headings; on a page without such those of its list of results (else of the whole page), which have no snippet.
    """
    headed = heading_results(pages)
    rest = pages.join(headed.select("page_id").distinct(), "page_id", "left_anti")
    inside = F.coalesce(F.nullif(F.regexp_extract("html", r"(?is)<ol\b.*?</ol\s*>", 0), F.lit("")), F.col("html"))
    listed = _results(rest, F.regexp_extract_all(inside, F.lit(r"(?is)(<a\b[^>]*>.*?</a\s*>)"), 1), 6).withColumn("snippet", F.lit(""))
    first = headed.unionByName(listed).groupBy("page_id", "url").agg(F.min(F.struct("n", "title", "snippet")).alias("f"))
    over = Window.partitionBy("page_id").orderBy("f.n")
    rows = first.withColumn("r", F.row_number().over(over) - 1).where(F.col("r") < most)
    return rows.select("page_id", F.col("r").alias("n"), "url", F.left("f.title", F.lit(150)).alias("title"), F.left("f.snippet", F.lit(300)).alias("snippet"))


def nth_result(pages: DataFrame, n: int) -> DataFrame:
    """(page_id, url, title): the n-th result, from 1, under second-level headings; pages with fewer give none. The text is cut to 120 characters."""
    over = Window.partitionBy("page_id").orderBy("n")
    rows = heading_results(pages).withColumn("r", F.row_number().over(over)).where(F.col("r") == n)
    return rows.select("page_id", "url", F.left("title", F.lit(120)).alias("title"))


def best_link(pages: DataFrame, word: str) -> DataFrame:
    """(page_id, url, title): of the links to other sites whose text or target contains the word that with the longest text, the first of several; its text cut to 120 characters."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*>.*?</a\s*>)"), 1)
    found = _results(pages, anchors, 0)
    hits = found.where(F.contains(F.lower("title"), F.lit(word.lower())) | F.contains(F.lower("url"), F.lit("".join(word.lower().split()))))
    best = hits.groupBy("page_id").agg(F.max_by(F.struct("url", "title"), F.struct(F.length("title"), -F.col("n"))).alias("b"))
    return best.select("page_id", "b.url", F.left("b.title", F.lit(120)).alias("title"))
