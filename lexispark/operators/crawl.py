"""Pages: links, main text and the index feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexispark.functions import text as tx
from lexispark.plans.blocked import row_numbers


def site_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+", 0)


def extract_links(pages: DataFrame, sites: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct links of pages: the site's pattern over every page, without the excluded parts.

    ``sites`` has ``site, pattern, exclude`` (array of substrings), one row per site.
    """
    found = pages.select(site_of(F.col(url)).alias("site"), html).join(sites, "site")
    links = found.select(
        "site", "exclude", F.explode(F.array_distinct(F.regexp_extract_all(html, "pattern", F.lit(0)))).alias("path")
    )
    full = links.withColumn("link", F.concat("site", "path"))
    return full.filter(~F.exists("exclude", lambda e: F.contains(F.col("link"), e))).select("link").distinct()


# Elements that never hold text, and elements that end a text block.
_SILENT = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<title.*?</title>"
_BLOCK = r"(?i)</?(?:html|head|body|div|p|h[1-6]|ul|ol|li|nav|article|section|header|footer|table|tr|td|br|aside|main)\b[^>]*>"


def main_text(html: Column, min_words: int = 10, max_link_share: float = 0.33) -> Column:
    """Text blocks with enough words and few of them inside links (shallow text features)."""
    blocks = F.split(F.regexp_replace(html, _SILENT, " "), _BLOCK)
    plain = lambda b: tx.one_line(F.regexp_replace(b, "<[^>]*>", " "))
    linked = lambda b: F.array_join(F.regexp_extract_all(b, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), " ")
    measured = F.transform(
        blocks,
        lambda b: F.struct(
            plain(b).alias("text"),
            F.size(tx.words(plain(b))).alias("words"),
            F.size(tx.words(plain(linked(b)))).alias("in_links"),
        ),
    )
    good = F.filter(
        measured, lambda m: (m["words"] >= min_words) & (m["in_links"] <= m["words"] * F.lit(max_link_share))
    )
    return F.array_join(F.transform(good, lambda m: m["text"]), "\n")


def index_feed(
    pages: DataFrame,
    indexed: DataFrame,
    page_id: str,
    url: str = "url",
    content: str = "content",
    batch: int = 2000,
    ids_per_block: int = 1 << 16,
) -> DataFrame:
    """Pages not yet indexed and fit for the index, with their batch number in id order."""
    c = F.col(content)
    fit = F.length(tx.trim_ws(c)) >= 200
    for mark in ("<div", "<table", "</p>"):
        fit = fit & ~F.contains(c, F.lit(mark))
    novel = pages.filter(fit).join(indexed.select(url), url, "left_anti")
    numbered = row_numbers(
        novel.select(page_id, url, content), [], [page_id], F.floor(F.col(page_id) / ids_per_block), "no", start=0
    )
    return numbered.withColumn("batch", F.floor(F.col("no") / batch)).drop("no")
