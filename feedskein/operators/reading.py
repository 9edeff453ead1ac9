"""Article HTML as text and links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.functions import wording as W
from feedskein.functions.markup import needs_reading, page_parts


def html_to_text(pages: DataFrame, html="html", text="text") -> DataFrame:
    """pages with the HTML replaced by its text: one line per stretch of text between
    tags, without scripts, styles and comments."""
    others = [c for c in pages.columns if c != html]
    return pages.select(*others, page_parts(F.col(html), F.lit(None).cast("string"), "text")["text"].alias(text))


def article_links(pages: DataFrame, html="html", base=None) -> DataFrame:
    """One row per link in document order: the other columns of pages, pos, text, href and
    resolved_href (href against the base column, as it is without one). Pages without an
    anchor are not handed to the reader."""
    others = [c for c in pages.columns if c != html]
    base_url = F.col(base) if base else F.lit(None).cast("string")
    read = pages.select(
        *others, page_parts(needs_reading(F.col(html), "<a"), base_url, "links")["links"].alias("_links")
    )
    return (
        read.select(*others, F.posexplode_outer("_links").alias("pos", "_link"))
        .filter(F.col("pos").isNotNull())
        .select(*others, F.col("pos").cast("long").alias("pos"), "_link.text", "_link.href", "_link.resolved_href")
    )


def link_lines(links: DataFrame) -> DataFrame:
    """links with `line`: number from 1, text and address."""
    return links.withColumn("line", F.format_string(W.LINK_LINE, F.col("pos") + 1, "text", "href"))


def open_articles(details: DataFrame) -> DataFrame:
    """Details with the body as `text` and its `links` as numbered lines, one read each."""
    others = [c for c in details.columns if c != "body"]
    read = details.select(*others, page_parts(F.col("body"), F.lit(None).cast("string"), "text", "links").alias("_parts"))
    return read.select(
        *others, F.col("_parts.text").alias("text"),
        F.transform(
            "_parts.links",
            lambda link, i: F.format_string(W.LINK_LINE, i + 1, link["text"], link["href"]),
        ).alias("links"),
    )
