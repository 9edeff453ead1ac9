"""Lists of feeds and articles, and how their rows read."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedskein.functions import wording as W
from feedskein.functions.text import blank_to_null
from feedskein.operators.skew import spread_join


def list_feeds(feeds: DataFrame, articles: DataFrame, ordered=True) -> DataFrame:
    """Each feed with its number of unread articles, by title.

    Only unread articles are read, and they are counted before they meet the feeds, so
    the join has one row per feed on both sides.
    """
    unread = articles.filter(~F.col("is_read")).groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("unread_count")
    )
    listed = feeds.join(unread, "feed_id", "left").select(
        *feeds.columns, F.coalesce("unread_count", F.lit(0)).alias("unread_count")
    )
    return listed.orderBy("title", "feed_id") if ordered else listed


def list_articles(
    feeds: DataFrame, articles: DataFrame, feed_id=None, unread_only=False, favorites_only=False,
    ordered=True, limit=None,
) -> DataFrame:
    """Articles with the title of their feed, newest first, undated last. Articles without
    a feed are left out. Ties in time go by feed and guid."""
    if feed_id is not None:
        articles = articles.filter(F.col("feed_id") == feed_id)
        feeds = feeds.filter(F.col("feed_id") == feed_id)
    if unread_only:
        articles = articles.filter(~F.col("is_read"))
    if favorites_only:
        articles = articles.filter(F.col("is_favorite"))
    titles = feeds.select("feed_id", F.col("title").alias("feed_title"))
    listed = spread_join(articles, titles, "feed_id", "inner", spread=["guid"]).select(
        *articles.columns, "feed_title"
    )
    if ordered or limit is not None:
        listed = listed.orderBy(*_newest())
    return listed if limit is None else listed.limit(limit)


def _newest() -> list[Column]:
    return [F.desc_nulls_last("published"), F.asc("feed_id"), F.asc("guid")]


def after(published, feed_id, guid) -> Column:
    """Whether an article comes after the one with these values in a list, newest first."""
    of_its_time = (F.col("feed_id") > feed_id) | ((F.col("feed_id") == feed_id) & (F.col("guid") > guid))
    if published is None:
        return F.col("published").isNull() & of_its_time
    bound = F.lit(published).cast("timestamp_ntz")
    return F.col("published").isNull() | (F.col("published") < bound) | ((F.col("published") == bound) & of_its_time)


def article_page(feeds: DataFrame, articles: DataFrame, size: int, bound=None, **predicates) -> DataFrame:
    """The first `size` articles of a list, or the first after `bound`, the (published, feed_id,
    guid) of the last one of the page before. However far down a page lies, it costs a filter,
    which reaches the files, and `size` rows per task; nothing is sorted as a whole. Articles
    that are added or removed meanwhile neither repeat nor hide others."""
    rest = articles if bound is None else articles.filter(after(*bound))
    return list_articles(feeds, rest, limit=size, **predicates)


def newest_per_feed(feeds: DataFrame, articles: DataFrame, size: int) -> DataFrame:
    """The `size` newest articles of each feed with their `rank`. Each task keeps that many of
    each feed before anything is shuffled, on keys and dates alone; what they hold meets the
    ones that are left by key. A feed with very many articles sends `size` rows per task."""
    order = Window.partitionBy("feed_id").orderBy(*_newest())
    keys = articles.select("feed_id", "guid", "published").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    titles = feeds.select("feed_id", F.col("title").alias("feed_title"))
    chosen = keys.drop("published").join(titles, "feed_id")
    return articles.join(chosen, ["feed_id", "guid"]).select(*articles.columns, "feed_title", "rank")


def view(feeds: DataFrame, articles: DataFrame, mode="all", **options) -> DataFrame:
    """list_articles for a mode: 'all', 'favorites' or a feed_id."""
    if mode == "all":
        return list_articles(feeds, articles, **options)
    if mode == "favorites":
        return list_articles(feeds, articles, favorites_only=True, **options)
    return list_articles(feeds, articles, feed_id=int(mode), **options)


def article_rows(listed: DataFrame, *keep: str) -> DataFrame:
    """The columns an article list shows."""
    return listed.select(
        *keep,
        F.when(F.col("is_read"), " ").otherwise(W.UNREAD).alias("unread"),
        F.when(F.col("is_favorite"), W.STAR).otherwise(" ").alias("star"),
        F.coalesce("feed_title", F.lit("")).alias("feed"),
        "title",
        F.coalesce(F.date_format("published", W.DAY), F.lit("")).alias("date"),
    )


def feed_labels(listed_feeds: DataFrame) -> DataFrame:
    """(section, title, feed_id, label): the two fixed entries, then the feeds by title.
    Sort by section, title and feed_id; feed_id is null in the fixed entries."""
    entries = F.array(*[
        F.struct(
            F.lit(section).alias("section"), F.lit("").alias("title"),
            F.lit(None).cast("long").alias("feed_id"), F.lit(label).alias("label"),
        )
        for section, label in enumerate([W.ALL_FEEDS, W.FAVORITES])
    ])
    fixed = listed_feeds.sparkSession.range(0, 1, 1, 1).select(F.inline(entries))
    feeds = listed_feeds.select(
        F.lit(2).alias("section"), "title", "feed_id",
        F.format_string(W.FEED_LABEL, "title", "unread_count").alias("label"),
    )
    return fixed.unionByName(feeds)


def article_details(listed: DataFrame, *keep: str) -> DataFrame:
    """title, meta line and body of each article; empty parts of the line are left out."""
    return listed.select(
        *keep,
        "title",
        F.concat_ws(
            W.META_SEPARATOR,
            blank_to_null(F.col("feed_title")),
            blank_to_null(F.col("author")),
            F.date_format("published", W.MINUTE),
        ).alias("meta"),
        F.coalesce(blank_to_null(F.col("summary")), F.lit(W.NO_CONTENT)).alias("body"),
    )
