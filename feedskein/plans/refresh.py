"""Refreshing feeds from captures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.functions import wording as W
from feedskein.operators.articles import first_observations
from feedskein.operators.documents import entries, feed_info, parse_feeds
from feedskein.operators.feeds import find_feeds
from feedskein.operators.skew import spread_join
from feedskein.plans.subscribe import no_capture
from feedskein.schemas import ARTICLE_CONTENT, ARTICLE_KEY
from feedskein.sources.captures import drop_unwanted, latest_captures, successes

CAPTURE = ["url", "http_status", "error_kind", "body", "fetched_at"]


def feed_observations(feeds: DataFrame, captures: DataFrame) -> DataFrame:
    """Every entry of every good capture of every feed, as observations. Failed fetches and
    documents nobody subscribed to are dropped before parsing."""
    fetched = successes(captures.select(*CAPTURE))
    wanted = spread_join(fetched, feeds.select("feed_id", "url"), "url", spread=["fetched_at"])
    good = parse_feeds(wanted).filter(F.col("error").isNull())
    return entries(good, "feed_id", "fetched_at").select(
        *ARTICLE_KEY, *ARTICLE_CONTENT, "fetched_at", "pos"
    )


def fetch_and_parse(wanted: DataFrame, captures: DataFrame) -> DataFrame:
    """wanted (url, one row each) with what parse_feeds makes of the last capture of each
    URL; feed is null where error is not. A URL without a capture is an error.

    Captures of other URLs stay out of the shuffle where possible. Both sides of the join
    have one row per URL, and the captures are already partitioned by it, so their bodies
    are shuffled once.
    """
    own = drop_unwanted(captures.select(*CAPTURE), wanted)
    last = latest_captures(own).withColumn("_captured", F.lit(True))
    parsed = parse_feeds(wanted.join(last, "url", "left"))
    error = F.when(F.col("_captured").isNull(), no_capture(F.col("url"))).otherwise(F.col("error"))
    return (
        parsed.withColumn("error", error)
        .withColumn("feed", F.when(F.col("error").isNull(), F.col("feed")))
        .drop("_captured")
    )


def refresh_rows(feeds: DataFrame, captures: DataFrame, live: DataFrame, content=True) -> DataFrame:
    """One row per distinct entry in the last capture of each feed, and one with null guid
    per feed that has none or failed: feed_id, error, the article columns, is_new.

    The new articles and the report both derive from these rows; write them if you need
    both. For the report alone do without content, so that only keys are shuffled. The
    join with the live articles reuses the partitioning of the deduplication.
    """
    parsed = fetch_and_parse(feeds.select("feed_id", "url"), captures)
    rows = entries(parsed, "feed_id", "error", "fetched_at", outer=True)
    if content:
        rows = first_observations(rows)
    else:
        rows = rows.select(*ARTICLE_KEY, "error").distinct()
    known = live.select(*ARTICLE_KEY, F.lit(True).alias("_live"))
    return rows.join(known, ARTICLE_KEY, "left").select(
        *rows.columns, (F.col("guid").isNotNull() & F.col("_live").isNull()).alias("is_new")
    )


def new_rows(rows: DataFrame) -> DataFrame:
    """The observations among refresh_rows that make new articles."""
    return rows.filter(F.col("is_new")).select(*ARTICLE_KEY, *ARTICLE_CONTENT, "fetched_at", "pos")


def feed_report(rows: DataFrame) -> DataFrame:
    """(feed_id, new_articles, error) per feed."""
    return rows.groupBy("feed_id").agg(
        F.count_if("is_new").alias("new_articles"), F.max("error").alias("error")
    )


def refresh_summary(report: DataFrame) -> DataFrame:
    """One row: feeds, new_articles, failed_feeds, message."""
    total = report.agg(
        F.count(F.lit(1)).alias("feeds"),
        F.coalesce(F.sum("new_articles"), F.lit(0)).alias("new_articles"),
        F.count("error").alias("failed_feeds"),
    )
    failed = F.when(
        F.col("failed_feeds") > 0, F.format_string(W.FETCHES_FAILED, "failed_feeds")
    ).otherwise("")
    message = F.when(
        F.col("feeds") == 0, W.NO_FEEDS
    ).otherwise(F.concat(F.format_string(W.FETCHED, "new_articles"), failed))
    return total.withColumn("message", message)


def selected_feeds(feeds: DataFrame, selectors: DataFrame) -> DataFrame:
    """The feeds that the selectors (titles or ids) mean, to refresh those alone."""
    return feeds.join(find_feeds(feeds, selectors).select("feed_id"), "feed_id", "left_semi")


def updated_feeds(feeds: DataFrame, captures: DataFrame) -> DataFrame:
    """feeds with title and link from their last good capture. A refresh leaves both as
    they were when subscribing; this is for callers who want them to follow."""
    wanted = feeds.select("feed_id", "url", F.col("title").alias("_title"), F.col("link").alias("_link"))
    parsed = fetch_and_parse(wanted, captures)
    good = F.col("error").isNull()
    return feed_info(parsed).select(
        "feed_id",
        F.when(good, F.col("title")).otherwise(F.col("_title")).alias("title"),
        "url",
        F.when(good, F.col("link")).otherwise(F.col("_link")).alias("link"),
    )
