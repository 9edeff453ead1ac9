"""Subscribing to sites: resolve each, check what was found, say what happens."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedskein.functions import wording as W
from feedskein.operators.discovery import resolve
from feedskein.operators.skew import spread_join
from feedskein.session import written


def no_capture(url: Column) -> Column:
    return F.format_string(W.FETCH_FAILED, url, F.lit(W.NOT_CAPTURED))


def subscriptions(sites: DataFrame, digest: DataFrame, feeds: DataFrame, pick=None) -> DataFrame:
    """(site_url, outcome, status, feed_url, title, link, message) for each site.

    status: added, exists, error, choose (several feeds; the choice is the caller's, or
    pick='first' takes the first) or not_found. Of several sites that lead to the same
    new feed, the first by site_url adds it. A feed is parsed before it is added.
    """
    resolved = resolve(sites, digest)
    takes = ["direct", "single"] + (["multiple"] if pick == "first" else [])
    chosen = resolved.withColumn("_taken", F.col("outcome").isin(takes)).withColumn(
        "feed_url", F.when(F.col("_taken"), F.col("feed_url"))
    )
    # narrow rows, written since the adders derive from them too; those without a feed to take
    # stay out of the joins, where they would be one key
    chosen = written(chosen.select("site_url", "outcome", "feed_url", "found", "_taken"), "resolved")
    without = chosen.filter(F.col("feed_url").isNull())
    chosen = chosen.filter(F.col("feed_url").isNotNull())
    targets = digest.select(
        F.col("url").alias("feed_url"), "error", F.col("title").alias("_title"), "link", F.lit(True).alias("_captured")
    )
    known = feeds.select(F.col("url").alias("feed_url"), F.lit(True).alias("_known"))
    checked = spread_join(chosen, targets, "feed_url", "left", spread=["site_url"])
    checked = spread_join(checked, known, "feed_url", "left", spread=["site_url"])
    url = F.col("feed_url")
    checked = checked.withColumn(
        "error", F.when(F.col("_captured").isNull(), no_capture(url)).otherwise(F.col("error"))
    ).withColumn("_known", F.coalesce("_known", F.lit(False)))
    addable = F.col("_taken") & ~F.col("_known") & F.col("error").isNull()
    first = checked.filter(addable).groupBy("feed_url").agg(F.min("site_url").alias("_adder"))
    judged = spread_join(checked, first, "feed_url", "left", spread=["site_url"]).unionByName(without, allowMissingColumns=True)
    status = (
        F.when(F.col("outcome") == "none", "not_found")
        .when(~F.col("_taken"), "choose")
        .when(F.col("_known"), "exists")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("_adder") != F.col("site_url"), "exists")
        .otherwise("added")
    )
    judged = judged.withColumn("status", status)
    added = F.col("status") == "added"
    message = (
        F.when(added, F.col("_title"))
        .when(F.col("status") == "exists", F.format_string(W.SUBSCRIBED, url))
        .when(F.col("status") == "error", F.format_string(W.ERROR, "error"))
        .when(F.col("status") == "choose", F.format_string(W.SEVERAL_FOUND, "found"))
        .otherwise(F.format_string(W.NOTHING_FOUND, "site_url"))
    )
    return judged.select(
        "site_url", "outcome", "status", "feed_url",
        F.when(added, F.col("_title")).alias("title"),
        F.when(added, F.col("link")).alias("link"),
        message.alias("message"),
    )


def subscribed_feeds(outcomes: DataFrame) -> DataFrame:
    """Rows (title, url, link) to append to feeds; sources.tables.append_feeds numbers them."""
    return outcomes.filter(F.col("status") == "added").select("title", F.col("feed_url").alias("url"), "link")
