"""The feeds table: adding, looking up, removing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.functions.text import strip
from feedskein.operators.skew import spread_join


def judge_requests(feeds: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (title, url, link, seq) with `reject_reason`, null for those to add.

    A URL can be subscribed once; of several requests for one, the lowest seq wins. seq
    must be unique. The winners are found on narrow columns, with partial aggregation.
    """
    valid = F.col("title").isNotNull() & F.col("url").isNotNull()
    first = requests.filter(valid).groupBy("url").agg(F.min("seq").alias("seq"))
    known = feeds.select("url", F.lit(True).alias("_known"))
    # url and seq together spread a URL that very many ask for
    winners = (
        first.join(known, "url", "left")
        .select("url", "seq", F.coalesce("_known", F.lit(False)).alias("_known"))
    )
    judged = requests.join(winners, ["url", "seq"], "left")
    return judged.select(
        "title", "url", F.coalesce("link", F.lit("")).alias("link"), "seq",
        F.when(F.col("title").isNull(), "title is null")
        .when(F.col("url").isNull(), "url is null")
        .when(F.col("_known").isNull() | F.col("_known"), "url exists")
        .alias("reject_reason"),
    )


def feeds_to_add(feeds: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows (title, url, link) to append to feeds, still without feed_id."""
    accepted = judge_requests(feeds, requests).filter(F.col("reject_reason").isNull())
    return accepted.select("title", "url", "link")


def urls_exist(feeds: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, subscribed) for each distinct url of urls."""
    known = feeds.select("url", F.lit(True).alias("_known"))
    return urls.select("url").distinct().join(known, "url", "left").select(
        "url", F.coalesce("_known", F.lit(False)).alias("subscribed")
    )


def find_feeds(feeds: DataFrame, selectors: DataFrame) -> DataFrame:
    """(selector, feed_id) for each distinct selector: title first, then id, else null.

    Several feeds may share a title; the lowest id counts, taken per title before the
    join. A number may have blanks around it and a sign, but no underscores.
    """
    wanted = selectors.select("selector").distinct()
    by_title = feeds.groupBy(F.col("title").alias("selector")).agg(F.min("feed_id").alias("_by_title"))
    # only numbers take part in the join on ids: a null key would gather all others in one task
    numbers = wanted.select("selector", strip(F.col("selector")).try_cast("long").alias("_id")).filter(F.col("_id").isNotNull())
    by_id = numbers.join(feeds.select(F.col("feed_id").alias("_id")), "_id").select("selector", F.col("_id").alias("_by_id"))
    found = wanted.join(by_title, "selector", "left").join(by_id, "selector", "left")
    return found.select("selector", F.coalesce("_by_title", "_by_id").alias("feed_id"))


def lookup_feeds(feeds: DataFrame, selectors: DataFrame) -> DataFrame:
    """Each distinct selector with the feed it means, if any."""
    return find_feeds(feeds, selectors).join(feeds, "feed_id", "left").select("selector", *feeds.columns)


def remove_feeds(feeds: DataFrame, articles: DataFrame, selectors=None, feed_ids=None):
    """(feeds left, articles left, outcome). The articles of a feed go with it.

    selectors (selector) name feeds by title or id, all judged against feeds as given;
    the outcome says per selector whether a feed was removed. feed_ids (feed_id) name
    feeds without the ambiguity of titles.
    """
    gone = None
    outcome = None
    if selectors is not None:
        found = find_feeds(feeds, selectors)
        outcome = found.select("selector", "feed_id", F.col("feed_id").isNotNull().alias("removed"))
        gone = found.filter(F.col("feed_id").isNotNull()).select("feed_id")
    if feed_ids is not None:
        ids = feed_ids.select("feed_id")
        gone = ids if gone is None else gone.unionByName(ids)
    if gone is None:
        raise ValueError("name the feeds to remove by selectors or feed_ids")
    gone = gone.distinct()
    return (
        feeds.join(gone, "feed_id", "left_anti"),
        spread_join(articles, gone, "feed_id", "left_anti", spread=["guid"]),
        outcome,
    )
