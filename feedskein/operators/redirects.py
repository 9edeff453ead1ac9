"""Following redirects through captured fetches.

A crawler that follows redirects itself leaves the document under the first address, with the
address it ended at in final_url. One that doesn't leaves a row per hop: a redirect status and,
in final_url, where it points. follow_redirects turns both into captures as a client that
follows would have made them, so that parsing, discovery and refreshing need know nothing of it.

Where chains end is found by pointer jumping on narrow rows: each round joins what has been
reached with what is reached from there, so a chain of n hops takes log2(n) rounds, and a
cycle, whose length doubles with every round, soon passes the limit. Bodies meet only the
redirects that end at them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedskein.functions import wording as W
from feedskein.functions.text import blank_to_null
from feedskein.operators.skew import spread_join
from feedskein.session import written
from feedskein.sources.captures import failure, latest_captures

# Statuses that name another address.
REDIRECTS = [301, 302, 303, 307, 308]
MOST = 20


def is_redirect() -> Column:
    points = blank_to_null(F.col("final_url")).isNotNull()
    return F.coalesce(F.col("http_status").isin(REDIRECTS), F.lit(False)) & points & F.col("error_kind").isNull()


def redirect_routes(captures: DataFrame, most=MOST) -> DataFrame:
    """(url, last, hops): where each redirecting URL ends by the last captures, and after how
    many hops; of chains longer than `most`, cycles included, only that hops is greater."""
    narrow = captures.select("url", "final_url", "http_status", "error_kind", "fetched_at")
    routes = latest_captures(narrow).filter(is_redirect()).select("url", F.col("final_url").alias("last"), F.lit(1).cast("long").alias("hops"))
    routes = written(routes, "routes")
    reach = 1
    while reach <= most:
        onward = routes.select(F.col("url").alias("last"), F.col("last").alias("_next"), F.col("hops").alias("_more"))
        routes = written(spread_join(routes, onward, "last", "left", spread=["url"]).select(
            "url", F.coalesce("_next", "last").alias("last"),
            (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), F.col("_next").isNotNull().alias("_moved"),
        ), "routes")
        moved = routes.filter("_moved").limit(1).count()
        routes = routes.select("url", "last", "hops")
        reach = reach * 2 if moved else most + 1
    return routes


def follow_redirects(captures: DataFrame, most=MOST) -> DataFrame:
    """captures in which every redirect has the status, error and body of the document that it
    leads to, by the document's last capture, and that document's address as final_url. An
    address at which a redirecting fetch ended, and which nobody fetched by itself, has a row
    of its own. A redirect to what nobody captured is a failed fetch, as is one of more than
    `most` hops or a cycle. Other rows stay as they are.
    """
    columns = captures.columns
    routes = redirect_routes(captures, most)
    onward = routes.select(F.col("url").alias("final_url"), F.col("last").alias("_last"), F.col("hops").alias("_hops"))
    sent = captures.filter(is_redirect()).drop("http_status", "error_kind", "body")
    sent = spread_join(sent, onward, "final_url", "left", spread=["url", "fetched_at"]).withColumns({
        "_last": F.coalesce("_last", "final_url"), "_hops": 1 + F.coalesce("_hops", F.lit(0))})
    # chains that are too long lead nowhere, and a null key would be one
    endless = sent.filter(F.col("_hops") > most).withColumns({
        "http_status": F.lit(None).cast("int"), "error_kind": F.lit(W.TOO_MANY_REDIRECTS), "body": F.lit(None).cast("string")})
    sent = sent.filter(F.col("_hops") <= most)

    there = captures.filter(~is_redirect())
    elsewhere = there.filter(failure().isNull() & blank_to_null(F.col("final_url")).isNotNull() & (F.col("final_url") != F.col("url")))
    fetched = captures.select("url").distinct()
    found = elsewhere.withColumn("url", F.col("final_url"))
    found = latest_captures(found.join(fetched, "url", "left_anti").select(*columns))

    ends = sent.select(F.col("_last").alias("url")).distinct()
    own = latest_captures(there.join(ends, "url", "left_semi").select(*columns))
    documents = own.unionByName(found).select(
        F.col("url").alias("_last"), "http_status", "error_kind", "body", F.lit(True).alias("_captured"))
    led = sent.join(documents, "_last", "left").withColumn(
        "error_kind", F.when(F.col("_captured").isNull(), W.NOT_CAPTURED).otherwise(F.col("error_kind")))
    led = led.withColumn("final_url", F.col("_last")).select(*columns)
    return there.unionByName(led).unionByName(endless.select(*columns)).unionByName(found)
