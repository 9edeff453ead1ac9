"""Table schemas. `published` is UTC wall-clock time without a zone."""

from pyspark.sql import types as T

CAPTURES = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("final_url", T.StringType()),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("error_kind", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
])

FEEDS = T.StructType([
    T.StructField("feed_id", T.LongType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("link", T.StringType(), False),
])

OBSERVATIONS = T.StructType([
    T.StructField("feed_id", T.LongType()),
    T.StructField("guid", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("published", T.TimestampNTZType()),
    T.StructField("summary", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("pos", T.LongType()),
])

# action is one of: read, toggle, delete
ACTIONS = T.StructType([
    T.StructField("feed_id", T.LongType(), False),
    T.StructField("guid", T.StringType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("at", T.TimestampType(), False),
    T.StructField("seq", T.LongType(), False),
])

ARTICLES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("feed_id", T.LongType(), False),
    T.StructField("guid", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("link", T.StringType(), False),
    T.StructField("author", T.StringType()),
    T.StructField("published", T.TimestampNTZType()),
    T.StructField("summary", T.StringType(), False),
    T.StructField("is_read", T.BooleanType(), False),
    T.StructField("is_favorite", T.BooleanType(), False),
])

PAGES = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("html", T.StringType()),
])

# What an observation brings to its article, in article column order.
ARTICLE_CONTENT = ["title", "link", "author", "published", "summary"]
ARTICLE_KEY = ["feed_id", "guid"]
