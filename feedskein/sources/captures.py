"""Captured documents: one row per fetch of a URL, successful or not."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedskein.functions import wording as W
from feedskein.functions.text import blank_to_null
from feedskein.operators.keyfilter import key_bits, possible
from feedskein.operators.skew import fits_broadcast
from feedskein.schemas import CAPTURES
from feedskein.session import estimated_bytes


def read_captures(spark: SparkSession, path: str, format="parquet") -> DataFrame:
    return spark.read.schema(CAPTURES).format(format).load(path)


def stream_captures(spark: SparkSession, path: str, format="parquet", files_per_batch=None) -> DataFrame:
    reader = spark.readStream.schema(CAPTURES).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


SMALL_SHARE = 4 * 1024 * 1024


def spread(rows: DataFrame) -> DataFrame:
    """rows in a partition per core, for work that is dear per row, if they come to less
    than 4 MB per core: so little may lie in fewer file blocks than there are cores, and
    costs next to nothing to shuffle. More is left as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(rows)
    return rows.repartition(cores) if size is not None and size < cores * SMALL_SHARE else rows


def failure() -> Column:
    """Message of a failed fetch, null for a successful one. Redirects have been followed, so
    any status but 2xx is a failure."""
    url = F.col("url")
    return (
        F.when(F.col("error_kind") == "timeout", F.format_string(W.FETCH_TIMEOUT, url))
        .when(~F.col("http_status").between(200, 299), F.format_string(W.FETCH_STATUS, "http_status", url))
        .when(F.col("error_kind").isNotNull(), F.format_string(W.FETCH_FAILED, url, "error_kind"))
    )


def capture_outcomes(captures: DataFrame) -> DataFrame:
    """captures with `error`, the failure message or null."""
    return captures.withColumn("error", failure())


def successes(captures: DataFrame) -> DataFrame:
    return captures.filter(failure().isNull())


WANTED_SLOTS = 1 << 26  # a bitmap of 8 MB, whatever it is made of


def drop_unwanted(captures: DataFrame, wanted: DataFrame) -> DataFrame:
    """captures without those of URLs not in wanted (url), so that the others' bodies leave the
    scan no further: without all of them if wanted can be broadcast, else without most. Then a
    bitmap of the wanted URLs of a fixed size is broadcast, and the captures that it lets through
    by chance (one in twenty for four million URLs) are left to the join that follows."""
    urls = wanted.select("url")
    if fits_broadcast(urls):
        return captures.join(urls, "url", "left_semi")
    return possible(captures, F.broadcast(key_bits(urls, WANTED_SLOTS, ["url"])), WANTED_SLOTS, ["url"])


def latest_captures(captures: DataFrame, *keys: str) -> DataFrame:
    """The last capture of each URL, or of each value of keys.

    max_by is aggregated before the shuffle, so a URL that was fetched very often sends
    one body per input task.
    """
    keys = keys or ("url",)
    rest = [c for c in captures.columns if c not in keys]
    order = F.struct("fetched_at", F.xxhash64(*rest))
    return (
        captures.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("last"))
        .select(*keys, *[F.col(f"last.`{c}`").alias(c) for c in rest])
    )


def page_captures(sites: DataFrame, captures: DataFrame) -> DataFrame:
    """(site_url, html) for each site_url; html is null if the page was not had."""
    named = sites.select("site_url").distinct()
    last = latest_captures(drop_unwanted(captures, named.withColumnRenamed("site_url", "url")))
    pages = successes(last).select(F.col("url").alias("site_url"), F.col("body").alias("html"))
    return named.join(pages, "site_url", "left").select(
        "site_url", blank_to_null(F.col("html")).alias("html")
    )
