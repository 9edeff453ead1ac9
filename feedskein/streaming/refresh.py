"""Refreshing as captures arrive.

Layout below a folder that all executors share:
  sightings/batch=<n>/   which articles micro-batch n saw, and the hash of what they held
  contents/batch=<n>/    what they held, each distinct content of an article once per batch, and when
  actions/               appended by others
  removals/              feeds that were removed, appended by others
  checkpoint/            the stream's own progress

A micro-batch appends all it saw and reads nothing of what is stored: which sightings make an
article live depends on actions that may be stored later than their time would have it, so
only the fold can tell. A repeated batch overwrites its own folders. The fold runs on the
narrow sightings and fetches the contents of what is live at the end.

These logs keep the whole history. Where only the present is wanted, streaming.articles keeps
it as state.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedskein.operators.articles import fold_state
from feedskein.plans.refresh import feed_observations
from feedskein.schemas import ACTIONS, ARTICLE_CONTENT, ARTICLE_KEY, OBSERVATIONS
from feedskein.streaming.logs import read_log, without_removed

_KEY = [f for f in OBSERVATIONS if f.name in ARTICLE_KEY]
_BATCH = T.StructField("batch", T.LongType())
_HASH = T.StructField("content", T.LongType())
SIGHTINGS = T.StructType([*_KEY, OBSERVATIONS["fetched_at"], OBSERVATIONS["pos"], _HASH, _BATCH])
_SEEN = T.StructField("seen", T.ArrayType(T.StructType([OBSERVATIONS["fetched_at"], OBSERVATIONS["pos"]])))
CONTENTS = T.StructType([*_KEY, *[OBSERVATIONS[c] for c in ARTICLE_CONTENT], _HASH, _BATCH])


def stored_sightings(spark: SparkSession, folder: str) -> DataFrame:
    """(feed_id, guid, fetched_at, pos, content, batch) of all feeds that are not removed."""
    return without_removed(spark, folder, read_log(spark, f"{folder}/sightings", SIGHTINGS))


def stored_actions(spark: SparkSession, folder: str) -> DataFrame:
    return read_log(spark, f"{folder}/actions", ACTIONS)


def stored_articles(spark: SparkSession, folder: str, tombstones=False) -> DataFrame:
    """The articles that the logs leave. Of sightings that arrived as one, that of the first
    batch counts."""
    state = fold_state(stored_sightings(spark, folder), stored_actions(spark, folder), tombstones, carry=["batch", "content"])
    contents = read_log(spark, f"{folder}/contents", CONTENTS)
    return state.join(contents, [*ARTICLE_KEY, "batch", "content"]).select(
        *ARTICLE_KEY, *ARTICLE_CONTENT, "is_read", "is_favorite")


def ingest_batch(feeds: DataFrame, folder: str, captures: DataFrame, batch: int) -> None:
    """Append what one batch of captures saw. A capture that is delivered twice counts once."""
    spark = captures.sparkSession
    seen = feed_observations(feeds, captures).withColumn("content", F.xxhash64(*ARTICLE_CONTENT))
    # when a content was seen lies beside it, so that what is wide is shuffled and written once
    contents = seen.groupBy(*ARTICLE_KEY, *ARTICLE_CONTENT, "content").agg(
        F.collect_set(F.struct("fetched_at", "pos")).alias("seen"))
    contents.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/contents/batch={batch}")
    stored = spark.read.schema(T.StructType([*_KEY, _HASH, _SEEN])).parquet(f"{folder}/contents/batch={batch}")
    sightings = stored.select(*ARTICLE_KEY, F.explode("seen").alias("at"), "content").select(
        *ARTICLE_KEY, "at.fetched_at", "at.pos", "content")
    sightings.write.mode("overwrite").parquet(f"{folder}/sightings/batch={batch}")


def start_refresh(captures: DataFrame, feeds, folder: str, trigger=None):
    """Start the stream over streaming captures. feeds is the feeds table, or a function
    that gives it, called per micro-batch so that new subscriptions count at once; trigger
    is as for writeStream.trigger."""
    def ingest(rows, batch):
        ingest_batch(feeds() if callable(feeds) else feeds, folder, rows, batch)

    return (
        captures.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
