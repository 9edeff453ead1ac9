"""Append-only logs of Parquet rows that streams and others write."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedskein.operators.skew import spread_join
from feedskein.schemas import ACTIONS
from feedskein.sources.tables import empty_table

REMOVALS = T.StructType([T.StructField("feed_id", T.LongType())])


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows below path; none if nothing has been written there."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_table(spark, schema)


def append_actions(actions: DataFrame, folder: str) -> None:
    actions.select(*ACTIONS.names).write.mode("append").parquet(f"{folder}/actions")


def append_removals(feed_ids: DataFrame, folder: str) -> None:
    """Feeds (feed_id) that were removed: their articles go with them."""
    feed_ids.select(F.col("feed_id").cast("long")).write.mode("append").parquet(f"{folder}/removals")


def without_removed(spark: SparkSession, folder: str, rows: DataFrame, spread=("guid",)) -> DataFrame:
    """rows without those of removed feeds. Ids of feeds are not given out twice, so all of
    them are from before the removal."""
    removed = read_log(spark, f"{folder}/removals", REMOVALS).distinct()
    return spread_join(rows, removed, "feed_id", "left_anti", spread=list(spread))
