"""Joins that stay spread when one key holds a large part of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.session import estimated_bytes

SALTS = 16


def fits_broadcast(frame: DataFrame) -> bool:
    """Whether Spark's own size estimate lets it broadcast frame. Where there is none, no."""
    size = estimated_bytes(frame)
    if size is None:
        return False
    limit = frame.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return size <= limit


def spread_join(rows: DataFrame, lookup: DataFrame, on, how="inner", spread=None, salts=SALTS) -> DataFrame:
    """rows joined to a narrow lookup with few rows per key, on the columns `on`.

    A lookup within the broadcast limit is left to Spark to broadcast: rows stay where
    they are. Otherwise a key of rows is split over `salts` tasks by the columns `spread`
    (its other columns by default), and lookup is repeated once per salt. The salt is
    part of the join key, so an aggregation by `on` afterwards shuffles anew, with partial
    aggregation first, and adaptive execution is free to split a heavy task further.
    """
    on = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(lookup):
        return rows.join(lookup, on, how)
    spread = spread or [c for c in rows.columns if c not in on]
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(repeated, [*on, "_salt"], how).drop("_salt")
