"""The feeds and articles tables: creating, upgrading, writing, appending, removing, numbering.

A table is a folder of plain Parquet, written by Spark's own modes:

  rows/bucket=<b>/   the rows, dealt by a hash of feed_id
  ids/               a row per change of the table: how many buckets it has, and the highest
                     id given out so far

Appending adds files. Removing rewrites the buckets that hold the feeds concerned by dynamic
partition overwrite and leaves all others alone; the same hash lets a read of one feed open
one bucket. One writer at a time changes a table.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedskein.operators.skew import spread_join
from feedskein.schemas import ARTICLE_KEY, ARTICLES, FEEDS
from feedskein.session import written

# Values for columns that older data lacks.
DEFAULTS = {"link": "", "title": "", "summary": "", "is_read": False, "is_favorite": False}
BUCKETS = 64  # of a new table; a bucket should be a few files
IDS = T.StructType([T.StructField("buckets", T.IntegerType()), T.StructField("top", T.LongType())])
KEYS = {"feed_id": ["url"], "id": ARTICLE_KEY}


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, and known to the optimizer as such: joins with it cost nothing."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def _read(spark: SparkSession, path: str, schema: T.StructType):
    """The files below path, None if there is no such folder."""
    try:
        return spark.read.schema(_all_null(schema)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _rows(spark: SparkSession, path: str, schema: T.StructType):
    return _read(spark, f"{path}/rows", T.StructType([*schema, T.StructField("bucket", T.IntegerType())]))


def _ids(spark: SparkSession, path: str):
    """(buckets, highest id given out) of a table; None if it is not there."""
    ids = _read(spark, f"{path}/ids", IDS)
    found = ids.agg(F.max("buckets"), F.max("top")).first() if ids is not None else (None, None)
    return None if found[0] is None else (found[0], found[1])


def _note(spark: SparkSession, path: str, buckets: int, top: int) -> None:
    noted = spark.range(0, 1, 1, 1).select(F.lit(buckets).alias("buckets"), F.lit(top).cast("long").alias("top"))
    noted.write.mode("append").parquet(f"{path}/ids")


def bucket_of(feed_id, buckets: int):
    return F.pmod(F.xxhash64(feed_id), F.lit(buckets)).cast("int")


def create_if_missing(spark: SparkSession, path: str, buckets=BUCKETS) -> None:
    if _ids(spark, path) is None:
        _note(spark, path, buckets, 0)


def create_tables(spark: SparkSession, folder: str, buckets=BUCKETS) -> None:
    create_if_missing(spark, f"{folder}/feeds", buckets)
    create_if_missing(spark, f"{folder}/articles", buckets)


def read_table(spark: SparkSession, path: str, schema: T.StructType, feed_id=None) -> DataFrame:
    """The rows, or those of one feed; an empty table if there is none."""
    rows, ids = _rows(spark, path, schema), _ids(spark, path)
    if rows is None or ids is None:
        return empty_table(spark, schema)
    if feed_id is not None:
        rows = rows.filter((F.col("bucket") == bucket_of(F.lit(feed_id).cast("long"), ids[0])) & (F.col("feed_id") == feed_id))
    return upgrade(rows.filter(F.col("feed_id").isNotNull()).drop("bucket"), schema)


def _save(rows: DataFrame, path: str, buckets: int, sort_key, mode, **options) -> None:
    """rows below path by bucket. Each task writes to the few buckets that its range of feeds
    falls in; rows of one feed lie together, so a filter on it skips the rest of a file."""
    dealt = rows.withColumn("bucket", bucket_of(F.col("feed_id"), buckets) if "bucket" not in rows.columns else F.col("bucket"))
    if sort_key:
        dealt = dealt.repartitionByRange("bucket", *sort_key).sortWithinPartitions("bucket", *sort_key)
    dealt.write.mode(mode).options(**options).partitionBy("bucket").parquet(f"{path}/rows")


def write_table(table: DataFrame, path: str, sort_key=None, id_column=None) -> None:
    """Make these rows the table. They must not come from it: what is there goes at once."""
    spark = table.sparkSession
    buckets, top = _ids(spark, path) or (BUCKETS, 0)
    _save(table, path, buckets, sort_key, "overwrite", partitionOverwriteMode="static")
    if id_column:
        highest = spark.read.parquet(f"{path}/rows").agg(F.max(id_column)).first()[0]  # one number
        top = max(top, highest or 0)
    _note(spark, path, buckets, top)


def append_rows(rows: DataFrame, path: str, id_column=None, keys=None, sort_key=None) -> None:
    """Add rows to the table; what is there is not touched.

    With id_column, rows get new ids, unique and higher than all that were ever given out, also
    to rows since removed; keys must tell the rows apart. The ids are noted before the rows are
    written, so an append that fails in between leaves a gap and no id is given out twice.
    """
    spark = rows.sparkSession
    buckets, top = _ids(spark, path) or (BUCKETS, 0)
    if id_column:
        counts = written(place_counts(rows, keys), "counts")  # of both the ids to note and the numbers
        _note(spark, path, buckets, top + (counts.agg(F.sum("_n")).first()[0] or 0))
        rows = number_rows(rows, id_column, keys, after=top, counts=counts)
    else:
        _note(spark, path, buckets, top)
    _save(rows, path, buckets, sort_key, "append")


def remove_rows(spark: SparkSession, path: str, schema: T.StructType, feed_ids: DataFrame, sort_key=None) -> None:
    """Remove the rows of feeds (feed_id). Of the buckets that they can be in, feed_id alone is
    read; those that do hold some are read and written whole. The numbers of both, at most as
    many as there are buckets, are all that the driver learns. A bucket keeps one row without
    feed, which no read returns, so that one that lost all its rows is overwritten too.

    Every step asks for the feeds, so they are found once, and written.
    """
    _remove(spark, path, schema, _gone(feed_ids), sort_key)


def _gone(feed_ids: DataFrame) -> DataFrame:
    return written(feed_ids.select(F.col("feed_id").cast("long")).distinct(), "gone")


def _remove(spark, path, schema, gone, sort_key):
    ids, rows = _ids(spark, path), _rows(spark, path, schema)
    if ids is None or rows is None:
        return
    possible = [r[0] for r in gone.select(bucket_of(F.col("feed_id"), ids[0])).distinct().collect()]
    held = rows.filter(F.col("bucket").isin(possible)).select("bucket", "feed_id").distinct()
    touched = [r[0] for r in held.join(gone, "feed_id", "left_semi").select("bucket").distinct().collect()]
    _rewrite(rows, path, schema, ids[0], touched, gone, sort_key)


def merge_files(spark: SparkSession, path: str, schema: T.StructType, sort_key=None) -> None:
    """Rewrite every bucket, after many small appends."""
    ids, rows = _ids(spark, path), _rows(spark, path, schema)
    if ids is not None and rows is not None:
        _rewrite(rows, path, schema, ids[0], list(range(ids[0])), None, sort_key)


def _rewrite(rows, path, schema, buckets, touched, gone, sort_key):
    if not touched:
        return
    held = rows.filter(F.col("bucket").isin(touched))
    left = held.filter(F.col("feed_id").isNotNull())
    if gone is not None:
        left = spread_join(left, gone, "feed_id", "left_anti")
    there = held.select("bucket").distinct()
    kept = there.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema], "bucket")
    _save(left.select(*schema.names, "bucket").unionByName(kept), path, buckets, sort_key, "overwrite", partitionOverwriteMode="dynamic")


def remove_stored_feeds(spark: SparkSession, folder: str, feed_ids: DataFrame) -> None:
    """Remove feeds (feed_id) from the tables of folder, and their articles with them. The
    articles go first: if it fails in between, doing it again removes the rest."""
    gone = _gone(feed_ids)
    _remove(spark, f"{folder}/articles", ARTICLES, gone, ARTICLE_KEY)
    _remove(spark, f"{folder}/feeds", FEEDS, gone, ["feed_id"])


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, FEEDS)


def read_articles(spark: SparkSession, path: str, feed_id=None) -> DataFrame:
    return read_table(spark, path, ARTICLES, feed_id)


def write_feeds(feeds: DataFrame, path: str) -> None:
    write_table(feeds, path, ["feed_id"], "feed_id")


def append_feeds(feeds: DataFrame, path: str) -> None:
    """Add feeds (title, url, link), which get their feed_id here."""
    append_rows(feeds.select("title", "url", "link"), path, "feed_id", KEYS["feed_id"])


def write_articles(articles: DataFrame, path: str) -> None:
    """Range-partitioned by bucket and key: a large feed takes several files."""
    write_table(articles, path, ARTICLE_KEY, "id")


def append_articles(articles: DataFrame, path: str) -> None:
    """Add new articles, which get their id here."""
    append_rows(articles.drop("id"), path, "id", KEYS["id"], ARTICLE_KEY)


def save_bucketed(articles: DataFrame, name: str, buckets: int, path=None) -> None:
    """articles as a catalog table bucketed by their key. Joins on the key with as many
    shuffle partitions as buckets then leave the table where it is: insert-if-new shuffles
    the new observations alone."""
    writer = articles.write.format("parquet").mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, *ARTICLE_KEY).sortBy(*ARTICLE_KEY).saveAsTable(name)


def _all_null(schema):
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def upgrade(table: DataFrame, schema: T.StructType) -> DataFrame:
    """table with the columns of schema: missing or null ones take their default.

    Columns that the file scan was asked for and did not find come as null, so this
    covers old files both alone and mixed with new ones.
    """
    columns = []
    for field in schema:
        value = F.col(field.name) if field.name in table.columns else F.lit(None)
        if not field.nullable and field.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[field.name]))
        columns.append(value.cast(field.dataType).alias(field.name))
    return table.select(*columns)


def _placed(rows: DataFrame, keys, partitions: int) -> DataFrame:
    return rows.withColumn("_place", F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int"))


def place_counts(rows: DataFrame, keys, partitions=None) -> DataFrame:
    """(_place, _n): how many of rows each partition of number_rows gets; one row per partition."""
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _placed(rows.select(*keys), keys, partitions).groupBy("_place").agg(F.count(F.lit(1)).alias("_n"))


def number_rows(rows: DataFrame, id_column: str, keys, after=0, partitions=None, counts=None) -> DataFrame:
    """rows with consecutive numbers from after + 1 up, without sorting them in one task.

    `after` is the highest number ever given out, so numbers of deleted rows do not come
    back. keys must be unique. A row's partition follows from its keys, and it is numbered
    by its place there plus the row counts of the partitions before. Only those counts,
    one per partition, meet in one task. Place and order depend on the keys alone, so
    partitions that are computed again after an executor is lost get the same numbers.
    Who has the place_counts of rows already, for as many partitions, spares a pass by giving them.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _placed(rows, keys, partitions)
    before = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    starts = (place_counts(rows, keys, partitions) if counts is None else counts).select(
        "_place", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row_bits = (1 << 33) - 1  # the lower bits of monotonically_increasing_id
    numbered = (
        placed.repartitionById(partitions, "_place")
        .sortWithinPartitions(*keys)
        .withColumn("_index", F.monotonically_increasing_id().bitwiseAND(F.lit(row_bits)))
    )
    number = (F.lit(after + 1) + F.col("_start") + F.col("_index")).alias(id_column)
    # starts has one row per partition, so it is small whatever the data
    return numbered.join(F.broadcast(starts), "_place").select(number, *rows.columns)
