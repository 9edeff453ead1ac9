"""Articles as keyed state over the streams of captures and actions.

Everything that happens to an article, sightings and actions alike, is an event of its key
(feed_id, guid), and a stateful processor keeps per key what replaying all of them in order of
arrival would leave. Events may come in any order, and repeatedly, as long as none is later
than `lateness` behind the newest; later ones are dropped. So per key the state `article` holds

  the article as it stands, the last delete, and the marks on it that are settled: no event
  before them can come any more
  later: sightings and marks after the last delete that are not settled, for a delete may
  still come in between and make a later sighting the first one

which is one row with at most the events of one `lateness`. Articles are read from the state
itself, at the cost of what is live, whatever the length of the history. Each micro-batch adds
up how many unread articles each feed has won or lost, so the feed list reads no articles.

Articles.java keeps the state, in Spark's own process; `fold` says here what it does, and does it
for streams that the Python operator has begun.

Layout below a folder that all executors share:
  actions/           appended by others
  removals/          feeds that were removed, appended by others
  unread/batch=<n>/  (feed_id, change) of micro-batch n; a repeated batch overwrites its own
  state/             the stream's checkpoint with the state
"""

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from feedskein.plans.refresh import feed_observations
from feedskein.schemas import ACTIONS, ARTICLE_CONTENT, ARTICLE_KEY
from feedskein.streaming.logs import read_log, without_removed
from feedskein.streaming.native import native

LATENESS = "7 days"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONTENT = "title string, link string, author string, published timestamp_ntz, summary string"
ARTICLE_STATE = (
    f"live boolean, {_CONTENT}, is_read boolean, is_favorite boolean, born_at long, born_seq long, cut_at long, cut_seq long, "
    "settled boolean, settled_read boolean, settled_favorite boolean, unsettled int"
)
EVENT_STATE = f"kind string, micros long, seq long, content long, {_CONTENT}"
STORED = f"{ARTICLE_STATE}, later array<struct<{EVENT_STATE}>>"
CHANGES = "feed_id long, guid string, live boolean, is_read boolean, is_favorite boolean, unread_change int"
UNREAD = "feed_id long, change long, batch long"


def events(observations: DataFrame, actions: DataFrame) -> DataFrame:
    """Both as events (feed_id, guid, at, kind, micros, seq, content, the content columns).
    `content` decides between sightings that arrived as one, as in the batch fold."""
    seen = observations.select(
        *ARTICLE_KEY, F.col("fetched_at").alias("at"), F.lit("seen").alias("kind"), F.unix_micros("fetched_at").alias("micros"),
        F.col("pos").alias("seq"), F.xxhash64(*ARTICLE_CONTENT).alias("content"), *ARTICLE_CONTENT)
    nothing = [F.lit(None).cast(seen.schema[c].dataType).alias(c) for c in ARTICLE_CONTENT]
    done = actions.select(
        *ARTICLE_KEY, "at", F.col("action").alias("kind"), F.unix_micros("at").alias("micros"), "seq", F.lit(0).cast("long").alias("content"), *nothing)
    return seen.unionByName(done).select(*ARTICLE_KEY, "at", *EVENT_NAMES)


class Articles(StatefulProcessor):
    """Applies the new events of a key and gives its change, if there is one. Articles.java does the
    same without a Python worker; this is for streams begun with it and clients without a JVM."""

    def init(self, handle) -> None:
        self.article = handle.getValueState("article", STORED)

    def handleInputRows(self, key, rows, timerValues):
        # one value holds all of a key: each call of the state costs more than the events do
        stored = self.article.get()
        before, known = (NEW, set()) if stored is None else (_Article(*stored[:-1]), {tuple(e) for e in stored[-1]})
        # events are told apart by all they hold, so one that is delivered twice counts once
        known |= {tuple(r)[_EVENT] for r in rows}
        after, later = fold(before, known, timerValues.getCurrentWatermarkInMs() * 1000)
        self.article.update((*after, later))
        change = unread(after) - unread(before)
        if change or any(getattr(after, c) != getattr(before, c) for c in ("live", "is_read", "is_favorite", "born_at", "born_seq")):
            yield Row(feed_id=key[0], guid=key[1], live=after.live, is_read=after.is_read, is_favorite=after.is_favorite, unread_change=change)

    def close(self) -> None:
        pass


def _names(schema):
    return [field.split()[0] for field in schema.split(", ")]


ARTICLE_STATE_NAMES, EVENT_NAMES = _names(ARTICLE_STATE), _names(EVENT_STATE)
_EVENT = slice(len(ARTICLE_KEY) + 1, None)  # of a row of events()
_Article, _Event = Row(*ARTICLE_STATE_NAMES), Row(*EVENT_NAMES)
NEW = _Article(False, None, None, None, None, None, False, False, None, None, None, None, False, False, False, 0)


def unread(article) -> int:
    return int(article.live and not article.is_read)


def fold(before, known, horizon):
    """(article, unsettled events) after the state `before` and a set of events. Up to `horizon`,
    in microseconds, all events are there. What is settled is older than all that is not, so a
    settled sighting after the last delete is the first one."""
    happened = [_Event(*e) for e in known]
    at = lambda e: (e.micros, e.seq)
    nowhere = (-(2**63), 0)
    cut = max([at(e) for e in happened if e.kind == "delete"] + [(before.cut_at, before.cut_seq) if before.cut_at is not None else nowhere])
    left = [e for e in happened if e.kind != "delete" and at(e) > cut]
    settled = before.settled and (before.born_at, before.born_seq) > cut
    first = min((e for e in left if e.kind == "seen"), key=lambda e: (*at(e), e.content), default=None)
    if settled and (first is None or at(first) >= (before.born_at, before.born_seq)):
        born, content = (before.born_at, before.born_seq), [getattr(before, c) for c in ARTICLE_CONTENT]
        is_read, is_favorite = before.settled_read, before.settled_favorite
    elif first is not None:
        born, content = at(first), [getattr(first, c) for c in ARTICLE_CONTENT]
        is_read = is_favorite = False
    else:
        born = None
    later = [e for e in left if e.micros > horizon]
    cut = (None, None) if cut == nowhere else cut
    if born is None:
        return _Article(False, *[None] * 5, False, False, None, None, *cut, False, False, False, len(later)), [tuple(e) for e in later]
    settled = born[0] <= horizon
    settled_read = settled_favorite = False
    for mark in left:
        if mark.kind != "seen" and at(mark) > born:
            reads, toggles = mark.kind == "read", mark.kind == "toggle"
            is_read, is_favorite = is_read or reads, is_favorite != toggles
    if settled:
        # what the marks that are not settled have done, taken back
        early = [e for e in left if e.kind != "seen" and at(e) > born and e.micros <= horizon]
        base = (before.settled_read, before.settled_favorite) if before.settled and born == (before.born_at, before.born_seq) else (False, False)
        settled_read = base[0] or any(e.kind == "read" for e in early)
        settled_favorite = base[1] != (sum(e.kind == "toggle" for e in early) % 2 == 1)
    article = _Article(True, *content, is_read, is_favorite, *born, *cut, settled, settled_read, settled_favorite, len(later))
    return article, [tuple(e) for e in later]


def stream_actions(spark: SparkSession, folder: str, files_per_batch=None) -> DataFrame:
    reader = spark.readStream.schema(ACTIONS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/actions")


def article_changes(observations: DataFrame, actions: DataFrame, lateness=LATENESS, in_python=False) -> DataFrame:
    """The stream of changes (feed_id, guid, live, is_read, is_favorite, unread_change)."""
    happened = events(observations, actions).withWatermark("at", lateness)
    if in_python:
        return happened.groupBy(*ARTICLE_KEY).transformWithState(Articles(), CHANGES, "Update", "EventTime")
    spark = happened.sparkSession
    schemas = [spark._jvm.org.apache.spark.sql.types.StructType.fromDDL(s) for s in (STORED, CHANGES)]
    return DataFrame(native(spark, "Articles").changes(happened._jdf, *schemas), spark)


def begun_in_python(spark: SparkSession, folder: str) -> bool:
    """Whether the stream's checkpoint is one of the Python operator: Spark goes on with none but its own."""
    operators = spark.read.format("state-metadata").load(f"{folder}/state").select("operatorName")
    return any("PySpark" in row.operatorName for row in operators.collect())


def start_articles(captures: DataFrame, feeds: DataFrame, folder: str, trigger=None, lateness=LATENESS, files_per_batch=None):
    """Start the stream over streaming captures and the actions below folder, which must be
    there. `feeds` is the feeds table. The state is dealt over as many partitions as
    spark.sql.shuffle.partitions says when it is first started; executors that are lost take
    nothing along, since the state lies in the shared folder."""
    spark = captures.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    seen = feed_observations(feeds, captures)
    in_python = not hasattr(spark, "_jsparkSession") or begun_in_python(spark, folder)
    changes = article_changes(seen, stream_actions(spark, folder, files_per_batch), lateness, in_python)

    def count(rows, batch):
        won = rows.groupBy("feed_id").agg(F.sum("unread_change").cast("long").alias("change")).filter(F.col("change") != 0)
        won.write.mode("overwrite").parquet(f"{folder}/unread/batch={batch}")

    return (
        changes.writeStream.outputMode("update").foreachBatch(count)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def current_articles(spark: SparkSession, folder: str, batch=None) -> DataFrame:
    """The articles of all feeds that are not removed, after the last micro-batch or after `batch`."""
    reader = spark.read.format("statestore").option("stateVarName", "article")
    if batch is not None:
        reader = reader.option("batchId", batch)
    state = reader.load(f"{folder}/state")
    articles = state.filter("value.live").select(
        "key.*", *[F.col(f"value.{c}").alias(c) for c in [*ARTICLE_CONTENT, "is_read", "is_favorite"]])
    return without_removed(spark, folder, articles)


def unread_counts(spark: SparkSession, folder: str, batch=None) -> DataFrame:
    """(feed_id, unread_count): the changes of all micro-batches added up."""
    changes = read_log(spark, f"{folder}/unread", UNREAD)
    if batch is not None:
        changes = changes.filter(F.col("batch") <= batch)
    return changes.groupBy("feed_id").agg(F.sum("change").alias("unread_count"))


def feed_list(feeds: DataFrame, folder: str, batch=None, ordered=True) -> DataFrame:
    """Each feed that is not removed with its number of unread articles, by title, as
    listing.list_feeds gives it, without reading articles."""
    spark = feeds.sparkSession
    left = without_removed(spark, folder, feeds, ["feed_id"])
    listed = left.join(unread_counts(spark, folder, batch), "feed_id", "left").select(
        *feeds.columns, F.coalesce("unread_count", F.lit(0)).alias("unread_count"))
    return listed.orderBy("title", "feed_id") if ordered else listed
