"""Article state from segments of the logs, each folded once.

The logs are cut by time of arrival into segments, days say. What a segment does to an article,
whatever came before, is one small row:

  cut            it deletes the article
  seen           after its last delete it sees the article, `born` being when first
  read, toggled  what its marks after the last delete do to an article that was there already
  read_after, toggled_after  what those after `born` do to an article that the segment makes

Two segments that follow each other are combined into the row of both, associatively, so a
snapshot is the row of all segments up to it and a new one costs the new log rows alone. State
comes out of a snapshot and any cut of the tail into segments alike. A hot article is folded
with partial aggregation inside a segment, and has one row per segment afterwards.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.functions.text import arrival
from feedskein.operators.skew import spread_join
from feedskein.schemas import ARTICLE_CONTENT, ARTICLE_KEY

EFFECT = ["cut", "seen", "born", "read", "toggled", "read_after", "toggled_after"]


def _marks(rows: DataFrame, read: str, toggled: str) -> DataFrame:
    return rows.groupBy(*ARTICLE_KEY).agg(
        F.max(F.col("action") == "read").alias(read), (F.count_if(F.col("action") == "toggle") % 2 == 1).alias(toggled))


def segment_effects(observations: DataFrame, actions: DataFrame, segment: int) -> DataFrame:
    """(feed_id, guid, segment, the effect): one row for each article that the observations and
    actions of one segment name. Reads no content."""
    done = actions.select(*ARTICLE_KEY, "action", arrival(F.col("at"), F.col("seq")).alias("_at"))
    deletes = done.filter(F.col("action") == "delete").groupBy(*ARTICLE_KEY).agg(F.max("_at").alias("_cut"))
    seen = observations.select(*ARTICLE_KEY, arrival(F.col("fetched_at"), F.col("pos")).alias("_at"))
    later = F.col("_cut").isNull() | (F.col("_at") > F.col("_cut"))
    born = spread_join(seen, deletes, ARTICLE_KEY, "left", spread=["_at"]).filter(later).groupBy(*ARTICLE_KEY).agg(F.min("_at").alias("born"))
    marks = spread_join(done.filter(F.col("action") != "delete"), deletes, ARTICLE_KEY, "left", spread=["_at"]).filter(later).drop("_cut")
    after = spread_join(marks, born, ARTICLE_KEY, "inner", spread=["_at"]).filter(F.col("_at") > F.col("born"))
    named = observations.select(*ARTICLE_KEY).unionByName(actions.select(*ARTICLE_KEY)).distinct()
    joined = named
    for part in (deletes, born, _marks(marks, "read", "toggled"), _marks(after, "read_after", "toggled_after")):
        joined = joined.join(part, ARTICLE_KEY, "left")
    flag = {c: F.coalesce(c, F.lit(False)).alias(c) for c in ("read", "toggled", "read_after", "toggled_after")}
    return joined.select(
        *ARTICLE_KEY, F.lit(segment).cast("long").alias("segment"), F.col("_cut").isNotNull().alias("cut"), F.col("born").isNotNull().alias("seen"),
        "born", *flag.values())


def _then(a, b):
    """The effect of segment b after segment a."""
    made = a["seen"]
    followed = {
        "cut": a["cut"], "seen": made | b["seen"], "born": F.coalesce(a["born"], b["born"]),
        "read": a["read"] | b["read"], "toggled": a["toggled"] != b["toggled"],
        "read_after": F.when(made, a["read_after"] | b["read"]).otherwise(b["read_after"]),
        "toggled_after": F.when(made, a["toggled_after"] != b["toggled"]).otherwise(b["toggled_after"]),
    }
    # a delete in b leaves nothing of a
    return F.struct(*[F.when(b["cut"], b[c]).otherwise(followed[c]).alias(c) for c in EFFECT])


def combined(effects: DataFrame) -> DataFrame:
    """The effects of several segments as those of one, which has the number of the last. An
    article has at most one row per segment, so that is what a group holds."""
    nothing = F.struct(*[
        (F.lit(None).cast(effects.schema["born"].dataType) if c == "born" else F.lit(False)).alias(c) for c in EFFECT])
    ordered = F.array_sort(F.collect_list(F.struct("segment", *EFFECT)))
    return effects.groupBy(*ARTICLE_KEY).agg(F.max("segment").alias("segment"), ordered.alias("_all")).select(
        *ARTICLE_KEY, "segment", F.aggregate("_all", nothing, _then).alias("_one")).select(
        *ARTICLE_KEY, "segment", *[F.col(f"_one.{c}").alias(c) for c in EFFECT])


def articles_of(effects: DataFrame, observations: DataFrame) -> DataFrame:
    """The articles that the combined effects of all segments leave, with the content of the
    observation that made each, of several that arrived as one by a hash."""
    live = effects.filter("seen").select(
        *ARTICLE_KEY, "born", F.col("read_after").alias("is_read"), F.col("toggled_after").alias("is_favorite"))
    brought = observations.select(*ARTICLE_KEY, arrival(F.col("fetched_at"), F.col("pos")).alias("born"), *ARTICLE_CONTENT)
    rest = [*ARTICLE_CONTENT, "is_read", "is_favorite"]
    one = brought.join(live, [*ARTICLE_KEY, "born"]).groupBy(*ARTICLE_KEY, "born").agg(
        F.min_by(F.struct(*rest), F.xxhash64(*ARTICLE_CONTENT)).alias("one"))
    return one.select(*ARTICLE_KEY, *[F.col(f"one.{c}").alias(c) for c in rest])
