"""The articles: insert if new, and their state as a fold over two append-only logs.

observations: what each fetch saw, in arrival order (fetched_at, pos).
actions: read, toggle (the favourite mark) and delete, in arrival order (at, seq).
Both orders are one order of arrival.

An article is (feed_id, guid). What is first seen stays: later versions are ignored. A
deleted article returns, new and unread, when it is seen again, unless tombstones are on.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.functions.text import arrival
from feedskein.operators.skew import spread_join
from feedskein.schemas import ARTICLE_CONTENT, ARTICLE_KEY


def check_constraints(observations: DataFrame, feeds: DataFrame) -> DataFrame:
    """observations with `reject_reason`: a null where none may be, or no such feed."""
    required = ["feed_id", "guid", "title", "link", "summary"]
    known = feeds.select("feed_id", F.lit(True).alias("_known"))
    # salted on what an observation is, so that one huge feed takes many tasks
    judged = spread_join(
        observations, known, "feed_id", "left", spread=["guid", "fetched_at", "pos"]
    )
    reason = F.coalesce(
        *[F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in required],
        F.when(F.col("_known").isNull(), F.lit("no such feed")),
    )
    return judged.select(*observations.columns, reason.alias("reject_reason"))


def split_rejects(judged: DataFrame):
    """(accepted without the reason, rejected with it)."""
    accepted = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, judged.filter(F.col("reject_reason").isNotNull())


def first_observations(observations: DataFrame) -> DataFrame:
    """The first observation of each article, whole. Partial aggregation comes before the
    shuffle, so an article seen very often sends one row per input task. Of several that
    arrived as one, a hash decides, so that recomputed tasks agree."""
    rest = [c for c in observations.columns if c not in ARTICLE_KEY]
    order = F.struct("fetched_at", "pos", F.xxhash64(*rest))
    return (
        observations.groupBy(*ARTICLE_KEY)
        .agg(F.min_by(F.struct(*rest), order).alias("first"))
        .select(*ARTICLE_KEY, *[F.col(f"first.`{c}`").alias(c) for c in rest])
    )


def new_observations(observations: DataFrame, live: DataFrame) -> DataFrame:
    """First observations of the articles that are not live. The join reuses the
    partitioning of the aggregation, and both sides have one row per article."""
    return first_observations(observations).join(live.select(*ARTICLE_KEY), ARTICLE_KEY, "left_anti")


def new_articles(observations: DataFrame) -> DataFrame:
    """Observations as articles nobody has touched."""
    return observations.select(
        *ARTICLE_KEY, *ARTICLE_CONTENT,
        F.lit(False).alias("is_read"), F.lit(False).alias("is_favorite"),
    )


def live_keys(observations: DataFrame, actions: DataFrame, tombstones=False, carry=()) -> DataFrame:
    """(feed_id, guid, born): each live article and the arrival that made it one, which is
    its first observation after its last delete. Reads no content columns but the narrow ones
    named in `carry`, which come along and decide between observations that arrived as one."""
    deletes = (
        actions.filter(F.col("action") == "delete")
        .groupBy(*ARTICLE_KEY).agg(F.max(arrival(F.col("at"), F.col("seq"))).alias("_cut"))
    )
    seen = observations.select(*ARTICLE_KEY, arrival(F.col("fetched_at"), F.col("pos")).alias("_at"), *carry)

    def first(rows):
        least = F.min(F.struct("_at", *carry) if carry else F.col("_at")).alias("_first")
        born = F.col("_first._at") if carry else F.col("_first")
        return rows.groupBy(*ARTICLE_KEY).agg(least).select(
            *ARTICLE_KEY, born.alias("born"), *[F.col(f"_first.{c}").alias(c) for c in carry])

    if tombstones:
        # a delete of an article not yet seen does nothing, so only later ones bury it
        return (
            first(seen).join(deletes, ARTICLE_KEY, "left")
            .filter(F.col("_cut").isNull() | (F.col("_cut") < F.col("born")))
            .select(*ARTICLE_KEY, "born", *carry)
        )
    after = spread_join(seen, deletes, ARTICLE_KEY, "left", spread=["_at"])
    return first(after.filter(F.col("_cut").isNull() | (F.col("_at") > F.col("_cut"))))


def fold_state(observations: DataFrame, actions: DataFrame, tombstones=False, content=ARTICLE_CONTENT, carry=()) -> DataFrame:
    """The articles that replaying both logs in arrival order would leave; `content` names the
    columns that an observation brings. Of several that arrived as one, a hash of their content
    decides. Where what an observation brings is narrow, name it in `carry` instead: it comes
    along with the keys, is not fetched, and decides itself.

    No replay is needed: the last delete of an article cuts off all before it, the first
    observation after that gives the content, and of the actions after that observation
    any read marks it read and an odd number of toggles makes it a favourite.

    All of this runs on keys and arrival numbers. The content is fetched at the end by
    key and arrival, so it is shuffled once and an article seen very often is spread.
    """
    born = live_keys(observations, actions, tombstones, carry)
    marks = actions.filter(F.col("action").isin("read", "toggle")).select(
        *ARTICLE_KEY, arrival(F.col("at"), F.col("seq")).alias("_at"), "action"
    )
    # the spread join repeats its lookup, so of all that is live it gets what has marks
    marked = born.select(*ARTICLE_KEY, "born").join(marks.select(*ARTICLE_KEY).distinct(), ARTICLE_KEY, "left_semi")
    counted = (
        spread_join(marks, marked, ARTICLE_KEY, "inner", spread=["_at"])
        .filter(F.col("_at") > F.col("born"))
        .groupBy(*ARTICLE_KEY)
        .agg(
            F.max(F.col("action") == "read").alias("_read"),
            (F.count_if(F.col("action") == "toggle") % 2 == 1).alias("_favorite"),
        )
    )
    state = born.join(counted, ARTICLE_KEY, "left").select(
        *ARTICLE_KEY, "born", *carry,
        F.coalesce("_read", F.lit(False)).alias("is_read"),
        F.coalesce("_favorite", F.lit(False)).alias("is_favorite"),
    )
    if carry:
        return state.drop("born")
    brought = observations.select(
        *ARTICLE_KEY, arrival(F.col("fetched_at"), F.col("pos")).alias("born"), *content
    )
    rest = [*content, "is_read", "is_favorite"]
    # two observations may share an arrival; the join has partitioned by it already
    one = brought.join(state, [*ARTICLE_KEY, "born"]).groupBy(*ARTICLE_KEY, "born").agg(
        F.min_by(F.struct(*rest), F.xxhash64(*content)).alias("one")
    )
    return one.select(*ARTICLE_KEY, *[F.col(f"one.{c}").alias(c) for c in rest])


def apply_actions(articles: DataFrame, actions: DataFrame) -> DataFrame:
    """articles after actions that all come later than the articles did. Actions on
    articles that are not there do nothing."""
    done = actions.groupBy(*ARTICLE_KEY).agg(
        F.max(F.col("action") == "delete").alias("_deleted"),
        F.max(F.col("action") == "read").alias("_read"),
        (F.count_if(F.col("action") == "toggle") % 2 == 1).alias("_toggled"),
    )
    joined = articles.join(done, ARTICLE_KEY, "left")
    return joined.filter(~F.coalesce("_deleted", F.lit(False))).select(*[
        (F.col(c) | F.coalesce("_read", F.lit(False))).alias(c) if c == "is_read"
        else (F.col(c) != F.coalesce("_toggled", F.lit(False))).alias(c) if c == "is_favorite"
        else F.col(c)
        for c in articles.columns
    ])


ACTIONS_KNOWN = ("read", "toggle", "delete")


def actions_on(articles: DataFrame, ids: DataFrame, action: str, at) -> DataFrame:
    """Rows for the actions log: one action at one time on the articles whose ids (id) are
    given. Ids of no article give no row."""
    if action not in ACTIONS_KNOWN:
        raise ValueError(f"action must be one of {', '.join(ACTIONS_KNOWN)}")
    keys = articles.select("id", *ARTICLE_KEY)
    return keys.join(ids.select("id").distinct(), "id", "left_semi").select(
        *ARTICLE_KEY, F.lit(action).alias("action"),
        F.lit(at).cast("timestamp").alias("at"), F.col("id").alias("seq"),
    )
