"""The keyed stream against the fold of the whole logs and against plain replay."""

import random
from datetime import datetime as D
from datetime import timedelta

import pytest
from pyspark.sql import types as T

from feedskein.operators.articles import first_observations, fold_state
from feedskein.operators.listing import list_feeds
from feedskein.plans import catalogue
from feedskein.plans.refresh import feed_observations
from feedskein.schemas import ACTIONS, OBSERVATIONS
from feedskein.sources.captures import stream_captures
from feedskein.streaming import articles as keyed
from feedskein.streaming.logs import append_actions, append_removals
from feedskein.streaming.native import native

MINUTE = 60_000_000


def event(kind, at, seq, content=0):
    title = f"{content}" if kind == "seen" else None
    return (kind, at * MINUTE, seq, content, title, title, None, None, title)


def replay(events):
    """One event after the other: (live, title, is_read, is_favorite)."""
    rank = {"read": 0, "toggle": 0, "seen": 1, "delete": 2}
    live, title, is_read, is_favorite = False, None, False, False
    for kind, _, _, _, name, *_ in sorted(events, key=lambda e: (e[1], e[2], rank[e[0]], e[3])):
        if kind == "seen" and not live:
            live, title, is_read, is_favorite = True, name, False, False
        elif kind == "delete":
            live, title, is_read, is_favorite = False, None, False, False
        elif live and kind == "read":
            is_read = True
        elif live and kind == "toggle":
            is_favorite = not is_favorite
    return live, title, is_read, is_favorite


@pytest.mark.parametrize("seed", range(60))
def test_any_order_of_arrival_gives_the_replay(seed):
    """Shuffled within the lateness, in batches, with repeats; and what is kept stays bounded."""
    r = random.Random(seed)
    times = 40 if seed % 2 else 12  # many ties
    happened = {event(r.choice(["seen", "seen", "read", "toggle", "delete"]), r.randrange(times), r.randrange(3), r.randrange(3)) for _ in range(60)}
    happened = {e if e[0] == "seen" else (*e[:3], 0, *e[4:]) for e in happened}
    lateness = r.choice([0, 3, 10, 100])
    arriving = sorted(happened, key=lambda e: e[1] // MINUTE + r.uniform(0, lateness))
    state, later, newest, done = keyed.NEW, [], -1, []
    while arriving:
        size = r.randint(1, 8)
        batch, arriving = arriving[:size], arriving[size:]
        # the horizon is what no later event can be before
        newest = max([newest, *[e[1] // MINUTE for e in batch]])
        horizon = min([(newest - lateness) * MINUTE, *[e[1] - 1 for e in arriving]])
        done += batch
        repeated = [e for e in done if e[1] > horizon and r.random() < 0.3]
        state, later = keyed.fold(state, {tuple(e) for e in later} | set(batch) | set(repeated), horizon)
        assert (state.live, state.title, state.is_read, state.is_favorite) == replay(done)
        assert all(e[1] > horizon for e in later) and len(later) == len(set(later)) == state.unsettled


def rss(*items):
    listed = "".join(f"<item><guid isPermaLink='false'>{g}</guid><title>{t}</title></item>" for g, t in items)
    return f"<rss><channel><title>T</title>{listed}</channel></rss>"


@pytest.fixture
def feeds(make):
    return make.feeds(*[(f, f"Feed {f}", f"u{f}") for f in range(1, 5)])


def batches(make, r, day):
    """Captures and actions of about a day, some of them from days before."""
    at = lambda: D(2025, 1, 1) + timedelta(days=day - r.choice([0, 0, 1, 2]), minutes=r.randrange(1000))
    captures = [{"url": f"u{r.randint(1, 5)}", "body": rss(*[(r.choice("abcdef"), f"day {day}") for _ in range(4)]), "fetched_at": at()} for _ in range(4)]
    actions = [(r.randint(1, 4), r.choice("abcdef"), r.choice(["read", "toggle", "delete"]), at(), r.randrange(10**9)) for _ in range(12)]
    return make.captures(*captures, *captures[:1]), make.actions(*actions)


def test_stream_equals_the_fold_after_every_batch(spark, feeds, make, tmp_path):
    """Each round is a new start from the checkpoint."""
    folder, r = str(tmp_path), random.Random(7)
    (tmp_path / "actions").mkdir()
    captures, actions = None, None
    for day in range(3):
        new_captures, new_actions = batches(make, r, 3 + day)
        captures = new_captures if captures is None else captures.unionByName(new_captures)
        actions = new_actions if actions is None else actions.unionByName(new_actions)
        new_captures.coalesce(1).write.mode("append").parquet(f"{folder}/captures")
        append_actions(new_actions.coalesce(2), folder)
        append_actions(new_actions.limit(3), folder)  # delivered twice
        arriving = stream_captures(spark, f"{folder}/captures")
        keyed.start_articles(arriving, feeds, folder, lateness="30 days").awaitTermination()
        state = keyed.current_articles(spark, folder)
        folded = fold_state(feed_observations(feeds, captures).distinct(), actions)
        assert sorted(state.collect()) == sorted(folded.select(*state.columns).collect())
        wanted = {(row.feed_id, row.unread_count) for row in list_feeds(feeds, state).collect()}
        assert {(row.feed_id, row.unread_count) for row in keyed.feed_list(feeds, folder).collect()} == wanted
    append_removals(spark.createDataFrame([(2,)], "feed_id long"), folder)
    assert {row.feed_id for row in keyed.feed_list(feeds, folder).collect()} == {1, 3, 4}
    assert 2 not in {row.feed_id for row in keyed.current_articles(spark, folder).collect()}
    plan = keyed.feed_list(feeds, folder)._jdf.queryExecution().executedPlan().toString()
    assert "/unread" in plan and "statestore" not in plan.lower()


def test_state_holds_only_what_is_not_settled(spark, feeds, make, tmp_path):
    folder = str(tmp_path)
    (tmp_path / "actions").mkdir()

    def run(day, title):
        make.captures({"url": "u1", "body": rss(("a", title)), "fetched_at": D(2025, 1, day)}).coalesce(1).write.mode("append").parquet(f"{folder}/captures")
        append_actions(make.actions((1, "a", "toggle", D(2025, 1, day, 1), day)), folder)
        keyed.start_articles(stream_captures(spark, f"{folder}/captures"), feeds, folder, lateness="1 day").awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "article").load(f"{folder}/state").select("value.*").collect()
        return state[0]

    run(1, "first")
    for day in (5, 9, 13):
        state = run(day, f"of day {day}")
    assert (state.title, state.is_favorite, state.settled) == ("first", False, True)
    assert state.unsettled <= 4  # of 8 events those of the last two days that were seen


def test_a_key_is_one_value_of_state(spark, feeds, make, tmp_path):
    """So that a key costs one read and one update, whatever it holds."""
    folder = str(tmp_path)
    (tmp_path / "actions").mkdir()
    make.captures({"url": "u1", "body": rss(("a", "first")), "fetched_at": D(2025, 1, 1)}).coalesce(1).write.parquet(f"{folder}/captures")
    append_actions(make.actions((1, "a", "toggle", D(2025, 1, 1, 1), 1)), folder)
    keyed.start_articles(stream_captures(spark, f"{folder}/captures"), feeds, folder).awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "article").load(f"{folder}/state").select("value.*").first()
    assert (state.title, state.is_favorite, state.unsettled) == ("first", True, 2)
    assert sorted(e.kind for e in state.later) == ["seen", "toggle"]


def nullable(schema):
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def operator_names(spark, folder):
    return {row.operatorName for row in spark.read.format("state-metadata").load(f"{folder}/state").collect()}


def test_state_is_kept_without_a_python_worker(spark, feeds, make, tmp_path):
    folder = str(tmp_path)
    append_actions(make.actions((1, "a", "toggle", D(2025, 1, 1, 1), 1)), folder)
    make.captures({"url": "u1", "body": rss(("a", "first")), "fetched_at": D(2025, 1, 1)}).write.parquet(f"{folder}/captures")
    keyed.start_articles(stream_captures(spark, f"{folder}/captures"), feeds, folder).awaitTermination()
    assert operator_names(spark, folder) == {"transformWithStateExec"}


def test_executors_get_the_compiled_class_once(spark):
    """Also where the driver knows it already, as from a context before."""
    jars = [native(spark, "Articles") and spark.sparkContext._jsc.sc().listJars().mkString(" ") for _ in range(2)]
    assert jars[0] == jars[1] and jars[0].count("feedskein-Articles") == 1


def test_a_stream_begun_in_python_goes_on_in_python(spark, feeds, make, tmp_path, monkeypatch):
    folder = str(tmp_path)
    (tmp_path / "actions").mkdir()

    def run(day, title):
        make.captures({"url": "u1", "body": rss(("a", title)), "fetched_at": D(2025, 1, day)}).coalesce(1).write.mode("append").parquet(f"{folder}/captures")
        append_actions(make.actions((1, "a", "toggle", D(2025, 1, day, 1), day)), folder)
        keyed.start_articles(stream_captures(spark, f"{folder}/captures"), feeds, folder).awaitTermination()
        return [(row.title, row.is_favorite) for row in keyed.current_articles(spark, folder).collect()]

    with monkeypatch.context() as patched:
        patched.setattr(keyed, "begun_in_python", lambda spark, folder: True)
        assert run(2, "second") == [("second", True)]
    assert operator_names(spark, folder) == {"transformWithStateInPySparkExec"}
    assert run(1, "first") == [("first", False)]


def test_the_state_of_every_batch_is_what_the_fold_gives(spark, tmp_path):
    """Random events of many keys, null ones too, some repeated, in batches of about four days."""
    r, folder, arrived, rounds = random.Random(11), str(tmp_path), [], 4
    for n in range(rounds):
        at = lambda: D(2025, 1, 1) + timedelta(days=4 * n + r.choice([0, 1, 2, 3]), minutes=r.randrange(3))  # noqa: E731,B023
        key = lambda: (r.choice([1, 2, None]), r.choice(["a", "b", "c", "d", None]))
        seen = [(*key(), f"{r.randrange(3)}", "", None, r.choice([None, D(2024, 5, 6, 7)]), "", at(), r.randrange(2)) for _ in range(50)]
        done = [(*key(), r.choice(["read", "toggle", "delete", "other"]), at(), r.randrange(2)) for _ in range(50)]
        observations = spark.createDataFrame(seen + seen[:5], nullable(OBSERVATIONS))
        actions = spark.createDataFrame(done + done[:5], nullable(ACTIONS))
        observations.coalesce(1).write.mode("append").parquet(f"{folder}/seen")
        actions.coalesce(1).write.mode("append").parquet(f"{folder}/actions")
        arrived.append(keyed.events(observations, actions).collect())
    stream = spark.readStream.schema(observations.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/seen")
    changes = keyed.article_changes(stream, keyed.stream_actions(spark, folder, 1), "5 days")
    given = {}

    def take(rows, batch):
        given[batch] = {(row.feed_id, row.guid): row for row in rows.collect()}

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.PROVIDER)
    changes.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    wanted, newest, settled = {}, None, 0
    for n in range(rounds):
        horizon = 0 if newest is None else newest - 5 * 24 * 60 * MINUTE
        by_key = {}
        for row in arrived[n]:
            by_key.setdefault((row.feed_id, row.guid), set()).add(tuple(row)[3:])
        for key, happened in by_key.items():
            before, later = wanted.get(key, (keyed.NEW, []))
            after, later = keyed.fold(before, set(later) | {tuple(e) for e in happened}, horizon)
            wanted[key] = after, later
            changed = any(getattr(after, c) != getattr(before, c) for c in ("live", "is_read", "is_favorite", "born_at", "born_seq"))
            assert (key in given[n]) == changed
            if changed:
                row = given[n][key]
                assert (row.live, row.is_read, row.is_favorite) == (after.live, after.is_read, after.is_favorite)
                assert row.unread_change == keyed.unread(after) - keyed.unread(before)
        newest = max([newest or 0, *[row.micros for row in arrived[n]]])
        state = spark.read.format("statestore").option("stateVarName", "article").option("batchId", n).load(f"{folder}/state")
        held = {tuple(row.key): (row.value[:-1], {tuple(e) for e in row.value.later}) for row in state.collect()}
        assert held == {key: (tuple(after), set(later)) for key, (after, later) in wanted.items()}
        settled += sum(value[keyed.ARTICLE_STATE_NAMES.index("settled")] for value, _ in held.values())
    assert settled


def test_the_feed_list_reads_documents_in_many_tasks_and_no_state(spark, tmp_path, monkeypatch):
    rows = [(n, f"line {n}\nother", "fr" if n == 3 else "en", "src7") for n in range(1, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    folders, plans, append = [], [], catalogue.logs.append_actions

    def appended(actions, folder):
        folders.append(folder)
        plans.append(actions._jdf.queryExecution().executedPlan().toString())
        append(actions, folder)

    monkeypatch.setattr(catalogue.logs, "append_actions", appended)
    listed = catalogue.QUERIES["keyed_feed_list"](spark, str(tmp_path)).collect()
    # the first entry is deleted between its captures, comes again with the later one and is read after
    assert [(row.feed_id, row.unread_count) for row in listed] == [(n, 1) for n in (1, 2, 4, 5, 6)]
    assert all("Coalesce" not in plan for plan in plans) and len(plans) == 2
    assert operator_names(spark, folders[0]) == {"transformWithStateExec"}
