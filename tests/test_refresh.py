from datetime import datetime as D

import pytest

from feedskein.operators.articles import first_observations, new_articles
from feedskein.plans import catalogue
from feedskein.plans.refresh import (
    feed_observations, feed_report, new_rows, refresh_rows, refresh_summary, selected_feeds, updated_feeds,
)
from feedskein.sources.captures import stream_captures
from feedskein.streaming.logs import append_actions, append_removals
from feedskein.streaming.refresh import ingest_batch, start_refresh, stored_articles, stored_sightings


def rss(title, *guids):
    items = "".join(f"<item><guid isPermaLink='false'>{g}</guid><title>{title} {g}</title></item>" for g in guids)
    return f"<rss><channel><title>{title}</title><link>l</link>{items}</channel></rss>"


@pytest.fixture
def feeds(make):
    return make.feeds((1, "One", "u1"), (2, "Two", "u2"), (3, "Three", "u3"), (4, "Four", "u4"), (5, "Five", "u5"))


@pytest.fixture
def captures(make):
    return make.captures(
        ("u1", rss("New", "a", "b", "a")), ("u2", "<html>"), {"url": "u3", "error_kind": "timeout"}, ("u4", rss("Empty")),
        ("other", rss("Other", "x")),
    )


def test_refresh(feeds, captures, make, joins):
    live = make.articles({"feed_id": 1, "guid": "b"}, {"feed_id": 2, "guid": "a"})
    rows = refresh_rows(feeds, captures, live)
    assert [(r.feed_id, r.guid, r.title, r.pos) for r in new_rows(rows).collect()] == [(1, "a", "New a", 0)]
    report = feed_report(rows)
    assert {r.feed_id: (r.new_articles, r.error) for r in report.collect()} == {
        1: (1, None), 2: (0, "Malformed feed content from u2"), 3: (0, "Timeout fetching u3"), 4: (0, None),
        5: (0, "Network error fetching u5: not captured"),
    }
    narrow = feed_report(refresh_rows(feeds, captures, live, content=False))
    assert sorted(narrow.collect()) == sorted(report.collect())
    total = refresh_summary(report).first()
    assert (total.feeds, total.new_articles, total.failed_feeds) == (5, 1, 3)
    assert total.message == "Fetched 1 new article(s) (3 feed(s) failed)"


def test_summary_without_failures_and_without_feeds(feeds, captures, make):
    good = refresh_rows(feeds.filter("feed_id = 1"), captures, make.articles())
    assert refresh_summary(feed_report(good)).first().message == "Fetched 2 new article(s)"
    none = refresh_rows(feeds.filter("feed_id < 0"), captures, make.articles())
    assert refresh_summary(feed_report(none)).first().message == "No feeds subscribed. Press 'a' to add one."


def test_last_capture_counts(make):
    feeds = make.feeds((1, "One", "u"))
    captures = make.captures(
        {"url": "u", "body": rss("Old", "a"), "fetched_at": D(2025, 1, 1)},
        {"url": "u", "body": rss("New", "b"), "fetched_at": D(2025, 1, 2)},
    )
    assert [r.guid for r in new_rows(refresh_rows(feeds, captures, make.articles())).collect()] == ["b"]
    assert {r.guid for r in feed_observations(feeds, captures).collect()} == {"a", "b"}


def test_one_feed(spark, feeds, captures, make):
    selectors = spark.createDataFrame([("One",), (" 3 ",), ("nobody",)], "selector string")
    chosen = selected_feeds(feeds, selectors)
    report = feed_report(refresh_rows(chosen, captures, make.articles()))
    assert {r.feed_id: r.new_articles for r in report.collect()} == {1: 2, 3: 0}


def test_feed_info_follows_only_on_request(feeds, captures):
    got = {r.feed_id: (r.title, r.link) for r in updated_feeds(feeds, captures).collect()}
    assert got == {1: ("New", "l"), 2: ("Two", ""), 3: ("Three", ""), 4: ("Empty", "l"), 5: ("Five", "")}


def test_stream_equals_batch(spark, feeds, make, tmp_path):
    folder = str(tmp_path)
    captures = make.captures(
        {"url": "u1", "body": rss("First", "a", "b"), "fetched_at": D(2025, 1, 1)},
        {"url": "u1", "body": rss("Later", "b", "c"), "fetched_at": D(2025, 1, 2)},
        {"url": "u2", "body": rss("Two", "a", "a"), "fetched_at": D(2025, 1, 1)},
        {"url": "u3", "body": "<html>", "fetched_at": D(2025, 1, 1)},
    )
    for day in (1, 2):  # a file per fetch
        captures.filter(f"day(fetched_at) = {day}").coalesce(1).write.mode("append").parquet(f"{folder}/captures")
    arriving = stream_captures(spark, f"{folder}/captures", files_per_batch=1)
    start_refresh(arriving, lambda: feeds, folder).awaitTermination()
    batch = new_articles(first_observations(feed_observations(feeds, captures)))
    streamed = stored_articles(spark, folder)
    assert sorted(streamed.collect()) == sorted(batch.collect())
    assert streamed.count() == 4


def test_repeated_batch_changes_nothing(spark, feeds, make, tmp_path):
    folder = str(tmp_path)
    first, second = make.captures(("u1", rss("A", "a"))), make.captures(("u1", rss("B", "a", "b")))
    ingest_batch(feeds, folder, first, 0)
    for _ in range(2):
        ingest_batch(feeds, folder, second, 1)
    assert sorted(r.title for r in stored_articles(spark, folder).collect()) == ["A a", "B b"]
    assert stored_sightings(spark, folder).count() == 3


def test_deleted_article_returns_through_the_stream(spark, feeds, make, tmp_path):
    folder = str(tmp_path)
    day = lambda n: D(2025, 1, n)
    ingest_batch(feeds, folder, make.captures({"url": "u1", "body": rss("Old", "a"), "fetched_at": day(1)}), 0)
    append_actions(make.actions((1, "a", "read", day(2), 0), (1, "a", "delete", day(2), 1)), folder)
    assert stored_articles(spark, folder).count() == 0
    ingest_batch(feeds, folder, make.captures({"url": "u1", "body": rss("New", "a"), "fetched_at": day(3)}), 1)
    assert [(r.title, r.is_read) for r in stored_articles(spark, folder).collect()] == [("New a", False)]
    assert stored_articles(spark, folder, tombstones=True).count() == 0


def test_late_delete_finds_what_came_after_it(spark, feeds, make, tmp_path):
    folder = str(tmp_path)
    day = lambda n: D(2025, 1, n)
    ingest_batch(feeds, folder, make.captures({"url": "u1", "body": rss("Old", "a"), "fetched_at": day(1)}), 0)
    ingest_batch(feeds, folder, make.captures({"url": "u1", "body": rss("New", "a"), "fetched_at": day(3)}), 1)
    append_actions(make.actions((1, "a", "delete", day(2), 0)), folder)
    assert [r.title for r in stored_articles(spark, folder).collect()] == ["New a"]


def test_removed_feed_takes_its_stored_articles_along(spark, feeds, make, tmp_path):
    folder = str(tmp_path)
    ingest_batch(feeds, folder, make.captures(("u1", rss("A", "a")), ("u2", rss("B", "x"))), 0)
    append_removals(spark.createDataFrame([(2,)], "feed_id long"), folder)
    assert [r.title for r in stored_articles(spark, folder).collect()] == ["A a"]


def test_ingest_reads_nothing_stored(spark, feeds, make, tmp_path):
    folder = str(tmp_path)
    ingest_batch(feeds, folder, make.captures(("u1", rss("A", "a"))), 0)
    (tmp_path / "sightings" / "batch=0" / "broken.parquet").write_bytes(b"no parquet")
    (tmp_path / "contents" / "batch=0" / "broken.parquet").write_bytes(b"no parquet")
    ingest_batch(feeds, folder, make.captures(("u1", rss("B", "b"))), 1)
    assert spark.read.parquet(f"{folder}/sightings/batch=1").count() == 1


def test_delete_between_two_captures_of_one_batch(spark, feeds, make, tmp_path):
    folder = str(tmp_path)
    at = lambda n, title: {"url": "u1", "body": rss(title, "a"), "fetched_at": D(2025, 1, n)}
    ingest_batch(feeds, folder, make.captures(at(1, "Old")), 0)
    append_actions(make.actions((1, "a", "delete", D(2025, 1, 3), 0)), folder)
    ingest_batch(feeds, folder, make.captures(at(2, "Before"), at(4, "After"), at(5, "Later")), 1)
    assert [r.title for r in stored_articles(spark, folder).collect()] == ["After a"]


def test_capture_delivered_twice(spark, feeds, make, tmp_path):
    folder = str(tmp_path)
    capture = make.captures(("u1", rss("A", "a", "b")))
    ingest_batch(feeds, folder, capture.unionByName(capture), 0)
    ingest_batch(feeds, folder, capture, 1)
    assert stored_sightings(spark, folder).distinct().count() == 4  # two articles in two batches
    assert stored_articles(spark, folder).count() == 2


def test_batch_writes_its_contents_once(spark, feeds, make, tmp_path):
    """No second copy of what is wide, and a content seen twice is there once, with both times."""
    folder = str(tmp_path)
    at = lambda n, *guids: {"url": "u1", "body": rss("T", *guids), "fetched_at": D(2025, 1, n)}
    ingest_batch(feeds, folder, make.captures(at(1, "a"), at(2, "a", "b"), at(2, "a", "b")), 0)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["contents", "sightings"]
    contents = spark.read.parquet(f"{folder}/contents/batch=0")
    assert sorted((r.guid, len(r.seen)) for r in contents.collect()) == [("a", 2), ("b", 1)]
    assert spark.read.parquet(f"{folder}/sightings/batch=0").count() == 3
    assert sorted(r.guid for r in stored_articles(spark, folder).collect()) == ["a", "b"]


def test_captures_lie_in_files_of_bounded_size(spark, make, tmp_path, monkeypatch):
    """As many as the documents need, for a stream in two micro-batches; four at least."""
    spark.range(200).selectExpr("id as doc_id", "sha2(cast(id as string), 512) as text").write.parquet(f"{tmp_path}/documents.parquet")
    captures = make.captures(*[(f"u{i}", "x") for i in range(200)])
    for number, (most, least_files) in enumerate([(1000, 10), (1 << 30, 4)]):
        monkeypatch.setattr(catalogue, "FILE_BYTES", most)
        half = catalogue._write_captures(spark, str(tmp_path), captures, f"{tmp_path}/{number}")
        files = spark.read.parquet(f"{tmp_path}/{number}/captures").inputFiles()
        assert least_files <= len(files) <= 2 * half
    assert half == 2
