from datetime import datetime as D

import pytest

from feedskein.operators.listing import (
    article_details, article_page, article_rows, feed_labels, list_articles, list_feeds, newest_per_feed, view,
)


@pytest.fixture
def seeded(make):
    feeds = make.feeds((1, "Beta", "u1"), (2, "Alpha", "u2"), (3, "Alpha", "u3"))
    articles = make.articles(
        {"feed_id": 1, "guid": "a", "published": D(2025, 1, 15), "author": "Ann", "summary": "s"},
        {"feed_id": 1, "guid": "b", "published": D(2025, 1, 17, 8, 5), "is_read": True},
        {"feed_id": 1, "guid": "c", "is_favorite": True},
        {"feed_id": 2, "guid": "d", "published": D(2025, 1, 16), "is_read": True, "is_favorite": True, "author": ""},
        {"feed_id": 9, "guid": "lost", "published": D(2025, 1, 30)},
    )
    return feeds, articles


def guids(frame):
    return [r.guid for r in frame.collect()]


def test_feeds_by_title_with_unread_counts(seeded):
    got = [(r.feed_id, r.title, r.unread_count) for r in list_feeds(*seeded).collect()]
    assert got == [(2, "Alpha", 0), (3, "Alpha", 0), (1, "Beta", 2)]


def test_no_feeds(make):
    assert list_feeds(make.feeds(), make.articles()).count() == 0


def test_newest_first_undated_last_and_no_orphans(seeded, joins):
    assert guids(list_articles(*seeded)) == ["b", "d", "a", "c"]


def test_predicates(seeded):
    assert guids(list_articles(*seeded, feed_id=1)) == ["b", "a", "c"]
    assert guids(list_articles(*seeded, unread_only=True)) == ["a", "c"]
    assert guids(list_articles(*seeded, favorites_only=True)) == ["d", "c"]
    assert guids(list_articles(*seeded, feed_id=1, unread_only=True, favorites_only=True)) == ["c"]
    assert guids(list_articles(*seeded, feed_id=9)) == []
    assert guids(list_articles(*seeded, limit=2)) == ["b", "d"]


def test_views(seeded):
    assert guids(view(*seeded)) == ["b", "d", "a", "c"]
    assert guids(view(*seeded, "favorites")) == ["d", "c"]
    assert guids(view(*seeded, 2)) == ["d"]


def test_row_display(seeded):
    rows = {r.guid: tuple(r) for r in article_rows(list_articles(*seeded), "guid").collect()}
    assert rows["a"] == ("a", "●", " ", "Beta", "t", "2025-01-15")
    assert rows["d"] == ("d", " ", "★", "Alpha", "t", "2025-01-16")
    assert rows["c"] == ("c", "●", "★", "Beta", "t", "")


def test_labels(seeded):
    labels = feed_labels(list_feeds(*seeded)).orderBy("section", "title", "feed_id")
    assert [r.label for r in labels.collect()] == ["All Feeds", "★ Favorites", "Alpha (0)", "Alpha (0)", "Beta (2)"]


def test_details(seeded):
    details = {r.guid: (r.meta, r.body) for r in article_details(list_articles(*seeded), "guid").collect()}
    assert details == {
        "a": ("Beta | Ann | 2025-01-15 00:00", "s"),
        "b": ("Beta | 2025-01-17 08:05", "(no content)"),
        "c": ("Beta", "(no content)"),
        "d": ("Alpha | 2025-01-16 00:00", "(no content)"),
    }


def test_list_reads_no_more_than_it_shows(spark, seeded, tmp_path, capsys):
    feeds, articles = seeded
    articles.write.parquet(str(tmp_path / "articles"))
    stored = spark.read.parquet(str(tmp_path / "articles"))
    rows = article_rows(list_articles(feeds, stored, feed_id=1, unread_only=True))
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "summary" not in plan
    assert "EqualTo(feed_id,1)" in plan and "Not(EqualTo(is_read,true))" in plan


@pytest.fixture
def many(make):
    days = [None, 1, 1, 2, 3, 3, 3, 4, 5, None]
    rows = [{"feed_id": f, "guid": f"g{i}", "published": d and D(2025, 1, d), "summary": f"s{i}"} for f in (1, 2, 9) for i, d in enumerate(days)]
    return make.feeds((1, "A", "u"), (2, "B", "v")), make.articles(*rows)


def test_pages_are_the_list_in_pieces(many):
    feeds, articles = many
    whole = [tuple(r) for r in list_articles(feeds, articles).collect()]
    for size in (1, 7, 20, 50):
        bound, pages = None, []
        while True:
            page = article_page(feeds, articles, size, bound).collect()
            pages += [tuple(r) for r in page]
            if len(page) < size:
                break
            bound = page[-1].published, page[-1].feed_id, page[-1].guid
        assert pages == whole
    page = article_page(feeds, articles, 3, (D(2025, 1, 3), 1, "g5"), unread_only=True)
    assert [(r.feed_id, r.guid) for r in page.collect()] == [(1, "g6"), (2, "g4"), (2, "g5")]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_newest_of_each_feed(many, joins):
    feeds, articles = many
    found = newest_per_feed(feeds, articles, 3)
    assert sorted((r.feed_id, r.rank, r.guid, r.feed_title, r.summary) for r in found.collect()) == [
        (f, i + 1, g, t, g.replace("g", "s")) for f, t in ((1, "A"), (2, "B")) for i, g in enumerate(["g8", "g7", "g4"])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "rangepartitioning" not in plan  # before the shuffle and after it
