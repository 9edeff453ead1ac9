import pytest

from feedskein.operators.feeds import (
    feeds_to_add, find_feeds, judge_requests, lookup_feeds, remove_feeds, urls_exist,
)
from feedskein.schemas import FEEDS
from feedskein.sources.tables import number_rows


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "title string, url string, link string, seq bigint")


def selectors(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "selector string")


def test_adding(spark, make):
    feeds = make.feeds((1, "Alpha", "u1"))
    wanted = requests(
        spark, ("A again", "u1", "l", 1), ("Beta", "u2", None, 2), ("Beta too", "u2", "l", 3),
        (None, "u3", "l", 4), ("Gamma", "u3", "l", 5), ("Delta", None, "l", 6), ("Beta", "u4", "l", 7),
    )
    reasons = {r.seq: r.reject_reason for r in judge_requests(feeds, wanted).collect()}
    assert reasons == {
        1: "url exists", 2: None, 3: "url exists", 4: "title is null", 5: None, 6: "url is null", 7: None,
    }
    added = feeds_to_add(feeds, wanted)
    assert {tuple(r) for r in added.collect()} == {("Beta", "u2", ""), ("Gamma", "u3", "l"), ("Beta", "u4", "l")}
    numbered = number_rows(added, "feed_id", ["url"], after=9)
    assert sorted(r.feed_id for r in numbered.collect()) == [10, 11, 12]
    assert numbered.columns == [f.name for f in FEEDS]


def test_urls_match_exactly(spark, make):
    feeds = make.feeds((1, "A", "https://a.example/feed"))
    urls = spark.createDataFrame([("https://a.example/feed",), ("https://a.example/feed/",), ("HTTPS://a.example/feed",)], "url string")
    got = {r.url: r.subscribed for r in urls_exist(feeds, urls).collect()}
    assert list(got.values()).count(True) == 1 and got["https://a.example/feed"]


@pytest.mark.parametrize("selector, expected", [
    ("Alpha", 1), ("alpha", None), ("2", 4), ("3", 3), (" 3 ", 3), ("+3", 3), ("1_0", None),
    ("99", None), ("", None), ("Same", 2), ("3.0", None), ("99999999999999999999", None),
])
def test_lookup_by_title_then_id(spark, make, selector, expected):
    feeds = make.feeds((1, "Alpha", "u1"), (2, "Same", "u2"), (3, "Same", "u3"), (4, "2", "u4"))
    assert find_feeds(feeds, selectors(spark, selector)).first().feed_id == expected


def test_lookup_gives_the_feed(spark, make):
    feeds = make.feeds((1, "Alpha", "u1", "l1"))
    got = {r.selector: (r.feed_id, r.url, r.link) for r in lookup_feeds(feeds, selectors(spark, "Alpha", "no", "no")).collect()}
    assert got == {"Alpha": (1, "u1", "l1"), "no": (None, None, None)}


def test_removing_takes_the_articles_along(spark, make, joins):
    feeds = make.feeds((1, "A", "u1"), (2, "B", "u2"), (3, "B", "u3"))
    articles = make.articles(*[{"feed_id": f, "guid": g} for f in (1, 2, 3) for g in "xy"])
    left, kept, outcome = remove_feeds(feeds, articles, selectors=selectors(spark, "B", "nobody"))
    assert sorted(r.feed_id for r in left.collect()) == [1, 3]
    assert sorted((r.feed_id, r.guid) for r in kept.collect()) == [(1, "x"), (1, "y"), (3, "x"), (3, "y")]
    assert {(r.selector, r.removed) for r in outcome.collect()} == {("B", True), ("nobody", False)}


def test_removing_by_id(spark, make):
    feeds = make.feeds((1, "Same", "u1"), (2, "Same", "u2"))
    gone = spark.createDataFrame([(2,)], "feed_id bigint")
    left, kept, _ = remove_feeds(feeds, make.articles({"feed_id": 2, "guid": "x"}), feed_ids=gone)
    assert [r.feed_id for r in left.collect()] == [1] and kept.count() == 0
