from datetime import datetime as D

from feedskein.operators.discovery import capture_digest
from feedskein.operators.redirects import MOST, follow_redirects, redirect_routes
from feedskein.plans.refresh import fetch_and_parse
from feedskein.plans.subscribe import subscriptions
from feedskein.sources.captures import drop_unwanted, page_captures

RSS = "<rss><channel><title>Here</title><item><guid>g</guid></item></channel></rss>"
ENDLESS = "Exceeded maximum allowed redirects."


def hop(url, to, status=301, day=1):
    return {"url": url, "final_url": to, "http_status": status, "fetched_at": D(2025, 1, day)}


def followed(captures):
    return {r.url: (r.final_url, r.http_status, r.error_kind, r.body) for r in follow_redirects(captures).collect()}


def test_chains_and_their_ends(make, joins):
    got = followed(make.captures(
        hop("a", "b"), hop("b", "c", 302), {"url": "c", "body": "text", "final_url": "c"}, hop("d", "nowhere", 308),
        hop("e", "f"), {"url": "f", "http_status": 404}, hop("g", "t"), {"url": "t", "error_kind": "timeout"},
        hop("h", None), {"url": "i", "http_status": 304, "final_url": "a"},
    ))
    assert got["a"] == got["b"] == got["c"] == ("c", 200, None, "text")
    assert got["d"] == ("nowhere", None, "not captured", None)
    assert got["e"] == ("f", 404, None, None) and got["g"] == ("t", None, "timeout", None)
    assert got["h"] == (None, 301, None, None) and got["i"] == ("a", 304, None, None)  # name no address, or no redirect


def test_circles_and_long_chains(make):
    rows = [hop("self", "self"), hop("x", "y"), hop("y", "z"), hop("z", "x"), hop("into", "x")]
    rows += [hop(f"n{i}", f"n{i + 1}") for i in range(30)] + [{"url": "n30", "body": "end"}]
    captures = make.captures(*rows)
    got = followed(captures)
    for url in ("self", "x", "y", "z", "into"):
        assert got[url][1:] == (None, ENDLESS, None)
    for i in range(30):
        assert got[f"n{i}"][1:] == ((200, None, "end") if 30 - i <= MOST else (None, ENDLESS, None)), i
    hops = {r.url: r.hops for r in redirect_routes(captures).collect()}
    assert hops["n29"] == 1 and hops["n10"] == 20 and hops["self"] > MOST


def test_the_last_capture_of_each_address_counts(make):
    got = follow_redirects(make.captures(
        hop("a", "old", day=1), hop("a", "b", day=2), hop("b", "gone", day=1), hop("b", "c", day=3),
        {"url": "c", "body": "first", "fetched_at": D(2025, 1, 1)}, {"url": "c", "body": "later", "fetched_at": D(2025, 1, 4)},
        {"url": "old", "body": "old", "fetched_at": D(2025, 1, 1)},
    )).collect()
    assert sorted((r.fetched_at.day, r.body) for r in got if r.url == "a") == [(1, "old"), (2, "later")]
    assert sorted((r.fetched_at.day, r.body or r.error_kind) for r in got if r.url == "b") == [(1, "not captured"), (3, "later")]
    assert sorted(r.body for r in got if r.url == "c") == ["first", "later"]


def test_documents_found_where_a_fetch_ended(make):
    got = followed(make.captures(
        {"url": "a", "final_url": "b", "body": "old", "fetched_at": D(2025, 1, 1)},
        {"url": "x", "final_url": "b", "body": "new", "fetched_at": D(2025, 1, 2)},
        {"url": "y", "final_url": "z", "http_status": 500}, hop("to", "b"),
        {"url": "p", "final_url": "q", "body": "by p"}, {"url": "q", "http_status": 404},
    ))
    assert got["b"][3] == "new" and got["a"][3] == "old" and got["to"] == ("b", 200, None, "new")
    assert "z" not in got and got["q"][1] == 404


def test_nothing_to_follow(make):
    rows = make.captures({"url": "a", "body": "x"}, {"url": "a", "body": "x"})
    assert follow_redirects(rows).count() == 2
    assert follow_redirects(rows.limit(0)).count() == 0


def test_parsing_pages_and_subscribing_follow(spark, make):
    captures = follow_redirects(make.captures(
        hop("https://a.example/feed", "https://b.example/feed"), {"url": "https://b.example/feed", "body": RSS},
        hop("https://c.example/", "https://c.example/home"),
        {"url": "https://c.example/home", "body": '<link rel="alternate" type="application/rss+xml" href="/feed">'},
        hop("https://c.example/feed", "https://a.example/feed"), hop("https://l.example/", "https://l.example/"),
        hop("https://d.example/feed.xml", "https://b.example/feed"),
    )).cache()
    wanted = spark.createDataFrame([("https://a.example/feed",), ("https://l.example/",)], "url string")
    parsed = {r.url: (r.error, r.feed and r.feed.title) for r in fetch_and_parse(wanted, captures).collect()}
    assert parsed == {
        "https://a.example/feed": (None, "Here"),
        "https://l.example/": (f"Network error fetching https://l.example/: {ENDLESS}", None),
    }
    sites = spark.createDataFrame([("https://a.example/feed",), ("https://c.example/",), ("https://d.example/blog",), ("https://l.example/",)], "site_url string")
    assert {r.site_url for r in page_captures(sites, captures).collect() if r.html} == {"https://a.example/feed", "https://c.example/"}
    outcomes = {r.site_url: (r.outcome, r.status, r.feed_url) for r in subscriptions(sites, capture_digest(captures), make.feeds()).collect()}
    assert outcomes == {
        "https://a.example/feed": ("direct", "added", "https://a.example/feed"),
        "https://c.example/": ("single", "added", "https://c.example/feed"),
        "https://d.example/blog": ("single", "added", "https://d.example/feed.xml"),
        "https://l.example/": ("none", "not_found", None),
    }


def test_bodies_nobody_asks_for_stay_out_of_the_shuffle(spark, make, joins):
    rows = [hop(f"https://{i}.example/", f"https://b.example/{i}") for i in range(60)]
    rows += [{"url": f"https://b.example/{i}", "body": RSS} for i in range(60)]
    captures = follow_redirects(make.captures(*rows))
    asked = [f"https://{i}.example/" for i in range(20)] + ["https://nowhere.example/"]
    wanted = spark.createDataFrame([(u,) for u in [*asked, None]], "url string")
    kept = [r.url for r in drop_unwanted(captures, wanted).collect()]
    assert sorted(kept) == sorted(asked[:20])
    parsed = {r.url: r.error for r in fetch_and_parse(wanted.dropna(), captures).collect()}
    assert parsed == {u: None if u != asked[20] else f"Network error fetching {u}: not captured" for u in asked}
