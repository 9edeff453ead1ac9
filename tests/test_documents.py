from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from feedskein.functions.text import feed_type, root_name
from feedskein.operators.documents import entries, entries_to_articles, feed_info, parse_feeds
from feedskein.sources.captures import capture_outcomes, latest_captures, page_captures, successes

RSS = """<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/">
<channel><description>Harbour news</description><link>https://harbour.example</link><title>Harbour</title>
<item><guid isPermaLink="false">pilot-7</guid><dc:creator>Mara</dc:creator><title>Pilot boat</title>
<content:encoded><![CDATA[<p>Back in service.</p>]]></content:encoded><pubDate>Sun, 03 Mar 2025 06:45:00 +0100</pubDate></item>
<item><title>Tide tables</title><enclosure url="https://harbour.example/t.pdf" type="application/pdf" length="9"/>
<description>For April.</description><link>https://harbour.example/tides</link></item>
<item><link>https://harbour.example/crane</link><description/><guid>https://harbour.example/crane?id=3</guid></item>
</channel></rss>"""

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">
<link rel="self" href="https://orchard.example/feed"/><link rel="alternate" type="text/html" href="https://orchard.example"/>
<title type="text">Orchard</title>
<entry><id>tag:orchard,2:pears</id><author><name>Ines</name></author><author><name>Tom</name></author>
<published>2025-02-11T08:00:00+02:00</published><updated>2025-02-12T08:00:00Z</updated>
<content type="html">&lt;b&gt;Pears&lt;/b&gt;</content><title>Pears</title></entry>
<entry><title>Plums</title><id>tag:orchard,2:plums</id><link href="https://orchard.example/plums"/></entry></feed>"""


def parsed_one(make, body, url="https://f.example/feed"):
    return parse_feeds(make.captures((url, body)))


def items(make, inner, head=""):
    """Entries of an RSS 2.0 document with this content in its channel."""
    return entries(parsed_one(make, f"<rss><channel><title>T</title>{head}{inner}</channel></rss>")).orderBy("pos").collect()


def test_rss(make):
    parsed = parsed_one(make, RSS)
    info = feed_info(parsed).first()
    assert (info.title, info.link, info.feed_type, info.error) == ("Harbour", "https://harbour.example", "rss", None)
    pilot, tides, crane = entries(parsed, "url").orderBy("pos").collect()
    assert (pilot.guid, pilot.link, pilot.author, pilot.summary) == ("pilot-7", "", "Mara", "<p>Back in service.</p>")
    assert pilot.published == D(2025, 3, 3, 5, 45)  # a Monday, whatever it says
    assert (tides.guid, tides.summary, tides.published) == ("https://harbour.example/tides", "For April.", None)
    assert (crane.guid, crane.title, crane.summary) == ("https://harbour.example/crane?id=3", "Untitled", "")


def test_atom(make):
    parsed = parsed_one(make, ATOM)
    info = feed_info(parsed).first()
    assert (info.title, info.link, info.feed_type) == ("Orchard", "https://orchard.example", "atom")
    pears, plums = entries(parsed).orderBy("pos").collect()
    assert (pears.guid, pears.link, pears.author, pears.published, pears.summary) == (
        "tag:orchard,2:pears", "", "Tom", D(2025, 2, 11, 6), "<b>Pears</b>")
    assert (plums.title, plums.link, plums.published, plums.summary) == ("Plums", "https://orchard.example/plums", None, "")


@pytest.mark.parametrize("body,good", [
    ('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>t</a:title></a:feed>', True),
    ('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>t</a:title>', False),
    ("<rss><channel><title>t</title></channel></rss>junk", False),
    ("<rss><channel><title>t</title></channel></rss> <!-- </rss> --><?x y?>\n", True),
    ("<rss><channel><title>t</title></channel></rss><rss/>", False),
    ("<rss><channel><title>t</title><item><title>a</title></item></channel></rss>junk", True),
])
def test_well_formed_to_the_end(make, body, good):
    assert (parsed_one(make, body).first().error is None) is good


def test_rss_1_items_beside_the_channel(make):
    body = (
        '<rdf:RDF xmlns:rdf="r" xmlns="p" xmlns:dc="d"><channel><title>R</title></channel>'
        '<item rdf:about="https://r.example/1"><title>x</title><dc:date>2025-01-15</dc:date><dc:creator>Bo</dc:creator></item></rdf:RDF>'
    )
    entry = entries(parsed_one(make, body)).first()
    assert (entry.guid, entry.author, entry.published) == ("https://r.example/1", "Bo", D(2025, 1, 15))


def test_guid_falls_back_to_link_then_to_nothing(make):
    got = items(make, (
        "<item><guid isPermaLink='false'>g</guid><link>l</link></item><item><link>l</link></item><item/>"
        "<item><guid/><link>l</link></item>"
    ))
    assert [r.guid for r in got] == ["g", "l", "", ""]


def test_permalink_guid_is_the_link(make):
    got = items(make, "<item><guid>g</guid></item><item><guid isPermaLink='false'>g</guid></item>")
    assert [r.link for r in got] == ["g", ""]


def test_absent_and_empty_differ(make):
    got = items(make, "<item/><item><title/></item><item><title></title></item>")
    assert [r.title for r in got] == ["Untitled", "", ""]
    untitled = feed_info(parsed_one(make, "<rss><channel><item/></channel></rss>", "u")).first()
    assert (untitled.title, untitled.link) == ("u", "")
    empty = feed_info(parsed_one(make, "<rss><channel><title/><item/></channel></rss>", "u")).first()
    assert empty.title == ""


def test_summary_and_content(make):
    ns = 'xmlns:content="c"'
    got = items(make, (
        f"<item><description>s</description><content:encoded {ns}>c</content:encoded></item>"
        f"<item><description></description><content:encoded {ns}>c</content:encoded></item>"
        f"<item><content:encoded {ns}>c</content:encoded></item>"
        "<item><description> s </description></item><item/>"
    ))
    assert [r.summary for r in got] == ["s", "c", "c", "s", ""]


def test_markup_in_content_is_kept(make):
    body = (
        "<feed><title>T</title><entry><content type='xhtml'><div>a <b>b</b></div></content></entry>"
        "<entry><content type='html'>&lt;p&gt;c</content></entry></feed>"
    )
    got = entries(parsed_one(make, body)).orderBy("pos").collect()
    assert [r.summary for r in got] == ["<div>a <b>b</b></div>", "<p>c"]


def test_author_forms(make):
    body = (
        "<feed><title>T</title><entry><author><name>A</name><email>a@x</email></author></entry>"
        "<entry><author><name>A</name></author><author><name>B</name></author></entry><entry/></feed>"
    )
    got = entries(parsed_one(make, body)).orderBy("pos").collect()
    assert [r.author for r in got] == ["A (a@x)", "B", None]


def test_atom_link_choice(make):
    body = (
        "<feed><title>T</title><link rel='self' href='s'/><link rel='alternate' type='text/html' href='h'/>"
        "<link rel='alternate' type='application/json' href='j'/><entry><link rel='enclosure' href='e'/></entry></feed>"
    )
    parsed = parsed_one(make, body)
    assert feed_info(parsed).first().link == "h"
    assert entries(parsed).first().link == ""


@pytest.mark.parametrize("body", [
    "<html><head><title>A page</title></head><body><p>x</p></body></html>",
    "", "words", "<rss><channel></channel></rss>", "<feed><title></title></feed>", "<rss><channel><title>x",
    "  <?xml version='1.0'?><rss><channel><title>blanks before</title></channel></rss>",
])
def test_malformed(make, body):
    row = parsed_one(make, body, "https://m.example").first()
    assert row.error == "Malformed feed content from https://m.example"


@pytest.mark.parametrize("body", [
    "<rss><channel><title>Empty</title></channel></rss>",
    "<rss><channel><item><title>no end",
    "<rss><channel><title>&nosuch;</title><item/></channel></rss>",
    "<a:feed xmlns:a='http://www.w3.org/2005/Atom'><a:title>T</a:title></a:feed>"
    .replace("</a:title>", "</a:title><a:entry/>"),
    "<?xml version='1.0'?><!-- <html> --><rss><channel><title>x</title></channel></rss>",
    "  <rss><channel><title>x</title></channel></rss>",
    "  <?xml version='1.0'?><rss><channel><title>x</title><item/></channel></rss>",
])
def test_not_malformed(make, body):
    assert parsed_one(make, body).first().error is None


def test_broken_and_sound_agree(make):
    sound = entries(parsed_one(make, RSS)).orderBy("pos").collect()
    broken = entries(parsed_one(make, RSS.replace("</channel></rss>", ""))).orderBy("pos").collect()
    assert sound == broken


def test_filter_on_parsed_column_parses_once(make):
    frame = parse_feeds(make.captures(("u", RSS))).filter(F.col("error").isNull())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_xml") == 1


def test_feed_type(spark):
    texts = [
        "<?xml?><FEED>", "<rss>", "<rss><feedburner:x/>", "<rdf:RDF>", "", " " * 495 + "<feed", " " * 496 + "<feed",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in frame.orderBy("i").select(feed_type(F.col("t"))).collect()]
    assert got == ["atom", "rss", "atom", "rss", "rss", "atom", "rss"]


def test_root_name(spark):
    texts = ["<?xml?><!DOCTYPE x [<!ELEMENT a (b)>]><!-- <p> \n --><rss a='1'>", "words", "a < b <i>", "", "<!-- a --> <!-- <rss>"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in frame.orderBy("i").select(root_name(F.col("t"))).collect()] == ["rss", "", "i", "", ""]


def test_fetch_failures(make):
    captures = make.captures(
        {"url": "a", "error_kind": "timeout"}, {"url": "b", "http_status": 404}, {"url": "c", "error_kind": "refused"},
        {"url": "d", "body": RSS}, {"url": "e", "http_status": 204, "body": RSS},
        {"url": "f", "http_status": 304, "body": RSS}, {"url": "g", "http_status": 503, "error_kind": "timeout"},
    )
    got = dict((r.url, r.error) for r in capture_outcomes(captures).collect())
    assert got == {
        "a": "Timeout fetching a", "b": "HTTP 404 fetching b", "c": "Network error fetching c: refused",
        "d": None, "e": None, "f": "HTTP 304 fetching f", "g": "Timeout fetching g",
    }
    assert {r.url for r in successes(captures).collect()} == {"d", "e"}
    errors = {r.url: r.error for r in parse_feeds(captures).collect()}
    assert errors == got


def test_latest_capture(make):
    captures = make.captures(
        {"url": "a", "body": "old", "fetched_at": D(2025, 1, 1)},
        {"url": "a", "body": "new", "fetched_at": D(2025, 1, 3)},
        {"url": "a", "body": "mid", "fetched_at": D(2025, 1, 2)},
        {"url": "b", "body": "one"},
    )
    assert {(r.url, r.body) for r in latest_captures(captures).collect()} == {("a", "new"), ("b", "one")}


def test_page_captures(spark, make):
    sites = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "site_url string")
    captures = make.captures(("a", "<p>"), {"url": "b", "http_status": 500, "body": "x"}, ("c", ""))
    got = {r.site_url: r.html for r in page_captures(sites, captures).collect()}
    assert got == {"a": "<p>", "b": None, "c": None, "d": None}


def test_entries_become_articles(make, joins):
    rows = entries(parse_feeds(make.captures(("u1", RSS), ("u2", ATOM), ("u3", ATOM))), "url")
    articles = entries_to_articles(rows, make.feeds((7, "W", "u1"), (8, "N", "u2")))
    got = sorted((r.feed_id, r.guid, r.is_read, r.is_favorite) for r in articles.collect())
    crane, tides = "https://harbour.example/crane?id=3", "https://harbour.example/tides"
    guids = [(7, crane), (7, tides), (7, "pilot-7"), (8, "tag:orchard,2:pears"), (8, "tag:orchard,2:plums")]
    assert got == [(*key, False, False) for key in guids]


ITEM = "<item><title>ok</title></item>"


@pytest.mark.parametrize("body", [
    f"<rss><channel><title>t</title><x>{'<a>' * 20000}{'</a>' * 20000}</x>{ITEM}</channel></rss>",
    f"<rss><channel><title>t</title>{ITEM}{'<a>' * 20000}",
    f"<rss><channel><title>t\x00</title>{ITEM}</channel></rss>",
    f'<!DOCTYPE rss [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;&a;">]><rss><channel><title>&b;</title>{ITEM}</channel></rss>',
    f'<!DOCTYPE rss SYSTEM "file:///etc/hostname"><rss><channel><title>t</title>{ITEM}</channel></rss>',
    f'<rss><channel a="1" a="2"><title>t</title>{ITEM}</channel></rss>',
    f"<?xml version='1.0' encoding='UTF-16'?><rss><channel><title>t</title>{ITEM}</channel></rss>",
    f"<rss><channel><undeclared:x>1</undeclared:x><title>t</title>{ITEM}</channel></rss>",
    f"\ufeff<rss><channel><title>t</title>{ITEM}</channel></rss>",
])
def test_hostile_documents_keep_their_entry(make, body):
    parsed = parsed_one(make, body)
    assert parsed.first().error is None
    assert [r.title for r in entries(parsed).collect()] == ["ok"]
