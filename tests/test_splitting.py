"""Documents read in parts against the same documents read whole."""

import random

import pytest
from pyspark.sql import functions as F

from feedskein.functions.parts import document_parts, element_ranges
from feedskein.operators import splitting
from feedskein.operators.discovery import sitemap_locs
from feedskein.operators.documents import entries, feed_info, parse_feeds
from feedskein.operators.splitting import FEED_PATHS, SITEMAP_PATHS, cut, dealt, loc_rows, parse_feed_parts, part_entries

TINY = {"split_bytes": 1, "part_bytes": 120}
ITEM = "<item><guid>{0}</guid><title>T {0}</title></item>"
RSS = '<?xml version="1.0"?>\n<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Feed</title><link>http://f/</link>{}</channel></rss>'

TRICKY = {
    "plain": RSS.format("".join(ITEM.format(i) for i in range(9))),
    "cdata": RSS.format("<item><guid>a</guid><description><![CDATA[</item><item><guid>no</guid>]]></description></item>" + ITEM.format("b")),
    "comment": RSS.format("<!-- <item><guid>no</guid></item> --><item><guid>a</guid><!-- </item> --></item>" + ITEM.format("b")),
    "attribute": RSS.format('<item><guid isPermaLink="</item>&lt;item>">a</guid></item>'.replace("</item>&", "&lt;/item>&")),
    "quoted end": RSS.format("<item a='>' b=\">'\"><guid>a</guid></item ><item/><item\n/>" + ITEM.format("b")),
    "title after": RSS.replace("<title>Feed</title>", "").format(ITEM.format(1) + "<title>Late</title>" + ITEM.format(2)),
    "nested": RSS.format("<item><guid>a</guid><x><item><guid>inner</guid></item></x><title>t</title></item>" + ITEM.format("b")),
    "two channels": "<rss><channel><title>A</title>" + ITEM.format(1) + "</channel><channel><title>B</title>" + ITEM.format(2) + "</channel></rss>",
    "beside": '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>R</title></channel><item rdf:about="x"><dc:creator>me</dc:creator></item><item rdf:about="y"/></rdf:RDF>',
    "both": "<rss><channel><title>A</title>" + ITEM.format(1) + "</channel>" + ITEM.format(2) + "</rss>",
    "atom": '<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><id>1</id><content type="xhtml"><div>x<entry/></div></content></entry><entry><id>2é漢</id></entry></feed>',
    "prefixed": '<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>P</a:title><a:entry><a:id>1</a:id></a:entry><a:entry><a:id>2</a:id></a:entry></a:feed>',
    "doctype": '<!DOCTYPE rss [<!ENTITY e "text">]><rss><channel><title>D</title><item><guid>&e;</guid></item>' + ITEM.format(2) + "</channel></rss>",
    "broken": RSS.format(ITEM.format(1) + "<item><guid>2<title>x & y</item>" + ITEM.format(3)),
    "cut off": RSS.format("".join(ITEM.format(i) for i in range(4)))[:-30],
    "more after": RSS.format(ITEM.format(1) + ITEM.format(2)) + "<rss/>",
    "comment after": RSS.format(ITEM.format(1) + ITEM.format(2)) + "<!-- end </rss> -->",
    "no entries": RSS.format(""),
    "untitled": "<rss><channel>" + ITEM.format(1) + "</channel></rss>",
    "long head": RSS.replace("\n", "<!--" + "x" * 300 + "-->").format(ITEM.format(1) + ITEM.format(2)),
    "feed within": "<rss><channel><title>x</title>" + ITEM.format("&lt;feed") + "<item><feed/></item></channel></rss>",
    "page": "<html><body><item>no</item></body></html>",
    "empty": "",
    "null": None,
}


def collected(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def assert_alike(captures, **sizes):
    whole, parts = parse_feeds(captures), parse_feed_parts(captures, **sizes)
    names = ["url", "pos", "guid", "title", "link", "author", "published", "summary"]
    assert collected(part_entries(parts, "url"), *names) == collected(entries(whole, "url"), *names)
    first = parts.filter("part = 0")
    names = ["url", "error", "feed_type", "well_formed"]
    assert collected(first, *names) == collected(whole, *names)
    assert collected(feed_info(first), "url", "title", "link") == collected(feed_info(whole), "url", "title", "link")


@pytest.mark.parametrize("sizes", [TINY, {"split_bytes": 1, "part_bytes": 4000}, {"split_bytes": 400, "part_bytes": 200}, {}])
def test_entries_and_feeds(spark, make, sizes):
    rows = [(f"http://h/{name}", body) for name, body in TRICKY.items()]
    failed = {"url": "http://h/gone", "body": TRICKY["plain"], "http_status": 404}
    assert_alike(make.captures(*rows, *rows[:3], failed), **sizes)


def test_no_captures(make):
    assert part_entries(parse_feed_parts(make.captures(), **TINY), "url").count() == 0


def random_feed(rng):
    def noise():
        return rng.choice(["", " ", "\n", "<!-- <item> -->", "<!--</channel>-->", "<?pi <item>?>", "<ttl>5</ttl>", "<image><title>I</title></image>"])

    def text():
        return "".join(rng.choice(["a", "é", "&amp;", "&#60;", "<![CDATA[</item>]]>", "<![CDATA[<entry>]]>", " ", "漢", "]]&gt;"]) for _ in range(rng.randrange(6)))

    def field():
        name = rng.choice(["guid", "title", "link", "description", "pubDate", "dc:creator", "item", "x"])
        return rng.choice([f"<{name}>{text()}</{name}>", f"<{name}/>", f"<{name} a='>'>{text()}</{name}>"])

    def item(name):
        return noise() + rng.choice([f"<{name}>" + "".join(field() for _ in range(rng.randrange(4))) + f"</{name}>", f"<{name}/>"]) + noise()

    items = "".join(item("item") for _ in range(rng.randrange(7)))
    body = rng.choice([
        f"<rss xmlns:dc='d'>{noise()}<channel><title>{text()}</title>{items}</channel></rss>",
        f"<rdf:RDF xmlns:rdf='r' xmlns:dc='d'><channel><title>R</title></channel>{items}</rdf:RDF>",
        "<feed xmlns:dc='d'><title>A</title>" + "".join(item("entry") for _ in range(rng.randrange(7))) + "</feed>",
    ])
    if rng.random() < 0.15:
        at = rng.randrange(len(body))
        body = body[:at] + body[at + rng.randrange(1, 9):]
    return body


def test_random_feeds(make):
    rng = random.Random(11)
    assert_alike(make.captures(*[(f"http://h/{i}", random_feed(rng)) for i in range(400)]), split_bytes=1, part_bytes=90)


def test_a_large_feed_is_read_by_many_tasks(spark, make):
    body = RSS.format("".join(f"<item><guid>{i}</guid><description>{'word ' * 40}</description></item>" for i in range(20_000)))
    captures = make.captures(("http://h/large", body))
    parts = parse_feed_parts(captures, split_bytes=1 << 20, part_bytes=64 << 10)
    assert part_entries(parts, "url").agg(F.count("*"), F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()[:] == (20_000, 0, 19_999, 20_000)
    pieces = cut(captures.select("url", "body"), FEED_PATHS, part_bytes=64 << 10)
    largest = pieces.agg(F.max(F.octet_length("body"))).first()[0]
    assert largest < 66 << 10
    tasks = dealt(pieces.withColumn("_same", F.lit("x"))).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 2 * min(r["count"] for r in tasks)


def test_parts_cover_the_document():
    data = TRICKY["plain"].encode()
    pieces = list(document_parts(data, FEED_PATHS, 100))
    assert [p[:3] for p in pieces] == [(0, 0, 9), (0, 3, 9), (3, 3, 9), (6, 3, 9)]
    assert all(element_ranges(p[3], FEED_PATHS) for p in pieces[1:])


MAPS = {
    "plain": "<urlset>" + "".join(f"<url><loc>http://h/{i}</loc></url>" for i in range(9)) + "</urlset>",
    "index": "<sitemapindex xmlns='s'><sitemap><loc> a </loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>",
    "several": "<urlset><url><loc>a</loc><loc>b</loc></url><url/><url><loc> </loc></url><url><loc>c</loc></url></urlset>",
    "comment": "<urlset><url><!-- <loc>no</loc> --><loc>a</loc></url><url><loc>b</loc></url></urlset>",
    "cdata": "<urlset><url><loc><![CDATA[a]]></loc></url><url><loc>b&amp;c</loc></url></urlset>",
    "mixed": "<urlset><url><loc>a</loc></url><sitemap><loc>b</loc></sitemap><url><loc>c</loc></url></urlset>",
    "astray": "<urlset><loc>x</loc><url><loc>a</loc></url><url><loc>b</loc></url></urlset>",
    "broken": "<urlset><url><loc>a</loc><url><loc>b</loc></url></urlset>",
    "page": "<html><loc>a</loc></html>",
    "empty": "",
    "null": None,
}


@pytest.mark.parametrize("sizes", [{"split_bytes": 1, "part_bytes": 40}, {"split_bytes": 60, "part_bytes": 1000}, {}])
def test_sitemaps(spark, sizes):
    frame = spark.createDataFrame([*MAPS.items(), *list(MAPS.items())[:2]], "name string, body string")
    expected = sitemap_locs(frame).select("name", F.posexplode("locs").alias("pos", "loc"))
    assert collected(loc_rows(frame, **sizes), "name", "pos", "loc") == collected(expected, "name", "pos", "loc")
    assert list(document_parts(MAPS["plain"].encode(), SITEMAP_PATHS, 40))[0] == (0, 0, 9, b"<urlset></urlset>")


def test_small_parts_leave_the_scan_together(spark, monkeypatch):
    """A batch per part costs more than parsing the part; large parts still go a few at a time."""
    documents = spark.createDataFrame([(i, RSS.format("".join(ITEM.format(j) for j in range(30)))) for i in range(20)], "n long, body string")
    scans = []
    monkeypatch.setattr(type(documents), "mapInArrow", lambda self, scan, schema: scans.append(scan))
    cut(documents, FEED_PATHS, part_bytes=150)
    given = documents.toArrow().combine_chunks().to_batches()
    batches = list(scans[0](iter(given)))
    assert len(batches) == 1
    parts = len(list(document_parts(documents.first().body.encode(), FEED_PATHS, 150)))
    assert parts > 5 and batches[0]["n"].to_pylist() == [i for i in range(20) for _ in range(parts)]
    monkeypatch.setattr(splitting, "TOGETHER_BYTES", 1000)
    batches = list(scans[0](iter(given)))
    assert sum(b.num_rows for b in batches) == 20 * parts and len(batches) > 20
