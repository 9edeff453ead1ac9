import time

import pyarrow as pa
import pytest

from feedskein.functions import markup
from feedskein.functions.markup import read_broken_feed, read_page
from feedskein.plans.catalogue import QUERIES
from feedskein.session import ARROW_ROWS, MOST_ARROW_ROWS
from feedskein.operators.discovery import page_feeds
from feedskein.operators.listing import article_details
from feedskein.operators.reading import article_links, html_to_text, link_lines, open_articles
from pyspark.sql import functions as F


def links(html):
    return [(x["text"], x["href"]) for x in read_page(html, "", ["links"])["links"]]


def text(html):
    return read_page(html, "", ["text"])["text"]


def feeds(html, base="https://site.example/blog/"):
    return [(f["url"], f["title"], f["feed_type"]) for f in read_page(html, base, ["feeds"])["feeds"]]


def test_links_in_document_order():
    assert links('<ul><li><a href="/1">One</a><li><a href=/2>Two</a></ul>') == [("One", "/1"), ("Two", "/2")]


def test_links_need_an_address():
    assert links('<a>nothing</a><a href="">blank</a><a href="  ">blanks</a><a href>bare</a>') == []


def test_link_without_text_shows_its_address():
    assert links('<a href=" https://x.example ">  </a>') == [("https://x.example", "https://x.example")]


def test_link_text_is_joined_without_separator():
    assert links('<a href="u">read <b>this</b> now</a>') == [("readthisnow", "u")]


def test_unclosed_link_lasts_to_the_end_of_its_parent():
    assert links("<div><a href='u'>one<p>two</div>three") == [("onetwo", "u")]
    assert links("<p>see <a href='u'>one <i>two") == [("onetwo", "u")]


def test_unclosed_link_holds_the_next():
    assert links("<a href='1'>x<a href='2'>y</a>z") == [("xyz", "1"), ("y", "2")]


def test_stray_end_tags_close_nothing():
    assert links("<p><a href='u'>one</b></i>two</a>") == [("onetwo", "u")]


def test_no_links_in_plain_text():
    assert links("just words") == []


def test_text_has_a_line_per_node():
    assert text("<p>Hello <b>world</b></p>\n<p> again </p>") == "Hello\nworld\nagain"


def test_text_leaves_out_what_is_not_shown():
    html = (
        "<!DOCTYPE html><head><style>p{}</style><script>var a = '</p><b>';</script></head>"
        "<template>t</template><!-- c -->a<ruby>b<rt>c</rt></ruby>"
    )
    assert text(html) == "a\nb"


def test_comment_splits_a_text_node():
    assert text("one<!-- -->two") == "one\ntwo"


def test_references():
    assert text("&copy; &amp; &#65;&#x42; &#150; &nosuch; a&b c") == "© & AB – &nosuch a&b c"


def test_plain_text_passes():
    assert text("no markup") == "no markup"


def test_text_of_nothing():
    assert text("") == ""


def test_page_feeds_are_resolved_and_typed():
    html = (
        '<link rel="alternate" type="application/atom+xml" title="A" href="a.xml">'
        '<link rel="ALTERNATE" type="application/rss+xml" href="/no">'
        '<LINK REL="home alternate" TYPE="Application/RSS+XML" HREF="/r.xml" title="">'
    )
    assert feeds(html) == [
        ("https://site.example/blog/a.xml", "A", "atom"),
        ("https://site.example/r.xml", "https://site.example/r.xml", "rss"),
    ]


def test_page_feeds_skip_other_links():
    html = (
        '<link rel="stylesheet" href="/s.css"><link rel="alternate" type="application/rss+xml">'
        '<link rel="alternate" type="application/rss+xml; charset=utf-8" href="/x">'
        '<link rel="alternate" type="application/rss+xml" href="">'
    )
    assert feeds(html) == []


def test_page_feeds_keep_duplicates():
    tag = '<link rel="alternate" type="application/rss+xml" href="/r">'
    assert len(feeds(tag + tag)) == 2


def test_page_feeds_column(spark):
    rows = [
        ("http://h.example/p", "<link rel=alternate type='application/rss&#43;xml' href=r>"),
        ("http://h.example/q", "<p>none</p>"),
        ("http://h.example/r", None),
    ]
    frame = spark.createDataFrame(rows, "url string, html string")
    got = [r[0] for r in frame.select(page_feeds(F.col("html"), F.col("url"))).collect()]
    assert [f.url for f in got[0]] == ["http://h.example/r"]
    assert got[1:] == [[], None]


def test_jobs_over_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://h.example/a/", '<p>x <a href="b">B</a> <a href="/c"></a>'), (2, "http://h.example/", "none")],
        "id int, url string, html string",
    )
    got = link_lines(article_links(pages, base="url")).orderBy("pos").collect()
    assert [(r.id, r.pos, r.resolved_href, r.line) for r in got] == [
        (1, 0, "http://h.example/a/b", "[1] B (b)"),
        (1, 1, "http://h.example/c", "[2] /c (/c)"),
    ]
    texts = {r.id: r.text for r in html_to_text(pages.drop("url")).collect()}
    assert texts == {1: "x\nB", 2: "none"}


def test_opened_article(spark):
    listed = spark.createDataFrame(
        [(1, "T", "Feed", None, None, '<a href="u">x</a>'), (2, "T", "", "Ann", None, "")],
        "id int, title string, feed_title string, author string, published timestamp_ntz, summary string",
    )
    opened = {r.id: r for r in open_articles(article_details(listed, "id")).collect()}
    assert (opened[1].meta, opened[1].text, opened[1].links) == ("Feed", "x", ["[1] x (u)"])
    assert (opened[2].meta, opened[2].text, opened[2].links) == ("Ann", "(no content)", [])


def test_broken_feed_gives_its_entries():
    feed = read_broken_feed(
        "<rss><channel><title>News &nbsp;&amp; more</title><image><title>logo</title></image>"
        "<item><title>One</title><guid isPermaLink='false'>g1</guid>"
        "<description><![CDATA[<p>a & b</p>]]></description></item>"
        "<item><title>Two<link>http://h.example/2</link><author>Ann"
    )
    assert feed["title"] == "News \xa0& more"
    one, two = feed["entries"]
    assert (one["title"], one["guid"][0]["_VALUE"], one["description"]) == ("One", "g1", "<p>a & b</p>")
    assert (two["title"], two["link"][0]["_VALUE"], two["author"][0]["_VALUE"]) == ("Two", "http://h.example/2", "Ann")


def test_broken_atom_feed():
    feed = read_broken_feed(
        "<a:feed><a:title>T</a:title><a:link href='h'/><a:entry><a:author><a:name>Ann</a:name></a:author>"
        "<a:link rel='alternate' href='e'/><a:id>7</a:id><a:content>x <b>y</b></a:content>"
    )
    assert feed["title"] == "T" and feed["link"][0]["_href"] == "h"
    entry = feed["entries"][0]
    assert entry["author"] == [{"name": "Ann"}] and entry["id"] == "7" and entry["content"] == ["x <b>y</b>"]


def test_no_feed_at_all():
    assert read_broken_feed("words") == {"title": None, "link": [], "entries": []}


@pytest.mark.parametrize("unit", ["<!--", "<!-- x >", "<a ", '<a href="', "<", "&", "</", "<![CDATA[", "<?x "])
def test_endless_markup_takes_no_endless_time(unit):
    start = time.process_time()
    read_page("<p>x</p>" + unit * 20000, "", ["text", "links"])
    read_broken_feed("<rss>" + unit * 20000)
    assert time.process_time() - start < 10


def test_unfinished_markup_is_text():
    assert text("<p>a</p>b <i c &amp; <!-- d") == "a\nb <i c &amp; <!-- d"


def test_what_was_read_becomes_arrow_a_slice_at_a_time(monkeypatch):
    monkeypatch.setattr(markup, "SLICE_ROWS", 2)
    sizes = []
    whole = pa.concat_arrays
    monkeypatch.setattr(markup.pa, "concat_arrays", lambda arrays: sizes.extend(map(len, arrays)) or whole(arrays))
    found = markup.in_slices(pa.string(), lambda text, other: text + other, pa.array(["a", None, "b", "c", ""]), pa.array(["1", "2", "3", "4", "5"]))
    assert found.to_pylist() == ["a1", None, "b3", "c4", "5"] and sizes == [2, 2, 1]
    assert markup.in_slices(pa.string(), str, pa.array([], pa.string())).to_pylist() == []


def test_pages_go_to_python_by_the_thousand(spark, tmp_path):
    """Ten thousand, as Spark has it, would be hundreds of MB; a smaller number that was set stays."""
    given = spark.conf.get(ARROW_ROWS)
    try:
        spark.createDataFrame([(i, f"u{i}", f"<p>{i}") for i in range(3)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
        for most, kept in (("10000", MOST_ARROW_ROWS), ("0", MOST_ARROW_ROWS), ("7", 7)):
            spark.conf.set(ARROW_ROWS, most)
            assert sorted(r.text for r in QUERIES["page_text"](spark, str(tmp_path)).collect()) == ["0", "1", "2"]
            assert int(spark.conf.get(ARROW_ROWS)) == kept
    finally:
        spark.conf.set(ARROW_ROWS, given)
