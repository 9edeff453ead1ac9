"""Views that turn other tables into the engine's tables, for queries and tests.

 customer  -> feeds
 events    -> observations, articles, and the two logs of the state fold
 documents -> one captured feed document per row, an entry per line of its text, in RSS
              2.0, Atom, RSS 1.0 or broken RSS by language; failing and malformed captures
 pages     -> captured sites: pages with and without link tags, pages that are feeds,
              well-known paths, sitemaps

Each view covers every row of its table. All but the home page of a site's root come
without a shuffle.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedskein.functions.urls import site_root
from feedskein.operators.articles import first_observations
from feedskein.sources.captures import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bodies(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table whose texts are to be parsed."""
    return spread(table(spark, sf_dir, name).select(*columns))


# --- feeds and articles ---------------------------------------------------------------


def feeds(spark, sf_dir) -> DataFrame:
    address = F.concat(F.lit("https://feeds.example.com/"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("feed_id"),
        F.col("c_name").alias("title"),
        F.concat(address, F.lit("/feed.xml")).alias("url"),
        address.alias("link"),
    )


def observations(spark, sf_dir) -> DataFrame:
    """With event_type and value, which the table itself does not have."""
    kind = F.col("event_type")
    number = F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("feed_id"),
        F.col("props").alias("guid"),
        F.concat(kind, F.lit(" "), number).alias("title"),
        F.concat(F.lit("https://feeds.example.com/"), F.col("user_id").cast("string"), F.lit("/"), number).alias("link"),
        F.when(kind != "signup", F.concat(F.lit("author of "), kind)).alias("author"),
        F.when(kind != "error", F.col("ts")).alias("published"),
        F.when(kind == "purchase", "").otherwise(F.concat(F.lit("<p>"), F.col("props"), F.lit("</p>"))).alias("summary"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
        F.col("event_id").alias("pos"),
        kind, "value",
    )


def articles(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    return first_observations(observations(spark, sf_dir)).select(
        "feed_id", "guid", "title", "link", "author", "published", "summary",
        kind.isin("view", "click").alias("is_read"), (kind == "purchase").alias("is_favorite"),
    )


def _history_guid() -> Column:
    # small values are by far the most frequent, so some articles have long histories
    return F.floor(F.col("value") / 10).cast("string")


def state_observations(spark, sf_dir) -> DataFrame:
    seen = observations(spark, sf_dir).filter(F.col("event_type").isin("signup", "purchase"))
    return seen.withColumn("guid", _history_guid()).drop("event_type", "value")


def state_actions(spark, sf_dir) -> DataFrame:
    done = observations(spark, sf_dir).filter(F.col("event_type").isin("view", "click", "error"))
    action = (
        F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "toggle")
        .otherwise("delete")
    )
    return done.select(
        "feed_id", _history_guid().alias("guid"), action.alias("action"),
        F.col("fetched_at").alias("at"), F.col("pos").alias("seq"),
    )


def state_articles(spark, sf_dir) -> DataFrame:
    """Articles with every mix of the two marks, keyed as in state_actions."""
    first = first_observations(observations(spark, sf_dir).withColumn("guid", _history_guid()))
    return first.select(
        "feed_id", "guid", "title", "link", "author", "published", "summary",
        F.col("event_type").isin("view", "click").alias("is_read"),
        F.col("event_type").isin("click", "purchase", "error").alias("is_favorite"),
    )


# --- captured feed documents ----------------------------------------------------------


def escaped(text: Column) -> Column:
    """text as XML character data, without the characters XML does not allow."""
    legal = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\uFFFE\uFFFF]", "")
    for character, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        legal = F.replace(legal, F.lit(character), F.lit(reference))
    return legal


def _tag(name: str, content: Column, attributes="") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), content, F.lit(f"</{name.split()[0]}>"))


DOCUMENT = ["doc_id", "text", "lang", "source"]


def document_url() -> Column:
    return F.concat(F.lit("https://docs.example.com/"), F.col("doc_id").cast("string"), F.lit("/feed.xml"))


def _entry_time(i: Column) -> Column:
    """2024 on, an hour per document and a minute per line."""
    start = F.timestamp_add("HOUR", (F.col("doc_id") % 87600).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return F.timestamp_add("MINUTE", i, start)


def _rfc822(i: Column, zone: str) -> Column:
    return F.concat(F.date_format(_entry_time(i), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(zone))


def _iso(i: Column, zone: str) -> Column:
    return F.concat(F.date_format(_entry_time(i), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))


def _rss_item(line: Column, i: Column, zone: str) -> Column:
    link = F.concat(document_url(), F.lit("#"), i.cast("string"))
    return _tag("item", F.concat(
        _tag("title", F.concat(F.lit("Line "), i.cast("string"))),
        _tag("guid", F.md5(line), ' isPermaLink="false"'),
        _tag("link", link),
        _tag("dc:creator", F.col("lang")),
        _tag("pubDate", _rfc822(i, zone)),
        _tag("description", escaped(line)),
    ))


def _atom_entry(line: Column, i: Column) -> Column:
    return _tag("entry", F.concat(
        _tag("title", F.concat(F.lit("Line "), i.cast("string")), ' type="text"'),
        F.lit('<link rel="enclosure" href="https://docs.example.com/audio"/><link href="'),
        document_url(), F.lit("#"), i.cast("string"), F.lit('"/>'),
        _tag("updated", _iso(i, "Z")),
        _tag("author", _tag("name", F.col("lang"))),
        F.lit("<summary/>"),
        _tag("content", escaped(line), ' type="html"'),
    ))


def _rdf_item(line: Column, i: Column) -> Column:
    return _tag("item", F.concat(_tag("dc:date", _iso(i, "+02:00")), _tag("description", escaped(line))))


def document_format() -> Column:
    lang = F.col("lang")
    return F.when(lang == "en", "rss").when(lang == "de", "atom").when(lang == "fr", "rdf").otherwise("broken")


def feed_document() -> Column:
    """The row's text as a feed document in the row's format."""
    lines = F.split("text", "\n")

    def body(entry):
        return F.array_join(F.transform(lines, entry), "")

    title = F.concat(F.col("source"), F.lit(" &amp; "), F.col("doc_id").cast("string"))
    rss_head = '<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>'
    atom_head = '<?xml version="1.0"?><!-- not <rss> --><feed xmlns="http://www.w3.org/2005/Atom">'
    rdf_head = (
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
        'xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">'
    )
    site = F.concat(F.lit("https://docs.example.com/"), F.col("doc_id").cast("string"))
    rss = F.concat(
        F.lit(rss_head), _tag("title", title), _tag("link", site),
        body(lambda x, i: _rss_item(x, i, " GMT")), F.lit("</channel></rss>"),
    )
    atom = F.concat(
        F.lit(atom_head), _tag("title", title), F.lit('<link rel="self" href="https://docs.example.com/self"/><link href="'),
        site, F.lit('"/>'), body(_atom_entry), F.lit("</feed>"),
    )
    rdf = F.concat(
        F.lit(rdf_head), _tag("channel", _tag("link", site)), body(_rdf_item), F.lit("</rdf:RDF>")
    )
    broken = F.concat(
        F.lit(rss_head), _tag("title", F.concat(title, F.lit(" &copy;"))),
        body(lambda x, i: _rss_item(x, i, " -0500")),
    )
    kind = document_format()
    return F.when(kind == "rss", rss).when(kind == "atom", atom).when(kind == "rdf", rdf).otherwise(broken)


def _captured(rows: DataFrame, url: Column, body: Column, status=None, error=None, at=None) -> DataFrame:
    return rows.select(
        url.alias("url"), url.alias("final_url"),
        (F.lit(200) if status is None else status).cast("int").alias("http_status"),
        (F.lit(None) if error is None else error).cast("string").alias("error_kind"),
        body.cast("string").alias("body"),
        (F.lit("2025-01-01 00:00:00") if at is None else at).cast("timestamp").alias("fetched_at"),
    )


def document_captures(spark, sf_dir) -> DataFrame:
    """Every document as a good capture."""
    documents = bodies(spark, sf_dir, "documents", *DOCUMENT)
    return _captured(documents, document_url(), feed_document())


def mixed_captures(spark, sf_dir) -> DataFrame:
    """Every document captured twice, first in vain, then by source (src0 to src4) as:
    timeout, 404, no such host, an HTML page, an empty titled feed, or else the feed."""
    documents = bodies(spark, sf_dir, "documents", *DOCUMENT)
    source = F.col("source")
    page = F.concat(F.lit("<html><head><title>x</title></head><body>"), escaped(F.col("text")), F.lit("</body></html>"))
    body = (
        F.when(source == "src3", page)
        .when(source == "src4", F.lit("<rss><channel><title>Nothing yet</title></channel></rss>"))
        .when(~source.isin("src0", "src1", "src2"), feed_document())
    )
    error = F.when(source == "src0", "timeout").when(source == "src2", "no such host")
    status = F.when(source == "src1", 404).when(error.isNull(), 200)
    return _captured(documents, document_url(), body, status, error).unionByName(
        _captured(table(spark, sf_dir, "documents"), document_url(), F.lit(None), F.lit(500), at=F.lit("2024-12-31 00:00:00"))
    )


def hop_captures(spark, sf_dir) -> DataFrame:
    """A capture per customer, most of which redirect to the one before: each 32nd is a
    document, one in four of those is not found, and one in four was only fetched by another
    address; in one of four such runs the sixth leads back up, so that those above it run in a circle."""
    number = F.col("c_custkey")
    place, run = number % 32, F.floor(number / 32) % 4

    def address(k):
        return F.concat(F.lit("https://r.example.com/"), k.cast("string"))

    document = place == 0
    aside = document & (run == 2)
    to = F.when(document, number).when((place == 5) & (run == 3), number + 3).otherwise(number - 1)
    return table(spark, sf_dir, "customer").select(
        F.when(aside, F.concat(F.lit("https://alias.example.com/"), number.cast("string"))).otherwise(address(number)).alias("url"),
        address(to).alias("final_url"),
        F.when(~document, 301).when(run == 1, 404).otherwise(200).cast("int").alias("http_status"),
        F.lit(None).cast("string").alias("error_kind"),
        F.when(document & (run != 1), F.concat(F.lit("document "), number.cast("string"))).alias("body"),
        F.lit("2025-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )


def moved_captures(spark, sf_dir) -> DataFrame:
    """mixed_captures, and for each document two addresses that lead to its feed one after the other."""
    number = F.col("doc_id").cast("string")
    old, between = F.concat(F.lit("https://old.example.com/"), number), F.concat(F.lit("https://between.example.com/"), number)
    hops = table(spark, sf_dir, "documents").select(F.inline(F.array(
        F.struct(old.alias("url"), between.alias("final_url")), F.struct(between.alias("url"), document_url().alias("final_url")))))
    moved = hops.select(
        "url", "final_url", F.lit(302).alias("http_status"), F.lit(None).cast("string").alias("error_kind"),
        F.lit(None).cast("string").alias("body"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("fetched_at"))
    return mixed_captures(spark, sf_dir).unionByName(moved)


def captured_at(documents: DataFrame, body: Column, at: str) -> DataFrame:
    """documents as good captures with this body at this time."""
    return _captured(documents, document_url(), body, at=F.lit(at))


def document_feeds(spark, sf_dir) -> DataFrame:
    """A feed per document."""
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        F.col("doc_id").alias("feed_id"),
        F.concat(F.lit("Feed "), F.col("doc_id").cast("string")).alias("title"),
        document_url().alias("url"),
        F.lit("").alias("link"),
    )


def document_live(spark, sf_dir) -> DataFrame:
    """Keys of articles already there: those RSS entries whose guid begins with 0 to 7."""
    lines = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("feed_id"), F.explode(F.split("text", "\n")).alias("line")
    )
    keys = lines.select("feed_id", F.md5("line").alias("guid"))
    return keys.filter(F.col("guid") < "8").distinct()


# --- captured sites -------------------------------------------------------------------


def _small_feed(title: Column, atom=False) -> Column:
    if atom:
        return F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>'), title, F.lit("</title></feed>"))
    return F.concat(F.lit('<rss version="2.0"><channel><title>'), title, F.lit("</title></channel></rss>"))


def roots(spark, sf_dir) -> DataFrame:
    """(root, home_id, html): each root with its page of the lowest page_id."""
    pages = table(spark, sf_dir, "pages").select(site_root(F.col("url")).alias("root"), "page_id", "html")
    return pages.groupBy("root").agg(
        F.min("page_id").alias("home_id"), F.min_by("html", "page_id").alias("html")
    )


def page_kind() -> Column:
    """By the address of the page: two feeds in its link tags, one, the page is down, it is
    itself a feed, or none of these."""
    url = F.col("url")
    return (
        F.when(F.contains(url, F.lit("?page=")), "two").when(F.contains(url, F.lit(".html")), "one")
        .when(F.contains(url, F.lit("#top")), "down").when(F.contains(url, F.lit("utm_source")), "feed")
        .otherwise("none")
    )


def linked_page() -> Column:
    """The page with the link tags of its kind in its head, among others that are no feeds."""
    number = F.col("page_id").cast("string")
    one = F.concat(
        F.lit('<link rel="alternate" type="application/rss+xml" title="RSS '), number,
        F.lit('" href="/p/'), number, F.lit('/rss">'),
    )
    two = F.lit('<LINK REL="home alternate" TYPE="Application/Atom+XML" HREF="atom.xml">')
    other = F.lit('<link rel="stylesheet" type="text/css" href="/s.css"><link rel="alternate" type="application/rss+xml">')
    kind = page_kind()
    tags = F.when(kind == "two", F.concat(one, two)).when(kind == "one", one).otherwise(F.lit(""))
    return F.replace(F.col("html"), F.lit("</head>"), F.concat(other, tags, F.lit("</head>")))


def site_captures(spark, sf_dir) -> DataFrame:
    """Captures of all pages, and of the well-known paths, sitemaps and feeds around them.

    Pages are as page_kind has it; the feeds their link tags name are good for English
    pages. Roots: m. has two feeds, an HTML page and a 404 at well-known paths; blog. and
    www. have a sitemap, the latter a broken one; others have nothing.
    """
    pages = bodies(spark, sf_dir, "pages", "page_id", "url", "html")
    number = F.col("page_id").cast("string")
    kind = page_kind()
    body = F.when(kind == "feed", _small_feed(F.concat(F.lit("Page "), number))).when(kind != "down", linked_page())
    page_rows = _captured(pages, F.col("url"), body, F.when(kind == "down", 404).otherwise(200))

    english = F.contains(F.col("url"), F.lit("/en/"))
    link_rows = _captured(
        table(spark, sf_dir, "pages"), F.concat(site_root(F.col("url")), F.lit("/p/"), number, F.lit("/rss")),
        F.when(english, _small_feed(F.concat(F.lit("Linked "), number))).otherwise("<p>gone</p>"),
    )

    home = roots(spark, sf_dir)
    path = F.explode(F.array(*[F.lit(p) for p in ("/feed", "/atom.xml", "/rss.xml", "/index.xml")])).alias("path")
    probed = home.filter(F.contains("root", F.lit("://m."))).select("root", path)
    known_rows = _captured(
        probed, F.concat("root", "path"),
        F.when(F.col("path") == "/feed", _small_feed(F.lit("Site feed")))
        .when(F.col("path") == "/atom.xml", _small_feed(F.lit("Site feed, Atom"), atom=True))
        .when(F.col("path") == "/index.xml", "<html><title>x</title></html>"),
        F.when(F.col("path") == "/rss.xml", 404).otherwise(200),
    )

    blog = F.contains("root", F.lit("://blog."))
    mapped = home.filter(blog | F.contains("root", F.lit("://www.")))
    href = F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), F.lit(1))
    extra = F.array(*[F.lit(x) for x in ("/feedback", "/news/feed.xml", "/x?y=/rss", "/News/FEED.xml", "/news/feed.xml", "/a/atom")])
    locs = F.array_join(F.transform(
        F.concat(href, extra), lambda x: F.concat(F.lit("<url><loc> "), F.col("root"), x, F.lit("\n</loc></url>"))
    ), "")
    end = F.when(blog, "</urlset>").otherwise("<url><loc>")
    map_rows = _captured(
        mapped, F.concat("root", F.lit("/sitemap.xml")),
        F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), locs, end),
    )
    path = F.explode(F.array(*[F.lit(p) for p in ("/feedback", "/news/feed.xml", "/a/atom")])).alias("path")
    map_feed_rows = _captured(
        mapped.select("root", path), F.concat("root", "path"),
        F.when(F.col("path") == "/news/feed.xml", _small_feed(F.lit("News")))
        .when(F.col("path") == "/a/atom", _small_feed(F.lit("Notes"), atom=True))
        .otherwise("<html><title>Tell us</title></html>"),
    )
    return (
        page_rows.unionByName(link_rows).unionByName(known_rows)
        .unionByName(map_rows).unionByName(map_feed_rows)
    )


def sites(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("url").alias("site_url"))
