"""Feed documents to feeds and entries.

Well-formed documents are parsed by from_xml inside the JVM. The rest, and documents whose
root carries a namespace prefix, go through the lenient reader; for all other rows that
reader gets null. Both give the same raw shape, so each rule below exists once.

Rules, "absent" meaning that the element is not there (an empty element is there):
 guid     id or guid, if absent the link, if absent ''
 title    if absent 'Untitled' (feed: its URL)
 link     if absent the guid of an RSS item unless marked as no permalink, else ''
 author   last author; may be null
 date     published, else updated, else null
 summary  if not empty the summary, else the first content, else ''
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedskein.functions import wording as W
from feedskein.functions.dates import first_date
from feedskein.functions.markup import ENTRY, FEED, broken_feed
from feedskein.functions.text import blank_to_null, feed_type, root_name, strip
from feedskein.operators.skew import spread_join
from feedskein.sources.captures import failure

# Root elements of feed documents, and those of them from_xml can read as they are.
FEED_ROOTS = ["rss", "rdf", "feed"]
STRICT_ROOTS = ["rss", "rdf:RDF", "feed"]

_CORRUPT = "_corrupt"
_DOCUMENT = T.StructType([
    T.StructField("channel", T.StructType([
        T.StructField("title", T.StringType()),
        T.StructField("link", FEED["link"].dataType),
        T.StructField("item", T.ArrayType(ENTRY)),
    ])),
    T.StructField("title", T.StringType()),
    T.StructField("link", FEED["link"].dataType),
    T.StructField("item", T.ArrayType(ENTRY)),
    T.StructField("entry", T.ArrayType(ENTRY)),
    T.StructField(_CORRUPT, T.StringType()),
])


def _strict_feed(document: Column) -> Column:
    none = F.array().cast(T.ArrayType(ENTRY))
    # RSS 2.0 has items in the channel, RSS 1.0 beside it, Atom has entries: one is filled
    return F.struct(
        F.coalesce(document["channel"]["title"], document["title"]).alias("title"),
        F.coalesce(document["channel"]["link"], document["link"]).alias("link"),
        F.concat(
            F.coalesce(document["channel"]["item"], none),
            F.coalesce(document["item"], none),
            F.coalesce(document["entry"], none),
        ).alias("entries"),
    )


def parse_documents(captures: DataFrame, body="body", verdict=None) -> DataFrame:
    """captures without the body, plus
    `feed` (title, link, entries as they stand in the document; null if it is no feed),
    `well_formed`, `feed_type`, and in the column `verdict`, if named, whether from_xml read it."""
    others = [c for c in captures.columns if c != body]
    text = F.col(body)
    root = root_name(text)
    local_root = F.lower(F.substring_index(root, ":", -1))
    staged = captures.select(
        *others, body, root.alias("_root"), local_root.isin(FEED_ROOTS).alias("_is_feed")
    ).select(
        *others,
        feed_type(text).alias("feed_type"), _ends_with_root(text, F.col("_root")).alias("_ends"),
        F.when(F.col("_is_feed"), text).alias("_text"),
        F.from_xml(
            F.when(F.col("_is_feed") & F.col("_root").isin(STRICT_ROOTS), text),
            _DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT},
        ).alias("_document"),
    )
    document = F.col("_document")
    parsed = document.isNotNull() & document[_CORRUPT].isNull() & F.col("_ends")
    staged = staged.select(
        *others, "feed_type", F.col("_text").isNotNull().alias("_is_feed"),
        parsed.alias("_parsed"), _strict_feed(document).alias("_strict"),
        broken_feed(F.when(~parsed, F.col("_text"))).alias("_lenient"),
    )
    lenient = F.col("_lenient")
    strict = F.col("_parsed") & F.col("_is_feed")
    return staged.select(
        *others, "feed_type",
        (F.col("_is_feed") & (F.col("_parsed") | F.coalesce(lenient["well_formed"], F.lit(False)))).alias("well_formed"),
        F.when(strict, F.col("_strict"))
        .when(lenient.isNotNull(), F.struct(*[lenient[f.name].alias(f.name) for f in FEED])).alias("feed"),
        *([strict.alias(verdict)] if verdict else []),
    )


def _ends_with_root(text: Column, root: Column) -> Column:
    """Whether nothing but blanks, comments and instructions follows the last end tag of the
    root, or there is no such tag. from_xml stops at the root's end and sees nothing of it."""
    end = F.concat(F.lit("</"), root)
    rest = F.call_function("substring_index", text, end, F.lit(-1))
    fits = F.rlike(rest, F.lit(r"(?s)\A\s*+>(?:\s++|<!--(?:(?!-->).)*+-->|<\?(?:(?!\?>).)*+\?>)*+\z"))
    return F.coalesce(~F.contains(text, end) | fits, F.lit(False))


def html_link(links: Column) -> Column:
    """The feed's or entry's page: text of a link element, or href of the last alternate
    link to HTML. '' for an empty element, null where there is none."""
    fits = F.filter(
        links,
        lambda x: F.when(
            x["_href"].isNotNull(),
            F.coalesce(x["_rel"], F.lit("alternate")).eqNullSafe("alternate")
            & F.coalesce(x["_type"], F.lit("text/html")).isin("text/html", "application/xhtml+xml"),
        ).otherwise(x["_rel"].isNull()),
    )
    last = F.try_element_at(fits, F.lit(-1))
    return F.when(F.size(fits) > 0, strip(F.coalesce(last["_href"], last["_VALUE"], F.lit(""))))


def malformed() -> Column:
    """No entries, and not well-formed or without a title. Holds for non-feeds too."""
    feed = F.col("feed")
    empty = F.coalesce(F.size(feed["entries"]), F.lit(0)) <= 0
    untitled = F.coalesce(strip(feed["title"]), F.lit("")) == ""
    return empty & (~F.coalesce(F.col("well_formed"), F.lit(False)) | untitled)


def malformed_message(url: Column) -> Column:
    return F.format_string(W.MALFORMED, url)


def feed_info(parsed: DataFrame) -> DataFrame:
    """parsed with `title` and `link` of each feed instead of the feed itself."""
    others = [c for c in parsed.columns if c not in ("feed", "well_formed")]
    return parsed.select(
        *others,
        F.coalesce(strip(F.col("feed.title")), F.col("url")).alias("title"),
        F.coalesce(html_link(F.col("feed.link")), F.lit("")).alias("link"),
    )


def entries(parsed: DataFrame, *keep: str, outer=False) -> DataFrame:
    """One row per entry: the columns `keep` of parsed, `pos` and the article columns.
    outer keeps a row with null pos and guid for a feed without entries."""
    # always the outer form: the inner one would add a filter below that parses once more
    rows = parsed.select(*keep, F.posexplode_outer("feed.entries").alias("pos", "entry"))
    if not outer:
        rows = rows.filter(F.col("pos").isNotNull())
    entry = F.col("entry")
    guid = F.try_element_at(entry["guid"], F.lit(-1))
    rows = rows.select(
        *keep, "pos", "entry",
        F.when(
            F.size(entry["guid"]) > 0, strip(F.coalesce(guid["_VALUE"], F.lit("")))
        ).alias("_guid"),
        (F.coalesce(F.lower(guid["_isPermaLink"]), F.lit("true")) == "true").alias("_permalink"),
        html_link(entry["link"]).alias("_link"),
        F.try_element_at(entry["author"], F.lit(-1)).alias("_author"),
        (F.size(entry["author"]) > 0).alias("_has_author"),
    )
    author = F.col("_author")
    person = F.when(
        author["email"].isNotNull() & author["name"].isNotNull(),
        F.concat(strip(author["name"]), F.lit(" ("), strip(author["email"]), F.lit(")")),
    ).otherwise(strip(F.coalesce(author["name"], author["_VALUE"], author["email"])))
    content = F.coalesce(
        F.try_element_at(entry["content"], F.lit(1)),
        F.try_element_at(entry["content:encoded"], F.lit(1)),
    )
    link = F.coalesce("_link", F.when(F.col("_permalink"), F.col("_guid")), F.lit(""))
    return rows.select(
        *keep,
        F.col("pos").cast("long").alias("pos"),
        F.when(
            F.col("pos").isNotNull(),
            F.coalesce("_guid", strip(entry["id"]), strip(entry["_rdf:about"]), link),
        ).alias("guid"),
        F.coalesce(strip(entry["title"]), F.lit(W.UNTITLED)).alias("title"),
        link.alias("link"),
        F.coalesce(
            F.when(F.col("_has_author"), F.coalesce(person, F.lit(""))), strip(entry["dc:creator"])
        ).alias("author"),
        first_date(
            "coalesce(entry.pubDate, entry.published, entry.issued)",
            "coalesce(entry.updated, entry.modified, entry.`dc:date`)",
        ).alias("published"),
        F.coalesce(
            blank_to_null(strip(F.coalesce(entry["description"], entry["summary"]))),
            strip(content), F.lit(""),
        ).alias("summary"),
    )


def parse_feeds(captures: DataFrame) -> DataFrame:
    """Captures parsed: parse_documents plus `error`, the message of a failed fetch or of
    malformed content, null for a good feed. Failed fetches are not parsed."""
    columns = [c for c in captures.columns if c != "body"]
    staged = captures.withColumn("_failure", failure())
    fetched = staged.withColumn("body", F.when(F.col("_failure").isNull(), F.col("body")))
    parsed = parse_documents(fetched)
    error = F.coalesce(F.col("_failure"), F.when(malformed(), malformed_message(F.col("url"))))
    return parsed.withColumn("error", error).select(
        *columns, "feed", "well_formed", "feed_type", "error"
    )


def entries_to_articles(entry_rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """Entries with `url` to new, unread articles of the feed subscribed at that url."""
    ids = feeds.select("feed_id", "url")
    return (
        spread_join(entry_rows, ids, "url").drop("url")
        .withColumn("is_read", F.lit(False)).withColumn("is_favorite", F.lit(False))
    )
