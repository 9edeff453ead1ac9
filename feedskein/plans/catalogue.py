"""The registered queries: name -> function of (spark, sf_dir). Their SQL is in oracles.py."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedskein.functions.dates import parse_date
from feedskein.functions.text import feed_type
from feedskein.operators import articles as A
from feedskein.operators import discovery as D
from feedskein.operators import documents as P
from feedskein.operators import feeds as T
from feedskein.operators import keyfilter as K
from feedskein.operators import listing as Q
from feedskein.operators import reading as H
from feedskein.operators import redirects as N
from feedskein.operators import segments as G
from feedskein.operators import splitting as V
from feedskein.plans import refresh as R
from feedskein.plans import subscribe
from feedskein.schemas import ARTICLE_CONTENT, ARTICLE_KEY, ARTICLES, FEEDS, OBSERVATIONS
from feedskein.session import estimated_bytes, limit_arrow_rows, scratch_dir, written
from feedskein.sources import archives, tables
from feedskein.sources import captures as C
from feedskein.sources import samples as S
from feedskein.streaming import articles as keyed
from feedskein.streaming import logs
from feedskein.streaming import refresh as streaming

QUERIES = {}


def query(function):
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        limit_arrow_rows(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


def _longs(frame, *columns):
    return frame.withColumns({c: F.col(c).cast("long") for c in columns})


# --- lists ------------------------------------------------------------------------------


@query
def feed_list_unread(spark, d):
    return Q.list_feeds(S.feeds(spark, d), S.articles(spark, d))


@query
def articles_all(spark, d):
    return Q.view(S.feeds(spark, d), S.articles(spark, d), "all")


@query
def articles_all_top(spark, d):
    """The fifty newest articles."""
    return Q.article_page(S.feeds(spark, d), S.articles(spark, d), 50)


@query
def articles_next_page(spark, d):
    """The fifty after those."""
    feeds, articles = S.feeds(spark, d), S.articles(spark, d)
    last = Q.article_page(feeds, articles, 50).orderBy(F.asc_nulls_first("published"), F.desc("feed_id"), F.desc("guid")).first()
    return Q.article_page(feeds, articles, 50, last and (last["published"], last["feed_id"], last["guid"]))


@query
def articles_newest_per_feed(spark, d):
    return _longs(Q.newest_per_feed(S.feeds(spark, d), S.articles(spark, d), 3), "rank")


@query
def articles_by_feed(spark, d):
    return Q.view(S.feeds(spark, d), S.articles(spark, d), 7)


@query
def articles_unread(spark, d):
    return Q.list_articles(S.feeds(spark, d), S.articles(spark, d), unread_only=True)


@query
def articles_favorites(spark, d):
    return Q.view(S.feeds(spark, d), S.articles(spark, d), "favorites")


@query
def articles_unread_favorites(spark, d):
    feeds, articles = S.feeds(spark, d), S.state_articles(spark, d)
    return Q.list_articles(feeds, articles, unread_only=True, favorites_only=True)


@query
def article_rows(spark, d):
    return Q.article_rows(Q.list_articles(S.feeds(spark, d), S.articles(spark, d)), "feed_id", "guid")


@query
def feed_labels(spark, d):
    return _longs(Q.feed_labels(Q.list_feeds(S.feeds(spark, d), S.articles(spark, d), ordered=False)), "section")


@query
def detail_meta(spark, d):
    listed = Q.list_articles(S.feeds(spark, d), S.articles(spark, d), ordered=False)
    return Q.article_details(listed, "feed_id", "guid")


@query
def article_view(spark, d):
    listed = Q.list_articles(S.feeds(spark, d), S.articles(spark, d), ordered=False)
    with_link = listed.withColumn("summary", F.concat(
        "summary", F.lit('<p>See <a href=" '), "link", F.lit(' ">the <b>original</b></a> &amp; <a href="/all">')
    ))
    opened = H.open_articles(Q.article_details(with_link, "feed_id", "guid"))
    return opened.withColumn("links", F.array_join("links", "\n"))


# --- state ------------------------------------------------------------------------------


@query
def ingest_dedup(spark, d):
    return A.first_observations(S.observations(spark, d)).select(*ARTICLE_KEY, *ARTICLE_CONTENT, "pos")


@query
def ingest_new_only(spark, d):
    seen = S.observations(spark, d)
    live = seen.filter(F.col("event_type") == "view").select(*ARTICLE_KEY).distinct()
    return A.new_articles(A.new_observations(seen, live))


@query
def ingest_filtered(spark, d):
    """The same through bitmaps of the keys: an index of the live articles, kept by two appends."""
    seen = S.observations(spark, d)
    live = seen.filter(F.col("event_type") == "view").select(*ARTICLE_KEY).distinct()
    slots = K.slots_for(live.count())
    halves = [K.key_bits(live.filter(half), slots) for half in (F.col("guid") < "8", F.col("guid") >= "8")]
    index = K.merged_bits(halves[0].unionByName(halves[1]))
    return A.new_articles(K.new_observations(seen, live, index, slots))


@query
def ingest_rejects(spark, d):
    seen = S.observations(spark, d).select(
        F.when(F.col("event_type") != "signup", F.col("feed_id") * 20).alias("feed_id"),
        "guid",
        F.when(F.col("event_type") != "error", F.col("title")).alias("title"),
        "link", "author", "published",
        F.when(F.col("event_type") != "purchase", F.col("summary")).alias("summary"),
        "fetched_at", "pos",
    )
    return A.check_constraints(seen, S.feeds(spark, d)).select("pos", "feed_id", "guid", "reject_reason")


@query
def state_fold(spark, d):
    return A.fold_state(S.state_observations(spark, d), S.state_actions(spark, d))


@query
def state_from_segments(spark, d):
    """The same from a snapshot of the first half of the log and two segments of the rest."""
    seen, done = S.state_observations(spark, d), S.state_actions(spark, d)
    bounds = S.table(spark, d, "events").agg(F.percentile_approx("ts", [0.3, 0.5, 0.8])).first()[0]  # three times

    def within(rows, column, low, high):
        after = F.lit(True) if low is None else F.col(column) > F.lit(low)
        return rows.filter(after & (F.lit(True) if high is None else F.col(column) <= F.lit(high)))

    effects = [
        G.segment_effects(within(seen, "fetched_at", low, high), within(done, "at", low, high), number)
        for number, (low, high) in enumerate(zip([None, *bounds], [*bounds, None]))
    ]
    snapshot = written(G.combined(effects[0].unionByName(effects[1])), "snapshot")
    return G.articles_of(G.combined(snapshot.unionByName(effects[2]).unionByName(effects[3])), seen)


@query
def state_fold_tombstones(spark, d):
    return A.fold_state(S.state_observations(spark, d), S.state_actions(spark, d), tombstones=True)


@query
def actions_applied(spark, d):
    return A.apply_actions(S.state_articles(spark, d), S.state_actions(spark, d))


# --- tables -----------------------------------------------------------------------------


@query
def schema_migration(spark, d):
    old = S.articles(spark, d).drop("is_favorite")
    return tables.upgrade(old, ARTICLES).drop("id")


@query
def articles_table(spark, d):
    path = scratch_dir(spark, "articles")
    tables.create_if_missing(spark, path)
    numbered = tables.number_rows(S.articles(spark, d), "id", ARTICLE_KEY)
    tables.write_articles(numbered, path)
    return tables.read_articles(spark, path).drop("id")


@query
def articles_appended(spark, d):
    """Articles in two appends, with how many share the id and whether the second ones come after."""
    path = scratch_dir(spark, "articles")
    tables.create_if_missing(spark, path)
    articles = S.articles(spark, d)
    first = F.col("guid") < "8"
    tables.append_articles(articles.filter(first), path)
    top = tables.read_articles(spark, path).agg(F.max("id")).first()[0] or 0  # one number
    tables.append_articles(articles.filter(~first), path)
    stored = tables.read_articles(spark, path)
    return stored.withColumns({
        "of_this_id": F.count("guid").over(Window.partitionBy("id")), "is_later": F.col("id") > top}).drop("id")


@query
def article_ids(spark, d):
    numbered = tables.number_rows(S.articles(spark, d), "id", ARTICLE_KEY, after=100)
    return numbered.agg(
        F.count(F.lit(1)).alias("articles"), F.min("id").alias("lowest"), F.max("id").alias("highest"),
        F.count_distinct("id").alias("ids"),
    )


def _feed_requests(spark, d):
    """An order asks for the feed of twice its customer's number; some without a title."""
    address = F.concat(F.lit("https://feeds.example.com/"), (F.col("o_custkey") * 2).cast("string"))
    return S.table(spark, d, "orders").select(
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).alias("title"),
        F.concat(address, F.lit("/feed.xml")).alias("url"),
        F.when(F.col("o_orderstatus") == "F", address).alias("link"),
        F.col("o_orderkey").alias("seq"),
    )


@query
def feeds_added(spark, d):
    return T.judge_requests(S.feeds(spark, d), _feed_requests(spark, d))


@query
def feeds_table(spark, d):
    """The feeds after adding: written, read back, numbered after the highest id."""
    feeds = S.feeds(spark, d)
    top = feeds.agg(F.max("feed_id")).first()[0] or 0  # one number
    new = T.feeds_to_add(feeds, _feed_requests(spark, d))
    numbered = tables.number_rows(new, "feed_id", ["url"], after=top)
    path = scratch_dir(spark, "feeds")
    tables.create_if_missing(spark, path)
    tables.write_feeds(feeds.unionByName(numbered), path)
    return tables.read_feeds(spark, path).select(
        "title", "url", "link", (F.col("feed_id") > top).alias("is_new")
    )


@query
def feeds_readded(spark, d):
    """The feed of the highest id is removed, then feeds are added twice: their ids go on after it."""
    path = scratch_dir(spark, "feeds")
    tables.write_feeds(S.feeds(spark, d), path)
    feeds = S.feeds(spark, d)
    top = feeds.agg(F.max("feed_id")).first()[0] or 0  # one number
    last = feeds.filter(F.col("feed_id") == top).select("feed_id")
    tables.remove_rows(spark, path, FEEDS, last)
    new = T.feeds_to_add(feeds, _feed_requests(spark, d))
    even = F.pmod(F.length("title"), F.lit(2)) == 0
    tables.append_feeds(new.filter(even), path)
    tables.append_feeds(new.filter(~even), path)
    return tables.read_feeds(spark, path).select(
        "title", "url", "link", (F.col("feed_id") > top).alias("is_new"),
        F.count("url").over(Window.partitionBy("feed_id")).alias("of_this_id"),
    )


@query
def feeds_removed_stored(spark, d):
    """Feeds and articles left in the stored tables, whose buckets of removed feeds were rewritten."""
    folder = scratch_dir(spark, "tables")
    tables.create_tables(spark, folder)
    tables.write_feeds(_segment_feeds(spark, d), f"{folder}/feeds")
    tables.append_articles(S.articles(spark, d), f"{folder}/articles")
    gone = T.find_feeds(_segment_feeds(spark, d), _selectors(spark, d)).filter(F.col("feed_id").isNotNull())
    tables.remove_stored_feeds(spark, folder, gone)
    feeds, articles = tables.read_feeds(spark, f"{folder}/feeds"), tables.read_articles(spark, f"{folder}/articles")
    return feeds.select("feed_id", F.lit(None).cast("string").alias("guid")).unionByName(articles.select(*ARTICLE_KEY))


@query
def feeds_url_exists(spark, d):
    return T.urls_exist(S.feeds(spark, d), _feed_requests(spark, d).select("url"))


def _selectors(spark, d):
    customers = S.table(spark, d, "customer")
    number = F.col("c_custkey").cast("string")
    segment = F.col("c_mktsegment")
    return customers.select(
        F.when(segment == "AUTOMOBILE", F.col("c_name"))
        .when(segment == "BUILDING", F.concat(F.lit(" "), number, F.lit(" ")))
        .when(segment == "FURNITURE", F.concat(F.lit("+"), number))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("nobody "), number))
        .otherwise(number).alias("selector")
    ).unionByName(customers.select(segment.alias("selector")))


def _segment_feeds(spark, d):
    """Feeds of which many share a title."""
    return S.table(spark, d, "customer").select(
        F.col("c_custkey").alias("feed_id"),
        F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("title"),
        F.concat(F.lit("https://feeds.example.com/"), F.col("c_custkey").cast("string")).alias("url"),
        F.lit("").alias("link"),
    )


@query
def feeds_lookup(spark, d):
    return T.lookup_feeds(_segment_feeds(spark, d), _selectors(spark, d))


@query
def feeds_removed_cascade(spark, d):
    """Feeds and articles left, the former with null guid."""
    feeds, articles, _ = T.remove_feeds(
        _segment_feeds(spark, d), S.articles(spark, d), selectors=_selectors(spark, d)
    )
    return feeds.select("feed_id", F.lit(None).cast("string").alias("guid")).unionByName(articles.select(*ARTICLE_KEY))


@query
def feeds_removed_outcome(spark, d):
    return T.remove_feeds(_segment_feeds(spark, d), S.articles(spark, d), selectors=_selectors(spark, d))[2]


# --- captures and parsing ---------------------------------------------------------------


@query
def capture_outcomes(spark, d):
    return _longs(C.capture_outcomes(S.mixed_captures(spark, d)).select("url", "http_status", "error"), "http_status")


@query
def capture_files(spark, d):
    """Captures written as JSON lines by a crawler, read with the schema."""
    path = scratch_dir(spark, "captures")
    S.mixed_captures(spark, d).write.json(path)
    read = C.read_captures(spark, path, "json")
    return read.select(
        "url", "final_url", F.col("http_status").cast("long").alias("http_status"), "error_kind",
        F.col("body").isNotNull().alias("has_body"), F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"),
    )


@query
def capture_archives(spark, d):
    """The same from crawl archives."""
    path = scratch_dir(spark, "archives")
    archives.register_archives(spark)
    S.mixed_captures(spark, d).write.format(archives.NAME).mode("append").save(path)
    read = spark.read.format(archives.NAME).option("split_bytes", 1 << 20).load(path)
    return read.select(
        "url", "final_url", F.col("http_status").cast("long").alias("http_status"), "error_kind",
        F.col("body").isNotNull().alias("has_body"), F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"),
    )


@query
def capture_latest(spark, d):
    last = C.latest_captures(S.mixed_captures(spark, d).drop("body"))
    return _longs(last.select("url", "http_status", "error_kind"), "http_status")


@query
def page_captures(spark, d):
    return C.page_captures(S.sites(spark, d), S.site_captures(spark, d))


@query
def parse_entries(spark, d):
    return P.entries(P.parse_feeds(S.document_captures(spark, d)), "url")


SMALL_PARTS = {"split_bytes": 1000, "part_bytes": 500}  # so that the documents of the tables are cut


@query
def parse_entries_in_parts(spark, d):
    """The entries of feed documents that are cut at their entries."""
    return V.part_entries(V.parse_feed_parts(S.document_captures(spark, d), **SMALL_PARTS), "url")


@query
def parse_rejects_in_parts(spark, d):
    parsed = V.parse_feed_parts(S.mixed_captures(spark, d), **SMALL_PARTS).filter("part = 0")
    return parsed.select("url", F.col("http_status").cast("long").alias("http_status"), "error")


@query
def parse_feed_info(spark, d):
    parsed = P.parse_feeds(S.document_captures(spark, d))
    return P.feed_info(parsed).select("url", "title", "link", "feed_type")


@query
def parse_articles(spark, d):
    rows = P.entries(P.parse_feeds(S.document_captures(spark, d)), "url")
    return P.entries_to_articles(rows, S.document_feeds(spark, d))


@query
def parse_rejects(spark, d):
    parsed = P.parse_feeds(S.mixed_captures(spark, d))
    return parsed.select("url", F.col("http_status").cast("long").alias("http_status"), "error")


@query
def fetch_and_parse(spark, d):
    """The feed documents and as many addresses that nobody captured."""
    known = S.document_feeds(spark, d).select("url")
    wanted = known.unionByName(known.select(F.replace("url", F.lit("/feed.xml"), F.lit("/gone.xml")).alias("url")))
    parsed = R.fetch_and_parse(wanted, S.mixed_captures(spark, d))
    return parsed.select("url", "error", F.when(F.col("feed").isNotNull(), F.size("feed.entries")).otherwise(0).cast("long").alias("entries"))


@query
def redirects_followed(spark, d):
    followed = N.follow_redirects(S.hop_captures(spark, d))
    return _longs(followed.select("url", "final_url", "http_status", "error_kind", "body"), "http_status")


@query
def fetch_redirected(spark, d):
    """The feed documents by addresses that redirect to them."""
    number = F.col("doc_id").cast("string")
    wanted = S.table(spark, d, "documents").select(F.concat(F.lit("https://old.example.com/"), number).alias("url"))
    parsed = R.fetch_and_parse(wanted, N.follow_redirects(S.moved_captures(spark, d)))
    return parsed.select("url", "error", F.when(F.col("feed").isNotNull(), F.size("feed.entries")).otherwise(0).cast("long").alias("entries"))


@query
def feed_types(spark, d):
    return S.table(spark, d, "documents").select("doc_id", feed_type(S.feed_document()).alias("feed_type"))


@query
def parse_dates(spark, d):
    second = F.date_trunc("second", "ts")
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(F.date_format(second, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(kind == "click", F.concat(F.lit("Mon, "), F.date_format(second, "d MMM yy HH:mm:ss"), F.lit(" EST")))
        .when(kind == "purchase", F.concat(F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".5+02:00")))
        .when(kind == "signup", F.date_format(second, "EEE MMM dd HH:mm:ss yyyy"))
        .when(F.col("value") < 20, F.date_format(second, "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("sometime in "), F.date_format(second, "yyyy")))
    )
    return S.table(spark, d, "events").select("event_id", text.alias("text")).select(
        "event_id", parse_date("text").alias("published")
    )


# --- refresh ----------------------------------------------------------------------------


def _refresh_rows(spark, d, feeds=None, content=False):
    feeds = S.document_feeds(spark, d) if feeds is None else feeds
    return R.refresh_rows(feeds, S.mixed_captures(spark, d), S.document_live(spark, d), content)


@query
def refresh_articles(spark, d):
    return R.new_rows(_refresh_rows(spark, d, content=True)).drop("fetched_at")


@query
def refresh_report(spark, d):
    return R.feed_report(_refresh_rows(spark, d))


@query
def refresh_summary(spark, d):
    return R.refresh_summary(R.feed_report(_refresh_rows(spark, d)))


@query
def refresh_one(spark, d):
    """The feeds that titles (French documents) and ids (German ones) name."""
    number = F.col("doc_id").cast("string")
    selectors = S.table(spark, d, "documents").filter(F.col("lang").isin("fr", "de")).select(
        F.when(F.col("lang") == "fr", F.concat(F.lit("Feed "), number)).otherwise(number).alias("selector")
    )
    feeds = R.selected_feeds(S.document_feeds(spark, d), selectors)
    return R.feed_report(_refresh_rows(spark, d, feeds))


@query
def refresh_feed_info(spark, d):
    return R.updated_feeds(S.document_feeds(spark, d), S.mixed_captures(spark, d))


FILE_BYTES = 32 * 1024 * 1024  # of documents, which come to several times as much as feeds


def _write_captures(spark, d, captures, folder):
    """The captures as files of a bounded size, four at least; those of one address lie in one
    file. Gives how many files are half of them, for a stream in two micro-batches."""
    documents = estimated_bytes(S.table(spark, d, "documents")) or 0
    files = max(4, 2 * -(-documents // (2 * FILE_BYTES)))
    captures.repartition(files, "url").write.option("compression", "zstd").parquet(f"{folder}/captures")
    return files // 2


@query
def refresh_stream(spark, d):
    """All captures through the stream, in several micro-batches, then the stored state."""
    folder = scratch_dir(spark, "stream")
    half = _write_captures(spark, d, S.mixed_captures(spark, d), folder)
    arriving = C.stream_captures(spark, f"{folder}/captures", files_per_batch=half)
    streaming.start_refresh(arriving, S.document_feeds(spark, d), folder).awaitTermination()
    return streaming.stored_articles(spark, folder)


def _later_captures(spark, d):
    """The feeds of documents captured once more, two days later, under another title."""
    documents = S.table(spark, d, "documents").filter(F.col("source") == "src7")
    body = F.concat(
        F.lit('<rss version="2.0"><channel><title>L</title><item><title>Later</title><guid>'),
        F.md5(F.element_at(F.split("text", "\n"), 1)), F.lit("</guid></item></channel></rss>"))
    return S.captured_at(documents, body, "2025-01-03 00:00:00")


def _late_actions(spark, d):
    """On the first entry of each feed: deleted between the two captures, then read after them."""
    keys = S.table(spark, d, "documents").select(
        F.col("doc_id").alias("feed_id"), F.md5(F.element_at(F.split("text", "\n"), 1)).alias("guid"))
    done = F.explode(F.array(
        F.struct(F.lit("delete").alias("action"), F.lit("2025-01-02 00:00:00").cast("timestamp").alias("at")),
        F.struct(F.lit("read").alias("action"), F.lit("2025-01-04 00:00:00").cast("timestamp").alias("at")),
    )).alias("done")
    return keys.select("*", done).select("feed_id", "guid", "done.action", "done.at", F.col("feed_id").alias("seq"))


def _streamed(spark, d):
    folder = scratch_dir(spark, "stream")
    captures = S.mixed_captures(spark, d).unionByName(_later_captures(spark, d))
    half = _write_captures(spark, d, captures, folder)
    arriving = C.stream_captures(spark, f"{folder}/captures", files_per_batch=half)
    streaming.start_refresh(arriving, S.document_feeds(spark, d), folder).awaitTermination()
    return folder


@query
def refresh_stream_actions(spark, d):
    """Captures through the stream, then actions that come late: deletes from between the captures."""
    folder = _streamed(spark, d)
    logs.append_actions(_late_actions(spark, d), folder)
    return streaming.stored_articles(spark, folder)


@query
def stored_after_removal(spark, d):
    """The same stored state after feeds are removed."""
    folder = _streamed(spark, d)
    logs.append_actions(_late_actions(spark, d), folder)
    gone = S.table(spark, d, "documents").filter(F.col("lang") == "fr").select(F.col("doc_id").alias("feed_id"))
    logs.append_removals(gone, folder)
    return streaming.stored_articles(spark, folder)


def _keyed(spark, d):
    """Captures and actions through the keyed stream, in several micro-batches of each, so that
    deletes come before and after the captures they lie between; and some actions twice."""
    folder = scratch_dir(spark, "keyed")
    captures = S.mixed_captures(spark, d).unionByName(_later_captures(spark, d))
    half = _write_captures(spark, d, captures, folder)
    actions = _late_actions(spark, d)
    logs.append_actions(actions.repartition(4, "guid"), folder)
    logs.append_actions(actions.filter("feed_id % 3 = 0").repartition(1), folder)  # one file, read by many tasks
    arriving = C.stream_captures(spark, f"{folder}/captures", files_per_batch=half)
    keyed.start_articles(arriving, S.document_feeds(spark, d), folder, lateness="30 days", files_per_batch=2).awaitTermination()
    return folder


@query
def keyed_articles(spark, d):
    """The articles that the keyed stream holds as state."""
    return keyed.current_articles(spark, _keyed(spark, d))


@query
def keyed_feed_list(spark, d):
    """The feed list from the changes of unread counts, after feeds are removed."""
    folder = _keyed(spark, d)
    gone = S.table(spark, d, "documents").filter(F.col("lang") == "fr").select(F.col("doc_id").alias("feed_id"))
    logs.append_removals(gone, folder)
    return keyed.feed_list(S.document_feeds(spark, d), folder)


# --- article HTML -----------------------------------------------------------------------


@query
def page_links(spark, d):
    return H.link_lines(H.article_links(S.bodies(spark, d, "pages", "page_id", "url", "html"), base="url")).drop("url")


@query
def page_text(spark, d):
    return H.html_to_text(S.bodies(spark, d, "pages", "page_id", "html"))


# --- discovery --------------------------------------------------------------------------


def _digest(spark, d):
    return written(D.capture_digest(S.site_captures(spark, d)), "digest")


@query
def discover_link_tags(spark, d):
    pages = S.table(spark, d, "pages").select(
        "page_id", D.page_feeds(S.linked_page(), F.col("url")).alias("feeds")
    )
    found = pages.select("page_id", F.posexplode_outer("feeds").alias("pos", "feed")).filter(F.col("pos").isNotNull())
    return _longs(found.select("page_id", "pos", "feed.url", "feed.title", "feed.feed_type"), "pos")


@query
def discover_well_known(spark, d):
    roots = S.roots(spark, d).select("root")
    return _longs(D.rank_feeds(D.well_known_feeds(roots, _digest(spark, d)), "root"), "pos", "rank")


@query
def validate_candidates(spark, d):
    roots = S.roots(spark, d).select("root")
    return _longs(D.validate(D.well_known_candidates(roots), _digest(spark, d)), "pos")


@query
def discover_sitemap(spark, d):
    roots = S.roots(spark, d).select("root")
    return _longs(D.rank_feeds(D.sitemap_feeds(roots, _digest(spark, d)), "root"), "pos", "rank")


@query
def sitemap_candidates(spark, d):
    roots = S.roots(spark, d).select("root")
    return _longs(D.sitemap_candidates(roots, _digest(spark, d)), "pos")


@query
def sitemap_candidates_in_parts(spark, d):
    """The feed-like addresses of sitemaps that are cut at their entries."""
    roots = S.roots(spark, d).select("root")
    return V.sitemap_candidates(roots, S.site_captures(spark, d), split_bytes=200, part_bytes=100)


@query
def discover_fallback(spark, d):
    return _longs(D.discover(S.sites(spark, d), _digest(spark, d)), "pos", "rank")


@query
def resolve_outcome(spark, d):
    return D.resolve(S.sites(spark, d), _digest(spark, d))


def _subscribed(spark, d):
    """Feeds of the sites' roots that are taken already, those of hosts with a hyphen."""
    root = S.roots(spark, d).filter(F.contains("root", F.lit("-")))
    return root.select(
        F.col("home_id").alias("feed_id"), F.lit("Known").alias("title"),
        F.concat("root", F.lit("/atom.xml")).alias("url"), F.lit("").alias("link"),
    )


@query
def subscriptions(spark, d):
    return subscribe.subscriptions(S.sites(spark, d), _digest(spark, d), _subscribed(spark, d))


@query
def subscriptions_first(spark, d):
    return subscribe.subscriptions(S.sites(spark, d), _digest(spark, d), _subscribed(spark, d), pick="first")
