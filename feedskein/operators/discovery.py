"""Finding the feeds of sites in captured documents.

capture_digest reads every body once and keeps what discovery can ask of it: is it a feed
and of what title and type, which feeds does a page link to, which addresses does a
sitemap list. Bodies are never shuffled; everything after is equi-joins on URLs of these
narrow rows. All steps use one digest, so write it first (session.written).

Strategies, each for the sites the ones before found nothing for: link tags of the page,
well-known paths, sitemap. The last two depend on the site's root alone, so they run and
rank once per root, and a root with very many sites meets only the result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedskein.functions.markup import FEED_LINK, page_parts
from feedskein.functions.text import strip
from feedskein.functions.urls import SITEMAP_PATH, WELL_KNOWN_PATHS, feed_like, site_root
from feedskein.operators.documents import feed_info, parse_feeds
from feedskein.operators.skew import spread_join
from feedskein.session import written
from feedskein.sources.captures import failure

_CORRUPT = "_corrupt"
_LOCS = T.ArrayType(T.StructType([T.StructField("loc", T.ArrayType(T.StringType()))]))
_SITEMAP = T.StructType([
    T.StructField("url", _LOCS),
    T.StructField("sitemap", _LOCS),
    T.StructField(_CORRUPT, T.StringType()),
])


def _may_link(html: Column) -> Column:
    """Whether a page can name feeds: it needs a link tag and a feed type, both of which
    hold a plus sign before `xml`, plain or as a character reference."""
    lower = F.lower(html)
    return F.contains(lower, F.lit("<link")) & lower.rlike(r"(\+|&#0*43;?|&#x0*2b;?|&plus;?)xml")


def _or_none(feeds: Column, html: Column) -> Column:
    return F.when(html.isNotNull(), F.coalesce(feeds, F.array().cast(T.ArrayType(FEED_LINK))))


def page_feeds(html: Column, base_url: Column) -> Column:
    """The feeds a page's link tags name, in page order; null for null html."""
    return _or_none(page_parts(F.when(_may_link(html), html), base_url, "feeds")["feeds"], html)


def strict_locs(sitemaps: DataFrame, body: str) -> DataFrame:
    """sitemaps with `_strict`, the locations where from_xml finds them in the usual layout,
    and `_complete`: the body is well-formed and has no more `loc` elements than those."""
    xml = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    staged = sitemaps.withColumn("_map", F.from_xml(body, _SITEMAP, xml))
    none = F.array().cast(_LOCS)
    listed = F.flatten(F.transform(
        F.concat(F.coalesce(F.col("_map.url"), none), F.coalesce(F.col("_map.sitemap"), none)),
        lambda x: F.coalesce(x["loc"], F.array().cast("array<string>")),
    ))
    staged = staged.withColumn("_strict", F.when(F.col(f"_map.{_CORRUPT}").isNull(), listed))
    lower = F.lower(body)
    marks = F.length(lower) - F.length(F.replace(lower, F.lit("<loc"), F.lit("")))
    complete = F.coalesce(F.size("_strict") * 4 == marks, F.lit(False))
    return staged.withColumn("_complete", complete).drop("_map")


def _locs(read: Column) -> Column:
    """The non-blank locations: the strict ones if complete, else those read leniently."""
    strict = F.filter(F.transform("_strict", strip), lambda x: x != "")
    return F.when(F.col("_complete"), strict).otherwise(read)


def sitemap_locs(sitemaps: DataFrame, body="body", locs="locs") -> DataFrame:
    """sitemaps with the non-blank locations of the body in `locs`, null for a null body.

    from_xml reads the usual layout. A body that is not well-formed, or has more `loc`
    elements than that layout accounts for, goes to the page reader.
    """
    staged = strict_locs(sitemaps, body)
    rest = F.when(~F.col("_complete"), F.col(body))
    staged = staged.withColumn("_read", page_parts(rest, F.lit(None).cast("string"), "locs")["locs"])
    return staged.withColumn(locs, _locs(F.col("_read"))).drop("_strict", "_complete", "_read")


def capture_digest(captures: DataFrame) -> DataFrame:
    """The last capture of each URL without its body: url, error (null for a good feed),
    title, link, feed_type, page_feeds, locs."""
    body, url = F.col("body"), F.col("url")
    is_sitemap = url == F.concat(site_root(url), F.lit(SITEMAP_PATH))
    fetched = captures.select(
        "url", "http_status", "error_kind", "fetched_at", F.when(failure().isNull(), body).alias("body")
    ).withColumn("_sitemap", F.when(is_sitemap, body))
    staged = strict_locs(fetched, "_sitemap")
    # one reading serves both: the page's feeds and the locations of an irregular sitemap
    irregular = F.col("_sitemap").isNotNull() & ~F.col("_complete")
    read = page_parts(F.when(_may_link(body) | irregular, body), url, "feeds", "locs")
    staged = staged.withColumn("_read", read).select(
        "url", "http_status", "error_kind", "fetched_at", "body",
        _or_none(F.col("_read.feeds"), body).alias("page_feeds"),
        F.when(F.col("_sitemap").isNotNull(), _locs(F.col("_read.locs"))).alias("locs"),
    )
    rest = ["error", "title", "link", "feed_type", "page_feeds", "locs"]
    info = feed_info(parse_feeds(staged)).select("url", "fetched_at", *rest)
    order = F.struct("fetched_at", F.xxhash64(*rest))
    return (
        info.groupBy("url").agg(F.max_by(F.struct(*rest), order).alias("last"))
        .select("url", *[F.col(f"last.{c}").alias(c) for c in rest])
    )


def _good(digest: DataFrame) -> DataFrame:
    return digest.filter(F.col("error").isNull()).select("url", "title", "feed_type")


def well_known_candidates(roots: DataFrame) -> DataFrame:
    """(root, pos, url): each path to probe on each root."""
    paths = F.array(*[F.lit(p) for p in WELL_KNOWN_PATHS])
    return roots.select("root", F.posexplode(paths).alias("pos", "_path")).select(
        "root", "pos", F.concat("root", "_path").alias("url")
    )


def validate(candidates: DataFrame, digest: DataFrame) -> DataFrame:
    """The candidates (url) that are good feeds."""
    good = _good(digest).select("url")
    return spread_join(candidates, good, "url", "left_semi")


def well_known_feeds(roots: DataFrame, digest: DataFrame) -> DataFrame:
    """(root, pos, url, title, feed_type) of the candidates that are good feeds."""
    return well_known_candidates(roots).join(_good(digest), "url").select(
        "root", "pos", "url", "title", "feed_type"
    )


def sitemap_candidates(roots: DataFrame, digest: DataFrame) -> DataFrame:
    """(root, pos, url): the feed-like addresses in each root's sitemap, first seen first."""
    maps = digest.filter(F.size("locs") > 0).select("url", "locs")
    listed = roots.select("root", F.concat("root", F.lit(SITEMAP_PATH)).alias("url")).join(maps, "url")
    locs = listed.select("root", F.posexplode("locs").alias("pos", "url")).filter(feed_like(F.col("url")))
    return locs.groupBy("root", "url").agg(F.min("pos").alias("pos")).select("root", "pos", "url")


def sitemap_feeds(roots: DataFrame, digest: DataFrame) -> DataFrame:
    """(root, pos, url, title, feed_type). Many sitemaps may list one feed, hence the salt."""
    return spread_join(
        sitemap_candidates(roots, digest), _good(digest), "url", spread=["root"]
    ).select("root", "pos", "url", "title", "feed_type")


def rank_feeds(found: DataFrame, *group: str) -> DataFrame:
    """found with `rank`: Atom first, then by title, then in order of discovery."""
    order = Window.partitionBy(*group).orderBy(F.col("feed_type") != "atom", "title", "pos")
    return found.withColumn("rank", F.row_number().over(order))


def _ranked_page_feeds(feeds: Column) -> Column:
    """A page's feeds ranked within its row."""
    keyed = F.transform(feeds, lambda x, i: F.struct(
        (x["feed_type"] != "atom").alias("a"), x["title"].alias("title"), i.alias("pos"),
        x["url"].alias("url"), x["feed_type"].alias("feed_type"),
    ))
    return F.sort_array(keyed)


def stage_sites(sites: DataFrame, digest: DataFrame) -> DataFrame:
    """Each site (site_url, blanks around it dropped) with what its own capture says: root,
    direct (it is itself a feed), its title and link, and its page's feeds ranked."""
    named = sites.select(strip(F.col("site_url")).alias("site_url")).filter(F.col("site_url") != "").distinct()
    own = digest.select(
        F.col("url").alias("site_url"),
        F.col("error").isNull().alias("_direct"),
        "title", "link",
        _ranked_page_feeds(F.col("page_feeds")).alias("page_feeds"),
    )
    return named.join(own, "site_url", "left").select(
        "site_url", site_root(F.col("site_url")).alias("root"),
        F.coalesce("_direct", F.lit(False)).alias("direct"), "title", "link", "page_feeds",
    )


def _left_over(staged: DataFrame) -> DataFrame:
    nothing = F.coalesce(F.size("page_feeds"), F.lit(0)) <= 0
    return staged.filter(~F.col("direct") & nothing & F.col("root").isNotNull())


def root_feeds(staged: DataFrame, digest: DataFrame) -> DataFrame:
    """(root, strategy, pos, url, title, feed_type, rank) for the roots of the sites whose
    own page gave nothing. A root's rows come from eight paths or from one sitemap."""
    roots = _left_over(staged).select("root").distinct()
    known = written(well_known_feeds(roots, digest), "known")
    rest = roots.join(known.select("root"), "root", "left_anti")
    mapped = sitemap_feeds(rest, digest)
    found = known.withColumn("strategy", F.lit("well_known")).unionByName(
        mapped.withColumn("strategy", F.lit("sitemap"))
    )
    return rank_feeds(found, "root")


_DISCOVERED = ["site_url", "strategy", "pos", "url", "title", "feed_type", "rank"]


def discover(sites: DataFrame, digest: DataFrame, staged=None, by_root=None) -> DataFrame:
    """The feeds of each site that is not itself a feed, ranked per site."""
    staged = written(stage_sites(sites, digest), "staged") if staged is None else staged
    by_root = root_feeds(staged, digest) if by_root is None else by_root
    linked = (
        staged.filter(~F.col("direct"))
        .select("site_url", F.posexplode_outer("page_feeds").alias("_at", "_feed"))
        .filter(F.col("_at").isNotNull())
        .select(
            "site_url", F.lit("link_tags").alias("strategy"), "_feed.pos", "_feed.url", "_feed.title",
            "_feed.feed_type", (F.col("_at") + 1).alias("rank"),
        )
    )
    others = spread_join(_left_over(staged).select("site_url", "root"), by_root, "root").select(*_DISCOVERED)
    return linked.unionByName(others)


def resolve(sites: DataFrame, digest: DataFrame) -> DataFrame:
    """(site_url, outcome, found, feed_url, title): outcome is direct, single, multiple or
    none; feed_url and title are those of the site itself or of its first feed."""
    staged = written(stage_sites(sites, digest), "staged")
    by_root = root_feeds(staged, digest)
    best = by_root.groupBy("root").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("rank") == 1, F.struct("url", "title"))).alias("_best"),
    )
    left_over = F.coalesce(F.size("page_feeds"), F.lit(0)) <= 0
    joined = spread_join(staged, best, "root", "left", spread=["site_url"])
    first = F.when(left_over, F.col("_best")).otherwise(
        F.struct(F.get("page_feeds", F.lit(0))["url"].alias("url"), F.get("page_feeds", F.lit(0))["title"].alias("title"))
    )
    found = (
        F.when(F.col("direct"), 1)
        .when(left_over, F.coalesce("_n", F.lit(0)))
        .otherwise(F.size("page_feeds"))
    ).cast("long")
    resolved = joined.select(
        "site_url", "direct", found.alias("found"),
        F.when(F.col("direct"), F.struct(F.col("site_url").alias("url"), "title")).otherwise(first).alias("_first"),
    )
    outcome = (
        F.when(F.col("direct"), "direct").when(F.col("found") == 0, "none")
        .when(F.col("found") == 1, "single").otherwise("multiple")
    )
    return resolved.select(
        "site_url", outcome.alias("outcome"), "found",
        F.col("_first.url").alias("feed_url"), F.col("_first.title").alias("title"),
    )
