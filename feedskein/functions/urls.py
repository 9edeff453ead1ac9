"""URL parts, split the way generic URL syntax does it.

try_parse_url gives null for a URL with a character that should have been escaped, and
such URLs do occur in sitemaps, so the parts are taken by pattern.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths to probe on a site, in probing order.
WELL_KNOWN_PATHS = [
    "/feed",
    "/rss",
    "/atom.xml",
    "/feed.xml",
    "/rss.xml",
    "/index.xml",
    "/feed/atom",
    "/feed/rss",
]

# Fixed value: what makes the path of a sitemap entry look like a feed.
FEED_PATH = "/feed|/rss|/atom"

SITEMAP_PATH = "/sitemap.xml"


def site_root(url: Column) -> Column:
    """scheme://authority, or null where the URL has neither."""
    scheme = F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]+", 1))
    authority = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    return F.when(authority != "", F.concat(scheme, F.lit("://"), authority))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def feed_like(url: Column) -> Column:
    return F.lower(url_path(url)).rlike(FEED_PATH)
