"""HTML pages and broken feed documents, read inside Arrow-batched UDFs.

Both readers sit on the standard library's tokenizer. Callers pass null for rows that need
no reading (see `needs_reading`), so those rows cost next to nothing here.

The UDFs are declared nondeterministic, though they are not, to keep the optimizer from
pushing filters on what was parsed below the parsing, which would parse again.
"""

import re
import sys
from collections import Counter
from html import escape
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.parsers import expat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# executors get the readers with the UDFs and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements that never have content.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
# Elements whose text is not part of the page's text.
SILENT = frozenset(["script", "style", "template", "rt", "rp"])
# Media types that mark a link as a feed.
FEED_TYPES = {"application/atom+xml": "atom", "application/rss+xml": "rss"}


def _strings(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _list(element):
    return T.ArrayType(element)


LINK = _strings("text", "href", "resolved_href")
FEED_LINK = _strings("url", "title", "feed_type")
PARTS = {
    "text": T.StringType(),
    "links": _list(LINK),
    "feeds": _list(FEED_LINK),
    "locs": _list(T.StringType()),
}


def arrow_type(spark_type):
    if isinstance(spark_type, T.ArrayType):
        return pa.list_(arrow_type(spark_type.elementType))
    if isinstance(spark_type, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in spark_type])
    return pa.bool_() if isinstance(spark_type, T.BooleanType) else pa.string()


def resolve(base, href):
    try:
        return urljoin(base or "", href)
    except ValueError:
        return href


def character(reference):
    """The text of a numeric reference; 128-159 are read as Windows-1252."""
    try:
        code = int(reference[1:], 16) if reference[0] in "xX" else int(reference)
        if code < 256:
            return bytes([code]).decode("windows-1252")
        return chr(code)
    except UnicodeDecodeError:
        return chr(code)
    except (ValueError, OverflowError, IndexError):
        return "�"


class Tokenizer(HTMLParser):
    """The tokenizer, without its repeated searches for an end that is not there.

    A page can hold very many starts of comments or tags after the last place where one
    could end, and each of them is looked at to the end of the page. Once one search has
    failed, those further on must, so they fail at once; the outcome is the same.
    """

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.no_comment_ends = False
        self.no_tag_ends = False

    def parse_comment(self, i, *report):
        end = -1 if self.no_comment_ends else super().parse_comment(i, *report)
        self.no_comment_ends = end < 0
        return end

    def parse_starttag(self, i):
        self.no_tag_ends = self.no_tag_ends or self.rawdata.find(">", i) < 0
        return -1 if self.no_tag_ends else super().parse_starttag(i)


class PageReader(Tokenizer):
    """Text nodes, anchors, feed links and sitemap locations of one page, in order.

    Nothing is closed implicitly: an element lasts to its end tag, or to the end tag of
    an element around it. So an unclosed anchor still is a link.
    """

    def __init__(self, base):
        super().__init__()
        self.base = base
        self.nodes = []      # stripped text nodes, blank ones left out
        self.pending = []    # pieces of the text node being read
        self.stack = []      # (name, span) of open elements
        self.open = Counter()
        self.silent = 0
        self.anchors = []    # [href, first node, end node]
        self.locs = []
        self.feeds = []

    def flush(self):
        if self.pending:
            node = "".join(self.pending).strip()
            self.pending.clear()
            if node and not self.silent:
                self.nodes.append(node)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_entityref(self, name):
        self.pending.append(html5.get(name + ";") or "&" + name)

    def handle_charref(self, name):
        self.pending.append(character(name))

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.flush()
        if data[:6].upper() == "CDATA[":
            self.pending.append(data[6:])
            self.flush()

    def handle_starttag(self, name, attributes):
        self.flush()
        span = None
        if name == "a":
            href = (dict(attributes).get("href") or "").strip()
            if href:
                span = [href, len(self.nodes), None]
                self.anchors.append(span)
        elif name == "loc":
            span = [None, len(self.nodes), None]
            self.locs.append(span)
        elif name == "link":
            self.feed_link(dict(attributes))
        if name in VOID:
            return
        self.stack.append((name, span))
        self.open[name] += 1
        self.silent += name in SILENT

    def handle_startendtag(self, name, attributes):
        self.handle_starttag(name, attributes)
        self.handle_endtag(name)

    def handle_endtag(self, name):
        self.flush()
        while self.open[name]:
            inner, span = self.stack.pop()
            self.open[inner] -= 1
            self.silent -= inner in SILENT
            if span:
                span[2] = len(self.nodes)
            if inner == name:
                return

    def feed_link(self, attributes):
        kind = FEED_TYPES.get((attributes.get("type") or "").lower())
        href = attributes.get("href")
        if kind and href and "alternate" in (attributes.get("rel") or "").split():
            url = resolve(self.base, href)
            self.feeds.append({"url": url, "title": attributes.get("title") or url, "feed_type": kind})

    def spans(self, spans):
        return [(href, "".join(self.nodes[first:end])) for href, first, end in spans]


def read_page(html, base, wanted):
    """The wanted parts of one page, as a dict."""
    reader = PageReader(base)
    try:
        reader.feed(html)
        reader.close()
        reader.flush()
    except AssertionError:  # a declaration the tokenizer refuses: the page has no markup
        return {part: html if part == "text" else [] for part in wanted}
    parts = {}
    if "text" in wanted:
        parts["text"] = "\n".join(reader.nodes)
    if "links" in wanted:
        parts["links"] = [
            {"text": text or href, "href": href, "resolved_href": resolve(base, href)}
            for href, text in reader.spans(reader.anchors)
        ]
    if "feeds" in wanted:
        parts["feeds"] = reader.feeds
    if "locs" in wanted:
        parts["locs"] = [text for _, text in reader.spans(reader.locs) if text]
    return parts


SLICE_BYTES, SLICE_ROWS = 1 << 20, 500


def in_slices(kind, read, texts, *others):
    """What `read` makes of each text and its other values, null of null, as an array of type
    `kind`. What is read is turned into Arrow a bounded number of bytes of text at a time, since
    as Python objects it takes many times their room."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    done, rows, held = [], [], 0
    for row, (text, *rest) in enumerate(zip(texts, *others)):
        rows.append(read(text.as_py(), *[value.as_py() for value in rest]) if text.is_valid else None)
        held += sizes[row]
        if held >= SLICE_BYTES or len(rows) >= SLICE_ROWS:
            done.append(pa.array(rows, type=kind))
            rows, held = [], 0
    return pa.concat_arrays([*done, pa.array(rows, type=kind)])


def page_parts(html: Column, base_url: Column, *wanted: str) -> Column:
    """Struct of the wanted parts (text, links, feeds, locs); null for null html."""
    result = T.StructType([T.StructField(w, PARTS[w]) for w in wanted])
    kind = arrow_type(result)

    @F.arrow_udf(result)
    def parts(pages: pa.Array, bases: pa.Array) -> pa.Array:
        return in_slices(kind, lambda page, base: read_page(page, base, wanted), pages, bases)

    return parts.asNondeterministic()(html, base_url)


def needs_reading(html: Column, mark: str) -> Column:
    """html where it holds the mark in either case, else null."""
    return F.when(F.contains(F.lower(html), F.lit(mark)), html)


# One entry as it stands in the document, for RSS 0.9x-2.0, RSS 1.0 and Atom alike.
ENTRY = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", _list(_strings("_VALUE", "_href", "_rel", "_type"))),
    T.StructField("guid", _list(_strings("_VALUE", "_isPermaLink"))),
    T.StructField("id", T.StringType()),
    T.StructField("_rdf:about", T.StringType()),
    T.StructField("author", _list(_strings("_VALUE", "name", "email"))),
    T.StructField("dc:creator", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("issued", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("modified", T.StringType()),
    T.StructField("dc:date", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("content", _list(T.StringType())),
    T.StructField("content:encoded", _list(T.StringType())),
])
FEED = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", ENTRY["link"].dataType),
    T.StructField("entries", _list(ENTRY)),
])

_ENTRY_FIELD = {f.name.lower(): f.name for f in ENTRY if not f.name.startswith("_")}
_MARKUP_FIELDS = ("description", "summary", "content", "content:encoded")
_CDATA = re.compile(r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)", re.DOTALL)


class FeedReader(Tokenizer):
    """What can be had from a feed document that is not well-formed XML.

    Entries run from their start tag to their end tag or the next entry. A field runs to
    its end tag, or to the end of the entry; markup inside a field is kept as text.
    """

    def __init__(self):
        super().__init__()
        self.title = None
        self.links = []
        self.entries = []
        self.entry = None
        self.field = None
        self.attributes = {}
        self.pieces = []
        self.skipped = None  # open element whose title and link are not the feed's
        self.person = None

    @staticmethod
    def local(name):
        prefix, _, rest = name.rpartition(":")
        return name if prefix in ("dc", "content", "media", "itunes") else rest

    def close_field(self):
        field, self.field = self.field, None
        if field is None:
            return
        text = "".join(self.pieces).strip()
        self.pieces = []
        attributes = self.attributes
        if field == "link":
            link = {"_VALUE": text or None, "_href": attributes.get("href"),
                    "_rel": attributes.get("rel"), "_type": attributes.get("type")}
            (self.links if self.entry is None else self.entry.setdefault("link", [])).append(link)
        elif self.entry is None:
            self.title = text
        elif field in ("name", "email"):
            self.person[field] = text
        elif field == "author":
            self.entry.setdefault("author", []).append({"_VALUE": text})
        elif field == "guid":
            self.entry.setdefault("guid", []).append(
                {"_VALUE": text, "_isPermaLink": attributes.get("ispermalink")})
        elif field in ("content", "content:encoded"):
            self.entry.setdefault(field, []).append(text)
        else:
            self.entry[_ENTRY_FIELD[field]] = text

    def handle_starttag(self, name, attributes):
        name = self.local(name)
        if name in ("item", "entry"):
            self.close_field()
            self.skipped = self.person = None
            self.entry = {}
            about = dict(attributes).get("rdf:about")
            if about is not None:
                self.entry["_rdf:about"] = about
            self.entries.append(self.entry)
        elif self.field == "author" and name in ("name", "email"):
            self.field = None
            self.person = {}
            self.entry.setdefault("author", []).append(self.person)
            self.start_field(name, attributes)
        elif self.field in _MARKUP_FIELDS or self.field and name not in _ENTRY_FIELD:
            self.pieces.append(self.get_starttag_text())
        elif self.field:  # its end tag is missing
            self.close_field()
            self.handle_starttag(name, attributes)
        elif self.person is not None:
            if name in ("name", "email"):
                self.start_field(name, attributes)
        elif self.entry is not None:
            if name in _ENTRY_FIELD:
                self.start_field(name, attributes)
        elif name in ("image", "textinput"):
            self.skipped = name
        elif name in ("title", "link") and not self.skipped:
            self.start_field(name, attributes)

    def start_field(self, name, attributes):
        self.field = name
        self.attributes = dict(attributes)
        self.pieces = []

    def handle_startendtag(self, name, attributes):
        inside = self.field
        self.handle_starttag(name, attributes)
        if self.field != inside:
            self.close_field()

    def handle_endtag(self, name):
        name = self.local(name)
        if name == self.field:
            self.close_field()
        elif name in ("item", "entry", "channel", "feed", "rss"):
            self.close_field()
            if name in ("item", "entry"):
                self.entry = None
        elif name == "author":
            self.person = None
        elif name == self.skipped:
            self.skipped = None
        elif self.field:
            self.pieces.append(f"</{name}>")

    def handle_data(self, data):
        if self.field:
            self.pieces.append(data)

    def handle_entityref(self, name):
        self.handle_data(html5.get(name + ";") or "&" + name + ";")

    def handle_charref(self, name):
        self.handle_data(character(name))


def read_broken_feed(body):
    reader = FeedReader()
    try:
        reader.feed(_CDATA.sub(lambda found: escape(found[1], quote=False), body))
        reader.close()
    except AssertionError:
        pass
    reader.close_field()
    return {"title": reader.title, "link": reader.links, "entries": reader.entries}


def is_well_formed(body) -> bool:
    """Whether a document is well-formed XML throughout."""
    try:
        expat.ParserCreate().Parse(body, True)
    except (expat.ExpatError, ValueError):
        return False
    return True


READ = T.StructType([*FEED.fields, T.StructField("well_formed", T.BooleanType())])
_READ_ARROW = arrow_type(READ)


@F.arrow_udf(READ)
def _broken_feed(bodies: pa.Array) -> pa.Array:
    return in_slices(_READ_ARROW, lambda body: {**read_broken_feed(body), "well_formed": is_well_formed(body)}, bodies)


def broken_feed(body: Column) -> Column:
    """The feed that a document from_xml cannot read still holds, and whether it is well-formed
    all the same; null for null."""
    return _broken_feed.asNondeterministic()(body)
