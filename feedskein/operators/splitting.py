"""Large feeds and sitemaps read in parts, by many tasks.

A document is one row, and so one task. Those of `split_bytes` or more are scanned once for the
places of their entries (functions/parts.py), and the parts are dealt to tasks and parsed apart.
The scan is all that is left of the large document in one task: it parses nothing, and hands out
parts a few at a time.

Results are those of whole documents. To make sure, parts count only if from_xml read every part
of the document with as many elements as the scan had seen; other documents, such as broken
ones, are read whole. Rows that are alike in all columns are read alike, each for itself.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedskein.functions.parts import document_parts
from feedskein.functions.text import feed_type, strip
from feedskein.functions.urls import SITEMAP_PATH, feed_like
from feedskein.operators.discovery import sitemap_locs, strict_locs
from feedskein.operators.documents import (
    STRICT_ROOTS, entries, malformed, malformed_message, parse_documents, parse_feeds,
)
from feedskein.operators.skew import spread_join
from feedskein.session import written
from feedskein.sources.captures import failure, latest_captures, successes

SPLIT_BYTES = 8 * 1024 * 1024
PART_BYTES = 1024 * 1024
TOGETHER_BYTES, TOGETHER_ROWS = 1024 * 1024, 1000  # parts that leave the scan in one batch

# Where the formats have their entries.
FEED_PATHS = frozenset(
    (root, *inner) for root in STRICT_ROOTS for inner in (("channel", "item"), ("item",), ("entry",))
)
SITEMAP_PATHS = frozenset([("urlset", "url"), ("sitemapindex", "sitemap")])

_PLACE = "part long, first long, within long, elements long"


def cut(documents: DataFrame, paths, body="body", part_bytes=PART_BYTES) -> DataFrame:
    """The documents as parts: their columns, `part` (0 for the rest of a document without its
    elements), `first` and `within`, the elements before and in the part, and `elements` in the
    whole. A document that has to be read whole is its own part 0, with null `elements`."""
    others = [c for c in documents.columns if c != body]
    given = documents.select(*others, body)
    schema = given.drop(body).schema
    for field in _PLACE.split(", "):
        schema = schema.add(*field.split(" "))
    schema = schema.add(body, "string")

    def pieces(text):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        part = -1
        for part, (first, within, elements, piece) in enumerate(document_parts(data, paths, part_bytes)):
            yield (part, first, within, elements), piece
        if part < 0:
            yield (0, 0, 0, None), data if text.is_valid else None

    def together(batch, rows, places, texts):
        rest = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
        placed = [pa.array(values, pa.int64()) for values in zip(*places)]
        return pa.RecordBatch.from_arrays([*rest, *placed, pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    def run(batches):
        # a batch costs far more than a small part, so parts leave by the thousand, or by the bytes
        for batch in batches:
            rows, places, texts, size = [], [], [], 0
            for row, text in enumerate(batch.column(len(others))):
                for place, piece in pieces(text):
                    rows.append(row)
                    places.append(place)
                    texts.append(piece)
                    size += len(piece or b"")
                    if size >= TOGETHER_BYTES or len(rows) >= TOGETHER_ROWS:
                        yield together(batch, rows, places, texts)
                        rows, places, texts, size = [], [], [], 0
            if rows:
                yield together(batch, rows, places, texts)

    return given.mapInArrow(run, schema)


def _large(body: Column, split_bytes) -> Column:
    return F.coalesce(F.octet_length(body) >= split_bytes, F.lit(False))


def _identified(documents: DataFrame, body: str) -> DataFrame:
    """documents with `_same`, the same for rows alike in all columns and for no others."""
    others = F.to_json(F.struct(*[c for c in documents.columns if c != body]), {"ignoreNullFields": "false"})
    return documents.withColumn("_same", F.concat(F.sha2(others, 256), F.sha2(F.col(body), 256)))


def dealt(parts: DataFrame) -> DataFrame:
    """The parts spread over tasks."""
    # a given number, since adaptive execution merges small partitions by size, and parsing costs more than their size tells
    number = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(number, "_same", "part")


def _unfit(parts: DataFrame, fits: Column) -> DataFrame:
    """(_same) of documents of which some part does not fit."""
    verdicts = parts.groupBy("_same").agg(F.min(F.coalesce(fits, F.lit(False))).alias("_fit"))
    return verdicts.filter(~F.col("_fit")).select("_same")


def parse_feed_parts(captures: DataFrame, split_bytes=SPLIT_BYTES, part_bytes=PART_BYTES) -> DataFrame:
    """What documents.parse_feeds gives for captures, with large feeds as several rows: `part` is
    0 in one row per capture, which has the feed's title and link, its error and, unless the
    feed was cut, its entries; the rows with higher parts have `first` and more entries. Pass it
    to part_entries, or its rows with part 0 to documents.feed_info."""
    others = [c for c in captures.columns if c != "body"]
    result = [*others, "feed", "well_formed", "feed_type", "error", "part", "first"]
    cuttable = _large(F.col("body"), split_bytes) & failure().isNull()

    def whole(frame):
        return parse_feeds(frame).withColumns({"part": F.lit(0).cast("long"), "first": F.lit(0).cast("long")}).select(*result)

    large = _identified(captures.filter(cuttable), "body")
    parts = dealt(cut(large.withColumn("_type", feed_type(F.col("body"))), FEED_PATHS, part_bytes=part_bytes))
    parsed = written(parse_documents(parts, verdict="_strict"), "parts")
    seen = F.coalesce(F.size("feed.entries"), F.lit(-1)) == F.col("within")
    unfit = written(_unfit(parsed, F.col("elements").isNull() | F.col("_strict") & seen), "unfit")
    error = F.when(F.col("elements").isNull() & malformed(), malformed_message(F.col("url")))
    fit = parsed.join(unfit, "_same", "left_anti").withColumn("error", error).withColumn("feed_type", F.col("_type"))
    again = large.join(unfit, "_same", "left_semi").drop("_same")
    return whole(captures.filter(~cuttable)).unionByName(fit.select(*result)).unionByName(whole(again))


def part_entries(parts: DataFrame, *keep: str) -> DataFrame:
    """documents.entries for what parse_feed_parts gives."""
    rows = entries(parts, *keep, "first")
    return rows.withColumn("pos", F.col("pos") + F.col("first")).drop("first")


def loc_rows(sitemaps: DataFrame, body="body", split_bytes=SPLIT_BYTES, part_bytes=PART_BYTES) -> DataFrame:
    """A row per non-blank location: the columns of sitemaps but the body, `pos` from 0, `loc`;
    large sitemaps are read in parts."""
    others = [c for c in sitemaps.columns if c != body]
    large = _large(F.col(body), split_bytes)

    def whole(frame):
        found = sitemap_locs(frame, body, "_locs")
        return found.select(*others, F.posexplode("_locs").alias("pos", "loc")).withColumn("pos", F.col("pos").cast("long"))

    named = _identified(sitemaps.filter(large), body)
    parts = strict_locs(dealt(cut(named, SITEMAP_PATHS, body, part_bytes)), body)
    listed = F.filter(F.transform("_strict", strip), lambda x: x != "")
    read = written(parts.select(*others, "_same", "part", "within", "elements", "_complete", listed.alias("_locs")), "locs")
    # locations in the rest would be out of order
    fits = F.col("elements").isNotNull() & F.col("_complete") & ((F.col("part") > 0) | (F.size("_locs") == 0))
    unfit = written(_unfit(read, fits), "unfit")
    sizes = read.select("_same", "part", F.size("_locs").cast("long").alias("_n")).distinct()
    before = Window.partitionBy("_same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_same", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    fit = read.join(unfit, "_same", "left_anti").join(offsets, ["_same", "part"])
    fit = fit.select(*others, "_before", F.posexplode("_locs").alias("pos", "loc"))
    fit = fit.select(*others, (F.col("pos") + F.col("_before")).alias("pos"), "loc")
    again = named.join(unfit, "_same", "left_semi").drop("_same")
    return whole(sitemaps.filter(~large)).unionByName(fit).unionByName(whole(again))


def sitemap_candidates(roots: DataFrame, captures: DataFrame, **sizes) -> DataFrame:
    """discovery.sitemap_candidates from captures: (root, pos, url), the feed-like addresses in
    each root's last sitemap, first seen first. Keyword arguments as in loc_rows."""
    maps = roots.select("root", F.concat("root", F.lit(SITEMAP_PATH)).alias("_site_map"))
    wanted = maps.select(F.col("_site_map").alias("url")).distinct()
    of_roots = spread_join(captures, wanted, "url", "left_semi", spread=["fetched_at"])
    last = successes(latest_captures(of_roots)).select(F.col("url").alias("_site_map"), "body")
    locs = loc_rows(last, **sizes).withColumnRenamed("loc", "url")
    found = spread_join(locs.filter(feed_like(F.col("url"))), maps, "_site_map", spread=["pos"])
    return found.groupBy("root", "url").agg(F.min("pos").alias("pos")).select("root", "pos", "url")
