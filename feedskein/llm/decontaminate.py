"""Finding and removing benchmark passages: a hash set of normalised n-grams.

The n-grams of the benchmark travel with the tasks in two literals of the plan: a hash set, in
which the places of their hashes are marked, and a table from hash to the n-grams themselves
with their items. A document is scanned where it lies: each token window is looked up in the
set, and only windows found there are spelled out and verified word by word. Documents are not
shuffled for that and a hot passage makes no group. Everything is DataFrame functions.

The literals are bounded in bytes. The n-grams of a larger benchmark are dealt by hash into
slices within the bound, and the documents are scanned once for each; an n-gram of very many
items is in several slices with some of them. Then only rows that are hit leave a scan, without
their texts, and are gathered by row.
"""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.session import written

N = 10
SLICE_BYTES = 16 << 20
ITEMS_TOGETHER = 1000
SPARSE = 16  # places of the hash set for each n-gram
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_REST = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z"
HITS = "array<struct<at: int, len: int, items: array<string>>>"


def words(text):
    """The words of a text: A-Z as a-z, split at ASCII other than letters and digits. A null
    text has none."""
    # lower() knows more letters than A-Z, so it is for texts of ASCII alone
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(lower, F.lit("")), _NO_WORD), lambda w: w != "")


def _bind(column, body):
    """body(column) with column evaluated once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(column), body), 1)


def _gram(ws, at, size):
    return F.slice(ws, at, size)


def benchmark_grams(benchmark: DataFrame, n=N, id_column="item_id", text_column="text") -> DataFrame:
    """(size, gram, items): the windows of n words of the items, or all words of an item of
    fewer, each with the sorted ids of the items that have it. Items without words have none;
    an item without id contaminates, but is not listed."""
    items = benchmark.select(F.col(id_column).cast("string").alias("item"), words(F.col(text_column)).alias("ws"))
    items = items.filter(F.size("ws") > 0).withColumn("size", F.least(F.size("ws"), F.lit(n)))
    grams = F.transform(
        F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1), lambda at: F.array_join(_gram(F.col("ws"), at, F.col("size")), " ")
    )
    return (
        items.select("item", "size", F.explode(F.array_distinct(grams)).alias("gram"))
        .groupBy("size", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def _slices(benchmark, n, id_column, text_column, slice_bytes):
    """(rows of n-grams with `hash`, `items` and the number of their slice, how many slices)."""
    grams = benchmark_grams(benchmark, n, id_column, text_column)
    groups = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("items") - 1) / ITEMS_TOGETHER)).cast("int"))
    rows = written(grams.select(
        "size", "gram", F.xxhash64(F.split("gram", " ")).alias("hash"),
        F.explode(F.transform(groups, lambda i: F.struct(i.alias("part"), F.slice("items", i * ITEMS_TOGETHER + 1, ITEMS_TOGETHER).alias("items")))).alias("p"),
    ).select("size", "gram", "hash", "p.*"), "grams")
    each = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i) + 4) + 4 * SPARSE
    total = rows.agg(F.sum(each)).first()[0] or 0
    # half the bound on average, so that no slice is dealt more than it
    count = 1 if total <= slice_bytes else -(-2 * total // slice_bytes)
    return rows.withColumn("slice", F.pmod(F.xxhash64("hash", "part"), F.lit(count))), count


def find_hits(docs: DataFrame, benchmark: DataFrame, n=N, id_column="doc_id", text_column="text", item_column="item_id", item_text="text", slice_bytes=SLICE_BYTES) -> DataFrame:
    """docs with n_words and hits: for each window of a document that an item has, its first
    word (from 1), its number of words and the ids of the items, in order. A window whose
    items are very many can be there several times, with some of them each.

    A null text has no words; an empty benchmark hits nothing. Each row of docs is judged by
    itself, whatever its id. Columns of docs with the names of the new ones are replaced.
    """
    docs = docs.drop("n_words", "hits")
    grams, slices = _slices(benchmark, n, item_column, item_text, slice_bytes)

    def scanned(frame, number):
        found = grams.filter(F.col("slice") == number).collect()  # within slice_bytes
        return _bind(words(F.col(text_column)), lambda ws: F.struct(F.size(ws).alias("n"), _window_hits(ws, found).alias("hits")))

    scan = _free("_scan", docs)
    if slices == 1:
        marked = docs.withColumn(scan, scanned(docs, 0))
        return marked.withColumns({"n_words": F.col(f"{scan}.n"), "hits": F.col(f"{scan}.hits")}).drop(scan)
    key = _free("_row", docs)
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "documents")
    parts = None
    for number in range(slices):
        hit = keyed.select(key, scanned(keyed, number).alias(scan)).select(key, F.col(f"{scan}.hits").alias("hits"))
        hit = written(hit.filter(F.size("hits") > 0), "hits")
        parts = hit if parts is None else parts.unionByName(hit)
    gathered = parts.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("hits"))).cast(HITS).alias("hits"))
    none = F.array().cast(HITS)
    return (
        keyed.withColumn("n_words", F.size(words(F.col(text_column)))).join(gathered, key, "left").drop(key)
        .withColumn("hits", F.coalesce("hits", none))
    )


def _free(name, frame):
    while name in frame.columns:
        name += "_"
    return name


def _window_hits(ws, found):
    if not found:
        return F.array().cast(HITS)
    places, buckets = SPARSE * len(found), max(1, len(found) // 4)
    marks, table = [0] * places, [{} for _ in range(buckets)]
    for row in found:
        marks[row["hash"] % places] = 1
        table[row["hash"] % buckets].setdefault(row["gram"], []).extend(row["items"])
    marks = F.from_json(F.lit(json.dumps(marks, separators=(",", ":"))), "array<tinyint>")
    table = F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "array<map<string, array<string>>>")

    def entry(array, size, window):
        return F.element_at(array, F.pmod(F.xxhash64(window), F.lit(size)).cast("int") + 1)

    def of_size(size):
        last = F.size(ws) - F.lit(size) + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        likely = F.filter(starts, lambda at: entry(marks, places, _gram(ws, at, size)) == 1)
        verified = F.transform(likely, lambda at: F.struct(
            at.alias("at"), F.lit(size).alias("len"),
            F.try_element_at(entry(table, buckets, _gram(ws, at, size)), F.array_join(_gram(ws, at, size), " ")).alias("items"),
        ))
        return F.filter(verified, lambda hit: hit["items"].isNotNull())

    return F.sort_array(F.flatten(F.array(*[of_size(size) for size in sorted({row["size"] for row in found})]))).cast(HITS)


def spans(hits):
    """Hits as disjoint runs of words: array<struct<at, end>>, end exclusive, in order."""
    kind = "array<struct<at: int, end: int>>"

    def add(runs, hit):
        last = F.try_element_at(runs, F.lit(-1))
        end = hit["at"] + hit["len"]
        return (
            F.when((F.size(runs) > 0) & (hit["at"] <= last["end"]), F.concat(
                F.slice(runs, 1, F.size(runs) - 1),
                F.array(F.struct(last["at"].alias("at"), F.greatest(last["end"], end).alias("end"))),
            ))
            .otherwise(F.concat(runs, F.array(F.struct(hit["at"].alias("at"), end.alias("end")))))
            .cast(kind)
        )

    return F.aggregate(hits, F.array().cast(kind), add)


def count_hit(hits):
    """How many words lie in any hit."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(hits, start, lambda seen, hit: F.struct(
        F.greatest(seen["end"], hit["at"] + hit["len"]).alias("end"),
        (seen["n"] + F.greatest(F.lit(0), hit["at"] + hit["len"] - F.greatest(seen["end"], hit["at"]))).alias("n"),
    ))["n"]


def hit_items(hits):
    """Ids of the items that a document has windows of, sorted as strings."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"]))))


def without_spans(text, hits):
    """text without the hit words and what separates each from the word before it."""
    def cut(runs):
        pieces = F.regexp_extract_all(text, F.lit(_PIECE), 0)
        kept = F.filter(pieces, lambda _, i: ~F.exists(runs, lambda r: (i + 1 >= r["at"]) & (i + 1 < r["end"])))
        return F.concat(F.array_join(kept, ""), F.regexp_extract(text, _REST, 0))
    return F.when(F.size(hits) == 0, text).otherwise(_bind(spans(hits), cut))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove="documents", **options) -> DataFrame:
    """docs without the documents that have a hit, or with remove="spans" without the words
    that are hit. Documents without hits stay as they are, null texts too. Takes the options
    of find_hits."""
    text = options.get("text_column", "text")
    plain = docs
    clash = {c: f"_own_{c}" for c in ("n_words", "hits") if c in docs.columns}
    for old, new in clash.items():
        plain = plain.withColumnRenamed(old, new)
    marked = find_hits(plain, benchmark, **options)
    if remove == "documents":
        kept = marked.filter(F.size("hits") == 0)
    elif remove == "spans":
        kept = marked.withColumn(text, without_spans(F.col(text), F.col("hits")))
    else:
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    kept = kept.drop("n_words", "hits")
    for old, new in clash.items():
        kept = kept.withColumnRenamed(new, old)
    return kept.select(*docs.columns)
