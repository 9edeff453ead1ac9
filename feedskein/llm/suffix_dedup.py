"""Removing substrings that an earlier document has: fingerprints by prefix doubling, chosen by content.

A substring of h bytes has a name (a rank among equal strings); the names of length h + g
come from sorting the pairs (name at p, name at p + g). Positions whose name has been seen in
one document only are done and drop out; the others go on to the next length until it reaches
the threshold. The growing offsets are 1, 2, 4, ... inside a document, where names are
fingerprints, and then two distributed rounds sort and rank: one at half the threshold, one at
the threshold itself.

Ranking every position at half the threshold would shuffle a multiple of the corpus. The first
round takes a position out of each run of positions instead, chosen by content: the one with
the smallest name among those of the half-length substrings inside a substring of threshold
length. Equal strings choose alike, so if a string is repeated, so is what it chose, and a
choice that is not repeated ends all positions that made it. What goes on are the runs of
positions that made a repeated choice, as text.

Rows are dealt into blocks by id and text, so rows of one id, or without one, spread; the id is
only a rank. Equal rows that would fill more than two blocks' share take part once, and the
result is given to each of them. A block sends each name and each run once, however many of its
documents hold it, and is answered in bits, so a passage that a third of all documents share
costs one entry per block. All passes read the same shuffle of the documents. Blocks are ordered
by document, so an answer means the same for a block computed again after a loss.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.llm.arrays import U64, chunks, doc_of, name_pairs, name_substrings, text_bytes
from feedskein.operators.skew import spread_join
from feedskein.session import written

BLOCK_BYTES = 4 * 1024 * 1024
ROW_BYTES = 64  # what a row weighs besides its text
NO_ID = np.iinfo(np.int64).max
_PLACE = U64(30)  # lower bits of a key: the place in the block
MOST_BYTES = 1 << 30
_LOW = U64((1 << 40) - 1)  # what a bucket sees of a name; the upper bits choose the bucket

RESULT = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary, _group long"
_NAMES = "block long, bucket long, names binary, several binary"
_SHARED = "block long, bucket long, shared binary"
_RUNS = "block long, bucket long, shared binary, ids binary, windows binary, text binary"
_HITS = "block long, bucket long, shared binary, hits binary"


class _Block:
    """The documents of a block in id order, and their runs of positions by chosen name."""

    def __init__(self, table, length, buckets):
        table = table.sort_by([("_id", "ascending"), ("_text", "ascending")])
        self.given, self.groups = table["_id"].to_pylist(), table["_group"].to_pylist()
        self.ids = np.array([NO_ID if i is None else i for i in self.given], np.int64)
        self.data, self.offsets = text_bytes(table["_text"])
        self.length = length
        half = length // 2 + 1
        inner = length - half + 1  # half-length substrings inside one of full length
        n = len(self.data)
        if n > MOST_BYTES:
            raise ValueError(f"a block of {n} bytes: places in a block are of 30 bits")
        names = name_substrings(self.data, half) if n >= half else np.zeros(0, U64)
        windows = len(names) - inner + 1
        if windows <= 0:
            self.starts = self.counts = self.docs = np.zeros(0, np.int64)
            self.names = self.order = np.zeros(0, U64)
            self.bucket_of = self.low = np.zeros(0, U64)
            return
        chosen = _least(names, inner)
        inside = np.zeros(windows, bool)
        for begin, end in zip(self.offsets[:-1], self.offsets[1:]):
            inside[begin:max(begin, end - length + 1)] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (chosen[1:] != chosen[:-1])
        firsts = self.offsets[:-1][np.diff(self.offsets) >= length]
        begins[firsts] = True
        starts = np.flatnonzero(begins)
        stops = np.flatnonzero(np.concatenate([inside[:-1] & (~inside[1:] | begins[1:]), inside[-1:]])) + 1
        name = names[chosen[starts]]
        self.starts, self.counts = starts, stops - starts
        self.docs = doc_of(self.offsets, starts)
        key = ((name >> U64(32)) % U64(buckets) << U64(40)) | (name & _LOW)
        self.distinct, self.name_of, self.sizes = np.unique(key, return_inverse=True, return_counts=True)
        self.half_names = names

    def empty(self):
        return not len(self.starts)

    def by_bucket(self):
        """(bucket, slice of the distinct names) for each bucket that the block has."""
        buckets = (self.distinct >> U64(40)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        for begin, end in zip(at, [*at[1:], len(buckets)]):
            yield int(buckets[begin]), slice(begin, end)

    def several(self):
        """Which distinct names more than one document of the block has."""
        ids = self.ids[self.docs]
        low = np.full(len(self.distinct), NO_ID)
        high = np.full(len(self.distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, self.name_of, ids)
        np.maximum.at(high, self.name_of, ids)
        return low != high

    def shared_runs(self, answers):
        """Runs whose name is shared, each distinct one once: (of run, index of the first
        such run, index among the distinct ones). answers: {bucket: packed bits}."""
        shared = np.zeros(len(self.distinct), bool)
        for bucket, part in self.by_bucket():
            if bucket in answers:
                shared[part] = _bits(answers[bucket], part.stop - part.start)
        runs = np.flatnonzero(shared[self.name_of])
        first, last = self.starts[runs], self.starts[runs] + self.counts[runs] - 1
        far = self.length - (self.length // 2 + 1)
        full = name_pairs(self.half_names, far)
        # both ends and the number of windows tell runs apart: they overlap in the middle
        text = full[first] * U64(3) + full[last] * U64(5) + self.counts[runs].astype(U64)
        order = np.lexsort((runs, text, self.name_of[runs]))
        text, name = text[order], self.name_of[runs][order]
        new = np.ones(len(order), bool)
        new[1:] = (text[1:] != text[:-1]) | (name[1:] != name[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return runs, runs[order[new]], which


def _least(names, inner):
    """The place of the smallest of each `inner` consecutive names."""
    result = np.empty(max(0, len(names) - inner + 1), np.int64)
    for begin, end in chunks(len(result)):
        least = names[begin:end + inner - 1] >> _PLACE << _PLACE
        least |= np.arange(begin, begin + len(least), dtype=U64)
        have = 1
        while have < inner:
            step = min(have, inner - have)
            least = np.minimum(least[:len(least) - step], least[step:])
            have += step
        result[begin:end] = least & U64((1 << 30) - 1)
    return result


def _bits(packed, count):
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=count).astype(bool)


def _answers(table, column):
    return dict(zip(table["bucket"].to_pylist(), table[column].to_pylist()))


def _table(rows, schema):
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(schema)})


def _schema(ddl):
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return [(name, kinds[kind]) for name, kind in (part.split(" ") for part in ddl.split(", "))]


def _send_names(length, buckets):
    def send(table):
        block = _Block(table, length, buckets)
        rows = []
        if not block.empty():
            number = table["_block"][0].as_py()
            several = block.several()
            low = (block.distinct & _LOW).view(np.uint8).reshape(-1, 8)[:, :5]
            for bucket, part in block.by_bucket():
                rows.append((number, bucket, low[part].tobytes(), np.packbits(several[part]).tobytes()))
        return _table(rows, _schema(_NAMES))
    return send


def _rank_names(table):
    """Which names of a bucket occur in more than one document."""
    blobs = table["names"].to_pylist()
    sizes = [len(b) // 5 for b in blobs]
    names = np.zeros((sum(sizes), 8), np.uint8)
    names[:, :5] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    names = names.view(U64).ravel()
    shared = np.concatenate([_bits(b, n) for b, n in zip(table["several"].to_pylist(), sizes)])
    order = np.argsort(names)
    same = names[order][1:] == names[order][:-1]
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    cuts = np.cumsum(sizes)[:-1]
    packed = [np.packbits(x).tobytes() for x in np.split(shared, cuts)]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "shared": pa.array(packed, pa.binary())})


def _send_runs(length, buckets):
    def send(docs, shared):
        rows = []
        block = _Block(docs, length, buckets) if docs.num_rows else None
        if block is not None and not block.empty():
            number = docs["_block"][0].as_py()
            answers = _answers(shared, "shared")
            _, kept, _ = block.shared_runs(answers)
            where = (block.distinct[block.name_of[kept]] >> U64(40)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(kept) else []
            for begin, end in zip(at, [*at[1:], len(kept)]):
                part = kept[begin:end]
                begins, counts = block.starts[part], block.counts[part]
                sizes = counts + length - 1
                text = block.data[_ranges(begins, sizes)]
                rows.append((
                    number, int(where[begin]), answers[int(where[begin])],
                    block.ids[block.docs[part]].tobytes(), counts.astype(np.int32).tobytes(), text.tobytes(),
                ))
        return _table(rows, _schema(_RUNS))
    return send


def _ranges(starts, sizes):
    """All positions of the ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _rank_runs(length):
    def rank(table):
        """Which positions of a bucket's runs start a string that a smaller document has."""
        counts = [np.frombuffer(b, np.int32).astype(np.int64) for b in table["windows"].to_pylist()]
        per_row = [int(c.sum()) for c in counts]
        counts = np.concatenate(counts)
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64)
        text = np.frombuffer(b"".join(table["text"].to_pylist()), np.uint8)
        sizes = counts + length - 1
        places = _ranges(np.cumsum(sizes) - sizes, counts)
        ids = np.repeat(ids, counts)
        names = [name_substrings(text, length, family)[places] for family in (0, 1)]
        order = np.argsort(names[0])
        new = names[0][order][1:] != names[0][order][:-1]
        if np.any(~new & (names[1][order][1:] != names[1][order][:-1])):  # two strings of one name
            order = np.lexsort((names[1], names[0]))
            new = (names[0][order][1:] != names[0][order][:-1]) | (names[1][order][1:] != names[1][order][:-1])
        groups = np.flatnonzero(np.concatenate([[True], new]))
        smallest = np.minimum.reduceat(ids[order], groups)
        hits = np.empty(len(ids), bool)
        hits[order] = np.repeat(smallest, np.diff([*groups, len(ids)])) < ids[order]
        packed = [np.packbits(x).tobytes() for x in np.split(hits, np.cumsum(per_row)[:-1])]
        return pa.table({
            "block": table["block"], "bucket": table["bucket"], "shared": table["shared"],
            "hits": pa.array(packed, pa.binary()),
        })
    return rank


def _covered(block, answers):
    """The bytes of a block that are removed."""
    length = block.length
    runs, kept, which = block.shared_runs(_answers(answers, "shared"))
    counts = block.counts[kept]
    where = (block.distinct[block.name_of[kept]] >> U64(40)).astype(np.int64)
    hits, at = [], np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(kept) else []
    found = _answers(answers, "hits")
    for begin, end in zip(at, [*at[1:], len(kept)]):
        hits.append(_bits(found[int(where[begin])], int(counts[begin:end].sum())))
    hits = np.concatenate(hits) if hits else np.zeros(0, bool)
    begins = np.cumsum(counts) - counts
    of_run = block.counts[runs]
    windows = _ranges(block.starts[runs], of_run)
    hit = hits[_ranges(begins[which], of_run)] if len(runs) else np.zeros(0, bool)
    # no smaller document outside the block: then the first of the block's own is the smallest
    later = block.ids[block.docs[runs]] > block.ids[block.docs[kept]][which]
    hit |= np.repeat(later, of_run)
    covered = np.zeros(len(block.data), bool)
    covered[windows[hit]] = True
    have = 1
    while have < length:  # a window's first byte marks the next ones: 1, 2, 4, ... more
        step = min(have, length - have)
        covered[step:] |= covered[:-step].copy()
        have += step
    return covered


def _cut(length, buckets):
    def cut(docs, answers):
        schema = _schema(RESULT)
        if not docs.num_rows:
            return _table([], schema)
        block = _Block(docs, length, buckets)
        covered = np.zeros(len(block.data), bool) if block.empty() else _covered(block, answers)
        rows = []
        for i, (begin, end) in enumerate(zip(block.offsets[:-1], block.offsets[1:])):
            gone, data = covered[begin:end], block.data[begin:end]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            kept = (data[~gone] if len(edges) else data).tobytes()
            rows.append((block.given[i], end - begin, edges[::2].tolist(), edges[1::2].tolist(), kept, block.groups[i]))
        return _table(rows, schema)
    return cut


def remove_repeats(docs: DataFrame, length=50, id_column="doc_id", text_column="text", block_bytes=BLOCK_BYTES) -> DataFrame:
    """Per document its bytes without those covered by a string of `length` bytes that also
    starts in a document of a smaller id; strings are judged on the input, overlaps count, and
    no string crosses documents.

    Columns: doc_id, n_bytes, starts and ends of the removed runs (bytes, end exclusive), kept
    (bytes: a cut may part a character).

    A null text is empty. A document without id keeps all that documents with one do not have
    and takes nothing from others; rows of one id are one document's. Texts shorter than
    `length` lose nothing. Other columns of docs are ignored, and no documents give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text"))
    weight = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long") + ROW_BYTES
    total = docs.agg(F.sum(weight)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    named = docs.select("*", F.xxhash64("_id", "_text").alias("_name"), F.xxhash64(F.lit(1), "_id", F.lit(2), "_text").alias("_other"))
    row = ["_name", "_other"]
    weights = named.groupBy(*row).agg(F.sum(weight).alias("_weight"), F.count("*").alias("_copies"))
    heavy = weights.filter((F.col("_copies") > 1) & (F.col("_weight") > 2 * (total // parts)))  # parts / 2 groups at most
    groups = written(heavy.select(*row, F.monotonically_increasing_id().alias("_group")), "equal_rows")
    if groups.isEmpty():
        return _removed(docs.withColumn("_group", F.lit(None).cast("long")), length, parts).drop("_group")
    marked = named.join(F.broadcast(groups), row, "left")
    copies = marked.filter("_group is not null")
    once = copies.groupBy("_group").agg(F.any_value("_id").alias("_id"), F.any_value("_text").alias("_text"))
    dealt = marked.filter("_group is null").select("_id", "_text", "_group").unionByName(once)
    found = written(_removed(dealt, length, parts), "removed")
    each = copies.select("_group", F.monotonically_increasing_id().alias("_copy"))
    again = spread_join(each, found.filter("_group is not null"), "_group", spread=["_copy"])
    return found.filter("_group is null").drop("_group").unionByName(again.drop("_group", "_copy"))


def _in_blocks(docs, parts):
    return docs.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(parts)))


def _removed(docs, length, parts):
    """RESULT of rows (_id, _text, _group); _group is only handed through."""
    by_block = _in_blocks(docs, parts).groupBy("_block")
    names = by_block.applyInArrow(_send_names(length, parts), _NAMES)
    shared = names.groupBy("bucket").applyInArrow(_rank_names, _SHARED)
    runs = by_block.cogroup(shared.groupBy("block")).applyInArrow(_send_runs(length, parts), _RUNS)
    hits = runs.groupBy("bucket").applyInArrow(_rank_runs(length), _HITS)
    return by_block.cogroup(hits.groupBy("block")).applyInArrow(_cut(length, parts), RESULT)
