"""Near-duplicates by MinHash: an inverted join over signature coordinates.

A document's set are its distinct shingles of five words. Its signature holds, for each of
COORDINATES hash functions, the smallest hash of the set; two sets agree in a coordinate with
the probability of their similarity. Documents are posted under each pair of coordinate and
value, and those that collide in at least MATCHES coordinates are compared by their full sets.

Prefix and skip: two signatures that agree in MATCHES coordinates agree in at least one of any
COORDINATES - MATCHES + 1. So a document is posted under its rarest pairs only, by a count over
all documents, and the long lists of frequent pairs are skipped; agreement in them is counted
when two documents meet. Documents of equal sets are one from the start.

Large groups. Emitting all pairs of a list would grow with its square. Instead the members of
the lists that have the same leader, the member that collides most, form a cluster. All are
compared with the leader, which gives links and exact distances to it. Distance by Jaccard is a
metric, so two members whose distances to the leader differ by more than the limit cannot be
linked, and two members that are both linked to the leader need no comparison. What is left, in
clusters where not all are, is compared in pairs of chunks of bounded size, ordered by distance;
a task gives back only links that connect. So every pair that collides under a posted pair is
compared, connected, or ruled out, and no list is cut.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedskein.llm.arrays import U64, mix, shingle_sets, slices, text_bytes, word_names
from feedskein.llm.components import components
from feedskein.operators.skew import spread_join
from feedskein.session import written

SHINGLE = 5
SIMILAR = (75, 100)  # intersection / union at least
COORDINATES, MATCHES = 64, 34
DOCS_PER_BLOCK = 4096
CHUNK = 512  # documents of a cluster that are compared with as many others in one task
BINS = 20  # by distance to the leader, for clusters of more than a chunk

_RANDOM = np.random.default_rng(64_34)
_FACTORS = _RANDOM.integers(0, 2**63, COORDINATES, dtype=U64) * U64(2) + U64(1)
_TERMS = _RANDOM.integers(0, 2**64, COORDINATES, dtype=U64, endpoint=False)
_SETS = "doc long, shingles binary, signature binary"
_KEYS = "block long, bucket long, keys binary, counts binary"


def signature(shingles):
    """The smallest hash of a set under each of the hash functions; uint32."""
    least = None
    for begin in range(0, len(shingles), 1024):
        part = ((shingles[begin:begin + 1024, None] * _FACTORS + _TERMS) >> U64(32)).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least.astype(np.uint32)


def _sets(texts):
    """The shingle set of each text of an Arrow column."""
    for begin, count in slices(texts):
        yield from shingle_sets(*word_names(*text_bytes(texts.slice(begin, count))), SHINGLE)


def sketches(docs: DataFrame) -> DataFrame:
    """(id, n, name1, name2, signature) from (id, text): the size of the set, 128 bits that
    name it, its signature; the last three are null for an empty set."""
    def run(batches):
        for batch in batches:
            rows = []
            for shingles in _sets(batch["text"]):
                if len(shingles):
                    names = [int(mix(shingles ^ U64(k)).sum(dtype=U64).astype(np.int64)) for k in (0x5BD1E995, 0x27D4EB2F)]
                    rows.append((len(shingles), *names, signature(shingles).tobytes()))
                else:
                    rows.append((0, None, None, None))
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["id", "n", "name1", "name2", "signature"])

    return docs.mapInArrow(run, "id long, n long, name1 long, name2 long, signature binary")


def _keys(table):
    """Coordinate and value of each document of a block, [documents, COORDINATES]."""
    values = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(-1, COORDINATES)
    return (np.arange(COORDINATES, dtype=U64) << U64(32)) | values.astype(U64)


def _by_bucket(keys, buckets):
    """Distinct keys in order of bucket, their counts and buckets, and the place of each key."""
    distinct, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    bucket = (mix(distinct) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return distinct[order], counts[order], bucket[order], back[place].reshape(keys.shape)


def _runs(values):
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return zip(at, [*at[1:], len(values)])


def _send_keys(buckets):
    def send(table):
        keys, counts, bucket, _ = _by_bucket(_keys(table), buckets)
        rows = [(int(bucket[b]), keys[b:e].tobytes(), counts[b:e].astype(np.int64).tobytes()) for b, e in _runs(bucket)]
        columns = list(zip(*rows))
        return pa.table({
            "block": pa.array([table["block"][0].as_py()] * len(rows), pa.int64()), "bucket": pa.array(columns[0], pa.int64()),
            "keys": pa.array(columns[1], pa.binary()), "counts": pa.array(columns[2], pa.binary()),
        })
    return send


def _count_keys(table):
    """The counts of a bucket's keys over all blocks, for each block in the order it sent them."""
    blobs = table["keys"].to_pylist()
    keys = np.frombuffer(b"".join(blobs), U64)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int64)
    _, place = np.unique(keys, return_inverse=True)
    totals = np.zeros(place.max() + 1, np.int64)
    np.add.at(totals, place, counts)
    cuts = np.cumsum([len(b) // 8 for b in blobs])[:-1]
    packed = [t.tobytes() for t in np.split(totals[place], cuts)]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "totals": pa.array(packed, pa.binary())})


def _post(buckets):
    def post(docs, answers):
        """Each document under its rarest keys, those left out that it alone has."""
        empty = {"key": pa.array([], pa.int64()), "doc": pa.array([], pa.int64()), "met": pa.array([], pa.int64())}
        if not docs.num_rows:
            return pa.table(empty)
        keys = _keys(docs)
        _, _, bucket, place = _by_bucket(keys, buckets)
        found = dict(zip(answers["bucket"].to_pylist(), answers["totals"].to_pylist()))
        totals = np.concatenate([np.frombuffer(found[int(bucket[b])], np.int64) for b, _ in _runs(bucket)])[place]
        rarest = np.lexsort((keys, totals), axis=1)[:, :COORDINATES - MATCHES + 1]
        rare = np.take_along_axis(totals, rarest, 1)
        shared = rare > 1
        ids = docs["rep"].to_numpy()
        met = totals.sum(axis=1) - COORDINATES
        times = shared.sum(axis=1)
        return pa.table({
            "key": np.take_along_axis(keys, rarest, 1)[shared].astype(np.int64), "doc": np.repeat(ids, times), "met": np.repeat(met, times),
        })
    return post


def postings(classes: DataFrame) -> DataFrame:
    """(key, doc, met): classes (rep, signature) under the rarest of their keys; met says in
    how many coordinates others agree with the document, counted with each other document."""
    spark = classes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() // DOCS_PER_BLOCK))
    by_block = classes.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(parts))).groupBy("block")
    sent = by_block.applyInArrow(_send_keys(parts), _KEYS)
    counted = sent.groupBy("bucket").applyInArrow(_count_keys, "block long, bucket long, totals binary")
    return by_block.cogroup(counted.groupBy("block")).applyInArrow(_post(parts), "key long, doc long, met long")


def clusters(posted: DataFrame) -> DataFrame:
    """(leader, doc): the members of all lists by leader, a leader in its own cluster too."""
    lists = posted.groupBy("key").agg(
        F.max(F.struct("met", (-F.col("doc")).alias("minus"))).alias("top"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    lists = lists.filter("low <> high").select("key", (-F.col("top.minus")).alias("leader"))
    members = posted.select("key", "doc").join(lists, "key").select("leader", "doc").distinct()
    return members


def _full_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = list(_sets(batch["text"]))
            yield pa.RecordBatch.from_arrays([
                batch["id"], pa.array([s.tobytes() for s in found], pa.binary()),
                pa.array([signature(s).tobytes() if len(s) else b"" for s in found], pa.binary()),
            ], ["doc", "shingles", "signature"])

    return docs.mapInArrow(run, _SETS)


def _common(a, b):
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _alike(common, a, b):
    return SIMILAR[1] * common >= SIMILAR[0] * (a + b - common)


def _distances(rows: DataFrame) -> DataFrame:
    """(leader, doc, distance, linked) from rows with both sets."""
    def run(batches):
        for batch in batches:
            result = []
            for mine, other in zip(batch["shingles"].to_pylist(), batch["leader_shingles"].to_pylist()):
                a, b = np.frombuffer(mine, U64), np.frombuffer(other, U64)
                common = _common(a, b)
                result.append((1 - common / (len(a) + len(b) - common), _alike(common, len(a), len(b))))
            columns = list(zip(*result)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [batch["leader"], batch["doc"], pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.bool_())],
                ["leader", "doc", "distance", "linked"])

    return rows.mapInArrow(run, "leader long, doc long, distance double, linked boolean")


def _root(parents, x):
    while parents.setdefault(x, x) != x:
        parents[x] = parents[parents[x]]
        x = parents[x]
    return x


def _link_chunks(one, two):
    """Links that connect components, between the documents of two chunks of a cluster or
    within one chunk (two is empty then): pairs that collide in enough coordinates and whose
    full sets are similar."""
    found = []
    if one.num_rows:
        within = not two.num_rows
        sides = [one, one if within else two]
        ids, own, distance = ([t[c].to_numpy() for t in sides] for c in ("doc", "component", "distance"))
        sets = [[np.frombuffer(s, U64) for s in t["shingles"].to_pylist()] for t in sides]
        marks = [np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint32).reshape(-1, COORDINATES) for t in sides]
        sizes = [np.array([len(s) for s in side]) for side in sets]
        parents = {}
        limit = 1 - SIMILAR[0] / SIMILAR[1] + 1e-9
        for i in range(len(ids[0])):
            others = (own[1] != own[0][i]) & (np.abs(distance[1] - distance[0][i]) <= limit)
            small, large = np.minimum(sizes[1], sizes[0][i]), np.maximum(sizes[1], sizes[0][i])
            others &= SIMILAR[1] * small >= SIMILAR[0] * large
            if within:
                others[:i + 1] = False
            others = np.flatnonzero(others)
            matches = (marks[1][others] == marks[0][i]).sum(axis=1)
            order = np.argsort(-matches, kind="stable")
            for j in others[order[:(matches >= MATCHES).sum()]]:
                a, b = _root(parents, own[0][i]), _root(parents, own[1][j])
                if a != b and _alike(_common(sets[0][i], sets[1][j]), sizes[0][i], sizes[1][j]):
                    parents[max(a, b)] = min(a, b)
                    found.append((ids[0][i], ids[1][j]))
    columns = list(zip(*found)) or [(), ()]
    return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})


def open_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links inside clusters whose members are not all linked to the leader. members:
    (leader, doc, distance, component), component the leader for those that are, else the
    document itself."""
    by_leader = members.groupBy("leader").agg(
        F.count("doc").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    unsettled = by_leader.filter("low <> high").select("leader", "n")
    bin_of = F.when(F.col("n") <= CHUNK, 0).otherwise(F.least(F.floor(F.col("distance") * BINS), F.lit(BINS - 1)))
    # a large cluster's members are one key of both joins
    binned = spread_join(members, unsettled, "leader", spread=["doc"]).withColumn("bin", bin_of.cast("int"))
    counts = binned.groupBy("leader", "bin").agg(F.ceil(F.count("doc") / CHUNK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    chunked = written(
        spread_join(binned, counts, ["leader", "bin"], spread=["doc"]).select(
            "leader", "doc", "distance", "component", F.struct("bin", part.alias("part")).alias("chunk")),
        "chunks")
    chunks = chunked.groupBy("leader", "chunk").agg(
        F.min("distance").alias("near"), F.max("distance").alias("far"), F.min("component").alias("low"), F.max("component").alias("high"))
    limit = 1 - SIMILAR[0] / SIMILAR[1] + 1e-9
    a, b = chunks.alias("a"), chunks.alias("b")
    one_component = (F.col("a.low") == F.col("a.high")) & (F.col("b.low") == F.col("b.high")) & (F.col("a.low") == F.col("b.low"))
    pairs = a.join(b, F.col("a.leader") == F.col("b.leader")).filter(
        (F.col("a.chunk") <= F.col("b.chunk")) & ~one_component
        & (F.col("b.near") - F.col("a.far") <= limit) & (F.col("a.near") - F.col("b.far") <= limit)
    ).select(F.col("a.leader").alias("leader"), F.col("a.chunk").alias("one"), F.col("b.chunk").alias("two"))
    pairs = written(pairs, "chunk_pairs")
    full = chunked.join(sets, "doc")
    group = ["leader", "one", "two"]
    first = full.withColumnRenamed("chunk", "one").join(pairs, ["leader", "one"]).groupBy(*group)
    second = full.withColumnRenamed("chunk", "two").join(pairs.filter("one <> two"), ["leader", "two"])
    second = second.toDF(*second.columns).groupBy(*group)  # columns of its own, apart from the first's
    return first.cogroup(second).applyInArrow(_link_chunks, "a long, b long")


def _with_leaders(star: DataFrame, sets: DataFrame) -> DataFrame:
    """(leader, doc, shingles, leader_shingles). The members of a large cluster are dealt into
    parts, and its leader's set is sent once to each part."""
    parts = star.groupBy("leader").agg(F.ceil(F.count("doc") / CHUNK).cast("int").alias("parts"))
    dealt = spread_join(star, parts, "leader", spread=["doc"]).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    leaders = sets.select(F.col("doc").alias("leader"), F.col("shingles").alias("leader_shingles")).join(parts, "leader")
    leaders = leaders.select("leader", "leader_shingles", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(sets, "doc").join(leaders, ["leader", "part"]).select("leader", "doc", "shingles", "leader_shingles")


def near_duplicates(docs: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Words are A-Z as a-z, parted by ASCII white space. A text of fewer than five words is one
    shingle; a null text or one without words has none and is linked with nothing. Documents
    are linked if 100 * intersection >= 75 * union of their sets, judged on the full sets;
    component_id is the smallest doc_id that links reach, kept says whether that is the row's
    own. Rows of one id are one document in links, and all have its component. A row without
    id is linked with nothing: component_id is null and it is kept.
    """
    given = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    sketched = written(sketches(given), "sketches")
    sets_of = sketched.filter("n > 0 and id is not null")
    classes = written(
        sets_of.groupBy("name1", "name2", "n").agg(F.min("id").alias("rep"), F.any_value("signature").alias("signature")), "classes")
    posted = written(postings(classes.select("rep", "signature")), "postings")
    members = written(clusters(posted), "members")
    star = members.filter("leader <> doc")
    wanted = star.select("doc").unionByName(star.select(F.col("leader").alias("doc"))).distinct()
    # a shuffle at every size: the wanted documents are a share of all
    texts = given.join(wanted.withColumnRenamed("doc", "id").hint("merge"), "id", "left_semi")
    sets = written(_full_sets(texts), "sets")
    compared = written(_distances(_with_leaders(star, sets)), "compared")
    links = compared.filter("linked").select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    near = compared.groupBy("leader", "doc").agg(F.min("distance").alias("distance"), F.max("linked").alias("linked"))
    own = near.select("leader").distinct().select("leader", F.col("leader").alias("doc"), F.lit(0.0).alias("distance"), F.lit(True).alias("linked"))
    placed = near.unionByName(own).select(
        "leader", "doc", "distance", F.when(F.col("linked"), F.col("leader")).otherwise(F.col("doc")).alias("component"))
    more = written(open_links(placed, sets), "links")
    final = components(links.unionByName(more).unionByName(_same_id(sets_of, classes)))
    named = classes.select("name1", "name2", "n", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "name1", "name2", "n", F.coalesce("component", "rep").alias("component"))
    result = sketched.drop("signature").join(named, ["name1", "name2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return result.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        (F.coalesce(component, F.lit(0)) == F.coalesce("id", F.lit(0))).alias("kept"),
    )


def _same_id(sketched, classes):
    """Links between the classes of rows that have one id and different sets."""
    several = sketched.groupBy("id").agg(F.min("name1").alias("low"), F.max("name1").alias("high")).filter("low <> high")
    rows = sketched.join(several.select("id"), "id").join(classes, ["name1", "name2", "n"])
    return rows.select(F.col("id").alias("a"), F.col("rep").alias("b"))


def drop_near_duplicates(docs: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """docs with one row of each component, that of its smallest id; of several rows with that
    id the one with the smallest hash of its text. Rows without id all stay."""
    found = near_duplicates(docs, id_column, text_column)
    kept = found.filter("kept and doc_id is not null").select(F.col("doc_id").alias(id_column)).distinct()
    first = Window.partitionBy(id_column).orderBy(F.xxhash64(text_column))
    rank = "_rank"
    while rank in docs.columns:
        rank += "_"
    chosen = docs.join(kept, id_column, "left_semi").withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1)
    return chosen.drop(rank).unionByName(docs.filter(F.col(id_column).isNull()))
