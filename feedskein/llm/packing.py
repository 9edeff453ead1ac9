"""Mixture-controlled packing of tokenized documents into training sequences.

Each source is a queue of tokens. A sequence is filled by deficit round-robin: every source is
credited its target share of the sequence, sources whose credit reaches LEAST_PIECE tokens are
served in turn, and room that is left goes to the sources with the highest credits, which then
are in debt. Credits are kept from sequence to sequence, so that proportions hold over any run
of sequences although a small source is not cut into crumbs. A source that is used up leaves
its share to the others.

What is served where follows from the number of tokens of each source alone. The line of all
tokens is divided into blocks at levels that are known without walking it: at a level, a source
has been served its weight times the level. So every task works out the blocks that its own
documents lie in, beginning from the credits carried over to them, and no token is shuffled.
Tokens are written once; the only shuffles are of token counts by input partition and source.
"""

import functools
import json
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedskein.llm.arrays import slices
from feedskein.llm.bpe import vocabulary
from feedskein.session import written

LENGTH = 2048
END_ID = 1
LEAST_PIECE = 32
TOKENS_PER_BLOCK = 1 << 19
MOST_QUEUES = 256
LONGEST = 1 << 14  # longer runs of text without a blank to cut at are left to the list-merging encoder
POINT = 40  # binary places of levels and credits
PIECES = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


# token ids


class Tokenizer:
    """Ids as the vocabulary's own library gives them, its special strings included."""

    def __init__(self, content):
        import tiktoken

        given = json.loads(content)
        self.plain = vocabulary(content, 20_000)
        special = self.plain.special
        ranks = {text: i for i, text in self.plain.strings.items() if i not in special.values()}
        merged = [i for _, i in sorted(self.plain.merges.values())]
        if merged != sorted(merged) or given.get("normalizer"):
            raise ValueError("the ids of the vocabulary are not in the order of its merges")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.kind = np.dtype("<u2" if max(self.plain.strings) < 1 << 16 else "<u4")

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LONGEST:
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype(self.kind)
        parts = []
        for part in cut_at_blanks(text):
            if len(part) > LONGEST:
                parts.append(np.frombuffer(self.plain.encode(part), np.int32))
            else:
                parts.append(self.encoding.encode_to_numpy(part, allowed_special="all"))
        return np.concatenate(parts).astype(self.kind)


def cut_at_blanks(text, most=LONGEST):
    """Parts of at most `most` characters whose ids together are those of the text, longer
    ones where it has no place to cut: before a single blank between two signs, where a
    piece of the text always ends."""
    begin = 0
    while len(text) - begin > most:
        cut = begin + most
        while cut > begin and not _ends_at(text, cut):
            cut = text.rfind(" ", begin, cut)
        if cut <= begin:
            cut = text.find(" ", begin + most)
            while cut >= 0 and not _ends_at(text, cut):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
        yield text[begin:cut]
        begin = cut
    yield text[begin:]


def _ends_at(text, at):
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


@functools.lru_cache(maxsize=2)
def _tokenizer(content):
    return Tokenizer(content)


TOKENS = "_part int, doc_id long, source string, _key string, _before long, _tokens long, _ids binary"


def tokenize(docs: DataFrame, vocabulary_path, id_column="doc_id", text_column="text", source_column="source", end_id=END_ID):
    """One row per document: its ids and the end id, packed, and how many tokens of its source
    come before it in its input partition, whose number is `_part`."""
    with open(vocabulary_path, encoding="utf-8") as file:
        content = file.read()

    def run(batches):
        known = _tokenizer(content)
        part, before = TaskContext.get().partitionId(), {}
        end = np.array([end_id], known.kind).tobytes()
        for whole in batches:
            for begin, count in slices(whole["_text"], 1 << 22):
                batch = whole.slice(begin, count)
                ids = [known.encode(t).tobytes() + end if t else end for t in batch["_text"].to_pylist()]
                counts = [len(i) // known.kind.itemsize for i in ids]
                starts = []
                for key, n in zip(batch["_key"].to_pylist(), counts):
                    starts.append(before.get(key, 0))
                    before[key] = starts[-1] + n
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(count, part, np.int32)), batch["_id"], batch["_source"], batch["_key"],
                    pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()),
                ], ["_part", "doc_id", "source", "_key", "_before", "_tokens", "_ids"])

    source = F.col(source_column).cast("string")
    key = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    given = docs.select(F.col(id_column).cast("long").alias("_id"), source.alias("_source"), key.alias("_key"), F.col(text_column).alias("_text"))
    return given.mapInArrow(run, TOKENS)


# who is served where


class Plan:
    """The order in which the tokens of all queues stand. `totals` and `weights` are per queue."""

    def __init__(self, totals, weights, length=LENGTH, least_piece=LEAST_PIECE, tokens_per_block=TOKENS_PER_BLOCK):
        self.totals, self.length, self.least = totals, length, least_piece
        self.total = sum(totals)
        self.blocks = max(1, -(-self.total // tokens_per_block))
        whole = sum(weights) or 1
        # in 2**-POINT: few enough that credits stay exact
        self.weights = [max(1, (w << POINT) // whole) for w in weights]
        self.used_up = sorted(-(-(t << POINT) // w) for t, w in zip(totals, self.weights))
        self.full = self.total // length * length
        self.starts = functools.lru_cache(maxsize=4096)(self._starts)
        self.block = functools.lru_cache(maxsize=64)(self._block)

    def level(self, tokens):
        """A level at which the queues have been served about so many tokens together."""
        low, high = 0, self.used_up[-1]
        while low < high:
            middle = (low + high) // 2
            if sum(min(t, w * middle >> POINT) for t, w in zip(self.totals, self.weights)) < tokens:
                low = middle + 1
            else:
                high = middle
        return low

    def _starts(self, block):
        """(level, tokens of each queue before the block): whole least pieces, but for the rest of a queue."""
        if block >= self.blocks:
            return self.used_up[-1], self.totals
        level = self.level(self.total * block // self.blocks)
        return level, [t if w * level >> POINT >= t else (w * level >> POINT) // self.least * self.least for t, w in zip(self.totals, self.weights)]

    def blocks_of(self, queue, begin, end):
        """The blocks in which tokens begin to end of a queue lie."""
        first = bisect_right(range(self.blocks), begin, key=lambda b: self.starts(b)[1][queue]) - 1
        block = first
        while block < self.blocks and self.starts(block)[1][queue] < end:
            yield block
            block += 1

    def rooms(self, at, end):
        """The sizes of the sequences, or of their parts, from place to place on the line of all tokens."""
        while at < end:
            if at < self.full:
                room = min(self.length - at % self.length, end - at)
            else:  # what fills no sequence makes sequences of powers of two
                rest = self.total - self.full
                done = at - self.full
                bound = 0
                for bit in reversed(range(rest.bit_length())):
                    if rest >> bit & 1:
                        bound += 1 << bit
                        if bound > done:
                            break
                room = min(bound - done, end - at)
            yield room
            at += room

    def _block(self, block):
        """For each queue: the places in the queue at which it is served in this block, and
        those on the line of all tokens, ascending, with the end of the last one."""
        level, start = self.starts(block)
        _, end = self.starts(block + 1)
        left = [e - s for s, e in zip(start, end)]
        credit = [(w * level - (s << POINT)) if n else 0 for w, s, n in zip(self.weights, start, left)]
        queues = [q for q, n in enumerate(left) if n]
        weight, least = sum(self.weights[q] for q in queues), self.least
        served = [([], []) for _ in left]
        done, at, turn = list(start), sum(start), 0

        def serve(queue, tokens):
            nonlocal at, room
            served[queue][0].append(done[queue])
            served[queue][1].append(at)
            done[queue] += tokens
            left[queue] -= tokens
            credit[queue] -= tokens << POINT
            at += tokens
            room -= tokens

        for room in self.rooms(sum(start), sum(end)):
            step = (room << POINT) // weight
            for queue in queues:
                credit[queue] += self.weights[queue] * step
            for queue in queues[turn:] + queues[:turn]:
                tokens = min(left[queue], credit[queue] >> POINT, room)
                if tokens >= min(least, left[queue]) and tokens > 0:
                    serve(queue, tokens)
            while room:
                queue = max((q for q in queues if left[q]), key=lambda q: credit[q])
                serve(queue, min(left[queue], room, max(least, credit[queue] >> POINT)))
            turn += 1
            if not all(left[q] for q in queues):
                queues = [q for q in queues if left[q]]
                weight = sum(self.weights[q] for q in queues) or 1
            turn = turn % len(queues) if queues else 0
        return [(np.array([*places, d], np.int64), np.array(line, np.int64)) for (places, line), d in zip(served, done)]

    def sequence(self, places):
        """(sequence, offset) of places on the line of all tokens."""
        number, offset = places // self.length, places % self.length
        rest, bound, row = self.total - self.full, self.full, self.full // self.length
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                inside = (places >= bound) & (places < bound + (1 << bit))
                number[inside], offset[inside] = row, places[inside] - bound
                bound, row = bound + (1 << bit), row + 1
        return number, offset


def shares(totals: dict, proportions=None):
    """Whole-number weights of queues: the tokens of each, or target proportions of the named
    ones and the tokens of the others for what those leave."""
    if not proportions:
        return dict(totals)
    named = {k: p for k, p in proportions.items() if k in totals}
    rest = sum(n for k, n in totals.items() if k not in named)
    free = 1 - sum(named.values())
    if any(p <= 0 for p in named.values()) or free < -1e-9 or (rest and free <= 1e-9):
        raise ValueError("target proportions must be positive and leave room for sources that are not named")
    whole = 1 << POINT
    return {k: max(1, int(whole * (named[k] if k in named else free * n / rest))) for k, n in totals.items()}


def pack(docs: DataFrame, vocabulary_path, proportions=None, length=LENGTH, least_piece=LEAST_PIECE, tokens_per_block=TOKENS_PER_BLOCK,
         most_queues=MOST_QUEUES, end_id=END_ID, id_column="doc_id", text_column="text", source_column="source") -> DataFrame:
    """The pieces of all documents in sequences: (doc_id, source, start, length, doc_tokens,
    sequence_id, offset, ids), ids being 32-bit little-endian numbers.

    Every sequence has `length` tokens, and the tokens at the end that fill none make sequences
    of powers of two: nothing is padded. `proportions` gives target shares of tokens by source
    (None for rows without one); by default each source has its share of the whole, so that all
    last to the end. A source beyond the `most_queues` largest shares a queue with the others
    beyond, and is packed as whole as the rest. A null or empty text is the end id alone. Rows
    of one id are packed each for itself; other columns are ignored. No rows give no pieces.
    """
    tokens = written(tokenize(docs, vocabulary_path, id_column, text_column, source_column, end_id), "tokens")
    with open(vocabulary_path, encoding="utf-8") as file:
        kind = _tokenizer(file.read()).kind
    counts = written(tokens.groupBy("_part", "_key").agg(F.sum("_tokens").alias("_n")), "counts")
    totals = counts.groupBy("_key").agg(F.sum("_n").alias("n"))
    largest = totals.orderBy(F.col("n").desc(), "_key").limit(most_queues).collect()
    queues = {row["_key"]: int(row["n"]) for row in largest}
    everything = int(counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    if not everything:
        return docs.sparkSession.createDataFrame([], PIECES)
    names = sorted(queues)
    targets = {("" if k is None else f"={k}"): p for k, p in (proportions or {}).items()}
    others = everything - sum(queues.values())
    if others:
        names.append(None)
        queues[None] = others
    weights = shares(queues, targets)
    plan_of = _Planner([queues[k] for k in names], [weights[k] for k in names], length, least_piece, tokens_per_block)

    # the place of each input partition's tokens in their queue: after those of earlier partitions
    number = F.coalesce(*[F.when(F.col("_key") == k, i) for i, k in enumerate(names) if k is not None], F.lit(len(names) - 1))
    placed = counts.withColumn("_queue", number)
    inside = Window.partitionBy("_queue", "_part").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_queue", "_part").agg(F.sum("_n").alias("_all"))
    earlier = Window.partitionBy("_queue").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_all").over(earlier), F.lit(0))).drop("_all")
    placed = placed.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(parts, ["_queue", "_part"])
    bases = placed.select("_part", "_key", "_queue", (F.col("_base") + F.col("_inside")).alias("_base"))
    given = tokens.join(bases, ["_part", "_key"]).select(
        "doc_id", "source", "_queue", (F.col("_base") + F.col("_before")).alias("_at"), "_tokens", "_ids")

    def run(batches):
        plan = plan_of()
        for whole in batches:
            for begin, count in slices(whole["_ids"], 1 << 23, 10_000):
                yield from _pieces(plan, whole.slice(begin, count), kind)

    return given.mapInArrow(run, PIECES)


class _Planner:
    """Makes the plan once per worker."""

    def __init__(self, *args):
        self.args = args

    def __call__(self):
        return _plan(*map(lambda a: tuple(a) if isinstance(a, list) else a, self.args))


@functools.lru_cache(maxsize=2)
def _plan(totals, weights, length, least_piece, tokens_per_block):
    return Plan(list(totals), list(weights), length, least_piece, tokens_per_block)


def _pieces(plan, batch, kind):
    """The pieces of some documents. Documents of a queue that follow each other there are cut together."""
    queue, at, tokens = (batch[c].to_numpy() for c in ("_queue", "_at", "_tokens"))
    order = np.lexsort((at, queue))
    follows = (queue[order][1:] == queue[order][:-1]) & (at[order][1:] == (at + tokens)[order][:-1])
    for rows in np.split(order, np.flatnonzero(~follows) + 1):
        if not len(rows):
            continue
        ids = np.frombuffer(b"".join(batch["_ids"].take(pa.array(rows)).to_pylist()), kind).astype("<u4")
        starts, which = at[rows], int(queue[rows[0]])
        begin, end = int(starts[0]), int(starts[-1] + tokens[rows[-1]])
        for block in plan.blocks_of(which, begin, end):
            places, line = plan.block(block)[which]
            low, high = max(begin, int(places[0])), min(end, int(places[-1]))
            cuts = np.unique(np.concatenate([[low, high], starts[(starts > low) & (starts < high)], places[(places > low) & (places < high)]]))
            if high <= low:
                continue
            row = np.searchsorted(starts, cuts[:-1], side="right") - 1
            turn = np.searchsorted(places, cuts[:-1], side="right") - 1
            number, offset = plan.sequence(line[turn] + cuts[:-1] - places[turn])
            picked = pa.array(rows[row])
            bounds = pa.array(((cuts - low) * 4).astype(np.int32))
            data = ids[low - begin:high - begin].tobytes()
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].take(picked), batch["source"].take(picked), pa.array(cuts[:-1] - starts[row]), pa.array(np.diff(cuts)),
                batch["_tokens"].take(picked), pa.array(number), pa.array(offset),
                pa.Array.from_buffers(pa.binary(), len(row), [None, bounds.buffers()[1], pa.py_buffer(data)]),
            ], ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, pieces): the tokens of each sequence in order, and the documents they come from."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "source", "ids")))
    joined = F.aggregate("_p", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    return pieces.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", F.aggregate("_p", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"), joined.alias("ids"),
        F.transform("_p", lambda p: F.struct(p["offset"], p["length"], p["doc_id"], p["start"], p["source"])).alias("pieces"),
    )
