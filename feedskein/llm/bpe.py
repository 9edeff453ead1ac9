"""Byte-pair encoding and decoding with a published vocabulary.

A text is cut at the vocabulary's special strings, the rest into pieces by the byte-level
splitting pattern. A piece starts as its bytes in a doubly linked list; a priority queue holds
the rank of every neighbouring pair, lowest rank and leftmost first. Merging a pair leaves
entries of its old neighbours in the queue; they are stale and skipped when they come up.
That is O(n log n) for a piece of any length. Decoding concatenates the strings of the ids.

The vocabulary is read once by the driver and travels with the tasks. Work is map-only. Each
worker remembers the ids of the pieces it saw last, up to twice PIECES, since pieces recur.
"""

import functools
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.llm.arrays import slices

# The splitting pattern that byte-level vocabularies are made with.
PIECE = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
PIECES = 250_000
LONGEST_KEPT = 64  # longer pieces are not remembered


def _byte_signs():
    """The printable sign that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


def _strings(given):
    """The bytes of each token id."""
    signs = _byte_signs()
    found = {i: bytes(signs[c] for c in token) for token, i in given["model"]["vocab"].items()}
    return found | {t["id"]: t["content"].encode() for t in given["added_tokens"]}


class Vocabulary:
    def __init__(self, content, pieces=PIECES):
        given = json.loads(content)
        signs = _byte_signs()
        vocabulary = given["model"]["vocab"]
        self.strings = _strings(given)
        self.start = [vocabulary[sign] for sign, _ in sorted(signs.items(), key=lambda x: x[1])]
        self.merges = {}
        for rank, pair in enumerate(given["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[left], vocabulary[right]] = rank, vocabulary[left + right]
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.pieces = regex.compile(PIECE)
        self.known = _Known(self, pieces)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.start[b] for b in piece]
        merges = self.merges
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        queue = []
        for at in range(len(ids) - 1):
            found = merges.get((ids[at], ids[at + 1]))
            if found:
                queue.append((found[0], at, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, at, merged = heapq.heappop(queue)
            right = after[at]
            if ids[at] < 0 or right >= len(ids):
                continue
            found = merges.get((ids[at], ids[right]))
            if not found or found[0] != rank:
                continue  # stale: one of the two has been merged with another
            ids[at], ids[right] = merged, -1
            after[at] = beyond = after[right]
            if beyond < len(ids):
                before[beyond] = at
                found = merges.get((merged, ids[beyond]))
                if found:
                    heapq.heappush(queue, (found[0], at, found[1]))
            if before[at] >= 0:
                found = merges.get((ids[before[at]], merged))
                if found:
                    heapq.heappush(queue, (found[0], before[at], found[1]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text, as packed 32-bit integers."""
        if self.special_at is None or not self.special_at.search(text):
            return b"".join(map(self.known.__getitem__, self.pieces.findall(text)))
        packed = []
        for part in self.special_at.split(text):
            if part in self.special:
                packed.append(np.int32(self.special[part]).tobytes())
            else:
                packed.extend(map(self.known.__getitem__, self.pieces.findall(part)))
        return b"".join(packed)

    def decode(self, ids) -> str:
        """Bytes that are no UTF-8 become the replacement character."""
        return _decoded(self.strings, ids)


def _decoded(strings, ids) -> str:
    return b"".join(map(strings.__getitem__, ids)).decode("utf-8", "replace")


class _Known(dict):
    """Packed ids by piece, of the newer pieces here and of those before them in `older`."""

    def __init__(self, vocabulary, most):
        super().__init__()
        self.vocabulary, self.most, self.older = vocabulary, most, {}

    def __missing__(self, piece):
        packed = self.older.get(piece)
        if packed is None:
            packed = np.array(self.vocabulary.merge(piece.encode()), np.int32).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


@functools.lru_cache(maxsize=4)
def vocabulary(content: str, pieces=PIECES) -> Vocabulary:
    """One per worker and vocabulary file."""
    return Vocabulary(content, pieces)


def _content(path):
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary_path: str, id_column="doc_id", text_column="text", pieces=PIECES) -> DataFrame:
    """(doc_id, ids array<int>) for each row, of the whole text; a null or empty text has no
    ids. A worker remembers twice `pieces` pieces: fewer take less memory and more time. Rows of one id are encoded each for itself; other columns are ignored."""
    content = _content(vocabulary_path)

    def run(batches):
        known = vocabulary(content, pieces)
        for whole in batches:
            for begin, count in slices(whole["_text"]):
                batch = whole.slice(begin, count)
                packed = [known.encode(t) if t else b"" for t in batch["_text"].to_pylist()]
                offsets = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
                ids = pa.array(np.frombuffer(b"".join(packed), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch["_id"], pa.ListArray.from_arrays(pa.array(offsets), ids)], ["doc_id", "ids"]
                )

    given = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text"))
    return given.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, ids, text): the text that the ids stand for, '' for none or null. An id that
    the vocabulary lacks is an error."""
    strings = _strings(json.loads(_content(vocabulary_path)))  # all that decoding needs: workers make no merges of it

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                ids = batch["ids"].flatten().to_numpy()  # row by row from here: a number in a list takes ten times the room
                ends = np.cumsum(batch["ids"].value_lengths().fill_null(0).to_numpy())
                texts = [_decoded(strings, ids[begin:end].tolist()) for begin, end in zip([0, *ends[:-1]], ends)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
