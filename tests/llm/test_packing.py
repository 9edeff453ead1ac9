"""Packing: every id once, no padding, proportions, and ids as the tokenizers library gives them."""

import collections
import random

import numpy as np
import pytest

from feedskein.llm import packing
from feedskein.llm.queries import vocabulary_path

DOCS = "doc_id long, text string, source string, start int, ids int, _part int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def own():
    with open(vocabulary_path(), encoding="utf-8") as file:
        return packing.Tokenizer(file.read())


def rows(n, seed=1):
    """A third of one source, a few of some, one of another, and rows without."""
    r = random.Random(seed)
    words = ["alpha", "beta", "  gamma", "\n\n", "delta's", "12", "é", "漢字"]
    out = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else None if i % 10 == 1 else "rare" if i == 7 else f"s{i % 7}"
        out.append((i, " ".join(r.choice(words) for _ in range(r.randint(0, 400))), source, 1, 2, 3))
    return out


def checked(pieces, docs, library, length):
    """The pieces, after comparing them with the ids of the documents one by one."""
    ids = collections.defaultdict(list)
    for doc_id, text, *_ in docs:
        ids[doc_id].append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    parts, lines = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        found = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(found) == p["length"] > 0
        assert any(found == whole[p["start"]:p["start"] + p["length"]] and len(whole) == p["doc_tokens"] for whole in ids[p["doc_id"]])
        parts[p["doc_id"]].append((p["start"], p["length"]))
        lines[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc_id, wholes in ids.items():
        if len(wholes) == 1:
            at = 0
            for start, size in sorted(parts[doc_id]):
                assert start == at
                at += size
            assert at == len(wholes[0])
        assert sum(n for _, n in parts[doc_id]) == sum(map(len, wholes))
    assert sorted(lines) == list(range(len(lines)))
    sizes = []
    for row in sorted(lines):
        at = 0
        for offset, size in sorted(lines[row]):
            assert offset == at
            at += size
        sizes.append(at)
    full = sum(map(len, sum(ids.values(), []))) // length
    assert sizes[:full] == [length] * full
    assert all(n & (n - 1) == 0 and n < length for n in sizes[full:]) and len(set(sizes[full:])) == len(sizes[full:])
    return sizes


@pytest.mark.parametrize("block", [1 << 19, 6000, 300])
def test_every_id_lies_in_one_piece(spark, library, block):
    docs = rows(150)
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    pieces = packing.pack(frame, vocabulary_path(), length=256, least_piece=16, tokens_per_block=block).collect()
    checked(pieces, docs, library, 256)


def test_proportions_hold_over_any_run_of_sequences(spark, library):
    docs = rows(400, 2)
    pieces = packing.pack(spark.createDataFrame(docs, DOCS), vocabulary_path(), length=512, tokens_per_block=20_000).collect()
    checked(pieces, docs, library, 512)
    totals, served = collections.Counter(), collections.defaultdict(collections.Counter)
    for p in pieces:
        totals[p["source"]] += p["length"]
        served[p["sequence_id"]][p["source"]] += p["length"]
    whole, so_far = sum(totals.values()), collections.Counter()
    queues = len(totals)
    for done, row in enumerate(sorted(served)[:whole // 512], 1):
        so_far.update(served[row])
        for source, n in totals.items():
            assert abs(so_far[source] - done * 512 * n / whole) <= packing.LEAST_PIECE * queues


def test_target_proportions_until_a_source_is_used_up(spark, library):
    docs = [(i, "word " * 200, "a" if i % 2 else "b", 1, 2, 3) for i in range(100)]
    pieces = packing.pack(spark.createDataFrame(docs, DOCS), vocabulary_path(), {"a": 0.75, "b": 0.25}, length=256, tokens_per_block=4000).collect()
    checked(pieces, docs, library, 256)
    half = [p for p in pieces if p["sequence_id"] < 40]
    a = sum(p["length"] for p in half if p["source"] == "a")
    assert abs(a - 0.75 * 40 * 256) < 64
    last = {p["source"] for p in pieces if p["sequence_id"] > 70}
    assert last == {"b"}
    with pytest.raises(ValueError):
        packing.shares({"a": 1, "b": 2}, {"a": 1.0})


def test_nulls_repeated_ids_long_texts_and_many_sources(spark, library):
    docs = [(1, "twice", "x", 0, 0, 0), (1, "twice", "x", 0, 0, 0), (1, "other", None, 0, 0, 0), (2, None, None, 0, 0, 0), (3, "", "", 0, 0, 0),
            (None, "no id", "x", 0, 0, 0), (4, "long " * 40_000 + "x" * 30_000, "y", 0, 0, 0)]
    docs += [(100 + i, f"text {i}", f"source{i}", 0, 0, 0) for i in range(30)]
    frame = spark.createDataFrame(docs, DOCS)
    pieces = packing.pack(frame, vocabulary_path(), most_queues=3, tokens_per_block=5000).collect()
    checked(pieces, docs, library, 2048)
    assert packing.pack(frame.limit(0), vocabulary_path()).collect() == []
    assert [p["length"] for p in packing.pack(frame.filter("doc_id = 2"), vocabulary_path()).collect()] == [1]


def test_sequences_hold_the_ids_in_order(spark):
    frame = spark.createDataFrame(rows(40), DOCS)
    pieces = packing.pack(frame, vocabulary_path(), length=128)
    by_place = {(p["sequence_id"], p["offset"]): p["ids"] for p in pieces.collect()}
    for row in packing.sequences(pieces).collect():
        assert row["ids"] == b"".join(by_place[row["sequence_id"], p["offset"]] for p in row["pieces"])
        assert len(row["ids"]) == 4 * row["length"]


def test_ids_are_those_of_the_library(library, own):
    r = random.Random(3)
    parts = ["<|endoftext|>", "<|end", " ", "  ", "\n", "'s", "'ll", "abc", " world", "é", "日本", "12", "\xa0", "\x1c", "\x85", "😀", "a" * 30]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1000)]
    texts += [" " * 100_000, "x" * 40_000, "ab  cd " * 5000, ("w " * 20_000) + "\n" * 20_000 + "end", "a  " * 8000]
    for text in texts:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert "".join(packing.cut_at_blanks(text, 50)) == text
