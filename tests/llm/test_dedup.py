"""Repeated strings and near-duplicates against plain Python."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from feedskein.llm import arrays, suffix_dedup
from feedskein.llm.components import components
from feedskein.llm.near_dedup import drop_near_duplicates, near_duplicates
from feedskein.llm.suffix_dedup import remove_repeats

DOCS = "doc_id long, text string, _text string, _block long, id string, n long, block int, kept boolean"


def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, False) for i, t in rows], DOCS)


def kept_bytes(rows, length):
    first = {}
    for i, text in rows:
        data, rank = (text or "").encode(), float("inf") if i is None else i
        for at in range(len(data) - length + 1):
            first[data[at:at + length]] = min(first.get(data[at:at + length], rank), rank)
    result = []
    for i, text in rows:
        data, rank = (text or "").encode(), float("inf") if i is None else i
        gone = set()
        for at in range(len(data) - length + 1):
            if first[data[at:at + length]] < rank:
                gone.update(range(at, at + length))
        starts = sorted(at for at in gone if at - 1 not in gone)
        ends = sorted(at + 1 for at in gone if at + 1 not in gone)
        result.append((i, len(data), starts, ends, bytes(b for at, b in enumerate(data) if at not in gone)))
    return sorted(result, key=str)


@pytest.mark.parametrize("seed,alphabet,length", [(1, "ab", 50), (2, "abcdé ", 50), (3, "ab", 9)])
def test_repeats(spark, seed, alphabet, length):
    r = random.Random(seed)
    pool = ["".join(r.choice(alphabet) for _ in range(r.randint(5, 120))) for _ in range(10)]
    rows = [(i, "".join(r.choice(pool)[:r.randint(1, 120)] for _ in range(r.randint(0, 6)))) for i in range(30)]
    rows += [(40, None), (41, "a" * 300), (42, "a" * 200), (None, "a" * 120 + pool[0]), (3, pool[1] * 2), (50, ""), (60, "long " * 9000)]
    found = remove_repeats(docs(spark, rows), length, block_bytes=500).collect()
    assert sorted(((*r[:4], bytes(r["kept"])) for r in found), key=str) == kept_bytes(rows, length)


def test_repeats_in_one_document_stay_and_spans_are_told(spark):
    line = "".join(chr(97 + i % 26) for i in range(0, 600, 7))[:60]
    rows = [(1, line + "|" + line), (2, "x" + line + "y")]
    found = {r["doc_id"]: r for r in remove_repeats(docs(spark, rows)).collect()}
    assert found[1]["starts"] == [] and found[1]["kept"] == rows[0][1].encode()
    assert (found[2]["starts"], found[2]["ends"], bytes(found[2]["kept"])) == ([1], [61], b"xy")


def test_rows_of_one_id_and_equal_rows_spread(spark):
    r = random.Random(11)
    passage = "".join(r.choice("abcdé ") for _ in range(80))
    rows = [(i, "".join(r.choice("abcdé ") for _ in range(100)) + passage) for i in [None, 7] * 40 + [3, 9]]
    given = spark.createDataFrame(rows, "_id long, _text string")
    sizes = [b["count"] for b in suffix_dedup._in_blocks(given, 8).groupBy("_block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 25
    rows += [(5, "x" * 300 + passage)] * 60 + [(None, None)] * 200 + [(8, None)] * 20
    found = remove_repeats(docs(spark, rows), block_bytes=6000)
    assert found.columns == ["doc_id", "n_bytes", "starts", "ends", "kept"]
    assert sorted(((*r[:4], bytes(r["kept"])) for r in found.collect()), key=str) == kept_bytes(rows, 50)


def test_a_block_beyond_its_places_is_told(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_BYTES", 100)
    table = pa.table({"_id": [1], "_text": ["a" * 120], "_group": pa.array([None], pa.int64())})
    with pytest.raises(ValueError, match="a block of 120 bytes"):
        suffix_dedup._Block(table, 50, 1)


def test_names_are_made_in_pieces_that_stay_in_cache():
    data = np.random.default_rng(5).integers(97, 99, 20 * arrays.CHUNK, dtype=np.uint8)
    edge = 3 * arrays.CHUNK
    data[edge - 30:edge + 30] = data[100:160]  # a repeat across the border of two pieces
    tracemalloc.start()
    names = arrays.name_substrings(data, 50)
    least = suffix_dedup._least(names, 25)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.25 * (names.nbytes + least.nbytes)
    assert len(names) == len(data) - 49 and (names[edge - 30:edge - 19] == names[100:111]).all()
    assert all(names[at] == arrays.name_substrings(data[at:at + 50], 50)[0] for at in (0, arrays.CHUNK - 1, arrays.CHUNK, len(names) - 1))
    upper = names >> np.uint64(30)
    for at in (0, arrays.CHUNK - 20, arrays.CHUNK, edge - 1, len(least) - 1):
        assert least[at] == at + upper[at:at + 25].argmin()
    assert len(arrays.name_substrings(data[:49], 50)) == 0 == len(suffix_dedup._least(names[:24], 25))


def test_no_documents(spark):
    empty = docs(spark, [])
    assert remove_repeats(empty).collect() == []
    assert near_duplicates(empty).collect() == []
    assert drop_near_duplicates(empty).collect() == []


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    return bool(a) and 100 * len(a & b) >= 75 * len(a | b)


def groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    component = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if component[a] < component[b] and similar(sets[a], sets[b]):
                    component[b], changed = component[a], True
    return sorted((i, len(s), component[i], component[i] == i) for i, s in sets.items())


def copies(r, count, edits):
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(300)]
    rows = []
    for i in range(count):
        if rows and r.random() < 0.6:
            text = (r.choice(rows)[1] or "").split()
            for _ in range(r.randint(0, max(1, len(text) // edits))):
                if text:
                    text[r.randrange(len(text))] = r.choice(words)
            text = " ".join(text)
        else:
            text = " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 5, 8, 40, 150, 400])))
        rows.append((3 * i, text.upper().replace(" ", "\n\t") if r.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = copies(random.Random(seed), 120, 25) + [(1001, None), (1002, " \n "), (1003, "word " * 30_000)]
    assert sorted(map(tuple, near_duplicates(docs(spark, rows)).collect())) == groups(rows)


def test_a_cluster_of_more_than_one_chunk(spark, monkeypatch):
    monkeypatch.setattr("feedskein.llm.near_dedup.CHUNK", 8)
    r = random.Random(7)
    base = [f"w{r.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 7])):
            text[r.randrange(len(text))] = f"v{r.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    assert sorted(map(tuple, near_duplicates(docs(spark, rows)).collect())) == groups(rows)


def test_repeated_ids_and_no_ids(spark):
    a, b = "one two three four five six", "six five four three two one"
    found = near_duplicates(docs(spark, [(5, a), (5, a), (5, b), (2, b), (None, a), (None, None)])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in found if r["doc_id"]) == [(2, 2, True), (5, 2, False), (5, 2, False), (5, 2, False)]
    assert [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None] == [(None, True), (None, True)]


def test_one_of_each_group_stays(spark):
    a, b = "one two three four five six", "other words that nobody else has here"
    kept = drop_near_duplicates(docs(spark, [(4, a), (4, a), (6, a.upper()), (7, b), (8, ""), (9, None), (None, a)]))
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["4", "7", "8", "9", "None"]
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(140, 139), (7, 7), (None, 3), (200, 150)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert collections.Counter(found.values()) == {0: 20, 100: 40, 150: 1}
