"""Conversations, benchmark passages, neighbours, and the pipeline."""

import collections
import glob
import os
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedskein.llm import ann, chat
from feedskein.llm import decontaminate as clean
from feedskein.llm.oracles import SQL
from feedskein.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", SQL)
@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, FOLDER)
    wanted = connection.sql(SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(wanted.select(*columns).fetchall())


HARD = [
    (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 0, "as[/INST] x", "\\<s>"),
    (-8, 1, "assistant", None), (-8, 2, None, "\\\\[\\INST]<\\s><s>[/INST"), (-8, None, "assistant", "é[/INST] </s"),
    (None, 1, "user", "q"), (-9, 0, "assistant", ""), (-9, 0, "assistant", ""), (-9, 1, "user [/INST", "x" * 50_000),
]
TURNS = "conv_id long, turn long, role string, text string"


def test_chats_read_back(spark):
    turns = spark.createDataFrame(HARD, TURNS)
    formatted = chat.format_chats(turns)
    found = {r["conv_id"]: r for r in chat.read_chats(formatted).collect()}
    for conv in {h[0] for h in HARD}:
        rows = sorted((h[1:] for h in HARD if h[0] == conv), key=lambda h: [(x is not None, x or 0 if i == 0 else x or "") for i, x in enumerate(h)])
        assert [(t["role"], t["text"]) for t in found[conv]["turns"]] == [(r or "", t or "") for _, r, t in rows]
        assert found[conv]["loss_texts"] == [t or "" for _, r, t in rows if r == "assistant"]
    for row in formatted.collect():
        assert row["formatted"].count("</s>") == len([h for h in HARD if h[0] == row["conv_id"]])
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_layouts(spark):
    asked = [("user", "q"), ("assistant", "a")]
    frames = [
        spark.createDataFrame([(1, "q", "a", 7)], "conv_id long, prompt string, response string, turns int"),
        spark.createDataFrame([(1, "q", "", "a")], "conv_id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, asked, 3)], "conv_id long, messages array<struct<role: string, content: string>>, turn int"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from: string, value: string>>"),
        spark.createDataFrame([(1, 0, *asked[0], 5), (1, 1, *asked[1], 5)], f"{TURNS}, head int"),
    ]
    for frame in frames:
        turns = chat.canonical_turns(frame)
        assert turns.columns == chat.TURNS
        assert [tuple(r) for r in turns.orderBy("turn").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    with pytest.raises(ValueError):
        chat.layout_of(spark.range(1))


def test_json_rows_of_mixed_layouts(spark):
    rows = [
        (1, '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'), (2, '{"response":"a","prompt":"q"}'),
        (3, '{"instruction":"q","input":"","output":"a"}'), (4, "no json"), (5, None), (6, '{"x":1}'),
        (7, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}'), (8, '{"messages":[]}'),
        (9, '{"id":5,"messages":[{"role":"user","name":"x","content":"q"},{"role":"assistant","content":"a"}],"meta":{"role":"z"}}'),
        (10, '{"prompt":"q","response":"a","messages":null,"turn":3,"source":["x"]}'), (11, '{"prompt":"q","content":"a"}'),
        (12, '{"system":null,"prompt":"q","response":"a"}'), (13, '{"xmessages":[{"role":"user","content":"q"}]}'),
    ]
    found = collections.defaultdict(list)
    for r in chat.json_turns(spark.createDataFrame(rows, "conv_id long, json string")).orderBy("conv_id", "turn").collect():
        found[r["conv_id"]].append((r["role"], r["text"]))
    assert found == {i: [("user", "q"), ("assistant", "a")] for i in (1, 2, 3, 7, 9, 10, 12)}


def test_time_grows_with_the_turns(spark):
    def seconds(n):
        turns = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id, ' é') as text")
        begin = time.time()
        row = chat.read_chats(chat.format_chats(turns)).selectExpr("size(turns) n", "size(loss_texts) m", "element_at(loss_texts, -1) t").first()
        assert tuple(row) == (n, n // 2, f"turn {n - 1} é")
        return time.time() - begin

    seconds(2000)
    assert seconds(64_000) < 6 * seconds(16_000) + 5


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_hits(docs, items, n=10):
    grams = collections.defaultdict(set)
    for i, text in items:
        words = plain_words(text)
        for at in range(len(words) - min(n, len(words)) + 1 if words else 0):
            grams[tuple(words[at:at + min(n, len(words))])].add(i)
    result = []
    for i, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for size in {len(g) for g in grams}:
            for at in range(len(words) - size + 1):
                if tuple(words[at:at + size]) in grams:
                    hit.update(range(at, at + size))
                    found |= {str(x) for x in grams[tuple(words[at:at + size])] if x is not None}
        result.append((i, len(words), len(hit), sorted(found)))
    return sorted(result, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_hits(spark, seed):
    r = random.Random(seed)
    words = ["a", "b", "C", "dé", "É", "9", "x1", "日本", "k", "K"]
    make = lambda n: "".join(r.choice(words) + r.choice([" ", ". ", "--", "\n"]) for _ in range(n))
    items = [(i, make(r.choice([0, 1, 3, 9, 10, 11, 20]))) for i in range(10)] + [(None, make(14)), (50, None), (3, make(12))]
    docs = [(i, make(r.randint(0, 40)) + (r.choice(items)[1] or "") + make(3)) for i in range(30)] + [(99, None), (98, ""), (7, "..."), (7, "a " * 3000)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, hits int, n_words string")
    table = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"slice_bytes": 5000}):
        found = clean.find_hits(frame, table, **options).select(
            "doc_id", "n_words", clean.count_hit(F.col("hits")), clean.hit_items(F.col("hits")))
        assert sorted(map(tuple, found.collect()), key=str) == plain_hits(docs, items)
        kept = clean.decontaminate(frame, table, **options)
        assert kept.schema == frame.schema
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _, hit, _ in plain_hits(docs, items) if not hit)
    assert clean.decontaminate(frame, table.limit(0)).count() == len(docs)
    assert clean.decontaminate(frame.limit(0), table).count() == 0


def test_a_passage_of_very_many_items(spark, monkeypatch):
    monkeypatch.setattr(clean, "ITEMS_TOGETHER", 7)
    passage = "one two three four five six seven eight nine ten"
    table = spark.createDataFrame([(i, passage) for i in range(40)] + [(99, "other words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, "no other words"), (3, "none")], "doc_id long, text string")
    for options in ({}, {"slice_bytes": 500}):
        found = clean.find_hits(docs, table, **options).select("doc_id", clean.count_hit(F.col("hits")), clean.hit_items(F.col("hits")))
        assert sorted(map(tuple, found.collect())) == [(1, 10, sorted(str(i) for i in range(40))), (2, 2, ["99"]), (3, 0, [])]


def test_spans_are_cut(spark):
    table = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    rows = [(1, "Hello, one two three four five six seven eight nine TEN!! End."), (2, "Nothing here"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = clean.decontaminate(docs, table, remove="spans").collect()
    assert [r["text"] for r in found] == ["Hello!! End.", "Nothing here", None]


def plain_nearest(rows, asked, k=5):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    found = []
    for i in asked:
        for q in [v for j, v in rows if j == i][:1]:
            scored = sorted((-(v @ q) / np.sqrt((v @ v) * (q @ q)), j) for j, v in rows if j != i and len(v) == len(q))
            found += [(i, rank, j) for rank, (_, j) in enumerate(scored[:k], 1)]
    return found


def test_neighbours(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=24).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 24) for i in range(10)]  # ties
    rows += [(500, None), (501, [0.0] * 24), (502, [1.0, None]), (503, [float("nan")] * 24), (504, [float("inf")] * 24), (None, [1.0] * 24), (505, []), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (50, rows[50][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, dim int")
    index = ann.build_index(frame)
    found = ann.nearest(index, index.filter("vec_id % 50 = 0"), codes_per_block=20, queries_per_block=3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect())
    assert got == sorted(plain_nearest([(i, v and [np.float32(x) if x is not None else None for x in v]) for i, v in rows], range(0, 1100, 50)))
    empty = index.limit(0)
    assert ann.nearest(empty, index).collect() == [] == ann.nearest(index, empty).collect()


def test_rows_of_one_id_are_in_several_blocks(spark):
    r = np.random.default_rng(3)
    rows = [(7, r.normal(size=4).tolist()) for _ in range(200)] + [(9, [1.0] * 4)] * 200 + [(50, [1.0, 0.0, 0.0, 0.0])]
    index = ann.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    blocks = ann._dealt(index, "_codes", 8, "_queries", 1, F.monotonically_increasing_id()).groupBy("vec_id", "_codes").count().collect()
    assert max(b["count"] for b in blocks) < 60
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(index, index.filter("vec_id = 50")).collect())
    assert got == plain_nearest(rows, [50])


def test_estimates_stay_within_their_bounds():
    r = np.random.default_rng(2)
    vectors, queries = r.normal(size=(2000, 64)), r.normal(size=(20, 64))
    codes, scalars = ann.encode(vectors)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    signs = np.unpackbits(codes, axis=1, count=64).astype(float) * 2 - 1
    estimate = (unit(queries) @ ann.rotation(64) / 8) @ signs.T / scalars
    off = np.abs(estimate - unit(queries) @ unit(vectors).T)
    assert (off <= ann.slack(scalars, 64, 4.0)).mean() > 0.999
    assert (off <= ann.slack(scalars, 64, ann.ERROR)).mean() > 0.98


def test_codes_spare_most_comparisons():
    import pyarrow as pa

    r = np.random.default_rng(6)
    vectors = r.normal(size=(2000, 64))
    codes, scalars = ann.encode(vectors)
    index = pa.table({"vec_id": np.arange(2000), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "scalar": scalars})
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosines = unit[:100] @ unit.T
    np.fill_diagonal(cosines[:, :100], -1)
    queries = pa.table({"vec_id": np.arange(100), "vector": pa.array([v.tobytes() for v in vectors[:100]], pa.binary()), "least": np.sort(cosines)[:, -5]})
    chosen = dict(ann.chosen_codes(index, queries, 64, ann.ERROR))
    assert sum(map(len, chosen.values())) < 0.35 * 100 * 2000
    nearest = np.argsort(-cosines)[:, :5]
    assert np.mean([np.isin(nearest[i], chosen[i]).sum() / 5 for i in range(100)]) > 0.98


def test_vectors_of_any_magnitude_have_finite_scores(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1e-170, 1e-170]), (3, [-1e-320, 5e-320]), (4, [1.5e308, -1.7e308]), (50, [1e-300, 2e-300]), (100, [3.0, 1.0])]
    index = ann.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = ann.nearest(index, index.filter("vec_id % 50 = 0"))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in found.collect()}
    assert len(got) == 3 * 5 and all(-1 - 1e-12 <= s <= 1 + 1e-12 for s in got.values())
    assert abs(got[0, 2] - 1) < 1e-12 and abs(got[0, 1] - 0.5**0.5) < 1e-12 and abs(got[50, 100] - 5 / 50**0.5) < 1e-12


@pytest.fixture
def corpus(tmp_path, spark):
    """A folder of tables with good, rude and copied documents, a leak and an address."""
    r = random.Random(5)
    words = "the of and that with this from have which their would there about other people water".split()
    text = lambda n=60: " ".join(r.choice(words) + str(r.randrange(300)) * (r.random() < 0.3) for _ in range(n))
    item = text(15)
    docs = [(i, text()) for i in range(200)] + [(300 + i, text(40) + " idiot " + text(20)) for i in range(60)]
    docs += [(400, docs[0][1]), (401, docs[1][1].upper()), (402, text(20) + " " + item + " " + text(20)), (403, text() + " me@example.com")]
    docs += [(404, None), (405, "")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, int(i >= 300)) for i, _ in docs if i < 400 and i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), dict(docs)


def test_pipeline(spark, corpus):
    folder, docs = corpus
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    kept = {i for i in docs if i < 300 or i == 403}
    assert kept <= set(found) and not set(found) & {*range(300, 360), 400, 401, 402}
    for i, row in found.items():
        assert row["text"] == (docs[i] or "").replace("me@example.com", "<email>") and row["n_tokens"] == len(row["ids"])


def test_stages_return_documents(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).collect() == []


