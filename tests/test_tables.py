import pytest
from pyspark.sql import functions as F

from feedskein.operators.articles import new_observations
from feedskein.schemas import ARTICLES, FEEDS
from feedskein.session import estimated_bytes, scratch_dir, size_shuffles, written
from feedskein.sources import tables
from feedskein.sources.tables import (
    append_articles, append_feeds, create_if_missing, create_tables, merge_files, number_rows, read_articles, read_feeds,
    remove_rows, remove_stored_feeds, save_bucketed, upgrade, write_articles, write_feeds,
)


def files_of(folder):
    return {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def ids(spark, *feed_ids):
    return spark.createDataFrame([(i,) for i in feed_ids], "feed_id long")


def test_created_empty_and_only_once(spark, make, tmp_path):
    folder = str(tmp_path)
    create_tables(spark, folder)
    assert read_feeds(spark, f"{folder}/feeds").schema.names == FEEDS.names
    write_feeds(make.feeds((1, "A", "u")), f"{folder}/feeds")
    create_tables(spark, folder)
    assert read_feeds(spark, f"{folder}/feeds").count() == 1
    assert read_articles(spark, f"{folder}/articles").count() == 0


def test_missing_table_reads_as_empty(spark, tmp_path):
    assert read_feeds(spark, str(tmp_path / "none")).count() == 0


def test_written_anew(spark, make, tmp_path):
    path = str(tmp_path / "feeds")
    write_feeds(make.feeds((1, "A", "u"), (2, "B", "v")), path)
    write_feeds(make.feeds((2, "B", "v")), path)
    assert [r.title for r in read_feeds(spark, path).collect()] == ["B"]


def test_append_leaves_what_is_there(spark, make, tmp_path):
    path = str(tmp_path / "articles")
    append_articles(make.articles({"feed_id": 1, "guid": "a"}, {"feed_id": 1, "guid": "b"}), path)
    files = files_of(tmp_path / "articles" / "rows")
    append_articles(make.articles({"feed_id": 1, "guid": "c"}), path)
    assert files.items() <= files_of(tmp_path / "articles" / "rows").items()
    assert sorted(r.id for r in read_articles(spark, path).collect()) == [1, 2, 3]


def test_ids_are_not_given_out_again(spark, make, tmp_path):
    path = str(tmp_path / "feeds")
    append_feeds(make.feeds((0, "A", "u"), (0, "B", "v")), path)
    remove_rows(spark, path, FEEDS, ids(spark, 2))
    append_feeds(make.feeds((0, "C", "w")), path)
    assert sorted(r.feed_id for r in read_feeds(spark, path).collect()) == [1, 3]
    write_feeds(make.feeds((1, "A", "u")), path)
    append_feeds(make.feeds((0, "D", "x")), path)
    assert sorted(r.feed_id for r in read_feeds(spark, path).collect()) == [1, 4]


def test_ids_of_a_failed_append_are_left_out(spark, make, tmp_path, monkeypatch):
    path = str(tmp_path / "feeds")
    append_feeds(make.feeds((0, "A", "u")), path)

    def fail(*arguments):
        raise OSError("disk full")

    with monkeypatch.context() as patched:
        patched.setattr(tables, "_save", fail)
        with pytest.raises(OSError):
            append_feeds(make.feeds((0, "B", "v"), (0, "C", "w")), path)
    append_feeds(make.feeds((0, "D", "x")), path)
    assert sorted((r.feed_id, r.title) for r in read_feeds(spark, path).collect()) == [(1, "A"), (4, "D")]


def test_removal_rewrites_the_buckets_concerned_alone(spark, make, tmp_path):
    folder, path = str(tmp_path), str(tmp_path / "articles")
    create_tables(spark, folder, buckets=16)
    rows = [{"feed_id": f, "guid": g} for f in range(40) for g in "abc"]
    append_articles(make.articles(*rows), path)
    append_feeds(make.feeds(*[(0, f"F{f}", f"u{f}") for f in range(40)]), f"{folder}/feeds")
    before = files_of(tmp_path / "articles" / "rows")
    bucket = {r.feed_id: r.b for r in ids(spark, *range(40)).withColumn("b", tables.bucket_of(F.col("feed_id"), 16)).collect()}
    gone = [3, 4, 1000]
    remove_stored_feeds(spark, folder, ids(spark, *gone))
    after = files_of(tmp_path / "articles" / "rows")
    changed = {f.parent.name for f in before.keys() ^ after.keys()}
    assert changed == {f"bucket={bucket[f]}" for f in gone if f in bucket}
    assert len(changed) <= 2 and not any(before[f] != after[f] for f in before.keys() & after.keys())
    assert {r.feed_id for r in read_articles(spark, path).collect()} == set(range(40)) - {3, 4}
    assert {r.feed_id for r in read_feeds(spark, f"{folder}/feeds").collect()} == set(range(1, 41)) - {3, 4}
    remove_stored_feeds(spark, folder, ids(spark, *gone))  # again, as after a failure
    assert read_articles(spark, path).count() == 38 * 3


def counted(spark, rows, column):
    """rows whose column is made by a function that counts its calls, and the counter."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def same(value):
        calls.add(1)
        return value

    return rows.withColumn(column, same.asNondeterministic()(column)), calls


def test_removed_feeds_are_found_once(spark, make, tmp_path, joins):
    folder = str(tmp_path)
    append_articles(make.articles(*[{"feed_id": f, "guid": g} for f in range(1, 21) for g in "ab"]), f"{folder}/articles")
    append_feeds(make.feeds(*[(0, f"F{f}", f"u{f}") for f in range(20)]), f"{folder}/feeds")
    gone, calls = counted(spark, ids(spark, 3, 4, 4, None), "feed_id")
    remove_stored_feeds(spark, folder, gone)
    assert calls.value == 4
    left = set(range(1, 21)) - {3, 4}
    assert {r.feed_id for r in read_articles(spark, f"{folder}/articles").collect()} == left
    assert {r.feed_id for r in read_feeds(spark, f"{folder}/feeds").collect()} == left


def test_appended_rows_are_made_twice(spark, make, tmp_path):
    path = str(tmp_path / "articles")
    rows, calls = counted(spark, make.articles(*[{"feed_id": f, "guid": "a"} for f in range(30)]), "feed_id")
    append_articles(rows.dropDuplicates(["feed_id", "guid"]), path)  # so that counting needs the keys
    assert calls.value == 60  # to count them, and to write them
    assert sorted(r.id for r in read_articles(spark, path).collect()) == list(range(1, 31))
    append_articles(read_articles(spark, str(tmp_path / "none")), path)
    append_articles(make.articles({"feed_id": 1, "guid": "b"}), path)
    assert max(r.id for r in read_articles(spark, path).collect()) == 31


def test_removing_everything_and_nothing(spark, make, tmp_path):
    folder, path = str(tmp_path), str(tmp_path / "articles")
    remove_stored_feeds(spark, folder, ids(spark, 1))
    append_articles(make.articles({"feed_id": 1, "guid": "a"}, {"feed_id": 2, "guid": "a"}), path)
    remove_rows(spark, path, ARTICLES, ids(spark))
    assert read_articles(spark, path).count() == 2
    remove_rows(spark, path, ARTICLES, ids(spark, 1, 2, 2))
    assert read_articles(spark, path).count() == 0
    append_articles(make.articles({"feed_id": 1, "guid": "a"}), path)
    assert [r.id for r in read_articles(spark, path).collect()] == [3]


def test_one_feed_opens_one_bucket(spark, make, tmp_path):
    path = str(tmp_path / "articles")
    create_if_missing(spark, path, buckets=8)
    append_articles(make.articles(*[{"feed_id": f, "guid": "a"} for f in range(30)]), path)
    one = read_articles(spark, path, feed_id=7)
    assert [r.feed_id for r in one.collect()] == [7]
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan


def test_small_files_merge(spark, make, tmp_path):
    path = str(tmp_path / "feeds")
    create_if_missing(spark, path, buckets=2)
    for name in "ABCDEF":
        append_feeds(make.feeds((0, name, name)), path)
    merge_files(spark, path, FEEDS, ["feed_id"])
    assert len(files_of(tmp_path / "feeds" / "rows")) <= 4
    assert sorted(r.title for r in read_feeds(spark, path).collect()) == list("ABCDEF")


def test_articles_round_trip(spark, make, tmp_path):
    path = str(tmp_path / "articles")
    articles = make.articles({"id": 1, "feed_id": 1, "guid": "a", "is_favorite": True}, {"id": 2, "feed_id": 1, "guid": "b"})
    write_articles(articles, path)
    assert sorted(read_articles(spark, path).collect()) == sorted(articles.collect())


def test_data_from_before_favorites(spark, make, tmp_path):
    path = str(tmp_path / "articles")
    articles = make.articles({"feed_id": 1, "guid": "a", "is_favorite": True})
    old = articles.drop("is_favorite").withColumn("guid", F.lit("old"))
    tables.append_rows(old.drop("id"), path, "id", ["guid"])
    assert [(r.guid, r.is_favorite) for r in read_articles(spark, path).collect()] == [("old", False)]
    append_articles(articles, path)
    assert sorted((r.guid, r.is_favorite) for r in read_articles(spark, path).collect()) == [("a", True), ("old", False)]


def test_upgrade_keeps_what_is_there(spark, make):
    articles = make.articles({"feed_id": 1, "guid": "a", "is_favorite": True, "is_read": True})
    assert upgrade(articles, ARTICLES).collect() == articles.collect()


def test_create_if_missing_leaves_data(spark, make, tmp_path):
    path = str(tmp_path / "feeds")
    write_feeds(make.feeds((1, "A", "u")), path)
    create_if_missing(spark, path)
    assert read_feeds(spark, path).count() == 1


def test_numbers_are_dense_unique_and_stable(spark):
    rows = spark.range(1000).select(F.col("id").alias("key"))
    numbered = number_rows(rows, "n", ["key"], after=50, partitions=7)
    first = {r.key: r.n for r in numbered.collect()}
    assert sorted(first.values()) == list(range(51, 1051))
    again = number_rows(rows.repartition(3), "n", ["key"], after=50, partitions=7)
    assert {r.key: r.n for r in again.collect()} == first


def test_numbers_of_nothing(spark):
    assert number_rows(spark.range(0), "n", ["id"]).count() == 0


@pytest.mark.parametrize("joins", ["salted"], indirect=True)
def test_bucketed_articles_are_not_shuffled(spark, make, tmp_path, joins):
    articles = make.articles({"feed_id": 1, "guid": "a"}, {"feed_id": 1, "guid": "b"})
    save_bucketed(articles, "bucketed_articles", 4, str(tmp_path / "bucketed"))
    seen = make.observations({"feed_id": 1, "guid": "b"}, {"feed_id": 2, "guid": "b"})
    new = new_observations(seen, spark.table("bucketed_articles"))
    assert [(r.feed_id, r.guid) for r in new.collect()] == [(2, "b")]
    plan = new._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    spark.sql("DROP TABLE bucketed_articles")


def test_shuffles_grow_with_the_input(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(10000).select(F.md5(F.col("id").cast("string")).alias("x")).write.parquet(path)
    rows = spark.read.parquet(path)
    size = estimated_bytes(rows)
    try:
        assert size_shuffles(spark, rows, per_task=size // 10, growth=1) in (10, 11)
        assert size_shuffles(spark, rows) in (10, 11)  # never fewer
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_written_results_lie_in_the_shared_folder(spark):
    frame = written(spark.range(3), "numbers")
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in frame.inputFiles())
    assert frame.count() == 3
    assert scratch_dir(spark, "a") != scratch_dir(spark, "a")
