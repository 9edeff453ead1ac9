"""From raw documents to token ids: the operators for training text, one after the other.

Each stage takes what the one before kept, as written and read back, and returns the columns
of documents; the last one returns token ids. A stage decides on its own input: what it drops
or changes is dropped or changed for all that follow.
"""

from pyspark.sql import DataFrame, SparkSession

from feedskein.llm import bpe, decontaminate, near_dedup, pii, quality
from feedskein.llm.queries import table, vocabulary_path
from feedskein.session import limit_arrow_rows, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labelled ones, does not reject. The
    others go. Where nothing is labelled, all stay."""
    model = quality.fit(docs, quality.grades(table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs, pii.fit(docs), count_column="n_chars")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, text) for each document: its token ids, and the text that they decode to."""
    limit_arrow_rows(spark)
    path = vocabulary_path()
    return bpe.decode(bpe.encode(docs, path, pieces=120_000), path).selectExpr("doc_id", "ids", "cast(size(ids) as long) as n_tokens", "text")


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", distinct_documents),
    ("benchmark decontamination", not_in_benchmark),
    ("PII", without_pii),
    ("BPE encoding and decoding", token_ids),
]

ORACLE_SQL = None  # trained models and token merges are not SQL; tests/llm compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What each stage before it keeps is written to the shared
    folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage{number}")
    return docs
