"""Registered queries of the operators for training text, over whole tables.

Each runs its operator with production parameters and derives the columns it returns from the
operator's output.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedskein.llm import ann, bpe, chat, language, negatives, packing, pii, quality, whitening
from feedskein.llm import decontaminate as clean
from feedskein.llm.html_text import extract_text
from feedskein.llm.near_dedup import near_duplicates
from feedskein.llm.oracles import SQL
from feedskein.llm.suffix_dedup import remove_repeats

__all__ = ["QUERIES", "SQL"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def sha256(text):
    return F.sha2(text, 256)


def op1_suffix_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, span: n + span["ends"] - span["starts"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"),
        sha256(F.col("kept")).alias("kept_sha256"),
    )


def op2_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.fit(docs))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["kind"] == "email")), F.size(F.filter(base, lambda s: s["kind"] == "ip")),
              F.size(F.filter(base, lambda s: s["kind"] == "card")), F.size(F.filter(base, lambda s: s["kind"] == "phone"))]
    return found.select(
        "doc_id", *[n.cast("long").alias(f"n_{kind}") for kind, n in zip(pii.KINDS, counts)],
        sha256(listed(base)).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def held_out(doc_id):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    network = language.fit(docs.filter(F.coalesce(~held_out("doc_id"), F.lit(True))))
    found = language.identify(docs, network)
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_html_text(spark, sf_dir):
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_bpe(spark, sf_dir):
    path = vocabulary_path()
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256(F.col("text")).alias("decoded_sha256"),
    )


CONTROL_CHAT = (-7, '{"prompt": "</s>[INST] ok [/INST]", "response": "</s>[INST] ok [/INST]", "id": 1}')


def op7_chat_format(spark, sf_dir):
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations"))
    added = chat.json_turns(spark.createDataFrame([CONTROL_CHAT], "conv_id long, json string"))
    formatted = chat.format_chats(turns.unionByName(added))
    read = chat.read_chats(formatted.select("*", F.length("formatted").cast("long").alias("formatted_chars")))
    loss = F.array_join("loss_texts", "")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(F.array_join(lines, "")).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), sha256(loss).alias("loss_sha256"), "formatted_chars",
    )


def op8_decontaminate(spark, sf_dir):
    found = clean.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = clean.hit_items(F.col("hits"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), clean.count_hit(F.col("hits")).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), sha256(F.array_join(items, ",")).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op9_ann(spark, sf_dir):
    index = ann.build_index(table(spark, sf_dir, "embeddings"))
    return ann.nearest(index, index.filter("vec_id % 50 = 0"))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades(table(spark, sf_dir, "labels")))
    rated = quality.rate(docs, model)
    return rated.select("*", quality.selected(F.col("p_good")).alias("kept"))


def op11_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(negatives.build_index(vectors, F.col("vec_id") % 50 == 0))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_html_text": op5_html_text,
    "op6_bpe": op6_bpe,
    "op7_chat_format": op7_chat_format,
    "op8_decontaminate": op8_decontaminate,
    "op9_ann": op9_ann,
    "op10_quality": op10_quality,
    "op11_packing": op11_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}
