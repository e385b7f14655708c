"""One thin query for each corpus operator, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.llm import ann, bpe, chat, decontam, filter_audit, jaccard, kmeans, lm, mixing, quality, secrets, sharding, warc
from clickloom.llm._shared import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards by proportional stratified interleaving."""
    placed = sharding.stratified_shards(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all whole texts and the bytes that they decode to, as digests."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), ranks, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of whole documents whose 5-word shingles are similar to 80 % or more."""
    groups = jaccard.jaccard_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


def op3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other documents each whole document links to, at the same similarity."""
    return jaccard.count_links(table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all whole texts by pairwise ranking."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back."""
    records = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all whole texts, weighed by who owns them."""
    return secrets.secret_report(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(chat.ADVERSARIAL, "conv_id long, turn long, role string, text string"))
    back = chat.read_back(chat.format_conversations(rows))
    joined = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("texts").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice and base scores of all whole texts."""
    return lm.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim benchmark windows in all whole documents."""
    found = decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.hit_report(found)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 8 clusters after 10 rounds."""
    return kmeans.cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, rounds=10)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents to target weights takes of each."""
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on all whole documents, in every order."""
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = (op1_sharding, op2_bpe, op3_jaccard, op3_links, op4_ann, op5_quality, op6_warc, op7_secrets, op8_chat, op9_lm, op10_decontamination, op11_centroids, op12_mixing, op13_filter_audit)


def queries():
    return {q.__name__: q for q in QUERIES}


def oracle_sql():
    return {"op1_sharding": sharding.ORACLE_SQL, "op3_jaccard": jaccard.ORACLE_SQL, "op3_links": jaccard.LINKS_SQL, "op4_ann": ann.ORACLE_SQL, "op6_warc": warc.ORACLE_SQL, "op7_secrets": secrets.ORACLE_SQL, "op8_chat": chat.ORACLE_SQL, "op10_decontamination": decontam.ORACLE_SQL, "op11_centroids": kmeans.ORACLE_SQL, "op12_mixing": mixing.ORACLE_SQL, "op13_filter_audit": filter_audit.ORACLE_SQL}
