"""The registered queries of the training-data operators and their oracle SQL.

Each query reads its whole table, calls its operator with production parameters and derives
the contract's digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm import (
    byte_bpe, decontaminate, jaccard_join, licenses, pii, quality_classifier, quality_rules, secrets, simhash, spelling,
    substring_dedup, toxicity, whitening,
)
from kpiloom.llm.common import materialise


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a paragraph or snippet that occurs in several documents, with its class."""
    found = substring_dedup.duplicated(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("at").alias("first_word"), "n_words", "class_id", "n_docs", "removed")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document; the score is the share of its words
    that lie in a match."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return (
        licenses.scan(docs)
        .withColumn("_base", F.filter("matches", lambda m: m["base"]))
        .withColumn("_spans", F.sort_array(F.transform("matches", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))))
        .withColumn(
            "_covered",
            F.expr(
                "aggregate(_spans, struct(0 as n, 0 as upto), (a, s) -> struct(a.n + greatest(s.end - greatest(s.start, a.upto), 0) as n, "
                "greatest(a.upto, s.end) as upto), a -> a.n)"
            ),
        )
        .select(
            F.col("_row.doc_id").alias("doc_id"), "n_words", F.size("_base").cast("long").alias("n_base"),
            F.array_min("_base.start").cast("long").alias("first_word"), F.array_max("_base.start").cast("long").alias("last_word"),
            joined(F.col("_base.label")).alias("base_labels"), joined(F.col("matches.label")).alias("labels"),
            F.when(F.col("n_words") > 0, F.col("_covered") / F.col("n_words")).otherwise(0.0).alias("score"),
        )
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base verdict and weakly supervised verdict of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs.select("doc_id", F.col("text")))
    return judged.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"),
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of the benchmark, and the items found."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def _scored(found: DataFrame) -> DataFrame:
    return found.select(F.col("_row.doc_id").alias("doc_id"), "held_out", "score", "predicted")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(quality_classifier.quality(docs, _read(spark, sf_dir, "labels")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(toxicity.toxicity(docs, _read(spark, sf_dir, "labels")))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 3-word shingles, linked at 3 or fewer bits, one row per document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = materialise(simhash.fingerprints(docs, "text", 3).select("doc_id", "fp"), "op6")
    return simhash.near_duplicates(marked, 3).select(
        "doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id"
    )


def _spans(kinds: tuple[str, ...] | None = None):
    """findings as kind:start:end, comma-joined; of the given kinds only."""
    from pyspark.sql import Column

    chosen: Column = F.col("findings")
    if kinds:
        chosen = F.filter(chosen, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def _count(kind: str):
    return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each distinct text scanned once against a new ledger."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    base = tuple(r.name for r in secrets.BASE)
    return secrets.findings(docs).select(
        F.col("_row.doc_id").alias("doc_id"), *[_count(k).alias(f"n_{k}") for k in base],
        F.sha2(_spans(base), 256).alias("base_sha256"), _spans().alias("spans"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that give it away."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.findings(docs).select(
        "doc_id", *[_count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(_spans(pii.KINDS), 256).alias("base_sha256"), _spans().alias("spans"),
    )


def tokenizer() -> tuple[dict[bytes, int], str]:
    """Ranks and split pattern of the public byte-level vocabulary of 50,256 tokens."""
    import public_tokenizers

    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded to ids and decoded again."""
    ranks, pattern = tokenizer()
    encoded = byte_bpe.encode(_read(spark, sf_dir, "documents"), ranks, pattern)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 7 letters or more with their more frequent near spelling, one row per word. Every
    31st (id, run) by its hash has lost a letter."""
    return spelling.variants(_read(spark, sf_dir, "documents"), min_length=7, min_count=2, ratio=10, delete_every=31).select(
        "word", "form", "root", "n", "n_near", "form_n"
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every usable embedding, one row each."""
    found = whitening.whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=16)
    return found.select(
        "vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_c")
    ).select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), "n", "deviation", F.col("_c.whitened").alias("whitened"),
        F.col("_c.explained").alias("explained"), "identity_error",
    )


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs, shingle=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scans": op2_license_scans,
    "op3_quality_rules": op3_quality_rules,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_secret_scans": op7_secret_scans,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_pii": op10_pii,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality_rules.oracle(),
    "op4_benchmark_decontamination": decontaminate.oracle(),
    "op11_spelling_variants": spelling.oracle(),
    "op13_ngram_jaccard_join": jaccard_join.oracle(),
}
