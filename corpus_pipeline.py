"""A training corpus from raw documents: five stages, each written as Parquet and reread.

Each stage takes all rows that the one before kept. All but the last return the columns of
``documents``; the last returns token ids. ``ORACLE_SQL`` is None because SQL can't express the
SimHash classes and the byte-pair merges; tests hold the run against brute force.

A stage's intermediate tables are removed when the next stage starts, as its result has been
written by then; tables that the next stage's input still reads are kept.

Texts go to Python in batches of some ``BATCH_BYTES`` rather than of 10,000 rows, so that what an
executor and its workers hold does not grow with the length of the texts. A stage sets this for the
session, as its rows are only read later, unless the session has a limit of its own; ``run`` takes
it back.

Odd input is treated as each operator's module says: rows with NULL or short texts fall to the
quality rules, repeated rows to the near-duplicate stage; empty tables go through as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm import byte_bpe, decontaminate, quality_rules, secrets, simhash
from kpiloom.llm.common import SCRATCH, materialise, remove_scratch
from kpiloom.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Bytes of a batch of rows sent to Python, and the setting.
BATCH_BYTES, BATCH_LIMIT = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Intermediate tables of the stage that ran last.
_LEFT: list[str] = []


def _tidy(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _LEFT:
            read = docs.inputFiles()
            done = [p for p in _LEFT if not any(p.split(":")[-1].lstrip("/") in f for f in read)]
            remove_scratch(spark, done)
            _LEFT[:] = [p for p in _LEFT if p not in done]
        if spark.conf.get(BATCH_LIMIT, None) is None:
            spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
        before = set(SCRATCH)
        out = stage(spark, docs, sf_dir)
        _LEFT.extend(p for p in SCRATCH if p not in before)
        return out

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage



def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return quality_rules.keep_good(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash class (3-word shingles, 3 bits)."""
    return simhash.keep_first(docs, shingle=3, max_distance=3)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text and n_chars counted anew."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the ids, and the digest of what they
    decode to."""
    ranks, pattern = tokenizer()
    encoded = byte_bpe.encode(docs, ranks, pattern)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    (name, _tidy(stage))
    for name, stage in (
        ("quality_rules", keep_good),
        ("simhash_near_dedup", keep_one_of_near_copies),
        ("benchmark_decontamination", drop_benchmark_leaks),
        ("secret_scans", redact_secrets),
        ("byte_bpe", tokenize),
    )
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    own = spark.conf.get(BATCH_LIMIT, None)
    try:
        for name, stage in STAGES:
            before, docs = written, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            written = SCRATCH[-1]
            if before:
                remove_scratch(spark, [before])
    finally:
        if own is None:
            spark.conf.unset(BATCH_LIMIT)
    return docs
