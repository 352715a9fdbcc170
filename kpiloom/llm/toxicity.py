"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are word unigrams, bigrams and skip-grams (one word left out), hashed into 2**BITS
slots, each counted once a text. FTRL-proximal keeps a rate per coordinate and sets
weak weights to exact zero (L1), so the model is a short list of slots and weights, at most
2**BITS entries, which is shipped with the scoring function whatever the corpus.

FTRL is sequential, so training rows (a documented bound, ``MOST_LABELLED``) are dealt by hash
into ``SHARDS`` shards; each shard runs FTRL, the accumulators are averaged coordinate by
coordinate in a Spark aggregate, and the next round goes on from the average (iterative
parameter mixing).

Rules for odd input: NULL and empty texts have no features and score the bias; repeated rows
keep their rows and score alike; without any training rows every score is 0.5; labels other
than 0 and 1 are ignored; other columns pass through (as ``_row``). Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.features import labelled, remainder

BITS = 18
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 1.0
SHARDS, ROUNDS, EPOCHS = 4, 2, 4
MOST_LABELLED = 40_000  #: labelled rows that are learnt from
_WORD = re.compile(r"[^\W_]+")


def slots(text: str | None, bits: int = BITS, words: dict[str, int] | None = None) -> np.ndarray:
    """The distinct feature slots of a text."""
    import xxhash

    words = {} if words is None else words
    digest = xxhash.xxh64_intdigest
    if len(words) > 500_000:
        words.clear()
    ids = []
    for w in _WORD.findall((text or "").lower()):
        h = words.get(w)
        if h is None:
            h = words[w] = digest(w.encode())
        ids.append(h)
    if not ids:
        return np.zeros(0, np.int32)
    h = np.array(ids, np.uint64)
    mix = lambda a, b, salt: (a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    grams = np.concatenate([h, mix(h[:-1], h[1:], 1), mix(h[:-2], h[2:], 2)])
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((grams >> np.uint64(64 - bits)).astype(np.int32))


def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that FTRL's accumulators stand for."""
    shrunk = np.sign(z) * L1 - z
    return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train_shard(texts: list[np.ndarray], ys: np.ndarray, z: np.ndarray, n: np.ndarray, epochs: int, bits: int) -> None:
    """FTRL over one shard, updating the accumulators in place; slot 2**bits is the bias."""
    bias = 1 << bits
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(texts)):
            own = np.append(texts[i], bias)
            w = weight(z[own], n[own])
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum()))))) - ys[i]
            sigma = (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / ALPHA
            z[own] += g - sigma * w
            n[own] += g * g


def train(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, epochs: int = EPOCHS, bits: int = BITS) -> dict[int, float]:
    """Slot to weight, zeros left out; ``rows`` has text and y."""
    size = (1 << bits) + 1
    state: dict[str, np.ndarray] = {}
    dealt = rows.select((F.pmod(F.xxhash64("text"), F.lit(shards))).alias("shard"), "text", "y")
    for _ in range(rounds):
        before = state

        def learn(shard: pd.DataFrame, before: dict[str, np.ndarray] = before) -> pd.DataFrame:
            shard = shard.sort_values(["text", "y"], na_position="first")
            z, n = np.zeros(size), np.zeros(size)
            if before:
                z[before["slot"]], n[before["slot"]] = before["z"], before["n"]
            words: dict[str, int] = {}
            train_shard([slots(t, bits, words) for t in shard["text"]], shard["y"].to_numpy(), z, n, epochs, bits)
            used = np.nonzero(n)[0]
            return pd.DataFrame({"slot": used, "z": z[used], "n": n[used]})

        own = dealt.groupBy("shard").applyInPandas(lambda s: learn(s), "slot long, z double, n double")
        # A slot that a shard has not seen counts as zero there, so sums are divided by all shards.
        table = own.groupBy("slot").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")).toArrow()
        state = {c: table.column(c).to_numpy() for c in table.column_names}  # at most 2**bits + 1 rows
    w = weight(state["z"], state["n"])
    return {int(s): float(x) for s, x in zip(state["slot"], w, strict=True) if x}


def score(model: dict[int, float], text: str = "text", bits: int = BITS) -> Column:
    """Probability column of a text column."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros((1 << bits) + 1)
        if model:
            dense[list(model)] = list(model.values())
        words: dict[str, int] = {}
        for texts in batches:
            sums = np.array([dense[slots(t, bits, words)].sum() for t in texts]) + dense[1 << bits]
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))))

    return of(F.col(text))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(_row, held_out, score, predicted) for every row of ``docs`` (doc_id, text, ...), learnt
    from the labels whose id's crc32 is not 2 modulo 4."""
    model = train(labelled(docs, labels, "toxic", 4, 2, most))
    return docs.select(
        F.struct("*").alias("_row"), F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), score(model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
