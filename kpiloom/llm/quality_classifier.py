"""Quality classifier: ridge regression on random Fourier features of document statistics.

A text becomes a few statistics (lengths, shares of capitals, digits, symbols, repeats). They
are standardised and mapped by ``FEATURES`` random cosines whose inner products approximate a
Gaussian kernel. Ridge scores come from the normal equations, summed within each partition and
then over partitions in a Spark aggregate, so the driver sees FEATURES x FEATURES numbers and
no rows. The sums are kept by fold; scores of rows left out, binned, are calibrated by isotonic
regression (pool adjacent violators over at most ``BINS`` bins).

Rules for odd input: NULL and empty texts have zero statistics and get a score like any other;
repeated rows keep their rows and score alike; labels other than 0 and 1 are ignored, of several
labels of an id the largest counts; without training rows every score is 0.5; other columns
pass through (as ``_row``). Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import materialise
from kpiloom.llm.features import labelled, remainder

FEATURES = 200  #: random cosines
WIDTH = 0.35  #: inverse width of the kernel, in standard deviations
RIDGE = 1e-2  #: ridge penalty per training row
FOLDS = 3
BINS = 1000
MOST_LABELLED = 200_000  #: labelled rows that are learnt from
SEED = 20240


def statistics(text: str | None) -> list[float]:
    """Statistics of one text; shares are of words or characters."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * 14
    lines = [x for x in text.split("\n") if x.strip()]
    solid = sum(map(len, words))
    low = text.lower()
    upper = sum(a != b for a, b in zip(text, low, strict=False)) if text != low else 0
    raw = text.encode("utf-8", "replace")
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>{}[]\\^~=_"))
    bangs = text.count("!") + text.count("?")
    stops = text.count(".") + text.count(",")
    grams = set(zip(words, words[1:], words[2:], strict=False))
    return [
        np.log1p(n), np.log1p(len(lines)), min(solid / n, 30.0), upper / chars, digits / chars, min(symbols / n, 3.0),
        min(bangs / n, 3.0), min(stops / n, 3.0), len(set(words)) / n, len(grams) / max(1, n - 2),
        len(set(lines)) / max(1, len(lines)), min(n / max(1, len(lines)), 500.0) / 100, float(n < 20), (chars - solid) / chars,
    ]


def _scaled(rows: list | np.ndarray, model: dict) -> np.ndarray:
    x = (np.asarray(rows, float).reshape(-1, len(model["mean"])) - model["mean"]) / model["std"]
    return np.clip(x, -8, 8)


def _cosines(x: np.ndarray) -> np.ndarray:
    """Random Fourier features with a constant column."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, WIDTH, (x.shape[1], FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))])


def isotonic(xs: np.ndarray, ys: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean ``ys`` with counts ``ns`` at increasing ``xs``."""
    blocks: list[list[float]] = []  # x sum, y sum, count
    for x, y, n in zip(xs, ys, ns, strict=True):
        blocks.append([x * n, y * n, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _stats_column(text: str) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts], dtype=object)

    return of(F.col(text))


def fit(rows: DataFrame) -> dict | None:
    """The model from ``rows`` (text, y); None without rows."""
    rows = materialise(
        rows.select(_stats_column("text").alias("x"), "y", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")),
        "quality-stats",
    )
    if rows.isEmpty():
        return None
    vector = array_to_vector("x")
    first = rows.agg(Summarizer.mean(vector).alias("m"), Summarizer.std(vector).alias("s")).first()
    std = first["s"].toArray()
    model = {"mean": first["m"].toArray(), "std": np.where(std > 1e-9, std, 1.0)}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                z = _cosines(_scaled(part["x"].tolist(), model))
                own = np.vstack([z.T @ z, z.T @ part["y"].to_numpy(float)])
                total[fold] = total.get(fold, 0) + own
        for fold, own in total.items():
            yield pd.DataFrame({"fold": int(fold), "i": np.arange(len(own), dtype="int32"), "v": list(own)})

    summed = (
        rows.mapInPandas(sums, "fold int, i int, v array<double>").groupBy("fold", "i")
        .agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()  # FOLDS * (FEATURES + 2) rows
    )
    by_fold = {f: np.zeros((FEATURES + 2, FEATURES + 1)) for f in range(FOLDS)}
    for r in summed:
        by_fold[r["fold"]][r["i"]] = r["v"].toArray()
    everything = sum(by_fold.values())

    def solve(own: np.ndarray) -> np.ndarray:
        n = max(own[FEATURES, FEATURES], 1.0)  # the constant column counts rows
        return np.linalg.solve(own[:-1] / n + RIDGE * np.eye(FEATURES + 1) / 10, own[-1] / n)

    model["w"] = solve(everything)
    left_out = {f: solve(everything - own) for f, own in by_fold.items()}

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                raw = _cosines(_scaled(part["x"].tolist(), model)) @ left_out[fold]
                yield pd.DataFrame({"bin": _bin(raw), "y": part["y"].to_numpy(float)})

    bins = rows.mapInPandas(scores, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model["xs"], model["ys"] = isotonic(*(np.array([float(r[c]) for r in bins]) for c in ("bin", "y", "n")))
    return model


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype("int32")


def predict(model: dict | None, rows: list) -> np.ndarray:
    """Calibrated scores of rows of statistics."""
    if model is None:
        return np.full(len(rows), 0.5)
    raw = _cosines(_scaled(rows, model)) @ model["w"]
    return np.interp(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1), model["xs"], model["ys"])


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(_row, held_out, score, predicted) for every row of ``docs`` (doc_id, text, ...), learnt
    from the labels whose id's crc32 is not 0 modulo 5."""
    model = fit(labelled(docs, labels, "quality", 5, 0, most))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(predict(model, [statistics(t) for t in texts]))

    return docs.select(
        F.struct("*").alias("_row"), F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), score(F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
