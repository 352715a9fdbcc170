"""Blocked Bloom filters over 64-bit keys, built by Spark and probed in tasks.

A key sets eight bits in one block of 256 bits, two in each of the block's four 64-bit words.
A filter is an array of blocks, so its size is fixed before it is built and can be checked before
it is broadcast. One row per block, OR-ed with a partial aggregate, reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 4
SCHEMA = "place int, " + ", ".join(f"w{k} long" for k in range(WORDS))


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bits(z: np.ndarray, lane: int) -> np.ndarray:
    """The two bits that key ``z`` sets in word ``lane`` of its block."""
    z = mixed(z ^ np.uint64(0x5851F42D4C957F2D))
    a, b = ((z >> np.uint64(12 * lane + 6 * k)) & np.uint64(63) for k in (0, 1))
    return (np.uint64(1) << a) | (np.uint64(1) << b)


def block_of(z: np.ndarray, blocks: int) -> np.ndarray:
    """The block of key ``z``, from its upper 32 bits."""
    return ((z >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def rows(place: np.ndarray, z: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of ``SCHEMA`` for keys and their places."""
    return {"place": place.astype(np.int32)} | {f"w{k}": bits(z, k).view(np.int64) for k in range(WORDS)}


def collect(keys: DataFrame, size: int) -> np.ndarray:
    """The filter of ``size`` blocks from rows of ``SCHEMA``."""
    columns = [f"w{k}" for k in range(WORDS)]
    found = keys.groupBy("place").agg(*[F.expr(f"bit_or({c})").alias(c) for c in columns]).toArrow()
    blocks = np.zeros((size, WORDS), np.uint64)
    at = found["place"].to_numpy()
    for k, c in enumerate(columns):
        blocks[at, k] = found[c].to_numpy().view(np.uint64)
    return blocks


def held(blocks: np.ndarray, place: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Index of the keys that the filter holds (all that were put in, and a few others)."""
    index = np.arange(len(z))
    for lane in range(WORDS):
        want = bits(z[index], lane)
        yes = blocks[place, lane] & want == want
        index, place = index[yes], place[yes]
    return index
