"""SimHash near-duplicates by meet-in-the-middle ball hashing.

``fingerprints`` adds a 64-bit SimHash of word shingles; ``near_duplicates`` links
fingerprints at Hamming distance ``max_distance`` or less and numbers the connected classes.

Ball hashing. Two fingerprints at distance d have a middle within d/2 of both, so every
distinct fingerprint emits all variants within half the radius and pairs meet on an equal
variant. For an odd radius 2r+1 the ball of radius r is one bit short. The literal remedy, a
ball of radius r+1, means 2,081 variants a fingerprint at radius 3. Instead one of three bit
blocks is left out of the variants in turn: a pair at distance 2r+1 differs in some block, and
without that block its distance is at most 2r. Radius 3 then takes 3 x 44 variants of about 43
bits. The left-out block makes some collisions false; every colliding pair is verified on all
64 bits. Exact copies are one fingerprint, so groups of copies never meet as pairs.

Inside one variant's group the links are found without all pairs: up to ``PAIRS`` members are
compared directly, more of them by looking up each member's neighbours in the group, and a
group emits no more links than members (a spanning forest), beyond groups of eight.

Rules for odd input: NULL or wordless text has fingerprint zero and is linked like any other;
repeated rows keep their rows and share a class; a class whose doc_ids are all NULL has a NULL
``component_id``; empty tables give no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import components, materialise

#: Members of a group that are compared pair by pair; larger groups look neighbours up.
PAIRS = 2048
#: Groups up to this size emit each verified pair.
SMALL = 8


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer. ``text`` is UTF-8; only A-Z are lower-cased."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str = "text", shingle: int = 3) -> Column:
    """Column expression (BIGINT) of a text column's SimHash."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return of(F.col(text).cast("binary"))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, column: str = "fp") -> DataFrame:
    return docs.withColumn(column, fingerprint(text, shingle))


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball_keys(max_distance: int) -> list[tuple[int, list[int]]]:
    """Per left-out block: (mask of the kept bits, XOR masks of the ball). The left-out bits
    of a key hold the block's number."""
    radius, odd = divmod(max_distance, 2)
    cuts = [0, 22, 43, 64] if odd else [0, 0]
    out = []
    for block, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        kept = [i for i in range(64) if not lo <= i < hi]
        mask = sum(1 << i for i in kept)
        tag = (block + 1) << lo if hi > lo else 0
        flips = [sum(1 << i for i in c) | tag for n in range(radius + 1) for c in combinations(kept, n)]
        out.append((_signed(mask), [_signed(x) for x in flips]))
    return out


def variants(fps: DataFrame, max_distance: int) -> DataFrame:
    """(key, fp): the ball of every distinct fingerprint."""
    def ball(mask: int, flips: list[int]) -> Column:
        kept = F.col("fp").bitwiseAND(F.lit(mask).cast("long"))
        return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: kept.bitwiseXOR(x))

    arrays = [ball(mask, flips) for mask, flips in ball_keys(max_distance)]
    return fps.select(F.explode(F.concat(*arrays)).alias("key"), "fp")


def _forest(members: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one group's distance graph."""
    n = len(members)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []

    def join(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[b] = a
                links.append((int(members[i]), int(members[j])))

    if n <= PAIRS:
        for i in range(n - 1):
            near = np.bitwise_count(members[i + 1 :] ^ members[i]) <= max_distance
            join(i, np.nonzero(near)[0] + i + 1)
        return links
    flips = np.array(
        [sum(1 << i for i in c) for k in range(1, max_distance + 1) for c in combinations(range(64), k)]
        if max_distance <= 3
        else [0],
        np.uint64,
    )
    if max_distance > 3:
        for i in range(n - 1):
            near = np.bitwise_count(members[i + 1 :] ^ members[i]) <= max_distance
            join(i, np.nonzero(near)[0] + i + 1)
        return links
    for i in range(n):
        near = members[i] ^ flips
        at = np.minimum(np.searchsorted(members, near), n - 1)
        join(i, at[members[at] == near])
    return links


def _links_of_sorted(keys: np.ndarray, fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    kept_keys, kept = keys[small], fps[small]
    for step in range(1, SMALL):
        if len(kept) <= step:
            break
        near = (kept_keys[step:] == kept_keys[:-step]) & (np.bitwise_count(kept[step:] ^ kept[:-step]) <= max_distance)
        left.append(kept[:-step][near])
        right.append(kept[step:][near])
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        found = _forest(np.unique(fps[s : s + n]), max_distance)
        if found:
            a, b = np.array(found, np.uint64).T
            left.append(a)
            right.append(b)
    none = np.zeros(0, np.uint64)
    a, b = (np.concatenate([none, *x]) for x in (left, right))
    a, b = np.maximum(a, b).view(np.int64), np.minimum(a, b).view(np.int64)
    pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def links(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints ``fp``; their connected classes are
    those of all pairs at ``max_distance`` or less."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys, values):
            a, b = _links_of_sorted(keys, values, max_distance)
            return pa.RecordBatch.from_pydict({"a": a, "b": b})

        old_keys, old_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([old_keys, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([old_fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if whole:
                yield out(keys[:whole], values[:whole])
            old_keys, old_fps = keys[whole:], values[whole:]
        if len(old_keys):
            yield out(old_keys, old_fps)

    grouped = variants(fps.select("fp").distinct(), max_distance).repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(verified, "a long, b long").distinct()


def classes(marked: DataFrame, max_distance: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(fp, root, component_id) for every distinct ``fp`` of ``marked`` (id_col, fp)."""
    fps = materialise(marked.groupBy("fp").agg(F.min(id_col).alias("_first")), "simhash-fps")
    stars = components(links(fps, max_distance), "simhash-links").withColumnRenamed("node", "fp")
    rooted = fps.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy(F.col("root").alias("_r")).agg(F.min("_first").alias("component_id"))
    return rooted.join(first, F.col("root") == F.col("_r")).select("fp", "root", "component_id")


def near_duplicates(marked: DataFrame, max_distance: int = 3, id_col: str = "doc_id") -> DataFrame:
    """``marked`` (with ``fp``, already materialised or cheap) plus ``root`` and ``component_id``."""
    return marked.join(classes(marked, max_distance, id_col), "fp")


def keep_first(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """One document of each class: the one with the smallest doc_id (NULL ids last); among
    repeated rows of that id the first by the texts. Columns as in ``docs``."""
    names = {"fp": "_fp", "root": "_root", "component_id": "_component"}
    taken = set(docs.columns) & {*names, *names.values()}
    renamed = {c: f"_in_{c}" for c in taken}
    work = docs.withColumnsRenamed(renamed) if renamed else docs
    marked = near_duplicates(materialise(fingerprints(work, "text", shingle), "simhash-docs"), max_distance)
    order = Window.partitionBy("root").orderBy(*[F.col(c).asc_nulls_last() for c in work.columns])
    first = (
        marked.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .withColumn("_nth", F.row_number().over(order))
        .where("_nth = 1")
    )
    return first.select(*[F.col(renamed.get(c, c)).alias(c) for c in docs.columns])
