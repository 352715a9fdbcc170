"""N-gram Jaccard join with count-vector R-trees.

A text's set holds its distinct word shingles (as 64-bit hashes). Two texts link when
100 * |A and B| >= percent * |A or B|; linked texts share a component.

**Count vectors and the bound.** Shingles are hashed into ``GROUPS`` groups; a set is the point of
its group counts. The overlap of two sets is at most the sum over groups of the smaller count, so a
pair can link only if that sum reaches (percent / (100 + percent)) * (|A| + |B|). An R-tree packs
points (sort-tile-recursive); a node keeps the largest count per group and its smallest set, which
bounds every pair below two nodes. Pairs of nodes are followed from the root down while the bound
holds, and the points that survive are verified exactly.

**Dealing points to trees.** One tree over all texts prunes nothing: between unrelated sets of n
shingles the counts differ by some 1.1 * sqrt(GROUPS * n) in all, spread over every group, so the
boxes of any two nodes overlap in all of them (README has the measured share). Each set therefore
goes to the buckets of the shingles that a link needs: ordered by rarity, two linked sets share one
of their first |A| - ceil(percent * |A| / 100) + 1 shingles. Every bucket has a tree of its own.
Rarity is the corpus count of the shingle's slot of ``SLOTS`` (all texts counted, one fixed-size
table); any fixed order is exact, so slots shared by chance cost time only.

**No copy, hot bucket or clique is expanded.**

1. Equal sets are one point; within a task a set is dealt once.
2. A bucket's lone sets are dropped in a streaming pass. Rows of shingles in hot slots are salted.
3. A linked pair shares not one but at least o - ceil(percent * larger / 100) + 1 buckets, o being
   the least overlap for its sizes; pairs that meet less often are not compared.
4. *Proposals*: in every bucket each set meets the bucket's pivots, and the pairs that meet often
   enough are verified. This joins most of a cluster by a few comparisons a set. Twice, with other
   pivots.
5. *Trees*: buckets that still hold several components are split by set size (the root level of the
   tree: counts sum to the size) and, above ``CELL`` sets, into cells of pairs of tiles. The R-trees
   of the cells give every pair of different components that passes the bound and meets often enough,
   once, in the first bucket of both; they are verified, if they are many for each set first the pair that meets
   most. A pair inside one component
   needs no comparison, as no component would change.

The sets of a pair are read from the texts again, one text a set: a Bloom filter of the ids in
question (at most ``FILTER_BLOCKS`` blocks, 32 MB) picks the rows to read and an exact join the
sets to keep, so sets of unique texts are never shuffled.

Rules for odd input: NULL, empty and wordless texts have the empty set and link with nothing (their
component is their own id); texts of fewer words than a shingle have their whole sequence as one
shingle; repeated rows keep their rows; a component without any id has a NULL one; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm import bloom
from kpiloom.llm.common import components, materialise

#: Coordinates of a point.
GROUPS = 128
#: Slots of the rarity table (8 bytes each), counted in blocks of ``SLOT_BLOCK``.
SLOTS, SLOT_BLOCK = 1 << 20, 1 << 10
#: Children of an R-tree node, points of a leaf.
FANOUT = 32
#: Rows of a bucket that are one leaf.
SMALL = 16
#: Sets of a tile; a cell compares two tiles.
CELL = 2048
FILTER_BLOCKS = 1 << 20
#: A shingle is hot if its slot counts this often and eight times the mean.
HOT = 4096
#: Pairs a set beyond which the trees' pairs are verified in rounds.
MANY = 2
#: Pivots of a bucket in the two rounds of proposals.
SEEDS = ((1, 2, 3, 4, 5, 6), (7, 8, 9, 10, 11, 12))
_WORDS = 1 << 18
#: Tokens of pairs that are looked up at once.
_PAIRS = 1 << 20


def _odd(n: int) -> np.ndarray:
    """Odd factors of the positions in a shingle, from a mixing rule."""
    return bloom.mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _distinct(hashes: np.ndarray) -> np.ndarray:
    own = np.sort(hashes)
    return own[np.r_[True, own[1:] != own[:-1]]]


def shingle_sets(texts: Iterable[bytes | None], size: int) -> Iterator[np.ndarray]:
    """Per UTF-8 text the sorted distinct hashes of its ``size``-word shingles; A-Z lower-cased,
    words between ASCII white space. Texts are hashed ``_WORDS`` words at a time."""
    import xxhash

    odd = _odd(size)

    def sets(parts: list[list[bytes]], held: int) -> Iterator[np.ndarray]:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(parts)), np.uint64, held)
        whole = np.zeros(0, np.uint64)
        if held >= size:
            whole = bloom.mixed(sum(hashes[i : held - size + 1 + i] * odd[i] for i in range(size)) + np.uint64(size))
        at = 0
        for words in parts:
            n = len(words)
            if n >= size:
                yield _distinct(whole[at : at + n - size + 1])
            elif n:
                yield bloom.mixed((hashes[at : at + n] * odd[:n]).sum(keepdims=True) + np.uint64(n))
            else:
                yield hashes[:0]
            at += n

    parts, held = [], 0
    for text in texts:
        parts.append(text.lower().split() if text else [])
        held += len(parts[-1])
        if held >= _WORDS:
            yield from sets(parts, held)
            parts, held = [], 0
    yield from sets(parts, held)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    return next(shingle_sets([text], size))


def _name(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    import xxhash

    both = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
    return int(both[0]), int(both[1])


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(SLOTS - 1)).astype(np.int64)


def _point(own: np.ndarray) -> bytes:
    """Group counts in 16 bits. A set with a larger count gets the largest in every group: then
    the bound says nothing about it, and its pairs are verified."""
    counts = np.bincount((own >> np.uint64(57)).astype(np.int64), minlength=GROUPS)
    return (counts if counts.max() < 1 << 16 else np.full(GROUPS, (1 << 16) - 1)).astype(np.uint16).tobytes()


def keys(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written: one row per text (id, n, k1, k2, its point in counts), and one per task and block of
    slots that it uses (block, counts)."""

    def schema(kind: pa.DataType) -> pa.Schema:
        return pa.schema([("id", kind), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("counts", pa.binary()), ("block", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, kind = np.zeros(SLOTS, np.uint32), None
        for batch in batches:
            kind, n, names, points, used = batch.column(1).type, [], [], [], []
            for own in shingle_sets(batch.column(0).to_pylist(), size):
                n.append(len(own))
                names.append(_name(own) if len(own) else (None, None))
                points.append(_point(own) if len(own) else None)
                used.append(_slot(own))
            n, names, points = n[: batch.num_rows], names[: batch.num_rows], points[: batch.num_rows]
            slots += np.bincount(np.concatenate(used), minlength=SLOTS).astype(np.uint32)
            k1, k2 = zip(*names, strict=True) if names else ((), ())
            columns = [batch.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(points, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(batch.num_rows, pa.int32())], schema=schema(kind))
        used = np.nonzero(slots.reshape(-1, SLOT_BLOCK).any(1))[0]
        if len(used):
            none = [pa.nulls(len(used), t) for t in (kind, pa.int64(), pa.int64(), pa.int64())]
            bodies = [slots[b * SLOT_BLOCK : (b + 1) * SLOT_BLOCK].tobytes() for b in used.tolist()]
            yield pa.RecordBatch.from_arrays([*none, pa.array(bodies, pa.binary()), pa.array(used.astype(np.int32))], schema=schema(kind))

    texts = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("id"))
    kind = texts.schema["id"].dataType.simpleString()
    return materialise(texts.mapInArrow(read, f"id {kind}, n long, k1 long, k2 long, counts binary, block int"), "jaccard-keys")


def slot_counts(written: DataFrame) -> np.ndarray:
    """Occurrences of all sets' shingles per slot; a table of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # at most SLOTS counts in all
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(body.as_py(), np.uint32)
                sums[block] = sums[block] + part if block in sums else part.astype(np.int64)
        yield pa.RecordBatch.from_pydict({"block": pa.array(sums.keys(), pa.int32()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    # Each part of a block is summed within its task, then again here (parts: a bounded number).
    parts = written.where("block IS NOT NULL").select("block", "counts").repartition("block")
    out = np.zeros(SLOTS, np.int64)
    for block, body in parts.mapInArrow(add, "block int, counts binary").collect():
        out[block * SLOT_BLOCK : (block + 1) * SLOT_BLOCK] += np.frombuffer(bytes(body), np.int64)
    return out


def prefix_rows(docs: DataFrame, weights: np.ndarray, size: int, percent: int, text_col: str = "text") -> DataFrame:
    """(token, salt, k1, n): every set under the shingles that a link needs, rarest first. Salt
    is -1 but for hot shingles, whose rows are dealt over several tasks."""
    hot = max(HOT, 8 * int(weights.mean()))
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(weights, 2**32 - 1).astype(np.uint32))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, seen = shared.value, set()  # names of the task's own sets
        for batch in batches:
            tokens, salts, names, sizes = [], [], [], []
            for own in shingle_sets(batch.column(0).to_pylist(), size):
                name = _name(own)
                if not len(own) or name in seen:
                    continue
                seen.add(name)
                need = len(own) - -(-percent * len(own) // 100) + 1
                weight = weights[_slot(own)]
                first = np.lexsort((own, weight))[:need]
                salt = np.where(weight[first] > hot, (name[1] & 0xFFFF) % (weight[first].astype(np.int64) // hot + 1), -1)
                tokens.append(own[first].view(np.int64))
                salts.append(salt)
                names.append(np.full(need, name[0]))
                sizes.append(np.full(need, len(own)))
            if tokens:
                columns = [np.concatenate(c) for c in (tokens, salts, names, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]), pa.array(columns[3].astype(np.int32))],
                    names=["token", "salt", "k1", "n"],
                )

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(deal, "token long, salt int, k1 long, n int")


def shared_buckets(rows: DataFrame, percent: int) -> DataFrame:
    """(token, k1, n): rows whose bucket holds another set of a size that can link. The rows
    come by size, so a row with any such partner has one beside it."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "salt", "n", "k1")
        last = {c: np.zeros(0, np.int64) for c in names} | {"ok": np.zeros(0, bool)}
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: np.concatenate([last[c], batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, c in enumerate(names)}
            ok = np.concatenate([last["ok"], np.zeros(batch.num_rows, bool)])
            fresh = np.ones(len(ok), bool)
            fresh[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in names], axis=0)  # copies from several tasks
            cols, ok = {c: v[fresh] for c, v in cols.items()}, ok[fresh]
            near = (cols["token"][1:] == cols["token"][:-1]) & (100 * cols["n"][:-1] >= percent * cols["n"][1:])
            ok[1:] |= near
            ok[:-1] |= near
            ok |= cols["salt"] >= 0
            out = np.nonzero(ok[:-1])[0]
            yield pa.RecordBatch.from_pydict({"token": cols["token"][out], "k1": cols["k1"][out], "n": cols["n"][out].astype(np.int32)})
            last = {c: v[-1:] for c, v in cols.items()} | {"ok": ok[-1:]}
        out = np.nonzero(last["ok"])[0]
        yield pa.RecordBatch.from_pydict({"token": last["token"][out], "k1": last["k1"][out], "n": last["n"][out].astype(np.int32)})

    dealt = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "k1")
    return dealt.select("token", "salt", "n", "k1").mapInArrow(kept, "token long, k1 long, n int")


def classes(named: DataFrame) -> DataFrame:
    """Written: (node, k1, k2, first, n, counts) of every distinct set that is not empty; first is
    its smallest id. The node ids are fixed by writing them."""
    rows = named.where("block IS NULL AND n > 0").groupBy("k1", "k2").agg(
        F.min("id").alias("first"), F.min("n").cast("int").alias("n"), F.min("counts").alias("counts")
    )
    return materialise(rows.select(F.monotonically_increasing_id().alias("node"), "*"), "jaccard-classes")


def fetched(docs: DataFrame, wanted: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written: (node, shingles) of the classes ``wanted`` (node, k1, k2, first)."""
    wanted = materialise(wanted.select("node", "k1", "k2", F.xxhash64("first").alias("h")), "jaccard-wanted")
    blocks = min(FILTER_BLOCKS, max(16, wanted.count() // 16))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = bloom.mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_pydict(bloom.rows(bloom.block_of(z, blocks), z))

    filled = bloom.collect(wanted.select("h").mapInArrow(put, bloom.SCHEMA), blocks)
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            z = bloom.mixed(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            chosen = bloom.held(shared.value, bloom.block_of(z, blocks), z)
            found: list[tuple] = []
            for own in shingle_sets(batch.column(0).take(pa.array(chosen)).to_pylist(), size):
                name = _name(own)
                if len(own) and name not in seen:
                    seen.add(name)
                    found.append((*name, own.view(np.int64)))
            if found:
                k1, k2, own = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["k1", "k2", "shingles"]
                )

    texts = docs.select(F.col(text_col).cast("binary").alias("text"), F.xxhash64(id_col).alias("h"))
    sets = texts.mapInArrow(read, "k1 long, k2 long, shingles array<long>").dropDuplicates(["k1", "k2"])
    return materialise(sets.join(wanted.select("node", "k1", "k2"), ["k1", "k2"]).select("node", "shingles"), "jaccard-sets")


def least_shared(a: str, b: str, percent: int) -> str:
    """SQL: the buckets that two linked sets of sizes ``a`` and ``b`` share at least. Of their o or
    more common shingles, the first o - ceil(percent * larger / 100) + 1 are in both prefixes."""
    ceil = lambda x, y: f"(({x}) + {y - 1}) DIV {y}"
    overlap = ceil(f"{percent} * (CAST({a} AS BIGINT) + {b})", 100 + percent)
    return f"({overlap} - {ceil(f'{percent} * CAST(greatest({a}, {b}) AS BIGINT)', 100)} + 1)"


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_sa", "_sb")).cast("long")
    return both.where((100 + percent) * common >= percent * (F.size("_sa") + F.size("_sb"))).select("a", "b")


def proposals(members: DataFrame, percent: int, seeds: tuple[int, ...]) -> DataFrame:
    """(a, b): each set b with the pivots a, of other components, that it meets often enough for a
    link. A bucket has one pivot a seed, its set of the smallest hash, so the buckets of a cluster
    agree on few and a set gets at most some ``len(seeds)`` pairs."""
    least = [
        F.min(F.struct(F.xxhash64(F.lit(seed), "root", "node").alias("h"), F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"))).alias(f"p{seed}")
        for seed in seeds
    ]
    pivots = F.array_distinct(F.array(*[F.struct(f"p{seed}.a", f"p{seed}.ra", f"p{seed}.na") for seed in seeds]))
    pivot = members.groupBy("token").agg(*least).select("token", pivots.alias("p")).where("size(p) > 0")
    met = members.join(pivot, "token").select("node", "n", "root", F.inline("p")).where("ra <> root").groupBy("node", "n", "a", "na").agg(F.count("*").alias("shared"))
    met = met.where(f"shared >= {least_shared('n', 'na', percent)} AND 100 * least(n, na) >= {percent} * greatest(n, na)")
    return met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


# --- R-tree -----------------------------------------------------------------------------

def packed(counts: np.ndarray, sizes: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """Sort-tile-recursive order of the points: by size, then slices of the slices by the
    coordinate that varies most, until a slice fills a leaf."""

    def tile(index: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
        index = index[np.argsort(by, kind="stable")]
        slices = max(2, round((len(index) / fanout) ** 0.5))
        step = -(-len(index) // slices)
        step = -(-step // fanout) * fanout  # whole leaves
        return [index[i : i + step] for i in range(0, len(index), step)]

    done, todo = [], [(np.arange(len(sizes)), sizes)]
    while todo:
        index, by = todo.pop()
        if len(index) <= fanout:
            done.append(index)
            continue
        parts = tile(index, by)
        if len(parts) == 1:
            parts = [index[i : i + fanout] for i in range(0, len(index), fanout)]
            done.extend(parts)
            continue
        for part in reversed(parts):
            spread = counts[part].std(0).argmax()
            todo.append((part, counts[part, spread]))
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def _reach(high_a: np.ndarray, low_a: np.ndarray, high_b: np.ndarray, low_b: np.ndarray, percent: int) -> np.ndarray:
    """The bound: can an overlap of these boxes suffice for sets of at least these sizes?"""
    most = np.minimum(high_a, high_b).sum(1, dtype=np.int64)
    return (100 + percent) * most >= percent * (low_a + low_b)


def tree_pairs(counts: np.ndarray, sizes: np.ndarray, percent: int, fanout: int = FANOUT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of points that pass the bound, in parts, from an R-tree joined with itself."""
    if len(sizes) < 2:
        return
    order = packed(counts, sizes, fanout)
    levels = [(counts[order], sizes[order].astype(np.int64), sizes[order].astype(np.int64))]
    while len(levels[-1][1]) > 1:
        high, low, top = levels[-1]
        starts = np.arange(0, len(low), fanout)
        levels.append((np.maximum.reduceat(high, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(top, starts)))
    frontier = [(len(levels) - 1, np.array([0]), np.array([0]))]
    while frontier:
        level, a, b = frontier.pop()
        high, low, top = levels[level]
        fits = _reach(high[a], low[a], high[b], low[b], percent)
        # Sizes alone: the larger set of a pair may be at most 100 / percent of the smaller.
        fits &= (100 * top[a] >= percent * low[b]) & (100 * top[b] >= percent * low[a])
        a, b = a[fits], b[fits]
        if level == 0:
            if len(a):
                yield order[a], order[b]
            continue
        below = len(levels[level - 1][1])
        step = max(1, (1 << 18) // (fanout * fanout))
        for at in range(0, len(a), step):
            ca = (a[at : at + step, None] * fanout + np.arange(fanout))[:, :, None]
            cb = (b[at : at + step, None] * fanout + np.arange(fanout))[:, None, :]
            inside = (ca < below) & (cb < below) & ((ca < cb) if level == 1 else (ca <= cb))
            ca, cb = np.broadcast_arrays(ca, cb)
            frontier.append((level - 1, ca[inside], cb[inside]))


def cells(members: DataFrame, percent: int, cell: int = CELL) -> DataFrame:
    """Members dealt to (token, band, cell): bands of sizes (a set is also a guest of the next
    band), and above ``cell`` sets pairs of tiles. Buckets with one component are left out.

    ``place`` deals cells to tasks by the bucket's pivot, its smallest hash: a cluster's buckets
    agree on few, so most of a set's buckets are in one task, where the set stands once."""
    # Sets that link are under one band apart: the ratio is a little wider than percent / 100.
    width = -log((percent - 1) / 100) if percent > 1 else 700.0
    band = F.floor(F.log("n") / F.lit(width)).cast("int")
    roles = F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own")))
    dealt = members.select("*", F.inline(roles))
    several = (
        dealt.groupBy("token", "band").agg(
            F.count("*").alias("sets"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("own").alias("any"),
            F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("least"),
        )
        .where("lo < hi AND any")
        .select("token", "band", F.col("least.node").alias("pivot"), F.expr(f"CAST(shiftleft(1, CAST(ceil(log2(greatest(sets / {cell}, 1))) AS INT)) AS INT)").alias("tiles"))
    )
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    return (
        dealt.join(several, ["token", "band"]).withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("token", "band", F.least("tile", "other").alias("ci"), F.greatest("tile", "other").alias("cj"), "tile", "own", "node", "root", "n", "pivot")
        .withColumn("place", F.xxhash64("pivot", "ci", "cj")).drop("pivot")
    )


def _small_pairs(starts: np.ndarray, rows: int, counts: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that pass the bound in groups of at most ``SMALL`` rows (one leaf each), for
    all groups at once: row i against row i + step."""
    length = np.diff(np.r_[starts, rows])
    left = np.repeat(np.where(length <= SMALL, length, 0), length) - (np.arange(rows) - np.repeat(starts, length)) - 1
    out_a, out_b = [], []
    for step in range(1, SMALL):
        a = np.nonzero(left >= step)[0]
        if not len(a):
            break
        b = a + step
        fits = _reach(counts[a], sizes[a], counts[b], sizes[b], percent)
        fits &= (100 * sizes[a] >= percent * sizes[b]) & (100 * sizes[b] >= percent * sizes[a])
        out_a.append(a[fits])
        out_b.append(b[fits])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _shared(flat: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows: how many tokens both hold, and the smallest of them (else -1). Row k
    holds the ascending token numbers flat[offsets[k]:offsets[k + 1]]."""
    length = np.diff(offsets)
    width = int(flat.max()) + 1 if len(flat) else 1
    held = np.repeat(np.arange(len(length)), length) * width + flat  # ascending
    count, first = np.zeros(len(i), np.int64), np.full(len(i), -1, np.int64)
    ends = np.cumsum(length[i])
    at = 0
    while at < len(i):  # parts of some _PAIRS tokens
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        n = length[i[at:to]]
        pair = np.repeat(np.arange(to - at), n)
        token = flat[np.repeat(offsets[i[at:to]], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
        want = j[at:to][pair] * width + token
        where = np.minimum(np.searchsorted(held, want), max(len(held) - 1, 0))
        hit = np.nonzero(held[where] == want)[0] if len(held) else np.zeros(0, np.int64)
        count[at:to] = np.bincount(pair[hit], minlength=to - at)
        own, lead = np.unique(pair[hit], return_index=True)
        first[at + own] = token[hit[lead]]
        at = to
    return count, first


def candidates(dealt: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared), a < b: pairs of different components that pass the bound in a cell's tree and
    share as many buckets as a link needs, each once.

    A set stands once in a place, with its buckets there and all its buckets. So the task itself
    counts what a pair shares, and only the first of its buckets gives the pair. A pair of different
    components has all its buckets in ``dealt``."""
    names = ("place", "band", "ci", "cj", "tile", "own", "node", "root", "n")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            part = {c: rows.column(c).to_numpy().astype(np.int64) for c in names}
            counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint16).reshape(-1, GROUPS)
            here, tokens = (rows.column(c).combine_chunks() for c in ("here", "tokens"))
            flat = tokens.flatten().to_numpy().view(np.uint64)
            known, number = np.unique(flat, return_inverse=True)
            length = pa.compute.list_value_length(tokens).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(length)), length)
            number = number[np.lexsort((number, row))]
            offsets = np.r_[0, np.cumsum(length)]

            # The buckets: rows of one group and token.
            group = np.r_[0, np.cumsum(np.any([part[c][1:] != part[c][:-1] for c in names[:4]], axis=0))]
            owner = np.repeat(np.arange(len(group)), pa.compute.list_value_length(here).to_numpy().astype(np.int64))
            token = np.searchsorted(known, here.flatten().to_numpy().view(np.uint64))
            order = np.lexsort((token, group[owner]))
            owner, token = owner[order], token[order]
            new = (token[1:] != token[:-1]) | (group[owner][1:] != group[owner][:-1])
            starts = np.r_[0, np.nonzero(new)[0] + 1]

            def often(i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
                """Rows a and b, and the buckets they share, of the entries i and j."""
                a, b, bucket = owner[i], owner[j], token[i]
                ok = (part["root"][a] != part["root"][b]) & ((part["own"][a] | part["own"][b]) != 0)
                ok &= (part["ci"][a] == part["cj"][a]) | (part["tile"][a] != part["tile"][b])
                a, b, bucket = a[ok], b[ok], bucket[ok]
                shared, first = _shared(number, offsets, a, b)
                least = (percent * (part["n"][a] + part["n"][b]) + 99 + percent) // (100 + percent)
                least -= (percent * np.maximum(part["n"][a], part["n"][b]) + 99) // 100 - 1
                ok = (shared >= least) & (first == bucket)
                return [a[ok], b[ok], shared[ok]]

            sizes = part["n"][owner]
            parts = []
            small = np.diff(np.r_[starts, len(owner)]) <= SMALL
            inside = np.repeat(small, np.diff(np.r_[starts, len(owner)]))
            index = np.nonzero(inside)[0]
            if len(index):
                heads = np.searchsorted(index, starts[small])
                i, j = _small_pairs(heads, len(index), counts[owner[index]], sizes[index], percent)
                parts.append(often(index[i], index[j]))
            for lo, hi in zip(starts[~small].tolist(), np.r_[starts[1:], len(owner)][~small].tolist(), strict=True):
                for i, j in tree_pairs(counts[owner[lo:hi]], sizes[lo:hi], percent):
                    parts.append(often(i + lo, j + lo))
            a, b, shared = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
            a, b = part["node"][a], part["node"][b]
            return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b), "shared": shared})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            new = np.nonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))[0] + 1
            begun = held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(4))
            last = int(new[-1]) if len(new) else 0  # its group may go on in the next batch
            if held and (begun or last):
                yield found(pa.Table.from_batches([*held, batch.slice(0, last)] if last else held))
                held = []
            elif last:
                yield found(pa.Table.from_batches([batch.slice(0, last)]))
            held.append(batch.slice(last))
        if held:
            yield found(pa.Table.from_batches(held))

    tokens = dealt.groupBy("node").agg(F.collect_set("token").alias("tokens"))
    placed = dealt.groupBy(*names).agg(F.collect_list("token").alias("here"))
    rows = placed.join(tokens, "node").join(nodes.select("node", "counts"), "node").select(*names, "here", "tokens", "counts")
    return rows.repartition("place").sortWithinPartitions(*names[:4]).mapInArrow(join, "a long, b long, shared long")


def foremost(pairs: DataFrame) -> DataFrame:
    """(a, b): for each set the pair (a, b, shared) that shares most buckets."""
    ends = pairs.select(F.col("a").alias("x"), "a", "b", "shared").union(pairs.select("b", "a", "b", "shared"))
    return ends.groupBy("x").agg(F.max(F.struct("shared", "a", "b")).alias("m")).select("m.a", "m.b").distinct()


def across(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components (node, root)."""
    ra, rb = (stars.select(F.col("node").alias(c), F.col("root").alias(f"_r{c}")) for c in "ab")
    both = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return both.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select(*pairs.columns)


# --- the whole join ---------------------------------------------------------------------

def joined(
    members: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, stars: DataFrame | None = None,
    seeds: tuple[tuple[int, ...], ...] | None = None, cell: int = CELL, made: list[str] | None = None,
) -> DataFrame:
    """(node, root) of all links. ``members`` (token, node, n): the sets under the shingles that a
    link needs; ``nodes`` (node, counts): their points; ``sets_of``: (node, shingles) of the sets of
    pairs (a, b); ``stars``: the components of links known before; ``seeds``: the pivots of each
    round of proposals (without ``stars`` one at least)."""

    def linked(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        pairs = materialise(pairs, "jaccard-pairs", made)
        new = materialise(verified(pairs, sets or sets_of(pairs), percent), "jaccard-links", made)
        return components(new if stars is None else new.union(stars.toDF("a", "b")), "jaccard-stars", made=made)

    def rooted() -> DataFrame:
        return materialise(members.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-members", made)

    rows = members.withColumn("root", F.col("node")) if stars is None else rooted()
    for some in SEEDS if seeds is None else seeds:
        stars = linked(proposals(rows, percent, some))
        rows = rooted()
    dealt = materialise(cells(rows, percent, cell), "jaccard-cells", made)
    pairs = materialise(candidates(dealt, nodes, percent), "jaccard-pairs", made)
    several = pairs.count()
    if not several:
        return stars
    sets = sets_of(pairs)
    if several > MANY * nodes.count():
        for _ in range(2):  # a pair a set first: what they join needs no more comparison
            stars = linked(foremost(pairs), sets)
            pairs = materialise(across(pairs, stars), "jaccard-pairs", made)
    return linked(pairs, sets)


def near_duplicates(
    docs: DataFrame, shingle: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL
) -> DataFrame:
    """(id_col, n_shingles, component_id), one row per row of ``docs``."""
    named = keys(docs, shingle, id_col, text_col)
    buckets = materialise(shared_buckets(prefix_rows(docs, slot_counts(named), shingle, percent, text_col), percent), "jaccard-buckets")
    nodes = classes(named)
    members = materialise(buckets.join(nodes.select("k1", "node"), "k1").select("token", "node", "n"), "jaccard-members")

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return fetched(docs, nodes.join(ends, "node", "left_semi"), shingle, id_col, text_col)

    stars = joined(members, nodes, sets_of, percent, cell=cell)
    placed = nodes.join(stars, "node", "left").select("k1", "k2", "first", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    whole = placed.join(least, "root").select("k1", "k2", "component_id")
    rows = named.where("block IS NULL").select("id", "n", "k1", "k2")
    many = rows.where("n > 0").join(whole, ["k1", "k2"]).select("id", "n", "component_id")
    return many.union(rows.where("n = 0").select("id", "n", "id")).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def oracle(shingle: int = 4, percent: int = 85) -> str:
    """DuckDB SQL of ``near_duplicates``: overlaps counted over an inverted index."""
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE
    list_distinct(list_transform(range(1, greatest(len(w) - {shingle - 2}, 2)), lambda i: array_to_string(w[i:i + {shingle - 1}], ' '))) END AS s
  FROM split
), held AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {100 + percent} * count(*) >= {percent} * (a.n + b.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id
"""
