"""Substring deduplication: MinHash banding of paragraphs, verified and clustered.

A paragraph is a line; where a text has blank lines, the lines between two of them are one too.
Those of more than ``LONG`` words are cut by content into pieces of ``PIECE`` words or more.
Passages inside lines are found by snippets: among every ``WINNOW`` consecutive 5-word shingles
from which ``LENGTH`` words can be taken the one with the smallest hash is an anchor, and the
words from it are a snippet, which is compared as a whole. A passage of WINNOW + LENGTH - 1 words
(30) or more gives every text that holds it a common snippet; as WINNOW is less than LENGTH, the
snippets of a passage leave no gaps between them.

1. All shingles of a paragraph give ``BANDS`` keys of ``ROWS`` MinHashes. For a similarity of 0.8
   the chance to share a key is 1 - (1 - 0.8**2)**4 = 0.983. A snippet has one key, its own.
   Equal (key, paragraph) rows of a batch are combined before the shuffle on the key.
2. Keys with several different paragraphs are candidates; their shingles are fetched and the
   exact Jaccard similarity is checked. A key with few of them compares all
   its pairs, a larger one emits a spanning forest of its links. A key with more than ``LARGE``
   is split by further MinHashes (``FINER``): each of its paragraphs gets several finer keys, which
   are treated alike. What is larger than that even then, after 14 equal MinHashes, is compared
   with one representative and in parts of LARGE / 2, so that no task compares all with all.
   That joins most of a large key by few comparisons. ``crowded`` then finds what it has missed:
   the paragraphs of all keys with more than LARGE are joined exactly by the shingles that a
   link needs, whatever their number, as in ``jaccard_join``.
3. Connected components of links are classes. A class in two or more documents is a finding:
   its first place (by doc_id, then position) stays, the others are removals. A place that
   overlaps the first within its document is part of it and left out.

What the later passes emit is filtered by two bitmaps of fixed size (``BITS`` bits) of the
paragraphs wanted; they only save work, joins on the paragraph decide.

Rules for odd input: NULL texts and texts without words have no paragraphs; a paragraph under 5
words is one shingle; a NULL doc_id comes last among places; repeated rows are two documents;
paragraphs that repeat within one document only are no finding; empty tables give no rows; other
columns are not carried. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm import jaccard_join
from kpiloom.llm.common import components, materialise, remove_scratch, row_key

SHINGLE, LENGTH, WINNOW = 5, 20, 11
BANDS, ROWS = 4, 2
SIMILAR = 0.8
LONG, PIECE = 400, 100
BITS = 1 << 26
SMALL = 8  #: different paragraphs of a key that are compared pair by pair
LARGE = 256  #: different paragraphs of a key that one task compares
FINER = ((4, 8), (8, 12))  #: MinHashes of a finer key, and finer keys of a paragraph, by step
_HASHES = BANDS * ROWS + sum(r * k for r, k in FINER)
_M, _K = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Odd multipliers and offsets of the MinHash permutations.
_A = (np.arange(1, _HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_B = np.arange(1, _HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """Numbers words in the order of their first look-up and keeps their hashes."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = at = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return at


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``width`` consecutive entries, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def _anchors(g: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in ``g`` at which paragraphs start. ``g`` holds the shingles of several texts,
    text k in g[starts[k]:ends[k]], with the largest value between texts. A shingle is an anchor
    if it is the least of some window of its text, among the shingles that leave LENGTH words;
    a text with under WINNOW of those is one window."""
    ends = np.maximum(ends - (LENGTH - SHINGLE), starts)
    picked = np.zeros(len(g), bool)
    long = ends - starts >= WINNOW
    if len(g) >= WINNOW and long.any():
        least = _slide(g, WINNOW, np.minimum)
        edge = np.zeros(len(g) + 1, np.int64)  # windows start from a text's start to its end - WINNOW
        np.add.at(edge, starts[long], 1)
        np.add.at(edge, ends[long] - WINNOW + 1, -1)
        least[np.cumsum(edge)[: len(least)] == 0] = 0
        pad = np.zeros(WINNOW - 1, np.uint64)
        picked = (_slide(np.concatenate([pad, least, pad]), WINNOW, np.maximum) == g) & (g > 0)
    for s, e in zip(starts[~long].tolist(), ends[~long].tolist(), strict=True):
        if e > s:
            picked[s + int(np.argmin(g[s:e]))] = True
    at = np.nonzero(picked)[0]
    text = np.searchsorted(starts, at, "right") - 1
    kept, before, seen, owner = [], 0, -1, -1
    for i, (a, h, t) in enumerate(zip(at.tolist(), g[at].tolist(), text.tolist(), strict=True)):
        if h != seen or t != owner or a - before >= WINNOW:  # long repeats of few words have anchors everywhere
            kept.append(i)
            before, seen, owner = a, h, t
    return at[kept]


def _lines(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The words of a text, and (first word, number of words) of its lines and blocks of lines."""
    words, spans, block, blocks, apart = [], [], 0, [], False
    for line in text.lower().split(b"\n"):
        own = line.split()
        if own:
            spans.append((len(words), len(own)))
            words += own
            block += 1
        elif block:
            blocks.append((len(spans) - block, block))
            block, apart = 0, True
    if apart:
        if block:
            blocks.append((len(spans) - block, block))
        spans += [(spans[i][0], spans[i + n - 1][0] + spans[i + n - 1][1] - spans[i][0]) for i, n in blocks if n > 1]
    return words, spans


def _pieces(g: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(first word, number of words) of the pieces of a paragraph of ``n`` words, cut at shingles
    that are the least of the PIECE on either side of them."""
    at = np.nonzero(_slide(g, 2 * PIECE + 1, np.minimum) == g[PIECE:-PIECE])[0] + PIECE
    cuts = [0]
    for a in at.tolist():
        if a - cuts[-1] >= PIECE:
            cuts.append(a)
    return list(zip(cuts, np.diff([*cuts, n]).tolist(), strict=True))


def _paragraphs(texts: list[bytes | None], words: _Words) -> tuple[tuple, tuple]:
    """Paragraphs as (text number, first word, number of words, name, shingles, offsets of each
    one's shingles), and snippets as (text number, first word, name). A name is a hash of all
    the words."""
    if len(words) > 1_000_000:
        words.clear()
        words.hashes.clear()
    split, spans = zip(*(_lines(t) if t else ([], []) for t in texts), strict=True) if texts else ((), ())
    n = np.fromiter(map(len, split), np.int64, len(split))
    numbers = np.fromiter((words[w] for ws in split for w in ws), np.int64, int(n.sum()))
    h = np.array(words.hashes, np.uint64)[numbers]
    starts = np.cumsum(n) - n
    ends = np.maximum(starts + n - SHINGLE + 1, starts)
    m = max(len(h) - SHINGLE + 1, 0)
    g = np.zeros(m, np.uint64)
    for i in range(SHINGLE):
        g = (g + h[i : i + m]) * _M
        g ^= g >> np.uint64(32)
    g = _mix(g)

    units = [(k, at, size) for k, own in enumerate(spans) for at, size in own if size <= LONG]
    for k, own in enumerate(spans):
        for at, size in own:
            if size > LONG:
                first = int(starts[k]) + at
                units += [(k, at + x, y) for x, y in _pieces(g[first : first + size - SHINGLE + 1], size)]
    text, at, size = (np.array(x, np.int64) for x in zip(*units, strict=True)) if units else (np.zeros(0, np.int64),) * 3
    count = np.maximum(size - SHINGLE + 1, 1)
    offsets = np.r_[0, np.cumsum(count)]
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count)
    flat = np.zeros(offsets[-1], np.uint64)
    whole = np.repeat(size >= SHINGLE, count)
    flat[whole] = g[(np.repeat(starts[text] + at, count) + within)[whole]]
    few = np.nonzero(size < SHINGLE)[0]
    acc = size[few].astype(np.uint64)
    for i in range(SHINGLE - 1):
        real = size[few] > i
        acc[real] = _mix((acc[real] + h[(starts[text] + at)[few[real]] + i]) * _M)
    flat[offsets[few]] = acc
    name = _mix(np.add.reduceat(_mix(flat ^ _mix(within.astype(np.uint64) * _K)), offsets[:-1]) * _M) if units else flat
    paragraphs = text, at, size, name, flat, offsets

    inside = np.zeros(m + 1, np.int64)
    real = ends > starts
    np.add.at(inside, starts[real], 1)
    np.add.at(inside, ends[real], -1)
    g[np.cumsum(inside)[:m] == 0] = np.uint64(2**64 - 1)
    at = _anchors(g, starts[real], ends[real])
    name = np.zeros(len(at), np.uint64)
    for i in range(0, LENGTH - SHINGLE + 1, SHINGLE):
        name = _mix((name + g[at + i]) * _M)
    where = np.nonzero(real)[0]
    text = where[np.searchsorted(starts[real], at, "right") - 1] if len(at) else at
    return paragraphs, (text, at - starts[text], name)


def _chunks(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list[bytes | None]]]:
    """(number of the first text, texts) of up to ``most`` bytes, or one longer text."""
    first, held, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py()
        held.append(text)
        size += len(text or b"")
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _least(flat: np.ndarray, offsets: np.ndarray, rows: range) -> np.ndarray:
    """MinHashes of each paragraph's shingles under the permutations ``rows``."""
    least = np.empty((len(offsets) - 1, len(rows)), np.uint64)
    for i, r in enumerate(rows):
        if len(least):
            least[:, i] = np.minimum.reduceat(_mix(flat * _A[r] + _B[r]), offsets[:-1])
    return least


def _keys(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BANDS keys of each paragraph; the low three bits of a key are its band."""
    least = _least(flat, offsets, range(BANDS * ROWS))
    keys = np.empty((len(least), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.zeros(len(least), np.uint64)
        for r in range(ROWS):
            key = _mix((key + least[:, b * ROWS + r]) * _M)
        keys[:, b] = (key & ~np.uint64(7)) | np.uint64(b)
    return keys


def banded(docs: DataFrame) -> DataFrame:
    """(key, name, n): keys of all paragraphs, n equal ones combined."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                (_, _, _, name, flat, offsets), (_, _, snippet) = _paragraphs(texts, words)
                keys = np.concatenate([_keys(flat, offsets).ravel(), (snippet & ~np.uint64(7)) | np.uint64(BANDS)])
                names = np.concatenate([np.repeat(name, BANDS), snippet])
                order = np.lexsort((names, keys))
                keys, names = keys[order], names[order]
                first = np.nonzero(np.r_[True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])])[0] if len(keys) else order
                yield pa.RecordBatch.from_pydict({
                    "key": keys[first].view(np.int64), "name": names[first].view(np.int64),
                    "n": np.diff(np.r_[first, len(keys)]).astype(np.int32),
                })

    return docs.select(F.col("text").cast("binary")).mapInArrow(emit, "key long, name long, n int")


def candidates(docs: DataFrame) -> DataFrame:
    """Three kinds of rows. (NULL, a, NULL): a paragraph that occurs more than once. (NULL, a,
    b): two different paragraphs that share a key with few others. (key, a, NULL): a paragraph
    of a key with more than SMALL different ones."""

    def split(keys: np.ndarray, names: np.ndarray, n: np.ndarray, open_key: int | None = None) -> pa.RecordBatch:
        first = np.nonzero(np.r_[True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])])[0]
        total = np.add.reduceat(n, first)
        keys, names = keys[first], names[first]
        starts = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
        sizes = np.diff(np.r_[starts, len(keys)])
        if keys[0] == open_key:
            sizes[0] += SMALL
        lengths = np.diff(np.r_[starts, len(keys)])
        twice = names[(total > 1) & ((keys & 3) == 0)]
        few = np.repeat((sizes > 1) & (sizes <= SMALL), lengths)
        few_keys, few_names = keys[few], names[few]
        left, right = [], []
        for step in range(1, SMALL):
            if len(few_keys) > step:
                same = few_keys[step:] == few_keys[:-step]
                left.append(few_names[:-step][same])
                right.append(few_names[step:][same])
        none = np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate([none, *left]), np.concatenate([none, *right])], 1), axis=0)
        many = np.repeat(sizes > SMALL, lengths)
        rows = len(twice) + len(pairs) + int(many.sum())
        has_key, has_b = np.zeros(rows, bool), np.zeros(rows, bool)
        has_key[len(twice) + len(pairs) :] = True
        has_b[len(twice) : len(twice) + len(pairs)] = True
        key, b = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        key[has_key], b[has_b] = keys[many], pairs[:, 1]
        a = np.concatenate([twice, pairs[:, 0], names[many]])
        return pa.RecordBatch.from_arrays([pa.array(key, mask=~has_key), pa.array(a), pa.array(b, mask=~has_b)], names=["key", "a", "b"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        open_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.concatenate([o, batch.column(i).to_numpy(zero_copy_only=False)]) for i, o in enumerate(old)]
            whole = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on
            if whole:
                yield split(*(x[:whole] for x in now), open_key)
                now = [x[whole:] for x in now]
            # Of a key with many paragraphs, only the last paragraph is held.
            last = int(np.searchsorted(now[1], now[1][-1]))
            if last and (now[0][0] == open_key or len(np.unique(now[1][:last])) > SMALL):
                open_key = int(now[0][0])
                yield split(*(x[:last] for x in now), open_key)
                now = [now[0][-1:], now[1][-1:], now[2][last:].sum(keepdims=True)]
            old = now
        if len(old[0]):
            yield split(*old, open_key)

    return banded(docs).repartition("key").sortWithinPartitions("key", "name").mapInArrow(groups, "key long, a long, b long")


def _bitmap(names: DataFrame) -> np.ndarray:
    """Bits of the names, at most BITS / 64 rows whatever the number of names."""
    slot = F.pmod("name", F.lit(BITS))
    words = names.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, int(pmod(name, {BITS}L) & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = words.toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return out.view(np.uint64)


def _within(names: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = names % np.uint64(BITS)  # BITS is a power of two, so signed and unsigned slots agree
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def places(docs: DataFrame, wanted: np.ndarray, compared: np.ndarray) -> DataFrame:
    """(doc_id, rk1, rk2, at, n_words, name, shingles) of paragraphs and snippets in the bitmap ``wanted``; shingles
    only for those in ``compared``, at one place a task."""
    spark = docs.sparkSession
    maps = spark.sparkContext.broadcast((wanted, compared))  # two times BITS / 8 bytes
    keyed = docs.select("doc_id", *row_key(), F.col("text").cast("binary").alias("text"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(), np.zeros(0, np.uint64)
        wanted, compared = maps.value
        for batch in batches:
            for start, texts in _chunks(batch.column(3)):
                (text, at, size, name, flat, offsets), (text_s, at_s, name_s) = _paragraphs(texts, words)
                hit, hit_s = _within(name, wanted), _within(name_s, wanted)
                new = np.nonzero(_within(name, compared) & hit)[0]
                new = new[np.unique(name[new], return_index=True)[1]]
                new = new[~np.isin(name[new], seen)]
                seen = np.concatenate([seen, name[new]])  # 8 bytes a compared paragraph of the task
                asked = np.zeros(len(name), bool)
                asked[new] = True
                chosen = flat[np.repeat(asked, np.diff(offsets))].view(np.int64)
                lengths = np.concatenate([np.where(asked, np.diff(offsets), 0)[hit], np.zeros(int(hit_s.sum()), np.int64)])
                none = np.concatenate([~asked[hit], np.ones(int(hit_s.sum()), bool)])
                text, at, name = (np.concatenate(x) for x in ((text[hit], text_s[hit_s]), (at[hit], at_s[hit_s]), (name[hit], name_s[hit_s])))
                size = np.concatenate([size[hit], np.full(int(hit_s.sum()), LENGTH)])
                shingles = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(chosen), mask=pa.array(none))
                take = pa.array(text + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(take) for c in range(3)] + [pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(name.view(np.int64)), shingles],
                    names=["doc_id", "rk1", "rk2", "at", "n_words", "name", "shingles"],
                )

    return keyed.mapInArrow(emit, f"doc_id {id_type}, rk1 long, rk2 long, at int, n_words int, name long, shingles array<long>")


def _similar(names: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the links (Jaccard similarity SIMILAR or more) of one group."""
    uniques = [np.unique(s) for s in sets]
    sizes = np.array([len(u) for u in uniques])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(uniques)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, own in enumerate(uniques):
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        shared = np.bincount(np.concatenate([owner[a:b] for a, b in zip(lo, hi, strict=True)]), minlength=len(sets))
        near = np.nonzero(shared >= SIMILAR * (sizes + sizes[i] - shared))[0]
        for j in near[near > i].tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[b] = a
                out.append((names[i], names[j]))
    return out


def _finer(groups: DataFrame, contents: DataFrame, step: int) -> DataFrame:
    """(key, name): the finer keys of a step for every paragraph of ``groups`` (key, name)."""
    rows, many = FINER[step]
    first = BANDS * ROWS + sum(r * k for r, k in FINER[:step])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = batch.column(2)
            offsets = sets.offsets.to_numpy().astype(np.int64)
            flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            least = _least(flat, offsets - offsets[0], range(first, first + rows * many))
            old = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = np.empty((len(old), many), np.uint64)
            for k in range(many):
                key = _mix((old + np.uint64(k + 1)) * _K)
                for r in range(rows):
                    key = _mix((key + least[:, k * rows + r]) * _M)
                keys[:, k] = key
            names = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), many)
            yield pa.RecordBatch.from_pydict({"key": keys.ravel().view(np.int64), "name": names})

    return groups.join(contents, "name").select("key", "name", "shingles").mapInArrow(emit, "key long, name long")


def spread(pairs: DataFrame, groups: DataFrame, contents: DataFrame, made: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``pairs`` and ``groups`` with the groups of more than LARGE paragraphs split. A split may
    part paragraphs that link; ``crowded`` joins these."""
    out = None
    for step in range(len(FINER) + 1):
        sizes = groups.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sized = materialise(groups.join(sizes, "key"), "substring-sized", made)
        ready, large = sized.where(F.col("n") <= LARGE).select("key", "name"), sized.where(F.col("n") > LARGE)
        out = ready if out is None else out.union(ready)
        if large.isEmpty():
            return pairs, out
        if step < len(FINER):
            groups = _finer(large.select("key", "name"), contents, step)
    part = F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / (LARGE // 2)))
    parts = large.select(F.xxhash64("key", part).alias("key"), "name")
    chosen = large.groupBy("key").agg(F.min("name").alias("a"))
    shared = large.select("key", F.col("name").alias("b")).join(chosen, "key").where("a <> b").select("a", "b")
    return pairs.union(shared).distinct(), out.union(parts)


def links(pairs: DataFrame, groups: DataFrame, contents: DataFrame) -> DataFrame:
    """Verified links (a, b) between different paragraphs that share a key: all of ``pairs``
    (a, b), and a spanning forest for each of ``groups`` (key, name)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, sets = None, [], []

        def close() -> pa.RecordBatch:
            found = _similar(names, sets) if len(names) > 1 else []
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

        for batch in batches:
            for k, n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if k != key and names:
                    yield close()
                    names, sets = [], []
                key = k
                names.append(n)
                sets.append(s.values.to_numpy(zero_copy_only=False))
        if names:
            yield close()

    large = groups.join(contents, "name").select("key", "name", "shingles")
    large = large.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")
    left = contents.select(F.col("name").alias("a"), F.col("shingles").alias("_a"))
    right = contents.select(F.col("name").alias("b"), F.col("shingles").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    small = pairs.join(left, "a").join(right, "b").where(shared >= SIMILAR * F.size(F.array_union("_a", "_b")))
    return large.union(small.select("a", "b")).distinct()


def crowded(stars: DataFrame, groups: DataFrame, contents: DataFrame, made: list[str] | None = None) -> DataFrame:
    """``stars`` (node, root) with every link between paragraphs of the ``groups`` of more than
    LARGE: an exact join of their sets of shingles. Two that link share one of their first
    n - ceil(SIMILAR * n) + 1 shingles, rarest first."""
    large = groups.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("key")
    names = groups.join(large, "key", "left_semi").select("name").distinct()
    sets = materialise(
        contents.join(names, "name").select(F.col("name").alias("node"), F.array_distinct("shingles").alias("shingles")), "substring-crowded", made
    )
    if sets.isEmpty():
        return stars
    percent = round(100 * SIMILAR)
    tokens = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "token")))
    need = F.expr(f"n - ({percent} * n + 99) DIV 100 + 1").cast("int")
    members = tokens.join(counts, "token", "left").groupBy("node", "n").agg(order.alias("t")).select("node", "n", F.inline(F.slice("t", 1, need)))
    members = materialise(members.where("c > 1").select("token", "node", "n"), "substring-members", made)

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([jaccard_join._point(x) for x in sets], pa.binary())], names=["node", "counts"])

    points = sets.mapInArrow(point, "node long, counts binary")
    return jaccard_join.joined(members, points, lambda pairs: sets, percent, stars, (), made=made)


def duplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, rk1, rk2, at, n_words, class_id, n_docs, removed): every place of a paragraph
    whose class occurs in several documents. ``at`` counts words from 0."""
    docs = docs.select("doc_id", "text")
    made: list[str] = []  # tables that nothing needs once the classes are written
    found = materialise(candidates(docs), "substring-candidates", made)
    pairs = found.where("b is not null").select("a", "b").distinct()
    groups = found.where("key is not null").select("key", F.col("a").alias("name"))
    names = F.col("name").isNotNull()
    every = found.select(F.explode(F.array("a", "b")).alias("name")).where(names)
    asked = materialise(
        groups.select("name").union(pairs.select(F.explode(F.array("a", "b")).alias("name"))).distinct(), "substring-compared", made
    )
    wanted, compared = _bitmap(every), _bitmap(asked)
    spots = materialise(places(docs, wanted, compared), "substring-places", made)
    # One row per paragraph, written once. An inner join, as a semi-join would be pushed below the aggregate.
    shingles = spots.where("shingles is not null").groupBy("name").agg(F.first("shingles").alias("shingles"))
    contents = materialise(shingles.join(asked, "name"), "substring-contents", made)
    stars = components(links(*spread(pairs, groups, contents, made), contents), "substring-links", made=made)
    stars = crowded(stars, groups, contents, made).withColumnRenamed("node", "name")
    classed = materialise(
        spots.drop("shingles").join(stars, "name", "left").withColumn("class_id", F.coalesce("root", "name")).drop("root", "name"),
        "substring-classes",
    )
    remove_scratch(docs.sparkSession, made)
    # Repeated rows are two documents with one key; of a document's places of a class the first counts.
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rk1", "rk2", "at", "n_words")
    per_class = classed.groupBy("class_id").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    own = classed.groupBy("class_id", "rk1", "rk2").agg(F.count("*").alias("_c"), F.countDistinct("at", "n_words").alias("_d"))
    counts = own.groupBy("class_id").agg(F.sum(F.expr("_c div _d")).alias("n_docs")).where("n_docs > 1")
    # Written, so that the last join has plain shuffled sides and Spark can split a hot class.
    known = materialise(per_class.join(counts, "class_id"), "substring-known")
    apart = (place == F.col("_first")) | (F.col("rk1") != F.col("_first.rk1")) | (F.col("rk2") != F.col("_first.rk2")) | (F.col("at") >= F.col("_first.at") + F.col("_first.n_words"))
    return classed.join(known, "class_id").where(apart).select(
        "doc_id", "rk1", "rk2", "at", "n_words", "class_id", "n_docs",
        (place != F.col("_first")).alias("removed"),
    )


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` with the removals cut out of ``text`` (a copy of a whole row keeps its first)."""
    cuts = duplicated(docs).where("removed").groupBy("rk1", "rk2").agg(F.sort_array(F.collect_set(F.struct("at", "n_words"))).alias("_cuts"))

    @F.pandas_udf("string")
    def cut(texts, starts, sizes):  # noqa: ANN001, ANN202
        import re

        import pandas as pd

        out = []
        for text, ats, ns in zip(texts, starts, sizes, strict=True):
            if ats is None or not len(ats):
                out.append(text)
                continue
            spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            parts, at = [], 0
            for s, n in zip(ats, ns, strict=True):
                lo, hi = spans[s][0], spans[min(s + n, len(spans)) - 1][1]
                if lo > at:
                    parts.append(text[at:lo])
                at = max(at, hi)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    rows = docs.select(F.struct("*").alias("_row"), *row_key()).join(cuts, ["rk1", "rk2"], "left")
    new = F.when(F.col("_cuts").isNotNull(), cut(F.col("_row.text"), F.col("_cuts.at"), F.col("_cuts.n_words"))).otherwise(F.col("_row.text"))
    return rows.select(*[(new if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
