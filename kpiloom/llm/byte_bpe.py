"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Pre-tokens ("words" here) repeat, so each is encoded once and its ids are joined back:

1. texts are cut into pre-tokens; positions are kept as the order of indexes into the block's
   own word list, a block being up to ``BLOCK`` pre-tokens of consecutive rows. One row per
   block is written, bucketed by block, so the positions are never shuffled;
2. the blocks' word lists, dealt into parts by a hash of the word, meet in a shuffle on the
   part: all copies of a word come together and it is encoded once;
3. the ids go back in a shuffle on the block, and each block is reassembled by position
   (``cogroup``; one group holds one block, whose size is bounded).

A literal explode of every pre-token would shuffle some 30 bytes for about 5 bytes of text,
three times; combined by block a word travels once a block. Decoding joins ids with the
token-byte table (all tokens' bytes, an id's start and length), which has a fixed size and is
shipped with the function; the join is by array index.

A block's numbers are held as 32-bit arrays and replaced in pieces, in cutting as in
reassembly, so that a Python worker holds little beside its block, and keeps little after it.

Rules for odd input: NULL and empty texts have no ids and decode to nothing; repeated rows keep
their rows; an empty table gives no rows; columns other than the id and the text are not
carried. A text of any length is one row of one block; a word of any length is encoded by a
heap in n log n. Special tokens do not exist: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from kpiloom.llm.common import scratch_path

BLOCK = 2_000_000  #: white-space pieces after which a block is closed (always after a whole text)
#: White space as the pattern means it (Unicode's property), for cutting texts into pieces: an
#: optional space and what follows it, or white space. No pre-token spans two pieces, so the
#: full pattern runs once for each distinct piece of a block.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class _Index(dict):
    """Numbers keys in the order of their first look-up."""

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        return at


def pack(numbers: np.ndarray) -> bytes:
    """Compressed non-negative integers below 2**31, bytes of equal weight together."""
    planes = np.ascontiguousarray(numbers, np.int32).view(np.uint8).reshape(-1, 4).T
    deflate = zlib.compressobj(1)
    return b"".join([*(deflate.compress(plane.tobytes()) for plane in planes), deflate.flush()])


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 token and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is merged, leftmost first, until
    none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) <= 100:
        none = 1 << 60
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            merged = parts[at] + parts[at + 1]
            parts[at : at + 2] = [merged]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(merged + parts[at + 1], none)
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + merged, none)
        return [ranks[p] for p in parts]
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been merged meanwhile
        alive[j], end[i], after[i] = 0, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the spans, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _replaced(
    flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, source: np.ndarray, ends: np.ndarray, chunk: int = 1 << 16
) -> tuple[np.ndarray, np.ndarray]:
    """Every number i of ``flat`` replaced by the ``counts[i]`` elements of ``source`` from
    ``starts[i]``, and where the (ascending) ``ends`` of stretches of ``flat`` are then. In
    pieces of ``chunk`` numbers, so that the index arrays stay small beside a block."""
    out, at, moved = [], 0, np.zeros(len(ends), np.int64)
    for lo in range(0, len(flat), chunk):
        own = flat[lo : lo + chunk]
        many = counts[own]
        upto = np.cumsum(many, dtype=np.int64)
        i, j = np.searchsorted(ends, [lo + 1, lo + len(own) + 1])
        moved[i:j] = at + upto[ends[i:j] - lo - 1]
        out.append(source[_spans(starts[own], many)])
        at += int(upto[-1])
    return (np.concatenate(out) if out else source[:0]), moved


def blocks(docs: DataFrame, pattern: str, parts: int, id_col: str, text: str, size: int = BLOCK) -> DataFrame:
    """One row per block: its ids, pre-tokens a text, word numbers in order, and the words by
    part with their (ascending) numbers. Frequent words have small numbers."""
    id_type = docs.schema[id_col].dataType
    schema = StructType([
        StructField("block", StringType()),
        StructField("ids", ArrayType(id_type)),
        StructField("lens", BinaryType()),
        StructField("flat", BinaryType()),
        StructField("parts", ArrayType(StructType([
            StructField("part", IntegerType()), StructField("at", BinaryType()), StructField("words", BinaryType()),
        ]))),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark.sql.pandas.types import to_arrow_schema

        find, cut_pieces, arrow = regex.compile(pattern).findall, _PIECE.findall, to_arrow_schema(schema)
        ids: list = []
        flat, ends, pieces = array("i"), array("q"), _Index()  # pieces of all texts, where each text ends

        def close() -> pa.RecordBatch:
            words = _Index()
            inner, many = array("i"), array("i")
            for piece in pieces:
                found = find(piece)
                inner.extend(map(words.__getitem__, found))
                many.append(len(found))
            pieces.clear()
            many = np.frombuffer(many, np.int32) if many else np.zeros(0, np.int32)
            inner = np.frombuffer(inner, np.int32) if inner else np.zeros(0, np.int32)
            old = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)
            numbers, upto = _replaced(old, np.cumsum(many, dtype=np.int64) - many, many, inner, np.frombuffer(ends, np.int64))
            chunk = 1 << 16
            often = np.zeros(len(words), np.int64)
            for lo in range(0, len(numbers), chunk):
                which, times = np.unique(numbers[lo : lo + chunk], return_counts=True)
                often[which] += times
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            for lo in range(0, len(numbers), chunk):
                numbers[lo : lo + chunk] = rank[numbers[lo : lo + chunk]]
            spelled = list(words)
            by_part: dict[int, list[int]] = {}
            for new, at in enumerate(order.tolist()):
                by_part.setdefault(zlib.crc32(spelled[at].encode()) % parts, []).append(new)
            row = {
                "block": uuid.uuid4().hex,
                "ids": ids,
                "lens": pack(np.diff(upto, prepend=0)),
                "flat": pack(numbers),
                "parts": [
                    {
                        "part": p,
                        "at": pack(np.diff(ats, prepend=0)),
                        "words": zlib.compress(json.dumps([spelled[order[n]] for n in ats], ensure_ascii=False).encode(), 1),
                    }
                    for p, ats in by_part.items()
                ],
            }
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in arrow], names=arrow.names)

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(key)
                flat.extend(map(pieces.__getitem__, cut_pieces(value.as_py() or "")))
                ends.append(len(flat))
                if len(flat) >= size:
                    closed = close()
                    ids, flat, ends, pieces = [], array("i"), array("q"), _Index()
                    yield closed
        if ids:
            yield close()

    return docs.select(id_col, text).mapInArrow(cut, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """(id_col, ids: ARRAY<INT>) for every row of ``docs``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"llm_bpe_{uuid.uuid4().hex}", scratch_path(spark, "bpe")
    (
        blocks(docs, pattern, parts, id_col, text, size)
        .write.bucketBy(parts, "block").format("parquet").option("path", path).option("compression", "zstd").saveAsTable(table)
    )
    cut = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the files belong to the folder, and the plan is resolved

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            for block, at, packed in zip(*(batch.column(i) for i in range(3)), strict=True):
                lengths, flat = [], []
                for w in json.loads(zlib.decompress(packed.as_py())):
                    own = known.get(w)
                    if own is None:
                        own = known[w] = encode_word(w.encode(), ranks)
                    lengths.append(len(own))
                    flat += own
                yield pa.RecordBatch.from_pydict({
                    "block": [block.as_py()], "at": [at.as_py()], "lens": [pack(np.array(lengths))], "ids": [pack(np.array(flat))],
                })

    words = cut.select("block", F.explode("parts").alias("p")).select("block", "p.at", "p.words", "p.part")
    known = (
        words.repartitionById(parts, "part").select("block", "at", "words")
        .mapInArrow(encode_parts, "block string, at binary, lens binary, ids binary")
    )
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("ids", ArrayType(IntegerType()))])

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        one = lambda name: unpack(left.column(name)[0].as_py())
        every = lambda name, f: np.concatenate([f(unpack(x.as_py())) for x in right.column(name)] or [np.zeros(0, np.int32)])
        same = lambda x: x
        keys, lens, flat = left.column("ids").combine_chunks().flatten(), one("lens"), one("flat")
        at, count, ids = every("at", np.cumsum), every("lens", same), every("ids", same)
        starts, counts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        starts[at], counts[at] = np.cumsum(count, dtype=np.int64) - count, count
        values, upto = _replaced(flat, starts, counts, ids, np.cumsum(lens, dtype=np.int64))
        upto = np.r_[0, upto].astype(np.int32)
        return pa.table({id_col: keys, "ids": pa.ListArray.from_arrays(pa.array(upto), pa.array(values))})

    return (
        cut.select("block", "ids", "lens", "flat").groupBy("block")
        .cogroup(known.groupBy("block")).applyInArrow(reassemble, schema)
    )


def token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes in order of their ids, and every id's start and
    length there; -1 is the length of an id without a token."""
    starts = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    lengths, at, spelled = np.full(len(starts), -1, np.int64), 0, []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        starts[rank], lengths[rank] = at, len(token)
        spelled.append(token)
        at += len(token)
    return np.frombuffer(b"".join(spelled), np.uint8), starts, lengths


def spell(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray], chunk: int = 1 << 20) -> bytes:
    """The bytes of ``ids``, joined with the token-byte table in pieces of ``chunk`` ids, so
    that the index arrays of a very long text stay small. Unknown ids are an error."""
    data, starts, lengths = table
    if len(ids) and (ids.min() < 0 or ids.max() >= len(lengths) or lengths[ids].min() < 0):
        raise ValueError("ids without a token")
    parts = (ids[at : at + chunk] for at in range(0, len(ids), chunk))
    return b"".join(data[_spans(starts[own], lengths[own])].tobytes() for own in parts)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``encoded`` plus ``column`` (BINARY): the bytes of its ids; NULL ids decode to NULL.
    Unknown ids are an error."""
    table = token_table(ranks)
    schema = StructType([*encoded.schema.fields, StructField(column, BinaryType())])
    place = encoded.columns.index(ids)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [
                    spell(x.values.to_numpy(zero_copy_only=False), table) if x.is_valid else None for x in part.column(place)
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*part.schema.names, column])

    return encoded.mapInArrow(join, schema)
