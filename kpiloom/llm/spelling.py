"""Spelling variant grouping by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced code point makes one the other. Instead
of comparing words, every word *generates* its edits and probes them against Bloom filters of
the vocabulary; only the positives are shuffled, to an exact join with the vocabulary that
removes the false ones.

* **Each pair once.** A word generates its deletions (one per run of equal letters) and the
  replacements by a larger letter. A pair that differs by an insertion is found from its longer
  word, one that differs by a replacement from its smaller word.
* **No strings for misses.** A word's hash is the sum over positions of letter value x position
  value modulo 2**64, so the hash of an edit follows from prefix sums. Edits are built as text
  only when the filter says yes.
* **Blocked filters, sharded by length** (``bloom``). A length's shard has ``ceil(words / 16)``
  blocks of 256 bits. Deletions probe the shard of length - 1, replacements their own.
* **Bounded broadcast.** A pass broadcasts at most ``PASS_BLOCKS`` blocks (32 MB). A larger
  vocabulary takes several passes, each over a range of blocks and over those words only whose
  edits can fall there, so the result is the same at every size.

Words are counted in each task first, so a word that fills a third of the corpus reaches the
shuffle once per ``MOST_HELD`` distinct words of a task. A word has at most some (2 * length + 1)
x 90 near words, so no key of a join grows with the data.

``root`` follows forms to the last by pointer doubling over written tables; a form is at least
``ratio`` times as frequent as its word, so chains are short and free of cycles (for ratio > 1).

Rules for odd input: NULL texts have no words; a NULL id counts as the empty text where words
are deleted from (``delete_every``); repeated rows count again; a run of any length is one word;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm import bloom
from kpiloom.llm.common import materialise

#: Letters of a run after A-Z are lower-cased, as code points: a-z and U+00C0 to U+00FF.
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
#: Words of the vocabulary a block of 256 bits holds on average (16 bits a word).
WORDS_A_BLOCK = 16
#: Blocks of 32 bytes that one pass broadcasts.
PASS_BLOCKS = 1 << 20
#: Distinct words a task holds before it passes their counts on.
MOST_HELD = 400_000
_EDITS_AT_ONCE = 1 << 21


def run_counts(docs: DataFrame, min_length: int, delete_every: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): occurrences per task of maximal letter runs, A-Z lower-cased.

    With ``delete_every``, where it divides the crc32 of ``<id>:<run>``, the run loses its code
    point crc32 % length (planted misspellings). Results under ``min_length`` are left out.
    """
    pattern = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")  # shorter runs can't give longer words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = raw.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{key}:".encode()) if delete_every else 0
                for word, n in Counter(pattern.findall(text.lower().decode("utf-8", "replace"))).items():
                    if delete_every:
                        h = zlib.crc32(word.encode(), start)
                        if h % delete_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= MOST_HELD:
                    yield passed()
        yield passed()

    # bytes.lower() lowers A-Z only.
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("binary"))
    return texts.mapInArrow(count, "word string, n long")


def vocabulary(docs: DataFrame, min_length: int, min_count: int, delete_every: int | None = None) -> DataFrame:
    """(word, n, length) of words that occur ``min_count`` times or more."""
    counts = run_counts(docs, min_length, delete_every).groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count).withColumn("length", F.length("word"))


# Letter and position values come from a mixing rule, so driver and tasks agree.

def _values(n: int, seed: int) -> np.ndarray:
    golden = np.uint64(0x9E3779B97F4A7C15)
    return bloom.mixed((np.arange(n, dtype=np.uint64) + np.uint64(seed)) * golden + golden) | np.uint64(1)


_LETTER = _values(256, 1 << 40)


class Shards:
    """Ranges of blocks of one pass: ``{length: (blocks of the shard, from, to, place in the pass)}``."""

    def __init__(self) -> None:
        self.of: dict[int, tuple[int, int, int, int]] = {}
        self.size = 0

    def add(self, length: int, blocks: int, lo: int, hi: int) -> None:
        self.of[length] = (blocks, lo, hi, self.size)
        self.size += hi - lo

    def places(self, length: int, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the keys that fall into this pass, their place)."""
        blocks, lo, hi, start = self.of[length]
        at = bloom.block_of(z, blocks)
        inside = np.nonzero((at >= lo) & (at < hi))[0] if (lo, hi) != (0, blocks) else np.arange(len(z))
        return inside, at[inside] - lo + start


def passes(sizes: dict[int, int], most: int = PASS_BLOCKS) -> list[Shards]:
    """Shards of all lengths dealt to passes of at most ``most`` blocks."""
    out = [Shards()]
    for length, words in sorted(sizes.items()):
        blocks, lo = max(16, -(-words // WORDS_A_BLOCK)), 0
        while lo < blocks:
            if out[-1].size >= most:
                out.append(Shards())
            hi = min(blocks, lo + most - out[-1].size)
            out[-1].add(length, blocks, lo, hi)
            lo = hi
    return out if out[-1].size else []


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their letters as a matrix) for a batch whose first column is ``word``."""
    words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        rows = np.nonzero(lengths == length)[0]
        step = max(1, _EDITS_AT_ONCE // (length * 4))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield length, part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), length)


def _filter(words: DataFrame, shards: Shards) -> np.ndarray:
    """The pass's blocks."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place, z = [], []
            for length, _, letters in _by_length(batch):
                key = bloom.mixed((_LETTER[letters] * _values(length, 0)).sum(1, dtype=np.uint64))
                inside, at = shards.places(length, key)
                place.append(at)
                z.append(key[inside])
            yield pa.RecordBatch.from_pydict(bloom.rows(np.concatenate(place), np.concatenate(z)))

    chosen = words.where(F.col("length").isin(*shards.of)).select("word")
    return bloom.collect(chosen.mapInArrow(keys, bloom.SCHEMA), shards.size)


def _positives(words: DataFrame, shards: Shards, blocks: np.ndarray, alphabet: list[int], min_length: int) -> DataFrame:
    """(near, word, n): edits that the pass's filter holds."""
    shared = words.sparkSession.sparkContext.broadcast(blocks)
    letters_up = np.array(sorted(alphabet), np.uint8)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value

        def held(length: int, h: np.ndarray) -> np.ndarray:
            z = bloom.mixed(h)
            inside, at = shards.places(length, z)
            return inside[bloom.held(blocks, at, z[inside])]

        for batch in batches:
            if not batch.num_rows:
                continue
            words, counts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            near, row = [], []
            for length, rows, m in _by_length(batch):
                terms = _LETTER[m] * _values(length, 0)
                total = terms.sum(1, dtype=np.uint64)
                if length in shards.of:
                    position = _values(length, 0)
                    for i in range(length):
                        who, letter = np.nonzero(letters_up > m[:, i : i + 1])
                        h = total[who] - terms[who, i] + _LETTER[letters_up[letter]] * position[i]
                        for k in held(length, h).tolist():
                            w = words[int(rows[who[k]])].as_py()
                            near.append(w[:i] + chr(letters_up[letter[k]]) + w[i + 1 :])
                            row.append(rows[who[k]])
                if length - 1 >= min_length and length - 1 in shards.of:
                    moved = _LETTER[m[:, 1:]] * _values(length - 1, 0)
                    before = np.zeros(len(m), np.uint64)
                    after = moved.sum(1, dtype=np.uint64)
                    for i in range(length):
                        who = np.nonzero(m[:, i] != m[:, i - 1])[0] if i else np.arange(len(m))
                        for k in held(length - 1, before[who] + after[who]).tolist():
                            w = words[int(rows[who[k]])].as_py()
                            near.append(w[:i] + w[i + 1 :])
                            row.append(rows[who[k]])
                        before = before + terms[:, i]
                        if i < length - 1:
                            after = after - moved[:, i]
            at = pa.array(np.array(row, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(near, pa.string()), words.take(at), pa.array(counts[np.array(row, np.int64)], pa.int64())], names=["near", "word", "n"]
            )

    reach = sorted({*shards.of, *(length + 1 for length in shards.of)})
    chosen = words.where(F.col("length").isin(*reach)).select("word", "n")
    # Few bytes, much work: a fixed number of tasks, as the bytes alone would be gathered in a few.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chosen.repartition(tasks, "word").mapInArrow(probe, "near string, word string, n long")


def near_pairs(words: DataFrame, min_length: int, most_blocks: int = PASS_BLOCKS) -> DataFrame:
    """(word, n, near, near_n): every pair of near words of ``words`` (word, n, length), both
    ways round. ``words`` should be written; it is read once per pass and once for the join."""
    sizes = {r.length: r["count"] for r in words.groupBy("length").count().collect()}
    alphabet = [ord(r[0]) for r in words.select(F.explode(F.split("word", ""))).distinct().collect()]  # at most 90
    parts = [
        _positives(words, shards, _filter(words, shards), alphabet, min_length) for shards in passes(sizes, most_blocks)
    ]
    if not parts:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    exact = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    once = materialise(found.join(exact, "near").select("word", "n", "near", "near_n"), "spelling-pairs")
    return once.union(once.select("near", "near_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each word's last form, by pointer doubling."""
    links = materialise(forms.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(ahead, "root").isEmpty():
            return links
        jumped = links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        links = materialise(jumped, "spelling-links")


def group(words: DataFrame, min_length: int = 7, ratio: int = 10, most_blocks: int = PASS_BLOCKS) -> DataFrame:
    """``words`` (word, n, length; written) with its form and root: (word, n, n_near, form,
    form_n, root)."""
    pairs = near_pairs(words, min_length, most_blocks)
    # min() of (-count, text): the largest count, ties to the smallest text in code-point order.
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("c"), "near")).alias("best"))
    joined = words.select("word", "n").join(best, "word", "left")
    led = -F.col("best.c") >= ratio * F.col("n")
    formed = materialise(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.c")).alias("form_n"),
        ),
        "spelling-forms",
    )
    last = roots(formed.where("form IS NOT NULL"))
    return formed.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, delete_every: int | None = None) -> DataFrame:
    """Spelling groups of the words of ``docs``: one row per word."""
    return group(materialise(vocabulary(docs, min_length, min_count, delete_every), "spelling-words"), min_length, ratio)


def oracle(min_length: int = 7, min_count: int = 2, ratio: int = 10, delete_every: int = 31) -> str:
    """DuckDB SQL of ``variants``: pairs meet on the text without one code point."""
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), found AS (
  SELECT id, unnest(regexp_extract_all(text, '[a-zÀ-ÿ]{{{min_length},}}')) AS run FROM runs
), counted AS (
  SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS bytes FROM found GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, len(bytes), 2), lambda i: ('0x' || substr(bytes, i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc
), typed AS (
  SELECT CASE WHEN h % {delete_every} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= {min_length} GROUP BY word HAVING sum(n) >= {min_count}
), cut AS (
  SELECT word, n, i, left(word, i::INT) || substr(word, (i + 2)::INT) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT DISTINCT c.word, c.n, w.word AS near, w.n AS near_n FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT DISTINCT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT DISTINCT a.word, a.n, b.word, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {ratio} * w.n THEN near END AS form,
    CASE WHEN near_n >= {ratio} * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), followed AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT f.word, f.next, g.form FROM followed f JOIN formed g ON g.word = f.next
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN followed r ON r.word = f.word AND r.next IS NULL
"""
