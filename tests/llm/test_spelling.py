"""Spelling variants against brute force, over several passes, and odd rows. The query itself is
held against its SQL in test_operators."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from kpiloom.llm import bloom, spelling

ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def edits(w):
    cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
    new = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in ALPHABET}
    more = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in ALPHABET}
    return (cut | new | more) - {w}


def expected(counts, min_length, ratio):
    out = {}
    for w, n in counts.items():
        near = [v for v in edits(w) if v in counts and len(v) >= min_length]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (n, len(near), best if best and counts[best] >= ratio * n else None)
    rows = {}
    for w, (n, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows[w] = (n, k, form, counts[form] if form else None, root)
    return rows


def words_of(spark, counts, parts=5):
    rows = [(w, n, len(w)) for w, n in counts.items()]
    return spark.createDataFrame(rows, "word string, n long, length int").repartition(parts)


def as_dict(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.fixture(scope="module")
def counts():
    rnd = random.Random(4)
    out = {}
    for _ in range(150):
        base = "".join(rnd.choice("abcéÿz") for _ in range(rnd.randint(4, 9)))
        out[base] = rnd.choice([3000, 4000, 4000])
        for _ in range(4):
            w = rnd.choice(sorted(edits(base)))
            if len(w) >= 4:
                out.setdefault(w, rnd.choice([2, 40, 300, 300]))
    return out | {"bbbbbbbbb": 90_000, "bbbbbbbb": 4500, "bbbbbbba": 200, "bbbbbaba": 3}


@pytest.mark.parametrize("blocks", [1 << 20, 20])
def test_groups_against_brute_force(spark, counts, blocks):
    got = as_dict(spelling.group(words_of(spark, counts), 4, 10, blocks))
    assert got == expected(counts, 4, 10)
    assert any(v[2] and got[v[2]][2] for v in got.values())  # chains of forms are there


def test_passes_cover_every_block_once():
    sizes = {7: 5000, 8: 1, 9: 100_000, 40: 3}
    for most in (64, 1000, 1 << 20):
        seen = collections.Counter()
        for shards in spelling.passes(sizes, most):
            assert 0 < shards.size <= most
            for length, (blocks, lo, hi, _) in shards.of.items():
                seen.update((length, b) for b in range(lo, hi))
                assert blocks >= sizes[length] / 16
        assert set(seen.values()) == {1} and len(seen) == sum(max(16, -(-n // 16)) for n in sizes.values())


def test_filter_misses_no_word_and_few_others(spark):
    rnd = random.Random(1)
    make = lambda: "".join(rnd.choice("abcdefghij") for _ in range(9))
    words = {make() for _ in range(4000)}
    (shards,) = spelling.passes({9: len(words)})
    blocks = spelling._filter(words_of(spark, dict.fromkeys(words, 2)), shards)

    def held(sample):
        m = np.array([list(w.encode()) for w in sample], np.uint8)
        z = bloom.mixed((spelling._LETTER[m] * spelling._values(9, 0)).sum(1, dtype=np.uint64))
        index, at = shards.places(9, z)
        return len(bloom.held(blocks, at, z[index])) / len(sample)

    assert held(sorted(words)) == 1
    assert held([w for w in (make() for _ in range(20_000)) if w not in words]) < 0.01


def test_runs_and_deletions(spark):
    texts = [
        (1, "Spelling SPELLING spelling, spélling×x short spelling_spelling"), (2, None), (3, ""), (None, "spelling wörterbücher"),
        (1, "Spelling SPELLING spelling, spélling×x short spelling_spelling"), (4, "a" * 30_000 + " " + "a" * 30_000 + " ÀÉÎÕÜÝþÿ àéîõüýþÿ"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n")
    want = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            run = run[:at] + run[at + 1 :] if h % 3 == 0 else run
            if len(run) >= 7:
                want[run] += 1
    got = {r.word: r.n for r in spelling.vocabulary(docs, 7, 1, 3).collect()}
    assert got == dict(want)
    plain = {r.word: r.n for r in spelling.vocabulary(docs, 7, 2).collect()}
    assert plain["spelling"] == 11 and plain["a" * 30_000] == 2 and "àéîõüýþÿ" not in plain


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).collect() == []


def test_ties_take_the_smallest_text(spark):
    counts = {"spelling": 2, "spellinx": 50, "spellinb": 50, "zspelling": 50, "lonelyword": 9}
    got = as_dict(spelling.group(words_of(spark, counts), 7, 10))
    assert got["spelling"] == (2, 3, "spellinb", 50, "spellinb") and got["lonelyword"] == (9, 0, None, None, "lonelyword")
    assert got["spellinx"][:3] == (50, 2, None)
