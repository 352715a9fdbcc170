"""The n-gram Jaccard join against all pairs, its R-tree against the bound, and odd rows. The
query itself is held against its SQL in test_operators."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiloom.llm import jaccard_join as jj


def shingles_of(text, k=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def expected(rows, k=4, percent=85):
    """(id, size, component) per row, from all pairs."""
    sets = [shingles_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(i)] = min(key, ids.get(find(i), key))
    return sorted(((key, len(s), ids.get(find(i))) for i, ((key, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted(map(tuple, jj.near_duplicates(docs, **kw).collect()), key=repr)


def corpus(seed, n):
    """Clusters of edited copies around the threshold, a passage in many texts, some short texts."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 3000)}"
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(n):
        base = [word() for _ in range(rnd.choice([1, 3, 4, 9, 60, 60, 200]))]
        if rnd.random() < 0.3:
            base += passage
        out.append(base)
        for _ in range(rnd.choice([0, 0, 0, 1, 6])):
            copy = list(rnd.choice(out[-3:]))
            for _ in range(rnd.randint(0, max(1, len(copy) // 40))):
                copy[rnd.randrange(len(copy))] = word()
            out.append(copy)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("percent, size", [(85, 4), (60, 2)])
def test_components_against_all_pairs(spark, percent, size):
    rows = corpus(7, 130)
    got = found(spark, rows, shingle=size, percent=percent)
    want = expected(rows, size, percent)
    assert got == want and len({r[2] for r in want}) < len(want)


def test_every_component_from_trees_alone(spark, monkeypatch):
    """Without proposals, with cells of three sets and salted buckets, the trees find all links."""
    monkeypatch.setattr(jj, "HOT", 2)
    monkeypatch.setattr(jj, "proposals", lambda members, percent, seeds: members.selectExpr("node AS a", "node AS b").limit(0))
    rows = corpus(3, 60)
    assert found(spark, rows, cell=3) == expected(rows)


def test_large_cluster_is_joined_by_proposals(spark):
    """Near copies of one text: the pairs compared stay near the number of sets."""
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(3):
            copy[rnd.randrange(300)] = f"x{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = jj.keys(docs, 4)
    buckets = jj.shared_buckets(jj.prefix_rows(docs, jj.slot_counts(named), 4, 85), 85)
    nodes = jj.classes(named)
    members = buckets.join(nodes.select("k1", "node"), "k1").select("token", "node", "n", F.col("node").alias("root"))
    pairs = jj.proposals(members, 85, (1,))
    assert nodes.count() == 400 and 300 <= pairs.count() <= 400 and jj.proposals(members, 85, (1, 2, 3)).count() <= 1200
    assert jj.verified(pairs, jj.fetched(docs, nodes, 4), 85).count() >= 300
    assert {r.component_id for r in jj.near_duplicates(docs).collect()} == {0}


def test_linked_pairs_share_enough_buckets(spark):
    """No linked pair falls below the least number of shared prefix shingles."""
    rows = corpus(11, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = collections.defaultdict(set)
    for r in jj.prefix_rows(docs, jj.slot_counts(jj.keys(docs, 4)), 4, 85).collect():
        buckets[r.k1].add(r.token)
    sets = {jj._name(own)[0]: set(own.tolist()) for _, t in rows if len(own := jj.shingles(t.encode(), 4))}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    need = spark.createDataFrame([(len(sets[a]), len(sets[b])) for a, b in linked], "x int, y int").selectExpr(jj.least_shared("x", "y", 85)).collect()
    assert linked and all(1 <= n[0] <= len(buckets[a] & buckets[b]) for n, (a, b) in zip(need, linked))


def test_trees_give_a_pair_once_and_only_if_it_meets_often(spark):
    """The tasks' own rows are the pairs to verify: none of a pair that meets too seldom, none twice."""
    docs = spark.createDataFrame(corpus(5, 60), "doc_id long, text string")
    named = jj.keys(docs, 4)
    buckets = jj.shared_buckets(jj.prefix_rows(docs, jj.slot_counts(named), 4, 85), 85)
    nodes = jj.classes(named)
    members = jj.materialise(buckets.join(nodes.select("k1", "node"), "k1").select("token", "node", "n", F.col("node").alias("root")), "members")
    pairs = jj.candidates(jj.cells(members, 85, 3), nodes, 85)
    assert pairs._jdf.queryExecution().analyzed().toString().startswith("MapInArrow")
    held = collections.defaultdict(set)
    for r in members.collect():
        held[r.node].add(r.token)
    point = {r.node: np.frombuffer(bytes(r.counts), np.uint16).astype(int) for r in nodes.collect()}
    want = []
    for a in held:
        for b in held:
            small, large = sorted((int(point[a].sum()), int(point[b].sum())))
            least = -(-85 * (small + large) // 185) - -(-85 * large // 100) + 1
            shared = len(held[a] & held[b])
            if a < b and shared >= max(least, 1) and 100 * small >= 85 * large and 185 * np.minimum(point[a], point[b]).sum() >= 85 * (small + large):
                want.append((a, b, shared))
    assert want and sorted(map(tuple, pairs.collect())) == sorted(want)


def test_slot_counts_cover_all_texts(spark):
    docs = spark.createDataFrame([(i, f"a b c d e{i % 7} f") for i in range(50)] + [(99, None)], "doc_id long, text string").repartition(4)
    got = jj.slot_counts(jj.keys(docs, 4))
    want = np.zeros(jj.SLOTS, np.int64)
    for i in range(50):
        np.add.at(want, jj._slot(jj.shingles(f"a b c d e{i % 7} f".encode(), 4)), 1)
    assert (got == want).all() and got.max() == 50


@pytest.mark.parametrize("points, fanout, spread", [(1, 4, 3), (2, 4, 3), (9, 4, 2), (300, 4, 6), (300, 32, 40), (64, 8, 0)])
def test_tree_finds_every_pair_under_the_bound(points, fanout, spread):
    rng = np.random.default_rng(points + spread)
    counts = rng.poisson(1 + rng.integers(0, spread + 1, (points, 1)), (points, 8)).astype(np.uint32)
    sizes = counts.sum(1).astype(np.int64)
    assert sorted(jj.packed(counts, sizes, fanout).tolist()) == list(range(points))
    got = [tuple(sorted(p)) for i, j in jj.tree_pairs(counts, sizes, 85, fanout) for p in zip(i.tolist(), j.tolist())]
    want = {
        (i, j) for i in range(points) for j in range(i + 1, points)
        if 185 * int(np.minimum(counts[i], counts[j]).sum()) >= 85 * int(sizes[i] + sizes[j])
        and 100 * min(sizes[i], sizes[j]) >= 85 * max(sizes[i], sizes[j])
    }
    assert len(got) == len(set(got)) and set(got) == want


def test_odd_rows(spark):
    long = " ".join(f"v{i % 977}x{i % 313}" for i in range(60_000))
    rows = [
        (9, "One two\tthree"), (3, "one TWO  three "), (5, None), (5, None), (6, ""), (7, " \n\t"), (4, "one two"), (None, "alpha beta gamma delta"),
        (None, "alpha beta  gamma delta"), (8, "Ünï cöde ÜNÏ wörds"), (2, "ünï cöde ünï wörds"), (10, long), (11, long + " tail"), (10, long),
        (12, "same " * 500), (13, "same same same same"), (14, "one two three"),
    ]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, node string")
    got = sorted(map(tuple, jj.near_duplicates(docs).collect()), key=repr)
    assert got == expected(rows)
    assert dict((r[0], r[2]) for r in got if r[0] is not None)[14] == 3 and (5, 0, 5) in got


def test_empty_table_and_text_ids(spark):
    assert jj.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([("b", "w x y z q"), ("a", "w x y z q"), ("c", "other words in this")], "doc_id string, text string")
    assert sorted(map(tuple, jj.near_duplicates(docs).collect())) == [("a", 2, "a"), ("b", 2, "a"), ("c", 1, "c")]
