"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into item-sized windows: ``size`` consecutive words, or the whole of a
shorter item. A document contains a window only if it contains every shingle of it, so one
shingle is a sufficient prefix: the rarest in the documents. The steps:

1. document shingles are joined with the shingles of all windows; what matches is written,
   and its counts order the shingles by rarity over the whole corpus;
2. every window keeps its rarest shingle as prefix and joins the matches on it, with the
   positional bound (the window must start in the text) and the length bound (and end in it);
3. the documents with candidates are read again and the candidates verified on the words.

Document words meet the benchmark in a broadcast join while its distinct shingles are few
(``BROADCAST_ROWS``, counted first); beyond that Spark plans a shuffled join of the same rows.
Only DataFrame and SQL functions are used.

Rules for odd input: NULL or wordless texts and items match nothing; a repeated item counts
once, an item whose id is NULL hits words but is not listed; repeated rows are judged alike,
each keeping its row; empty tables give no rows or no hits; other columns pass through under
any name (as ``_row``). Texts are read whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import NON_ALNUM, UPPER, LOWER, materialise, rolling, row_key

SIZE = 10  #: words of a window
SHINGLE = 5  #: words of a shingle; shorter windows are one shingle
#: Distinct shingles that may be broadcast (about 40 bytes each, so 40 MB).
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NON_ALNUM, -1), "")


def exact_words(text: str) -> Column:
    """Words of the A-Z-lower-cased text."""
    return _words(F.translate(F.col(text), UPPER, LOWER))


def loose_words(text: str) -> Column:
    """As many words, lower-cased in full: equal exact words are equal here too, and the
    function is much faster than ``translate``. For searching; matches are verified."""
    return _words(F.lower(F.col(text)))


def _grams(hashes: str, size: str, k: int) -> str:
    return f"if({size} < {k}, array(), slice({rolling(hashes, k)}, 1, {size} - {k - 1}))"


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, window, len): the distinct windows of every item as space-joined words."""
    cut = items.select("item_id", exact_words("text").alias("_w")).where("size(_w) > 0")
    starts = F.expr(f"sequence(0, greatest(size(_w) - {size}, 0))")
    return cut.select("item_id", "_w", F.explode(starts).alias("_s")).select(
        "item_id", F.expr(f"array_join(slice(_w, _s + 1, {size}), ' ')").alias("window"),
        F.expr(f"least(size(_w), {size})").alias("len"),
    ).distinct()


def _window_shingles(wins: DataFrame, size: int, shingle: int) -> DataFrame:
    """(window, len, k, gram, at): the shingles of each distinct window and their offsets."""
    words = wins.select("window", "len").distinct().withColumn("_h", F.transform(F.split(F.lower("window"), " "), lambda w: F.xxhash64(w)))
    parts = [
        words.where(F.col("len") >= shingle if k == shingle else F.col("len") == k)
        .select("window", "len", F.lit(k).alias("k"), F.posexplode(F.expr(_grams("_h", "len", k))).alias("at", "gram"))
        for k in range(1, shingle + 1)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def occurrences(docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """((rk1, rk2, start, len, window) for every place of a window in a document, windows).
    ``docs`` needs doc_id and text."""
    shingle = min(shingle, size)
    wins = materialise(windows(items, size), "decon-windows")
    parts = materialise(_window_shingles(wins, size, shingle), "decon-shingles")
    grams = parts.select("k", "gram").distinct()
    counts = grams.groupBy("k").count().collect()  # at most ``shingle`` rows
    small = sum(r["count"] for r in counts) <= BROADCAST_ROWS

    hashed = docs.select(*row_key(), loose_words("text").alias("_w")).withColumn("_h", F.expr("transform(_w, w -> xxhash64(w))"))
    matches = None
    for r in counts:  # usually one: 5-word shingles
        k = r["k"]
        own = grams.where(F.col("k") == k).select("gram")
        found = hashed.select("rk1", "rk2", F.size("_w").alias("n_words"), F.posexplode(F.expr(_grams("_h", "size(_w)", k))).alias("at", "gram"))
        found = found.join(F.broadcast(own) if small else own, "gram").select("rk1", "rk2", "n_words", F.lit(k).alias("k"), "gram", "at")
        matches = found if matches is None else matches.union(found)
    empty = docs.sparkSession.createDataFrame([], "rk1 long, rk2 long, start int, len int, window string")
    if matches is None:
        return empty, wins
    matches = materialise(matches.distinct(), "decon-matches")

    rarity = matches.groupBy("k", "gram").agg(F.count("*").alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "gram")
    prefixes = (
        parts.join(rarity, ["k", "gram"], "left").groupBy("window", "len", "k").agg(F.min(order).alias("p"))
        .where("p.n > 0").select("len", "k", F.col("p.gram").alias("gram"), F.col("p.at").alias("offset")).distinct()
    )
    candidates = (
        matches.join(F.broadcast(prefixes) if small else prefixes, ["k", "gram"])
        .withColumn("start", F.col("at") - F.col("offset"))
        .where("start >= 0 and start + len <= n_words")
        .groupBy("rk1", "rk2").agg(F.collect_set(F.struct("start", "len")).alias("_c"))
    )
    seen = docs.select(*row_key(), "text").join(candidates, ["rk1", "rk2"]).select("rk1", "rk2", exact_words("text").alias("_w"), "_c")
    places = seen.select("rk1", "rk2", "_w", F.explode("_c").alias("c")).select(
        "rk1", "rk2", "c.start", "c.len", F.expr("array_join(slice(_w, c.start + 1, c.len), ' ')").alias("window")
    )
    exact = wins.select("window", "len").distinct()
    verified = places.join(F.broadcast(exact) if small else exact, ["window", "len"]).distinct()
    return verified.select("rk1", "rk2", "start", "len", "window"), wins


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """(_row, n_words, n_hit, item_ids, contaminated) for every row of ``docs`` (doc_id, text,
    ...): words inside any occurrence, and the ids of the items found, sorted as strings."""
    places, wins = occurrences(docs, items, size, shingle)
    places = materialise(places, "decon-places")
    hit = places.groupBy("rk1", "rk2").agg(F.sort_array(F.collect_set(F.struct("start", F.expr("start + len").alias("end")))).alias("_o")).select(
        "rk1", "rk2",
        F.expr(
            "aggregate(_o, struct(0L as n, 0 as upto), (a, o) -> struct("
            "a.n + greatest(o.end - greatest(o.start, a.upto), 0) as n, greatest(a.upto, o.end) as upto), a -> a.n)"
        ).alias("_hit"),
    )
    ids = wins.where("item_id is not null").select("window", F.col("item_id").cast("string").alias("id"))
    named = (
        places.select("rk1", "rk2", "window").distinct().join(ids, "window").select("rk1", "rk2", "id").distinct()
        .groupBy("rk1", "rk2").agg(F.sort_array(F.collect_set("id")).alias("_ids"))
    )
    found = hit.join(named, ["rk1", "rk2"], "left")
    rows = docs.select(F.struct("*").alias("_row"), *row_key(), F.size(loose_words("text")).cast("long").alias("n_words"))
    return rows.join(found, ["rk1", "rk2"], "left").select(
        "_row", "n_words", F.coalesce("_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, unchanged."""
    places, _ = occurrences(docs, items, size)
    hit = materialise(places.select("rk1", "rk2").distinct(), "decon-hit")
    rows = docs.select(F.struct("*").alias("_row"), *row_key())
    return rows.join(hit, ["rk1", "rk2"], "left_anti").select("_row.*")


def oracle(size: int = SIZE) -> str:
    """The whole query in DuckDB SQL."""
    sep, upper, lower = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", UPPER, LOWER
    return f"""
with d as (select row_number() over () as r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce("text", ''), '{upper}', '{lower}'), '{sep}'), lambda e: e <> '') as ws from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce("text", ''), '{upper}', '{lower}'), '{sep}'), lambda e: e <> '') as ws from benchmark),
n as (select distinct item_id, win, len(win) as l from (
  select item_id, list_slice(ws, s + 1, s + {size}) as win from (select item_id, ws, unnest(range(greatest(len(ws) - {size}, 0) + 1)) as s from b where len(ws) > 0))),
p as (select r, unnest(ws) as word, unnest(range(len(ws))) as i from d),
g as (select l, r, i, list(word) over (partition by l, r order by i rows between current row and {size - 1} following) as win
  from p, (select distinct l from n)),
o as (select distinct r, i, k.l, n.item_id from (select l, r, i, list_slice(win, 1, l) as win from g) k join n on k.l = n.l and k.win = n.win),
h as (select r, count(distinct i + j) as n_hit from (select r, i, unnest(range(l)) as j from (select distinct r, i, l from o)) group by r),
m as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from o group by r)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join h using (r) left join m using (r)"""
