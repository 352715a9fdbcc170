"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation
estimates how far each can be trusted, and the posterior probability decides.

Everything is DataFrame and SQL functions. A text's statistics come from array functions
within its own row, so no text is shuffled; the only aggregate is over vote patterns, at most
2 ** len(RULES) rows whatever the corpus, and each EM step is one aggregate of that table.

Rules for odd input: NULL, empty and white-space texts have no words, zero statistics and fail
the base rule; a posterior of exactly one half keeps; repeated rows are judged
alike, each keeping its row; an empty table gives no rows; other columns pass through under
any name. Texts of any length are judged whole (array functions are n log n in the words).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import SPACE, materialise, rolling

WINDOW = 8  #: words of a window that may repeat
STEPS = 12  #: EM steps
SHARE = 0.5  #: share of good texts that EM starts from
#: Where EM starts: the chance that a rule fires on a good and on a bad text, by its vote.
START = {-1: (0.005, 0.3), 1: (0.9, 0.3)}
PRIOR = 50.0  #: pseudo texts of each class at those rates; they keep every rate off 0 and 1


@dataclass(frozen=True)
class Rule:
    """``when`` is an SQL condition on the statistics; where it holds the rule casts ``vote``
    (1 good, -1 bad), elsewhere it abstains."""

    name: str
    when: str
    vote: int = -1


RULES = (
    Rule("short", "n_words < 20"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words"),
    Rule("capitals", "10 * n_upper > 3 * word_chars"),
    Rule("exclamations", "10 * n_bangs > n_words"),
    Rule("digits", "10 * n_digits > 2 * word_chars"),
    Rule(
        "prose",
        "n_words >= 50 and 50 * n_symbols <= n_words and 100 * n_repeat_words <= 10 * n_words "
        "and word_chars between 4 * n_words and 9 * n_words and 100 * n_upper <= 15 * word_chars",
        1,
    ),
)
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
              "n_upper", "n_bangs", "n_digits")


def _repeated(windows: str) -> str:
    """SQL: words covered by windows (array of hashes) that occur twice or more."""
    order = f"array(sort_array(transform({windows}, (h, i) -> struct(h as h, i as i))))"
    places = (
        f"transform({order}, s -> sort_array(transform(filter(transform(s, (x, j) -> struct(x.i as i, "
        "coalesce(get(s, j - 1).h = x.h, false) or coalesce(get(s, j + 1).h = x.h, false) as d)), x -> x.d), x -> x.i)))"
    )
    return (
        f"aggregate({places}[0], struct(0L as n, -1 as next), (acc, p) -> struct("
        f"acc.n + (p + {WINDOW} - greatest(p, acc.next)) as n, p + {WINDOW} as next), acc -> acc.n)"
    )


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_row, the columns of STATISTICS as BIGINT): ``_row`` is the whole input row."""
    bare = lambda drop: F.length("_text") - F.length(F.regexp_replace("_text", drop, ""))
    words = (
        docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .withColumn("_words", F.array_remove(F.split("_text", SPACE, -1), ""))
        .withColumn("_hashes", F.expr("transform(_words, w -> xxhash64(w))"))
        .withColumn("_lines", F.expr(r"filter(split(_text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
        .withColumn(
            "_windows",
            F.expr(f"if(size(_words) < {WINDOW}, array(), slice({rolling('_hashes', WINDOW)}, 1, size(_words) - {WINDOW - 1}))"),
        )
    )
    return words.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        bare("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"case when size(array_distinct(_windows)) = size(_windows) then 0L else {_repeated('_windows')} end").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        bare("[A-Z]+").cast("long").alias("n_upper"),
        bare("[!?]+").cast("long").alias("n_bangs"),
        bare("[0-9]+").cast("long").alias("n_digits"),
    )


def start(rules: tuple[Rule, ...]) -> dict:
    return {"share": SHARE, "rates": {r.name: START[r.vote] for r in rules}}


def estimate(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, steps: int = STEPS) -> dict:
    """EM over (f_<rule>... BOOLEAN, n): the share of good texts and, per rule, the chances
    that it fires on a good and on a bad text. Rules are taken as independent within a class;
    an abstention says nothing; a rule never speaks against its own vote."""
    model = start(rules)
    for _ in range(steps):
        weighed = patterns.withColumn("p", posterior(model, rules))
        sums = [F.sum("n").alias("all"), F.sum(F.col("n") * F.col("p")).alias("good")]
        for r in rules:
            fired = F.when(F.col(f"f_{r.name}"), F.col("n")).otherwise(0)
            sums += [F.sum(fired * F.col("p")).alias(f"{r.name}_1"), F.sum(fired * (1 - F.col("p"))).alias(f"{r.name}_0")]
        s = weighed.agg(*sums).first()
        if not s["all"]:
            break
        rates = {}
        for r in rules:
            good = (s[f"{r.name}_1"] + PRIOR * START[r.vote][0]) / (s["good"] + PRIOR)
            bad = (s[f"{r.name}_0"] + PRIOR * START[r.vote][1]) / (s["all"] - s["good"] + PRIOR)
            rates[r.name] = (good, min(bad, good) if r.vote > 0 else max(bad, good))
        model = {"share": (s["good"] + PRIOR * SHARE) / (s["all"] + PRIOR), "rates": rates}
    return model


def posterior(model: dict, rules: tuple[Rule, ...] = RULES) -> Column:
    """Probability that a text is good, from the columns f_<rule>."""
    odds = F.lit(math.log(model["share"] / (1 - model["share"])))
    for r in rules:
        good, bad = model["rates"][r.name]
        odds = odds + F.when(F.col(f"f_{r.name}"), math.log(good / bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_row, STATISTICS, base_failed, posterior, kept). The statistics are written once: EM
    and the verdicts read them, not the texts."""
    fired = [f"f_{r.name}" for r in rules]
    stats = materialise(
        statistics(docs, text).select("*", *[F.expr(r.when).alias(f) for r, f in zip(rules, fired, strict=True)]),
        "quality",
    )
    patterns = materialise(stats.groupBy(*fired).agg(F.count("*").alias("n")), "quality-votes")
    return (
        stats.withColumn("posterior", posterior(estimate(patterns, rules), rules))
        .withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
        .drop(*fired)
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is kept, unchanged."""
    return judge(docs).where("kept").select("_row.*")


def oracle() -> str:
    """The whole query in DuckDB SQL, EM steps as a chain of one-row tables."""
    space = r"[\x20\x09-\x0D]"
    fired = ", ".join(f"f_{r.name}" for r in RULES)
    weigh = lambda share, rate: (
        f"1 / (1 + exp(-(ln({share} / (1 - {share})) + "
        + " + ".join(f"case when f_{r.name} then ln({rate(r, 0)} / {rate(r, 1)}) else 0 end" for r in RULES)
        + ")))"
    )
    sql = f"""
with t as (select row_number() over () as r, doc_id, coalesce("text", '') as x from documents),
w as (select r, doc_id, x, list_filter(regexp_split_to_array(x, '{space}+'), lambda e: e <> '') as ws,
  list_filter(string_split(x, chr(10)), lambda e: regexp_matches(e, '[^\\x20\\x09-\\x0D]')) as ls from t),
p as (select r, unnest(ws) as word, unnest(range(len(ws))) as i from w),
g as (select r, i, list(word) over (partition by r order by i rows between current row and {WINDOW - 1} following) as win from p),
h as (select r, i from (select r, i, count(*) over (partition by r, win) as c from g where len(win) = {WINDOW}) where c > 1),
c as (select r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) as n from (select r, i, lead(i) over (partition by r order by i) as nxt from h) group by r),
s as (select w.r, doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
  coalesce(c.n, 0)::bigint as n_repeat_words, len(ls) as n_lines, length(regexp_replace(x, '[^A-Z]', '', 'g')) as n_upper,
  length(regexp_replace(x, '[^!?]', '', 'g')) as n_bangs, length(regexp_replace(x, '[^0-9]', '', 'g')) as n_digits
  from w left join c using (r)),
v as (select *, {', '.join(f"({r.when}) as f_{r.name}" for r in RULES)} from s),
m0 as (select {fired}, count(*) as n, {weigh(SHARE, lambda r, c: START[r.vote][c])} as p from v group by all)"""
    for k in range(STEPS):
        sums = ", ".join(
            f"sum(case when f_{r.name} then n * {w} else 0 end) as {r.name}_{c}" for r in RULES for w, c in (("p", 1), ("(1 - p)", 0))
        )
        good = lambda r: f"({r.name}_1 + {PRIOR * START[r.vote][0]}) / (g + {PRIOR})"
        bad = lambda r: f"({r.name}_0 + {PRIOR * START[r.vote][1]}) / (a - g + {PRIOR})"
        rates = ", ".join(
            f"{good(r)} as {r.name}_0, {'least' if r.vote > 0 else 'greatest'}({bad(r)}, {good(r)}) as {r.name}_1" for r in RULES
        )
        sql += f""",
s{k} as (select sum(n) as a, sum(n * p) as g, {sums} from m{k}),
r{k} as materialized (select (g + {PRIOR} * {SHARE}) / (a + {PRIOR}) as share, {rates} from s{k}),
m{k + 1} as materialized (select {fired}, n, {weigh("share", lambda r, c: f"{r.name}_{c}")} as p from m{k}, r{k})"""
    same = " and ".join(f"v.f_{r.name} = m.f_{r.name}" for r in RULES)
    return sql + f"""
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and m.p >= 0.5 as kept, round(m.p, 6) as posterior
from v join m{STEPS} m on {same}"""
