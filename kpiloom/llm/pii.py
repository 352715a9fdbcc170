"""Personal data: patterns, and terms that give the protected entities away.

Patterns find e-mail addresses, IP addresses, card and phone numbers; each distinct value is a
protected entity. A term discloses an entity as far as the two occur together in the corpus,
wherever in a document they stand: with df as document counts, the entity's information is
IC(e) = ln(N / df(e)) and the term gives PMI(t, e) = ln(N df(t, e) / (df(t) df(e))) of it. A term
with PMI >= THRESHOLD IC is a finding in the documents that hold both: it is generalised there, or
removed if it gives REMOVE or more of the information. Terms are the words outside the matches of
a document. Pairs seen in fewer than SUPPORT documents are no evidence.

Only DataFrame and SQL functions are used. Documents are counted per term and per pair before
anything is joined, each document giving one row per distinct word, and only documents with an
entity of SUPPORT documents or more are paired with words; no pair of documents is ever formed.

The regular expressions are the plain ones with possessive quantifiers and run starts, so that
they match the same places without backtracking or recursion on very long runs. Places come
from the lengths of matches and of the gaps between them.

Rules for odd input: NULL and empty texts have no findings; failing matches are dropped without
a second try; kinds may overlap; repeated rows keep their rows, count as documents and get the
same findings; an empty table gives no rows; other columns are not carried by ``findings`` and
pass through ``sanitise``. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import materialise, row_key

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3  #: documents that a term and an entity must share
THRESHOLD, REMOVE = 0.8, 0.95  #: shares of an entity's information
SPAN = "array<struct<s:int,e:int>>"

#: Word of a text before lower-casing: letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap condition that a text with a match meets.
HINTS = {
    "email": "contains(_text, '@')", "ip": "_text rlike '[0-9][.][0-9]+[.][0-9]'",
    "card": "_text rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", "phone": "contains(_text, '+')",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _valid(kind: str, m: str) -> str:
    """SQL condition on a match."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "ip":
        return f"{m} rlike '^{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}$'"
    if kind == "phone":
        return f"length({digits}) between 8 and 15"
    if kind == "card":  # Luhn: from the right, every second digit doubled, digits of products summed
        return (
            f"aggregate(transform(regexp_extract_all(reverse({digits}), '[0-9]', 0), (d, i) -> int(if(i % 2 = 0, int(d), (2 * int(d)) div 10 + (2 * int(d)) % 10))), "
            "0, (a, d) -> a + d) % 10 = 0"
        )
    return "true"


def places(gaps: str, matches: str) -> str:
    """SQL: (s, e) of the matches, from the strings of the gaps and of the matches. Running
    sums in chunks, so that the work isn't the square of the number of matches."""
    chunk = 128
    lens = f"zip_with(slice({gaps}, 1, size({matches})), {matches}, (g, m) -> struct(length(g) as g, length(m) as m))"
    parts = f"transform(sequence(0, (size(_n) - 1) div {chunk}), c -> slice(_n, int(c * {chunk} + 1), {chunk}))"
    offsets = (
        "aggregate(_p, struct(0 as at, cast(array() as array<int>) as o), (a, p) -> struct("
        "a.at + aggregate(p, 0, (x, y) -> x + y.g + y.m) as at, concat(a.o, array(a.at)) as o), a -> a.o)"
    )
    inner = (
        f"zip_with(_p, {offsets}, (p, o) -> aggregate(p, struct(o as at, cast(array() as {SPAN}) as r), (a, x) -> struct("
        "a.at + x.g + x.m as at, concat(a.r, array(struct(a.at + x.g as s, a.at + x.g + x.m as e))) as r), a -> a.r))"
    )
    return (
        f"if(size({matches}) = 0, cast(array() as {SPAN}), "
        f"transform(array({lens}), _n -> transform(array({parts}), _p -> flatten({inner}))[0])[0])"
    )


def _sql(pattern: str) -> str:
    """The pattern inside an SQL string literal."""
    return pattern.replace("\\", "\\\\")


_SQL_WORD = _sql(WORD)


def _terms(text: str) -> Column:
    """The distinct lower-cased words of a text."""
    return F.expr(f"array_distinct(transform(regexp_extract_all({text}, '{_SQL_WORD}', 0), w -> lower(w)))")


#: SQL: ``_text`` without the matches in ``found``.
_OUTSIDE = (
    "aggregate(array_sort(found, (a, b) -> a.start - b.start), struct(cast(array() as array<string>) as out, 0 as at), (a, f) -> struct("
    "if(f.start > a.at, concat(a.out, array(substring(_text, a.at + 1, f.start - a.at))), a.out) as out, greatest(a.at, f.end) as at), "
    "a -> array_join(concat(a.out, array(substring(_text, a.at + 1))), ' '))"
)


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, rk1, rk2, _text, found): ``found`` holds kind, start, end and value of each valid
    match, by kind as listed, then start. ``_text`` is NULL without a match."""
    work = docs.select("doc_id", *row_key(), F.coalesce("text", F.lit("")).alias("_text"))
    for kind, pattern in PATTERNS.items():
        work = work.withColumn(
            f"_m_{kind}",
            F.expr(f"case when {HINTS[kind]} then regexp_extract_all(_text, '{_sql(pattern)}', 0) else cast(array() as array<string>) end"),
        )
    for kind, pattern in PATTERNS.items():
        work = work.withColumn(
            f"_g_{kind}", F.expr(f"case when size(_m_{kind}) > 0 then split(_text, '{_sql(pattern)}', -1) else cast(array() as array<string>) end")
        )
    for kind in PATTERNS:
        work = work.withColumn(f"_p_{kind}", F.expr(places(f"_g_{kind}", f"_m_{kind}")))
    found = [
        F.expr(
            f"transform(filter(arrays_zip(_p_{k}, _m_{k}), x -> {_valid(k, f'x._m_{k}')}), "
            f"x -> struct('{k}' as kind, x._p_{k}.s as start, x._p_{k}.e as end, x._m_{k} as value))"
        )
        for k in PATTERNS
    ]
    return work.withColumn("found", F.concat(*found)).select(
        "doc_id", "rk1", "rk2", F.when(F.size("found") > 0, F.col("_text")).alias("_text"), "found"
    )


def held_entities(base: DataFrame) -> DataFrame:
    """(rk1, rk2, _text, found, kind, value): every document under each of its entities."""
    return base.where("size(found) > 0").select(
        "rk1", "rk2", "_text", "found", F.inline(F.expr("array_distinct(transform(found, f -> struct(f.kind as kind, f.value as value)))"))
    )


def disclosing(base: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, value, term, remove): terms that give an entity away, ``base`` being mentions."""
    held = held_entities(base)
    entities = materialise(held.groupBy("kind", "value").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= SUPPORT), "pii-entities")
    words = held.join(entities.select("kind", "value"), ["kind", "value"]).select("kind", "value", F.explode(_terms(_OUTSIDE)).alias("term"))
    together = materialise(words.groupBy("kind", "value", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= SUPPORT), "pii-together")
    # Counted before the join, which then has one row a term.
    counted = docs.select(F.explode(_terms("coalesce(text, '')")).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    alone = counted.where(F.col("n_term") >= SUPPORT).join(together.select("term").distinct(), "term")
    total = base.count()
    pmi = F.log(F.lit(float(max(total, 1))) * F.col("n_both") / F.col("n_term") / F.col("n_entity"))
    ic = F.log(F.lit(float(max(total, 1))) / F.col("n_entity"))
    return (
        together.join(entities, ["kind", "value"]).join(alone, "term")
        .where((ic > 0) & (pmi >= THRESHOLD * ic))
        .select("kind", "value", "term", (pmi >= REMOVE * ic).alias("remove"))
    )


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, rk1, rk2, findings) for every row of ``docs`` (doc_id, text): kind, start, end
    of the patterns' matches by kind, then of terms (kind ``term``, or ``remove``) by start."""
    base = materialise(mentions(docs), "pii-mentions")
    giving = materialise(disclosing(base, docs.select("text")), "pii-terms")
    told = held_entities(base).join(giving.select("kind", "value").distinct(), ["kind", "value"])
    own = (
        told.select("rk1", "rk2", "kind", "value", F.explode(_terms(_OUTSIDE)).alias("term"))
        .join(giving, ["kind", "value", "term"]).groupBy("rk1", "rk2", "term").agg(F.max("remove").alias("remove"))
        .groupBy("rk1", "rk2").agg(F.map_from_entries(F.collect_list(F.struct("term", "remove"))).alias("_terms"))
    )
    texts = base.where("_text is not null").dropDuplicates(["rk1", "rk2"]).select("rk1", "rk2", "_text", "found")
    word = _SQL_WORD
    spans = (
        texts.join(own, ["rk1", "rk2"])
        .withColumn("_m", F.expr(f"regexp_extract_all(_text, '{word}', 0)"))
        .withColumn("_g", F.expr(f"split(_text, '{word}', -1)"))
        .withColumn("_p", F.expr(places("_g", "_m")))
        .select(
            "rk1", "rk2",
            F.expr(
                "transform(filter(arrays_zip(_p, _m), x -> map_contains_key(_terms, lower(x._m)) "
                "AND NOT exists(found, f -> x._p.s < f.end AND x._p.e > f.start)), "
                "x -> struct(if(_terms[lower(x._m)], 'remove', 'term') as kind, x._p.s as start, x._p.e as end))"
            ).alias("_more"),
        )
    )
    none = "cast(array() as array<struct<kind:string,start:int,end:int>>)"
    return base.select("doc_id", "rk1", "rk2", "found").join(spans, ["rk1", "rk2"], "left").select(
        "doc_id", "rk1", "rk2",
        F.expr(f"concat(transform(found, f -> struct(f.kind as kind, f.start as start, f.end as end)), coalesce(_more, {none}))").alias("findings"),
    )


def _cut(text: Column) -> Column:
    """The text with its findings replaced: kinds by their name, removed terms by nothing."""
    ordered = "array_sort(findings, (a, b) -> case when a.start != b.start then a.start - b.start else b.end - a.end end)"
    pieces = (
        f"aggregate({ordered}, struct(cast(array() as array<string>) as out, 0 as at), (a, f) -> struct("
        "if(f.start >= a.at, concat(a.out, array(substring(_t, a.at + 1, f.start - a.at), "
        "if(f.kind = 'remove', '', concat('[', upper(f.kind), ']')))), a.out) as out, greatest(a.at, f.end) as at), "
        "a -> concat(array_join(a.out, ''), substring(_t, a.at + 1)))"
    )
    return F.when(F.size("findings") > 0, F.expr(pieces)).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data generalised to its kind and disclosing terms generalised or
    removed in ``text``."""
    found = findings(docs.select("doc_id", "text")).dropDuplicates(["rk1", "rk2"]).select("rk1", "rk2", "findings")
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_t"), *row_key()).join(found, ["rk1", "rk2"])
    return rows.select(*[(_cut(F.col("_t")) if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
