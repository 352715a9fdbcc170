"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a folder of
Parquet rows (blob, rules, findings), says which rules, by name and version, have seen a blob.
A scan looks up what is missing, reads one copy of each unseen blob, applies the missing rules
only, appends to the ledger and joins all findings back to all paths that hold the blob.

The copy of a blob is chosen by the smallest hash of its path and fetched by (blob, hash), so a
blob held by a third of all paths stays spread out. Repeated rows share both; they are combined
before the shuffle, so that each blob is scanned once and no key holds more than a row a map
task. What returns to the paths is a blob's findings, joined by Spark's skew-aware sort-merge
join.

Rules for odd input: NULL texts are the empty blob, which has no findings; repeated rows are
one path with one blob and keep their rows; a NULL path is a path; matches that fail their
rule's test are dropped without a second try; spans of different kinds may overlap; an empty
table gives no rows and writes no ledger rows; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kpiloom.llm.common import materialise, scratch_path

FINDING = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, findings {FINDING}"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs over the text, leftmost and non-overlapping; a match of which ``group``
    is shorter than ``least`` is dropped. ``hint``: lower-case strings of which a text must
    hold one, else the pattern isn't run. Raise ``version`` when a rule changes."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = re.ASCII
    hint: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


BASE = (
    Rule(
        "assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12, 2, re.ASCII | re.IGNORECASE, ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18, hint=("akia",)),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs are maximal, so the length test can be the pattern's
)
#: What may stand between the lines of a key: white space, escaped in strings, or a quote or comment mark.
_BETWEEN = r"""(?:\s|\\[nrt]|["',>\#*|])"""
#: Formats published by the services that issue these keys.
MORE = (
    # To the END line if that is the next line of dashes, else to the last base64 line.
    Rule(
        "private_key",
        r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:"
        r"[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----|"
        rf"(?:{_BETWEEN}++(?:Proc-Type|DEK-Info|Key-Info|Version|Comment|Hash|Charset|MessageID):[^\n\r\\]*+)*+"
        rf"(?:(?:{_BETWEEN}++[A-Za-z0-9+/]{{16,}}+={{0,2}})++(?:{_BETWEEN}++=?[A-Za-z0-9+/]{{1,15}}+={{0,2}}(?=\x20*+(?:[\r\n\\]|\Z)))?+)?+)",
        hint=("private key",), version=2,
    ),
    Rule("code_host", r"(?<![A-Za-z0-9_])gh[oprsu]_[A-Za-z0-9]{36,}", hint=("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("chat", r"(?<![A-Za-z0-9-])xox[abeprs]-[A-Za-z0-9-]{10,}", hint=("xox",)),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint=("eyj",)),
    Rule("url_login", r"://[^\s:/@]{1,256}:[^\s:/@]{1,256}@", hint=("://",)),
)
RULES = BASE + MORE


def find(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then in the order of ``rules``."""
    low = text.lower()
    out = []
    for order, rule in enumerate(rules):
        if rule.hint and not any(h in low for h in rule.hint):
            continue
        for m in re.compile(rule.pattern, rule.flags).finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), order, m.end()))
    return [(rules[order].name, start, end) for start, order, end in sorted(out)]


def _finder(rules: tuple[Rule, ...]) -> Callable[..., Column]:
    @F.pandas_udf(FINDING)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, seen in batches:
            yield pd.Series([
                [
                    {"kind": k, "start": s, "end": e}
                    for k, s, e in find(text, tuple(r for r in rules if old is None or r.key not in old))
                ]
                for text, old in zip(texts, seen, strict=True)
            ])

    return of


def address(versions: DataFrame, path: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(_row, blob, _path): ``_path`` is a hash of the path, ``_row`` the columns to carry, by
    default all."""
    content = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.struct(*(carry or ["*"])).alias("_row"), F.sha2(content, 256).alias("blob"), F.xxhash64(path).alias("_path"))


def update_ledger(versions: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> int:
    """Scan what the ledger hasn't seen and append it; the number of blobs that were scanned."""
    spark = versions.sparkSession
    wanted = F.array(*[F.lit(r.key) for r in rules])
    addressed = address(versions, path, text)
    blobs = addressed.groupBy("blob").agg(F.min("_path").alias("_path"))
    seen = _read(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_seen"))
    todo = blobs.join(seen, "blob", "left").where(
        F.col("_seen").isNull() | (F.size(F.array_except(wanted, "_seen")) > 0)
    )
    texts = (
        addressed.select("blob", "_path", F.coalesce(F.col(f"_row.{text}"), F.lit("")).alias("_text"))
        .groupBy("blob", "_path").agg(F.first("_text").alias("_text"))
    )
    scanned = texts.join(todo, ["blob", "_path"]).select(
        "blob",
        F.when(F.col("_seen").isNull(), wanted).otherwise(F.array_except(wanted, "_seen")).alias("rules"),
        _finder(rules)("_text", "_seen").alias("findings"),
    )
    before = _read(spark, ledger).count()
    scanned.write.mode("append").parquet(ledger)
    return _read(spark, ledger).count() - before


def _read(spark, ledger: str) -> DataFrame:
    """The ledger's rows; none before the first scan."""
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        # Not createDataFrame: its empty RDD would start Python workers of its own on every executor.
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(LEDGER)])
    return spark.read.schema(LEDGER).parquet(ledger)


def _known(versions: DataFrame, ledger: str | None, path: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, _f) of the blobs with findings of ``rules``, after bringing the ledger up to date.
    Written, so that the join back to the paths has plain sides and Spark can split a hot blob."""
    ledger = ledger or scratch_path(versions.sparkSession, "secrets-ledger")
    update_ledger(versions, ledger, path, text, rules)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    asked = F.array(*[F.lit(r.key) for r in rules])
    names = F.array(*[F.lit(r.name) for r in rules])
    known = (
        _read(versions.sparkSession, ledger).where(F.size("findings") > 0)
        .select("blob", F.explode(F.array_distinct("findings")).alias("f"), F.array_intersect("rules", asked).alias("_now"))
        .where(F.array_contains(names, F.col("f.kind")) & F.exists("_now", lambda k: F.substring_index(k, "@", 1) == F.col("f.kind")))
        .select("blob", F.struct(F.col("f.start").alias("start"), order[F.col("f.kind")].alias("order"), F.col("f.kind").alias("kind"), F.col("f.end").alias("end")).alias("f"))
        .groupBy("blob").agg(F.sort_array(F.collect_set("f")).alias("_f"))
    )
    return materialise(known, "secrets-known")


def _joined(addressed: DataFrame, known: DataFrame) -> DataFrame:
    return addressed.join(known, "blob", "left").select(
        "_row", "blob",
        F.coalesce(F.transform("_f", lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))), F.array().cast(FINDING)).alias("findings"),
    )


def findings(versions: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_row, blob, findings) for every row of ``versions``, after bringing the ledger (a new
    one if not given) up to date; ``_row`` is the row without its text, which need not travel.
    Findings of rules that are not asked for, or of other versions of a rule, are left out."""
    known = _known(versions, ledger, path, text, rules)
    return _joined(address(versions, path, text, [c for c in versions.columns if c != text]), known)


def _redacted(text: str | None, starts, ends) -> str | None:
    if text is None:
        return None
    parts, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        if s >= at:
            parts += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every finding of ``text`` replaced by ``[SECRET]`` (overlapping ones by
    one) and ``n_chars``, where there is one, counted anew."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_redacted(*x) for x in zip(texts, starts, ends, strict=True)], dtype=object)

    found = _joined(address(docs), _known(docs, ledger, "doc_id", "text", rules)).withColumn(
        "_text",
        F.when(F.size("findings") > 0, cut("_row.text", "findings.start", "findings.end")).otherwise(F.col("_row.text")),
    )
    new = {"text": F.col("_text"), "n_chars": F.when(F.size("findings") > 0, F.length("_text")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[
        (new[c] if c in new else F.col(f"_row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns
    ])
