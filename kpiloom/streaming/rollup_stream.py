"""Incremental maintenance of the daily campaign rollup with Structured Streaming.

New ``campaign_stats`` files (append-only facts) arriving in a folder are summed
per micro-batch to the (customer_id, id, date) grain and written to
``<rollup>/batch_id=<epoch>``. Writing each epoch to its own folder in overwrite
mode makes a replayed epoch (after a failure between write and commit) replace its
own output instead of adding it twice, so the rollup is exactly-once without
streaming state. Readers re-sum the per-batch partials. ``compact`` folds finished
epochs into ``<rollup>/compacted_to=<epoch>``: the name records the last epoch inside, so
readers take the newest compacted folder and the epochs after it, and nothing twice.

Restated days. A source that states whole days again (late conversions, corrections) is not
additive. With ``restated=True`` a batch *replaces* the (account, day) pairs that it holds: of
all statements of an account's day the newest counts, by the source's ``stamp`` column if it has
one, else by arrival; equal stamps go by arrival. Every partial keeps its stamp and epoch, so the
order of arrival does not matter and a replayed epoch still replaces only itself. A day that is
stated to be empty is one row with a NULL id: it replaces the day and is no row of the rollup.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kpiloom.plans.rollup import GRAIN, MEASURES, daily_rollup
from kpiloom.sources.files import remove
from kpiloom.sources.tables import CAMPAIGN_STATS, conform


#: What orders the statements of an account's day, beside the rollup's columns.
STATED = ("stamp", "epoch")
_DAY = ["customer_id", "date"]


def newest_days(rows: DataFrame) -> DataFrame:
    """Of all statements of each account's day, the rows of the newest (``STATED`` columns). The
    newest stamps are one row per account and day, combined before the shuffle."""
    order = F.struct(*STATED)
    last = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in _DAY]).agg(F.max(order).alias("_last"))
    same = order == F.col("_last")
    for c in _DAY:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(last, same, "left_semi")


def stated_rollup(batch: DataFrame, epoch: int, stamp: str | None = None) -> DataFrame:
    """One batch's newest statement of each account's day, summed to the rollup's grain."""
    marked = batch.withColumns({
        "stamp": F.col(stamp) if stamp else F.lit(None).cast("bigint"), "epoch": F.lit(epoch).cast("bigint"),
    })
    kept = newest_days(conform(marked, "campaign_stats", keep=STATED))
    summed = kept.groupBy(*GRAIN, *STATED).agg(*[F.sum(m).alias(m) for m in MEASURES])
    return conform(summed, "campaign_stats", keep=STATED)


def batch_writer(rollup_path: str, restated: bool = False, stamp: str | None = None):
    """The ``foreachBatch`` function: one idempotent partial rollup per epoch."""
    base = rollup_path.rstrip("/")

    def write(batch: DataFrame, epoch_id: int) -> None:
        partial = stated_rollup(batch, epoch_id, stamp) if restated else daily_rollup(conform(batch, "campaign_stats"))
        partial.write.mode("overwrite").parquet(f"{base}/batch_id={epoch_id}")

    return write


def start_rollup_stream(
    spark: SparkSession,
    source_path: str,
    rollup_path: str,
    checkpoint_location: str,
    available_now: bool = True,
    processing_time: str = "5 minutes",
    max_files_per_trigger: int | None = None,
    schema: StructType | None = None,
    restated: bool = False,
    stamp: str | None = None,
) -> StreamingQuery:
    """Start the stream. ``schema`` is the source files' schema; by default it is read from
    the files that are there (the contract's if there are none), so measures may be DOUBLE.
    ``available_now`` processes what is there and stops; otherwise it runs every
    ``processing_time``. ``checkpoint_location`` must be a shared folder. ``restated`` and
    ``stamp``: statements replace days (see above); a day's rows must arrive in one batch."""
    reader = spark.readStream.schema(schema or _source_schema(spark, source_path))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = (
        reader.parquet(source_path)
        .writeStream.foreachBatch(batch_writer(rollup_path, restated, stamp))
        .option("checkpointLocation", checkpoint_location)
    )
    writer = (
        writer.trigger(availableNow=True) if available_now
        else writer.trigger(processingTime=processing_time)
    )
    return writer.start()


def _source_schema(spark: SparkSession, source_path: str) -> StructType:
    try:
        return spark.read.parquet(source_path).schema
    except AnalysisException:  # no file yet
        return CAMPAIGN_STATS


def _folders(spark: SparkSession, base: str) -> tuple[int, list[int]]:
    """(last epoch inside the newest compacted folder or -1, epochs after it)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def done(name: str) -> bool:  # a folder without _SUCCESS is still being written, or was left by a failure
        return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}/_SUCCESS"))

    upto = max((int(n.split("=")[1]) for n in names if n.startswith("compacted_to=") and done(n)), default=-1)
    epochs = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch_id=") and done(n))
    return upto, [e for e in epochs if e > upto]


def _partials(spark: SparkSession, paths: list[str], restated: bool) -> DataFrame:
    """The partials of several folders; a compacted one may differ in the measures' types."""
    keep = STATED if restated else ()
    parts = [conform(spark.read.parquet(p), "campaign_stats", keep) for p in paths[:1]]
    if len(paths) > 1:
        parts.append(conform(spark.read.parquet(*paths[1:]), "campaign_stats", keep))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_stream_rollup(spark: SparkSession, rollup_path: str, restated: bool = False) -> DataFrame:
    """Current rollup: the newest compacted partials and the later epochs, summed (additive), or
    the newest statement of each account's day (``restated``, as the stream was started)."""
    base = rollup_path.rstrip("/")
    upto, epochs = _folders(spark, base)
    paths = [f"{base}/compacted_to={upto}"] * (upto >= 0) + [f"{base}/batch_id={e}" for e in epochs]
    if not paths:
        return spark.createDataFrame([], CAMPAIGN_STATS)
    both = _partials(spark, paths, restated)
    if not restated:
        return daily_rollup(both)
    stated = F.col("id").isNotNull()  # else a day that is stated to be empty, or rows of no campaign
    for m in MEASURES:
        stated |= F.col(m).isNotNull()
    return newest_days(both).where(stated).drop(*STATED)


def compact(spark: SparkSession, rollup_path: str, keep: int = 1, restated: bool = False) -> int:
    """Fold all epochs but the newest ``keep`` (one may still be replayed) into a new compacted
    folder and return its epoch; -1 if there was nothing to fold. Folders that it replaces are
    removed only when the new one is complete. Of restated days the newest statements stay, with
    their stamps, so that a late older one still loses."""
    base = rollup_path.rstrip("/")
    upto, epochs = _folders(spark, base)
    fold = epochs[: len(epochs) - keep] if keep else epochs
    if not fold:
        return -1
    old = [f"{base}/compacted_to={upto}"] * (upto >= 0)
    paths = [f"{base}/batch_id={e}" for e in fold]
    rows = _partials(spark, old + paths, restated)
    folded = newest_days(rows) if restated else daily_rollup(rows)
    folded.write.mode("overwrite").parquet(f"{base}/compacted_to={fold[-1]}")
    for p in old + paths:
        remove(spark, p)
    return fold[-1]
