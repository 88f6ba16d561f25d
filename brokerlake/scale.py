"""Building blocks that keep hot groups out of single tasks.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. When one key may
hold a third of a table, order-dependent work is done here over *ranges of the sorted table*
instead: a hot key is spread over as many tasks as its share of the data.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows dealt by a part of the join keys are not dealt again by all of them
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole texts go to Python in batches of this size, not of 10 000 rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on. Cluster sizing is left alone."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


_SPLITS = "spark.sql.files.maxPartitionBytes"
_READ = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_DEALT = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: MB of a file, or of a shuffle, that one task reads at most, where narrow numbers become texts many
#: times their size that the task groups or sorts in memory
SPLIT_MB = 16
#: partitions that such a shuffle deals, if none are asked for; small ones are read together
DEALT = 1_000


def small_splits(spark: SparkSession) -> SparkSession:
    """Let a task read at most ``SPLIT_MB``, of a file or of a shuffle; a smaller setting is kept.

    A shuffle that deals as few partitions as there are cores would leave each task to sort a share of the
    table, on disk; many are dealt, and adaptive plans join them by what they hold.
    """
    for name in (_SPLITS, _READ):
        number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", spark.conf.get(name).strip().lower()).groups()
        if int(number) << 10 * " kmgt".index(unit or " ") > SPLIT_MB << 20:
            spark.conf.set(name, f"{SPLIT_MB}m")
    if spark.conf.get(_DEALT, None) is None:
        spark.conf.set(_DEALT, str(max(DEALT, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a temporary folder is made in local mode; on a cluster that is an error,
    as no other machine would see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="brokerlake-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def work_folder(spark: SparkSession, label: str = "work") -> str:
    """The name of a new folder below ``shared_root``."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the session names."""
    shared_root(df.sparkSession)
    return df.checkpoint()


#: deletes the shuffle files of an action when it ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder.

    Unlike a checkpoint it is columnar, compressed and of a known size, so later joins can
    choose their strategy by what the table really holds. What was shuffled to make it is deleted
    once it is written, and not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    folder = work_folder(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


#: rows up to which a table of facts that many rows look up goes to every task
AT_HAND = 500_000


def at_hand(df: DataFrame) -> DataFrame:
    """A table that is looked up: stored, and broadcast if it has at most ``AT_HAND`` rows."""
    fixed = stored(df, "side")
    return F.broadcast(fixed) if fixed.count() <= AT_HAND else fixed


def _numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    ident = F.monotonically_increasing_id()
    return (
        df.orderBy(*keys, *order)
        .withColumn("_id", ident)
        .withColumn("_part", F.shiftright("_id", 33).cast("int"))
        .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )


def sorted_ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Globally sort by key and order, fix the result, and add ``_part`` and ``_row``.

    ``_part`` numbers the sorted ranges and ``_row`` counts within one; both are stored, so a
    lost executor cannot renumber them. A partition of the result is one range, in its order.
    """
    return durable(_numbered(df, keys, order))


def global_rank(ranged: DataFrame, name: str = "_rank") -> DataFrame:
    """Row number over the whole sorted table; the side table has one row per range."""
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    # broadcast is bounded by the number of ranges, not by the data
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .drop("_offset")
    )


#: rows of one key that a single task may rank; keys with more are ranked over sorted ranges
HOT = 100_000


def positions(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "position",
    bound: DataFrame | None = None,
) -> DataFrame:
    """1-based place of each row within its key, as ``row_number`` gives, but skew-proof.

    Keys are counted first, in ``bound`` if given: a table that holds at least as many rows of each
    key as ``df``. All but hot keys are ranked by a window, which needs no shuffle where ``df`` is
    dealt by key already. ``keys`` must not be NULL, ``order`` must be total.
    """
    counted = (df if bound is None else bound).groupBy(*keys).agg(F.count("*").alias("_n"))
    # at most one key in HOT rows
    hot = stored(counted.where(F.col("_n") > HOT).select(*keys), "hot-keys")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    if hot.isEmpty():
        return df.withColumn(name, place)
    cold = df.join(F.broadcast(hot), keys, "left_anti").withColumn(name, place)
    return cold.unionByName(_range_positions(df.join(F.broadcast(hot), keys, "left_semi"), keys, order, name))


def _range_positions(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``positions`` over sorted ranges, which a hot key spans.

    The only per-key work is a ``min``, which combines map-side; the join back is an equi-join
    on the key that AQE can split.
    """
    ranked = global_rank(stored(_numbered(df, keys, order), "ranges"))
    firsts = ranked.groupBy(*keys).agg(F.min("_rank").alias("_first"))
    return (
        ranked.join(firsts, keys)
        .withColumn(name, F.col("_rank") - F.col("_first") + 1)
        .drop("_rank", "_first", "_part", "_row")
    )


def lower_nearest_rank(df: DataFrame, value: str, percent: int) -> DataFrame:
    """Exact ``sorted[int(percent/100 * (n - 1))]`` of a non-negative integer column.

    Two passes over value counts: first by the value's high bits, then by exact value inside
    the one high-bits group that holds the rank. No pass sorts rows, and the second window
    sees at most 65 536 distinct values.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("long").alias("_v"))
    rows = rows.withColumn("_high", F.shiftright("_v", 16))
    before = Window.orderBy("_high").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    coarse = (
        rows.groupBy("_high").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(everything))
        .withColumn("_target", F.expr(f"({int(percent)} * (_total - 1)) div 100"))
        .where("_before <= _target and _target < _before + _n")
        .select("_high", (F.col("_target") - F.col("_before")).alias("_skip"))
    )
    upto = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(F.broadcast(coarse), "_high")  # exactly one row
        .groupBy("_v").agg(F.count("*").alias("_n"), F.max("_skip").alias("_skip"))
        .withColumn("_upto", F.sum("_n").over(upto))
        .where("_upto > _skip")
        .agg(F.min("_v").alias(value))
    )


def first_by(order: Column, *columns: str) -> list[Column]:
    """Aggregates that take each column from the first row in ``order`` (map-side combinable)."""
    return [F.min_by(F.col(c), order).alias(c) for c in columns]


def nulls_last_key(column: Column, descending: bool = False) -> list[Column]:
    """Two order columns that sort a nullable number with NULL last in either direction."""
    return [column.isNull().asc(), column.desc() if descending else column.asc()]
