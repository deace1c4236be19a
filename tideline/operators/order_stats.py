"""Exact ranks, shares and medians without sorting a whole table in one task.

Rows are sorted once over range partitions, whose splitters Spark samples from the values, and each
row keeps the number of its partition and its place in it. Sums over the partitions before (one row
per partition) turn places into places of the whole table. A hash of the row breaks ties, so equal
values spread over as many partitions as they need, and values in any narrow interval do as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.runtime import checkpointed

#: Rows of a partition are numbered in the lower 33 bits of monotonically_increasing_id.
_PLACE = (1 << 33) - 1


def in_order(df: DataFrame, *by: Column) -> DataFrame:
    """All rows with ``_pid``, the number of their range partition, and ``_pos``, their place in it from 0 on.

    Written once to the shared folder: another evaluation could sample other splitters.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return checkpointed(sorted_.withColumns({
        "_pid": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))}))


def _by_value(df: DataFrame, value: str) -> DataFrame:
    return in_order(df.where(F.col(value).isNotNull()), F.col(value), F.xxhash64(*df.columns))


def _ends(rows: DataFrame, value: str) -> DataFrame:
    """One row per partition: its rows ``_c``, the rows before it, all rows, and its least and largest value."""
    each = rows.groupBy("_pid").agg(F.count("*").alias("_c"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    upto = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.withColumns({"_before": F.sum("_c").over(upto) - F.col("_c"), "_n": F.sum("_c").over(Window.partitionBy(F.lit(0)))})


def with_pct_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average-method percentile rank; NULL stays NULL and leaves the denominator."""
    rows = _by_value(df, value)
    ends = checkpointed(_ends(rows, value))
    # few values reach over the end of a partition: their first place and number come from all partitions they are in
    last = F.lag("_hi").over(Window.orderBy("_pid"))
    over = ends.withColumn("_last", last).where(F.col("_lo") == F.col("_last")).select(F.col("_lo").alias("_v")).distinct()
    parts = rows.join(F.broadcast(over), rows[value] == over["_v"]).groupBy("_v", "_pid").agg(F.count("*").alias("_k"))
    parts = parts.join(F.broadcast(ends.select("_pid", "_before", "_c")), "_pid")
    first = F.min_by(F.col("_before") + F.col("_c") - F.col("_k"), F.col("_pid"))
    wide = parts.groupBy("_v").agg(first.alias("_from"), F.sum("_k").alias("_all"))
    local = rows.withColumns({"_less": F.rank().over(Window.partitionBy("_pid").orderBy(value)) - 1,
                              "_same": F.count("*").over(Window.partitionBy("_pid", value))})
    # tables of at most one row per partition
    j = local.join(F.broadcast(ends.select("_pid", "_before", "_n")), "_pid").join(F.broadcast(wide), local[value] == wide["_v"], "left")
    less = F.coalesce(F.col("_from"), F.col("_before") + F.col("_less"))
    ranked = j.select(*df.columns, ((less + (F.coalesce("_all", "_same") + 1) / 2.0) / F.col("_n")).alias(out))
    return ranked.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))


def largest(df: DataFrame, value: str, share: int, tie: list[str]) -> DataFrame:
    """The ``max(1, n div share)`` rows with the largest values, n counting non-NULL values.

    Of the rows that hold the last value taken, the first by ``tie`` are in.
    """
    rows = in_order(df.where(F.col(value).isNotNull()), F.col(value).desc(), *map(F.col, tie))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") / share))
    placed = rows.join(F.broadcast(_ends(rows, value).select("_pid", "_before", "_n")), "_pid")
    return placed.where(F.col("_before") + F.col("_pos") < k).select(*df.columns)


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median",
                 each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Median per key (mean of the two middle values), one row per key.

    ``each`` gives the keys of a row where it has several (one row per key, other columns kept); rows
    are sorted before that, once. Counts per key and partition tell which partitions hold the middle
    of a key, and only their rows are looked at again.
    """
    rows = _by_value(df, value)
    rows = each(rows) if each else rows
    counts = rows.groupBy(*keys, "_pid").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({"_before": F.sum("_c").over(upto) - F.col("_c"), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    lo, hi = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    holds = counts.where((F.col("_before") < hi) & (F.col("_before") + F.col("_c") >= lo))
    holds = holds.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"), "_before", "_n")
    on = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_pid").orderBy(value))
    middle = rows.join(holds, on).withColumn("_at", place)
    at = lambda k: F.max(F.when(F.col("_at") == k, F.col(value)))
    return middle.groupBy(*keys).agg(((at(lo) + at(hi)) / 2.0).alias(out))
