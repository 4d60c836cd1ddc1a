"""Episodes as a sequence: ids, batches, mining, bounded buffers, and the newest of anything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each non-null key; rows of one key are copies."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.dropDuplicates(list(keys))


def ranges(rows: DataFrame, order: Sequence[str], rows_per_part: int = 1_000_000) -> DataFrame:
    """rows, sorted in range partitions of about so many rows, with the number of each partition as _part."""
    from maieutic.session import stored

    n = max(1, -(-rows.count() // rows_per_part))
    return stored((rows.repartitionByRange(n, *order) if n > 1 else rows.coalesce(1)).withColumn("_part", F.spark_partition_id()))


def numbered(rows: DataFrame, order: Sequence[str], name: str = "seq", start: int = 1, rows_per_part: int = 1_000_000) -> DataFrame:
    """rows with dense numbers in the given order.

    Range partitions are numbered each for itself and moved by the sizes of those
    before, so no window runs over all rows; the sizes, one a partition, are all that
    is gathered.
    """
    parts = ranges(rows, order, rows_per_part)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part").orderBy(*order)
    return parts.withColumn("_rn", F.row_number().over(own)).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_rn") + F.col("_before") + F.lit(start - 1)).cast("long")).drop("_part", "_rn", "_before")


def batch_number(seq: Column, size: int = 4, start: int = 1) -> Column:
    """The batch of a dense number: consecutive rows, size of them each, the last one perhaps fewer."""
    return F.floor((seq - F.lit(start)) / F.lit(size)).cast("long")


def hardest(rows: DataFrame, batch: Sequence[str], reward: str, tie: str, fraction: float = 0.25) -> DataFrame:
    """The rows of lowest reward of each batch: the ceiling of fraction of its rows, at least one; ties by tie."""
    by = Window.partitionBy(*batch)
    ranked = rows.withColumn("_rank", F.row_number().over(by.orderBy(reward, tie))).withColumn("_n", F.count("*").over(by))
    return ranked.where(F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(fraction)))).drop("_rank", "_n")


def tail(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last n rows; none for 0. A bounded heap in each task, merged once."""
    return rows.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def newest_per_key(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """key, value, seq: for each key the value with the greatest seq, null values included."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(seq, value)).alias("_m")).select(key, F.col(f"_m.{value}").alias(value), F.col(f"_m.{seq}").alias(seq))


def checkpoint_name(role: Column, step: Column) -> Column:
    return F.format_string("checkpoints/%s/step_%06d", role, step)


def pruned(names: DataFrame, role: str, name: str, keep: int) -> DataFrame:
    """Names beyond the last keep of each role, in order of name; none for keep 0, which keeps all."""
    if keep <= 0:
        return names.limit(0)
    w = Window.partitionBy(role).orderBy(F.col(name).desc())
    return names.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > keep).drop("_r")
