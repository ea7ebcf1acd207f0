"""Running values over timelines, in one of two ways.

`WINDOWS` are Spark's window functions: one sorted task for each recording. `Blocks` is for recordings of any length: rows are
dealt to blocks of neighbours, about as many in each, whatever recording they belong to. Every block is reduced by itself,
the few reductions of a recording's blocks give what each block starts from, and that is joined back to its rows. Tables
are written to the shared folder between steps, as a block must hold the same rows each time it is read. Rows that are
equal in recording and order stay in one block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.shared import publish, scratch


class Windows:
    """Running values by window functions."""

    def deal(self, rows: DataFrame, order: tuple, partition: tuple) -> DataFrame:
        """rows as they are to be given to running(), in that order."""
        return rows

    def running(self, rows: DataFrame, name: str, value: Column, how: str, order: tuple, partition: tuple, before: bool = False) -> DataFrame:
        """Adds name: the max, min, sum or last (that isn't null) of value up to the row, or before it."""
        w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        return rows.withColumn(name, self._of(value, how).over(w))

    @staticmethod
    def _of(value: Column, how: str) -> Column:
        return F.last(value, ignorenulls=True) if how == "last" else {"max": F.max, "min": F.min, "sum": F.sum}[how](value)


class Blocks(Windows):
    """Running values block by block; rows have a column _block besides their own."""

    def __init__(self, blocks: int | None = None):
        self.blocks = blocks

    def deal(self, rows: DataFrame, order: tuple, partition: tuple) -> DataFrame:
        spark = rows.sparkSession
        by = [*partition, *order]
        n = self.blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.drop("_block").repartitionByRange(n, *by).sortWithinPartitions(*by)
        return publish(dealt.withColumn("_block", F.spark_partition_id().cast("long")), scratch(spark, "blocks"))

    def running(self, rows: DataFrame, name: str, value: Column, how: str, order: tuple, partition: tuple, before: bool = False) -> DataFrame:
        inner = super().running(rows, name, value, how, order, (*partition, "_block"), before)
        if how == "last":
            whole = F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("_value"))))["_value"]
        else:
            whole = self._of(value, how)
        own = rows.groupBy(*partition, "_block").agg(whole.alias("_own"))
        carried = super().running(own, "_carry", F.col("_own"), how, ("_block",), partition, before=True)
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in partition]) if partition else F.lit(True)
        carried = carried.select(F.col("_block").alias("_of_block"), "_carry", *[F.col(c).alias(f"_{c}_") for c in partition])
        both = inner.join(carried, same & (F.col("_block") == F.col("_of_block")))
        carry, mine = F.col("_carry"), F.col(name)
        if how == "last":
            value = F.coalesce(mine, carry)
        elif how == "sum":
            value = F.when(mine.isNull() | carry.isNull(), F.coalesce(mine, carry)).otherwise(mine + carry)
        else:
            value = (F.greatest if how == "max" else F.least)(mine, carry)
        return publish(both.select(*rows.columns, value.alias(name)), scratch(rows.sparkSession, "running"))


WINDOWS = Windows()
