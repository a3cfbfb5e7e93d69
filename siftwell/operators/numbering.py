"""Numbers of all rows in a global order, without a single task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

_ROW_BITS = 33


def numbered(spark: SparkSession, df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """All rows of df with their place from 1 on: sorted by range partitions, to whose own places the rows before are added."""
    # the ranges are sampled, so what they gave is kept
    held = storage.stored(spark, df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", _ROW_BITS)
    before, sums = 0, []
    for r in held.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        sums.append((r["part"], before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(sums, "_part long, _before long"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return held.withColumn("_part", part).join(offsets, "_part").withColumn(into, place).drop("_part", "_before", "_id")
