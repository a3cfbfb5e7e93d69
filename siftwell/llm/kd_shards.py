"""Sharding by a k-d tree over metadata, with DataFrame operations only.

Each row becomes a point, one number per metadata dimension (a string's is its rank among the distinct
values), with the row's bytes as its weight. All nodes of a level are split at once. One aggregation gives
each node's bytes and the spread of every dimension; the rows are then sorted by node and by the node's
widest dimension, by range partitions, and a row's weight in that order, added up within its partition and
to what the partitions before it hold, says on which side of its node's weighted median it lies. So a split
is exact, however many nodes, values or equal rows there are: rows that tie go by a number of their own.
Nothing but a row for each partition reaches the driver. Nodes' statistics are looked up in a table that is
broadcast while small. The text is read once; later passes read the narrow table of points, stored anew at
each level.

Cases: a null text weighs 1 (nothing plus 1); null metadata sorts first, next to the least value; equal
rows get different slots and are split like others; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Rows that one task sorts or numbers.
PART_ROWS = 1 << 16
ROW_BITS = 33


def _in_order(spark: SparkSession, df: DataFrame, order: list[Column], parts: int, name: str) -> DataFrame:
    """df stored in an order, with the number of its range partition and its place there (``_part``, ``_place``)."""
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    held = shared.stored(spark, dealt, name)
    return held.withColumn("_part", F.shiftright("_id", ROW_BITS)).withColumn("_place", F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)).drop("_id")


def _before(spark: SparkSession, df: DataFrame, amount: Column, into: str) -> DataFrame:
    """df of _in_order() with the sum of amount over all rows before."""
    parts, total = [], 0
    for r in df.groupBy("_part").agg(F.sum(amount).alias("n")).orderBy("_part").collect():  # a row for each partition
        parts.append((r["_part"], total))
        total += r["n"]
    sums = F.broadcast(spark.createDataFrame(parts, f"_part long, {into} long"))
    own = F.sum(amount).over(W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)) - amount
    return df.join(sums, "_part").withColumn(into, F.col(into) + own)


def ranked(spark: SparkSession, rows: DataFrame, name: str, into: str, parts: int) -> DataFrame:
    """rows with the rank of a column's value among the distinct values, from 1 on (0 for null), by their order."""
    value = F.col(name)
    counts = rows.where(value.isNotNull()).groupBy(name).agg(F.count("*").alias("_n"))
    places = _before(spark, _in_order(spark, counts, [value], parts, "values"), F.lit(1).cast("long"), into)
    table = shared.stored(spark, places.select(name, (F.col(into) + 1).alias(into), "_n"), "ranks")
    return shared.joined(rows, table, name, "_n", "left").withColumn(into, F.coalesce(into, F.lit(0).cast("long")))


def kd_leaves(spark: SparkSession, rows: DataFrame, dims: list[str], weight: str, leaves: int) -> DataFrame:
    """rows with columns ``shard`` from 0 to leaves - 1 and ``tie``, a number of the row's own. Weights are positive."""
    if leaves < 1:
        raise ValueError("leaves must be 1 or more")
    names, n = rows.columns, rows.count()
    parts = max(1, math.ceil(n / PART_ROWS))
    # equal rows get numbers of their own; what numbers them is stored
    tie = F.struct(F.xxhash64(*names).alias("h"), F.monotonically_increasing_id().alias("i"))
    points = shared.stored(spark, rows.withColumn("tie", tie), "points")
    for i, d in enumerate(dims):
        if isinstance(rows.schema[d].dataType, T.StringType):
            points = ranked(spark, points, d, f"_c{i}", parts)
        else:
            points = points.withColumn(f"_c{i}", F.col(d).cast("long"))
    codes = [f"_c{i}" for i in range(len(dims))]
    ends = points.agg(*(f(c).alias(f"{k}{c}") for c in codes for k, f in (("lo", F.min), ("hi", F.max)))).first()
    # from 0 to 1 by the dimension's range; null is the least
    scaled = [F.coalesce((F.col(c) - F.lit(ends[f"lo{c}"] or 0)) / F.lit(float(max((ends[f"hi{c}"] or 0) - (ends[f"lo{c}"] or 0), 1))), F.lit(-1e-9)) for c in codes]
    nodes = points.select(*names, "tie", F.array(*scaled).alias("_p"), F.lit(0).cast("long").alias("_n"), F.lit(leaves).cast("long").alias("_share"))
    # a node's number is that of its first leaf
    for level in range(max(0, math.ceil(math.log2(leaves)))):
        spread = [F.coalesce(F.stddev_pop(F.col("_p")[i]), F.lit(0.0)) for i in range(len(dims))]
        stats = nodes.groupBy("_n").agg(F.first("_share").alias("_share"), F.sum(weight).alias("_whole"), F.count("*").alias("_rows"), F.array(*spread).alias("_s"))
        widest = F.array_position("_s", F.array_max("_s")).cast("int")
        left = F.floor(F.col("_share") / 2)
        table = shared.stored(spark, stats.select("_n", widest.alias("_dim"), (F.col("_whole") * left / F.col("_share")).alias("_goal"), left.alias("_left"), "_rows", "_whole"), f"stats{level}")
        known = shared.joined(nodes, table.drop("_whole"), "_n", "_rows")
        order = [F.col("_n"), F.element_at("_p", F.col("_dim")), F.col("tie")]
        summed = _before(spark, _in_order(spark, known, order, parts, f"sorted{level}"), F.col(weight), "_sum")
        # sums begin anew in each node: what all nodes before it weigh is the least of its rows' sums
        base = shared.stored(spark, summed.groupBy("_n").agg(F.min("_sum").alias("_base"), F.count("*").alias("_rows")), f"base{level}")
        placed = shared.joined(summed.drop("_part", "_place"), base, "_n", "_rows")
        # a row goes to the side on which more of it lies; a node of one leaf stays whole
        right = (F.col("_left") > 0) & (F.col("_sum") - F.col("_base") + F.col(weight) / 2 > F.col("_goal"))
        share = F.when(F.col("_left") == 0, F.col("_share")).when(right, F.col("_share") - F.col("_left")).otherwise(F.col("_left"))
        nodes = placed.select(*names, "tie", "_p", (F.col("_n") + F.when(right, F.col("_left")).otherwise(0)).alias("_n"), share.cast("long").alias("_share"))
        nodes = shared.stored(spark, nodes, f"level{level}")
    return nodes.select(*names, F.col("_n").cast("int").alias("shard"), "tie")


def number(spark: SparkSession, df: DataFrame, group: str, tie: str, into: str) -> DataFrame:
    """Number the rows of each group from 0 without a gap, all tasks alike however large a group is."""
    parts = max(1, math.ceil(df.count() / PART_ROWS))
    held = _before(spark, _in_order(spark, df, [F.col(group), F.col(tie)], parts, "numbered"), F.lit(1).cast("long"), into)
    held = held.drop("_part", "_place")
    base = shared.stored(spark, held.groupBy(group).agg(F.min(into).alias("_base"), F.count("*").alias("_rows")), "firsts")
    return shared.joined(held, base, group, "_rows").withColumn(into, F.col(into) - F.col("_base")).drop("_base")


def kd_shards(spark: SparkSession, docs: DataFrame, leaves: int = 16, target_bytes: int | None = None) -> DataFrame:
    """Shards of documents of nearly equal bytes. With target_bytes, as many leaves as keep to it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *(c for c in ("lang", "source") if c in docs.columns),
    )
    if target_bytes:
        leaves = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    dims = [c for c in ("lang", "source", "size", "doc_id") if c in rows.columns]
    found = kd_leaves(spark, rows, dims, "size", leaves).select("doc_id", "size", "text_crc32", "shard", "tie")
    return number(spark, found, "shard", "tie", "slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
