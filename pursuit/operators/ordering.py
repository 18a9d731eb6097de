"""Ranks and neighbours inside groups of any size.

A window over a group puts the whole group into one task. Here rows are range partitioned over (group, order) first, so
a group that holds most rows becomes many chunks; windows run inside a chunk and a small table of one row per group and
chunk carries the counts and the edge values over the seams."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pursuit.staging import lookup, staged


def _placed(df: DataFrame, by, orders) -> DataFrame:
    """Rows with the number of the range partition they lie in. Staged, so every reader sees the same placement."""
    return staged(
        df.repartitionByRange(*[F.col(c) for c in by], *orders).withColumn("_chunk", F.spark_partition_id()), "ordered")


def with_rank(df: DataFrame, by, orders, rank: str = "rank", total: str | None = None) -> DataFrame:
    """Adds the row number of every row in its group under ``orders`` (which must not tie), and the group's size. Stages its steps when called."""
    rows = _placed(df, by, orders)
    chunks = rows.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    chunks = lookup(chunks.select(
        *by, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(everything).alias("_total"),
    ), "chunks")
    inside = Window.partitionBy(*by, "_chunk").orderBy(*orders)
    ranked = rows.withColumn("_inside", F.row_number().over(inside)).join(chunks, [*by, "_chunk"])
    ranked = ranked.withColumn(rank, F.col("_before") + F.col("_inside"))
    if total:
        ranked = ranked.withColumnRenamed("_total", total)
    return ranked.drop("_chunk", "_before", "_inside", "_total")


def with_neighbours(df: DataFrame, by, order: str) -> DataFrame:
    """Adds ``prev_<order>`` and ``next_<order>``: the value before and after in the group, null at its ends. Stages its steps when called."""
    rows = _placed(df, by, [F.col(order)])
    edges = rows.groupBy(*by, "_chunk").agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    along = Window.partitionBy(*by).orderBy("_chunk")
    edges = lookup(edges.select(
        *by, "_chunk", F.lag("_hi").over(along).alias("_prev"), F.lead("_lo").over(along).alias("_next")), "edges")
    inside = Window.partitionBy(*by, "_chunk").orderBy(order)
    rows = rows.withColumns({
        f"prev_{order}": F.lag(order).over(inside), f"next_{order}": F.lead(order).over(inside),
    }).join(edges, [*by, "_chunk"])
    return rows.withColumns({
        f"prev_{order}": F.coalesce(f"prev_{order}", "_prev"), f"next_{order}": F.coalesce(f"next_{order}", "_next"),
    }).drop("_chunk", "_prev", "_next")
