"""Tracking tables clustered by play, so that work on one play or player reads them without an exchange of frames.

A week's table is sorted for pruning; this one is bucketed by game and play and sorted inside a bucket. Joins of frames with
frames of the same play, windows along a player's frames and aggregates per player then run where the frames lie. A bucket
holds whole plays, so the layout is for plays of a usual size; tables with endless plays are read with ``load_weeks``."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursuit.schema import FRAME, PLAY

KINDS = ("input", "output")


def _table(root: str, kind: str) -> str:
    """A name in the session's catalog for the files under ``root``."""
    return f"pursuit_{kind}_{hashlib.md5(root.rstrip('/').encode()).hexdigest()[:12]}"


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def write_clustered(inp: DataFrame, out: DataFrame, root: str, buckets: int = 200) -> list[str]:
    """Input and output frames under ``root``, one file for each bucket; returns the names of the tables in the catalog.

    Choose ``buckets`` so that a bucket fits a task: about the table's size over 128 MB."""
    spark, names = inp.sparkSession, []
    for kind, df in zip(KINDS, (inp, out)):
        name = _table(root, kind)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        placed = df.repartition(buckets, *PLAY).sortWithinPartitions(*FRAME)
        placed.write.mode("overwrite").option("path", f"{root.rstrip('/')}/{kind}").bucketBy(buckets, *PLAY).sortBy(*FRAME).saveAsTable(name)
        names.append(name)
    layout = spark.range(1).select(F.lit(buckets).alias("buckets"), *[F.lit(_columns(df)).alias(k) for k, df in zip(KINDS, (inp, out))])
    layout.coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/layout")
    return names


def read_clustered(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The tables under ``root`` with their clustering, also in a session that did not write them."""
    layout = spark.read.json(f"{root.rstrip('/')}/layout").first()
    frames = []
    for kind in KINDS:
        name = _table(root, kind)
        if not spark.catalog.tableExists(name):
            spark.sql(f"CREATE TABLE {name} ({layout[kind]}) USING parquet CLUSTERED BY ({', '.join(PLAY)}) SORTED BY ({', '.join(FRAME)}) "
                      f"INTO {layout.buckets} BUCKETS LOCATION '{root.rstrip('/')}/{kind}'")
        frames.append(spark.table(name))
    return frames[0], frames[1]
