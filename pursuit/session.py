"""Session defaults, for new sessions and for the ones a cluster hands out."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Runtime settings the plans count on; all of them decide by measured sizes and have another way beyond the limit.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even where that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # one row per player meets many frames: hash the small side when every partition of it is measured to fit, sort otherwise
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # no broadcast on an estimate (an exploded table looks as small as its source); adaptive execution broadcasts what it
    # has measured, and staged lookups are broadcast after their rows are counted
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # frame arrays: some hundred tracks in a task's hash map, then a sort, so that the map stays small
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "512",
    # a table spread by a player's key meets one keyed by player and frame without another exchange
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # frames go to Python as narrow rows, and a batch ends by its rows alone: with a limit in bytes Spark adds up the buffers of
    # every column again for each row, which takes longer than everything else on the way
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1),
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on a session that already runs."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "pursuit", master: str | None = None, **conf) -> SparkSession:
    """A tuned session; anything else comes from the cluster or from ``conf`` (dots as double underscores)."""
    builder = SparkSession.builder.appName(app).config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**TUNING, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors of an application, once, so that functions of its modules can be loaded there. Spark
    serves the file from the driver; executors need no copy of their own."""
    if spark.sparkContext.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="pursuit-"), "pursuit.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        at = os.path.join(folder, name)
                        out.write(at, os.path.relpath(at, os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(spark.sparkContext.applicationId)
    return spark
