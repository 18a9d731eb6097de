"""The registered queries of the subpackage and, where SQL can say it, the same results in SQL."""

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


# Documents go to Python in small batches, so that a worker holds little beside the piece it works on. The limit in bytes is
# Spark's own: sessions tuned for narrow rows have none.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(2**26)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Puts SETTINGS on the session for the operators that work on it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
