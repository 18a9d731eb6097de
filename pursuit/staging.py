"""Written hand-offs between the stages of one application.

A staged table cuts lineage, survives the loss of executors, and can be read by several consumers without computing it
again. A lookup is a staged table that joins meet: its rows are counted in the file footers, and only a table within the
limit is broadcast; beyond it the join is shuffled.
"""

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else the context's checkpoint folder, else a
    folder in the warehouse. A warehouse on the driver's own disk is refused unless the driver is the whole cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse:
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        local = warehouse.startswith("file:") or "://" not in warehouse
        if local and not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError(f"the warehouse {warehouse} is on one machine: set spark.checkpoint.dir to a folder every executor can reach")
        root = f"{warehouse.rstrip('/')}/_staging"
    return root.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pursuit-{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, label: str) -> str:
    """A path no other stage uses, grouped by application so one folder can be dropped when the application ends."""
    return f"{application_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_tables: list[tuple[str, str]] = []     # application and name of the tables that ``clustered`` has put in the catalog


def clustered(df: DataFrame, label: str, keys: list[str], buckets: int, placed: bool = False) -> DataFrame:
    """``df`` staged in ``buckets`` files by the hash of ``keys`` and read back with that layout: joins, windows and aggregates
    by columns that include the keys, under these or other names, run where the rows lie and exchange nothing.

    One task reads a file, so choose ``buckets`` for what a task makes of its rows. Rows made of a table of as many buckets by the
    same values, without an exchange in between, are ``placed``: they are written where they lie."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    name = "pursuit_" + path.rsplit("/", 1)[-1].replace("-", "_")
    rows = df if placed else df.repartition(buckets, *keys)
    rows.write.option("path", path).option("compression", "zstd").bucketBy(buckets, *keys).saveAsTable(name)
    _tables.append((spark.sparkContext.applicationId, name))
    return spark.table(name)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system it lies in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder another path in its file system; folders above it are made. One that is not there becomes an empty folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at, new = hadoop(path), hadoop(to)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        files.mkdirs(at)
    files.mkdirs(new.getParent())
    if not files.rename(at, new):
        raise RuntimeError(f"{path} was not renamed to {to}")


def sweep(spark: SparkSession) -> None:
    """Have the driver look for shuffle files that nothing refers to any more; executors keep them until it does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again, and the shuffle files behind what has been written."""
    for table in tables:
        root = application_dir(table.sparkSession)
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
                delete(table.sparkSession, folder)
    if tables:
        sweep(tables[0].sparkSession)


def clear(spark: SparkSession) -> None:
    """Delete everything this application has staged; results must have been written before."""
    for at in [t for t in _tables if t[0] == spark.sparkContext.applicationId]:
        spark.sql(f"DROP TABLE IF EXISTS {at[1]}")
        _tables.remove(at)
    delete(spark, application_dir(spark))


LOOKUP_ROWS = 100_000


def lookup(df: DataFrame, label: str, limit: int = LOOKUP_ROWS) -> DataFrame:
    """A staged table of narrow rows for the small side of joins, broadcast when it holds at most ``limit`` rows."""
    table = staged(df, label)
    return table.hint("broadcast") if table.count() <= limit else table
