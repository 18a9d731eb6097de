"""Weeks whose input and output file have both landed, from a stream of landed files.

State is kept by season and week: which file came, in which version, and which pair was handed on last. A week goes on when
both files are there and at least one is new, so a corrected file runs its week again; a file that stays alone longer than
``patience`` is reported once."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pursuit.plans.prepare import prepare_weeks
from pursuit.sources.landing import Landing

PAIR = "season int, week int, status string, input_version string, output_version string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pairing(StatefulProcessor):
    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "kind string", "version string")
        self.sent = handle.getValueState("sent", "versions string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for kind, version in zip(batch["kind"], batch["version"]):
                self.files.updateValue((kind,), (version,))
        here = {k[0]: v[0] for k, v in self.files.iterator()}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(here) < 2:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
            return
        versions = f"{here['input']} {here['output']}"
        if not self.sent.exists() or self.sent.get()[0] != versions:
            self.sent.update((versions,))
            yield self._row(key, "complete", here)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        here = {k[0]: v[0] for k, v in self.files.iterator()}
        if len(here) == 1:
            yield self._row(key, "alone", here)

    def _row(self, key, status: str, here: dict) -> pd.DataFrame:
        return pd.DataFrame({"season": [key[0]], "week": [key[1]], "status": [status],
                             "input_version": [here.get("input")], "output_version": [here.get("output")]})

    def close(self) -> None:
        pass


def paired_weeks(files: DataFrame, patience_ms: int) -> DataFrame:
    """Weeks to store (``complete``) and lone files to report (``alone``), from a stream of ``Landing`` rows."""
    return files.groupBy("season", "week").transformWithStateInPandas(
        statefulProcessor=Pairing(patience_ms), outputStructType=PAIR, outputMode="Update", timeMode="ProcessingTime")


def stream_pairs(spark: SparkSession, raw: str, processed: str, checkpoint: str, patience_ms: int = 24 * 3600 * 1000, **trigger):
    """Start the stream over the raw folder: complete weeks are validated and stored, each in place of what was there of it;
    lone files are appended to ``<processed>/alone``. A batch that runs again stores the same weeks again. ``trigger`` is
    that of the stream, by default every minute."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.dataSource.register(Landing)
    pairs = paired_weeks(spark.readStream.format("landing").load(raw), patience_ms)

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.collect()  # a few weeks of a season
        for season in sorted({r.season for r in rows}):
            weeks = sorted(r.week for r in rows if r.season == season and r.status == "complete")
            if weeks:
                prepare_weeks(spark, raw, processed, weeks, season)
        alone = [r for r in rows if r.status == "alone"]
        if alone:
            spark.createDataFrame(alone, PAIR).withColumn("batch", F.lit(number)).write.mode("overwrite") \
                .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{processed}/alone")

    return pairs.writeStream.option("checkpointLocation", checkpoint).outputMode("update") \
        .trigger(**(trigger or {"processingTime": "1 minute"})).foreachBatch(handle).start()
