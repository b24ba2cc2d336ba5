"""Quotas and arriving documents as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkstat.operators.preparation import upsert


def daily_counts(requests: DataFrame, late: str = "5 days") -> DataFrame:
    """``(day, visitor_key, n)`` of first-pass requests that succeed: event-time days with a watermark for late ones; deliveries with
    one seq inside the watermark count once."""
    r = requests.filter(F.coalesce("upstream_ok", F.lit(False)) & (F.coalesce("pass_no", F.lit(1)) == 1)).withWatermark("ts", late)
    r = r.dropDuplicatesWithinWatermark(["seq"])
    g = r.groupBy(F.window("ts", "1 day").alias("w"), F.coalesce("visitor_key", F.lit("unknown")).alias("visitor_key")).count()
    return g.select(F.col("w.start").cast("date").alias("day"), "visitor_key", F.col("count").alias("n"))


def admitted(requests: DataFrame, per_key: int = 3) -> DataFrame:
    """``(day, visitor_key, seq)`` of the requests let through: a counter for each key and day that ends a day after its last request
    (processing time). What does not fit is refused and takes nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        rows = []
        for b in batches:
            for seq in sorted(b["seq"]):
                if used < per_key:
                    used += 1
                    rows.append((key[0], key[1], seq))
        state.update((used,))
        state.setTimeoutDuration(86_400_000)
        yield pd.DataFrame(rows, columns=["day", "visitor_key", "seq"])

    r = requests.filter(F.coalesce("upstream_ok", F.lit(False)) & (F.coalesce("pass_no", F.lit(1)) == 1))
    r = r.select(F.to_date("ts").alias("day"), F.coalesce("visitor_key", F.lit("unknown")).alias("visitor_key"), "seq")
    return r.groupBy("day", "visitor_key").applyInPandasWithState(step, "day date, visitor_key string, seq bigint", "used int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_once(spark: SparkSession, df: DataFrame, checkpoint: str, target: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its result, which its batches write to the folder ``target``.

    Batches without data are switched off meanwhile: a processing-time timeout would ask for them for ever, and such a run would
    never end. A batch run again writes over its own folder; in complete mode the last batch has everything.
    """
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    last = {"n": -1}

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        last["n"] = number

    try:
        q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    if last["n"] < 0:
        return spark.createDataFrame([], df.schema)
    out = spark.read.schema(df.schema)
    return out.parquet(f"{target}/batch={last['n']}") if mode == "complete" else out.parquet(*[f"{target}/batch={i}" for i in range(last["n"] + 1)])


def arriving(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Documents of JSON-lines shards as they come into a folder."""
    return spark.readStream.schema(schema).json(folder)


def upsert_shards(stream: DataFrame, target: str, checkpoint: str, key: str = "mirrors"):
    """Each batch replaces the rows of the target with its keys. A batch is written to a folder of its own number first and the target
    named after it last, so that a batch run again gives the same state."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{target}/state-{number}"
        before = f"{target}/state-{number - 1}"
        try:
            old = spark.read.schema(batch.schema).parquet(before)
            new = upsert(old, batch, key)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            new = batch
        new.write.mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
