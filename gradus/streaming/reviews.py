"""Streams of learner events (an extension): windows with late data, and running memory state of each learner and type."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradus.operators.learning import DAY

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
STATE = "ts array<double>, event_id array<bigint>, quality array<int>"
OUT = "user_id bigint, event_type string, n_reviews int, stability double"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Events of the Parquet files of a folder as they come.

    All files that are there make one batch unless ``files_per_batch`` is given: files are taken by the time they were
    written, which need not be that of their events, and with a watermark a file read later loses what is older than
    the watermark that files before it have moved. Who limits the files gives the windows a ``late`` that covers their disorder.
    """
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): events in windows of event time; what is later than ``late`` is left out."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, finish, n): a learner's events without a pause longer than ``gap``."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def memory_state(events: DataFrame, first: float = 2 * DAY) -> DataFrame:
    """(user_id, event_type, n_reviews, stability): state of the FSRS-like rule after each batch, kept between batches.

    The state holds the reviews of one learner and type in the order of time and event, so that a review that comes late
    takes its place and the result does not depend on the order in which files are read. An event_id counts once.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        new = pd.DataFrame({"ts": rows["ts"].astype("int64") / 1e9 if rows["ts"].dtype.kind == "M" else rows["ts"], "event_id": rows["event_id"], "quality": (rows["value"] // 1).astype("int64") % 6})
        if state.exists:
            ts, ids, quality = state.get
            new = pd.concat([pd.DataFrame({"ts": list(ts), "event_id": list(ids), "quality": list(quality)}), new])
        new = new.drop_duplicates("event_id").sort_values(["ts", "event_id"])
        s = first
        for q in new["quality"].tolist():
            s = s * (1.6 + 0.12 * max(0, q - 3)) if q >= 3 else max(s / 1.8, 60.0)
        state.update((new["ts"].astype(float).tolist(), new["event_id"].astype(int).tolist(), new["quality"].astype(int).tolist()))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "n_reviews": [len(new)], "stability": [s]})

    return events.groupBy("user_id", "event_type").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a stream over what is there now, into Parquet files below ``folder``, and gives what they hold.

    Each batch is written to a folder of its own, again in the same one if it is repeated after a failure. In complete mode the last
    batch counts; in update and append mode all of them, and the latest row of a key is the caller's choice.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch bigint").parquet(f"{folder}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).head()[0])
    return out.drop("batch")
