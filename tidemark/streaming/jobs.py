"""The same operators on streams.

Late rows beyond the watermark are dropped here; the periodic batch rebuild takes them in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.changes import classify_changes
from tidemark.operators.intervals import blocked_points, blocked_ranges, day_number, used_levels
from tidemark.operators.sessions import first_windows
from tidemark.operators.vectors import nearest_class
from tidemark.session import cut
from tidemark.streaming.snapshot import BucketedSnapshot, committed

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watch_files(spark: SparkSession, path: str, schema: str, per_batch: int = 1000) -> DataFrame:
    """New manifest files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def ingest_snapshot(spark: SparkSession, stream: DataFrame, snapshot: str, keys: list[str], compare: list[str], **layout) -> BucketedSnapshot:
    """The snapshot of a manifest stream: keys, what is compared, and whether the row is missing."""
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *compare])
    return BucketedSnapshot(spark, snapshot, f"{schema}, missing boolean", keys, **layout)


def incremental_ingest(stream: DataFrame, snapshot: str, changes: str, checkpoint: str, keys: list[str], compare: list[str], **layout):
    """Classify each batch of manifest rows against the stored snapshot and update it.

    Only the buckets that hold the batch's keys are read, and only changed rows are written (see
    ``BucketedSnapshot``; ``layout``: buckets, max_deltas).
    """
    spark = stream.sparkSession
    store = ingest_snapshot(spark, stream, snapshot, keys, compare, **layout)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # of rows seen at the same time the largest, so that a repeated batch takes the same
        newest = F.max_by(F.struct(*compare), F.struct("seen_at", *compare)).alias("_row")
        latest = batch.groupBy(*keys).agg(newest).select(*keys, "_row.*").persist()
        try:
            # as many as there are buckets
            touched = [r[0] for r in latest.select(store.bucket()).distinct().collect()]
            known = store.read(batch_id, touched)
            status = classify_changes(latest, known, keys, compare).where("status not in ('missing', 'gone')")
            status.write.mode("overwrite").parquet(f"{changes}/batch={batch_id}")
            written = batch.sparkSession.read.schema(status.schema).parquet(f"{changes}/batch={batch_id}")
            fresh = latest.join(written.where("status <> 'unchanged'").select(*keys), keys, "left_semi")
            store.append(fresh.withColumn("missing", F.lit(False)), batch_id)
            store.compact(batch_id)
            store.purge(batch_id)
        finally:
            latest.unpersist()

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def stream_sessions(stream: DataFrame, gap_hours: float, late: str, by: list[str], ts: str = "ts") -> DataFrame:
    """Sessions per owner; a pause of exactly the gap does not split."""
    gap = f"{round(gap_hours * 3600)} seconds"
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("window"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start_at"), F.max(ts).alias("end_at"))
        .drop("window")
    )


def stream_first_copies(stream: DataFrame, late: str, hash_column: str = "sha256", ts: str = "ts") -> DataFrame:
    """First arrival of each content hash; the batch regroup later picks the best copy."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([hash_column])


def stream_absorb(stream: DataFrame, windows: DataFrame, ts: str = "ts", key: str = "id") -> DataFrame:
    """Rows of the stream with the first locked window they fall into.

    The windows are cut once, when the query is built, into stretches that do not overlap, each with its
    first window. Stream and stretches meet on blocks of days; a row lies in one stretch at most, so
    nothing is aggregated and no state is kept.
    """
    stretches = cut(first_windows(windows))
    # the day of the last moment that is still inside
    last = F.unix_micros(F.col("until").cast("timestamp")) - 1
    blocks = blocked_ranges(stretches, day_number(F.col("start_at")), F.floor(last / 86_400_000_000))
    rows = blocked_points(stream.select(key, ts), day_number(F.col(ts)), used_levels(blocks))
    inside = (F.col(ts) >= F.col("start_at")) & (F.col(ts) < F.col("until"))
    return rows.join(blocks, ["_level", "_block"]).where(inside).select(key, ts, "event_id")


class _Thinning(StatefulProcessor):
    """Keeps the last kept fingerprint of an owner until no row can be compared with it any more."""

    def __init__(self, window_s: float, max_diff: float):
        self.window_us = int(window_s * 1_000_000)
        self.max_diff = max_diff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "at bigint, mark array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        last = self.state.get() if self.state.exists() else None
        at, mark = (last[0], np.asarray(last[1])) if last else (None, None)
        frames = [r[r["us"] >= passed] for r in rows if len(r)]
        frames = [r for r in frames if len(r)]
        if not frames:
            return
        batch = pd.concat(frames).sort_values(["us", "id"], ignore_index=True)
        kept = []
        for i, (us, value) in enumerate(zip(batch["us"], batch["mark"])):
            if value is None:
                kept.append(i)
                continue
            value = np.asarray(value, dtype=np.float64)
            if at is not None and abs(us - at) <= self.window_us and np.abs(value - mark).mean() < self.max_diff:
                continue
            # a row that comes late is kept, but what came after it stays the last one
            if at is None or us >= at:
                at, mark = int(us), value
            kept.append(i)
        if at is not None:
            self.state.update((at, [float(x) for x in mark]))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # the first whole millisecond after the window
            self.handle.registerTimer((at + self.window_us) // 1000 + 1)
        yield pd.DataFrame({"owner": batch["owner"], "id": batch["id"], "us": batch["us"]}).iloc[kept]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_thin(
    stream: DataFrame, owner: str, fingerprint: str, window_s: float = 120, max_diff: float = 12.0, ts: str = "ts", key: str = "id", late: str = "1 hour"
) -> DataFrame:
    """Sequential thinning per owner; rows are put in order within each batch.

    Rows later than ``late`` are left out. An owner's state goes when the watermark has passed the window
    after its last kept row: nothing that may still come could be compared with it.
    """
    rows = stream.withWatermark(ts, late).select(
        F.col(owner).alias("owner"),
        F.col(key).alias("id"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.col(fingerprint).cast("array<double>").alias("mark"),
        F.col(ts),
    )
    owner_type = rows.schema["owner"].dataType.simpleString()
    return rows.groupBy("owner").transformWithStateInPandas(
        statefulProcessor=_Thinning(window_s, max_diff),
        outputStructType=f"owner {owner_type}, id bigint, us bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


def publish_classes(classes: DataFrame, folder: str) -> int:
    """Write the next version of a class table (class_id, class_vector); its number."""
    version = max(committed(classes.sparkSession, folder, "v"), default=-1) + 1
    classes.select(F.col("class_id").cast("bigint"), F.col("class_vector").cast("array<double>")).write.mode("overwrite").parquet(f"{folder}/v={version}")
    return version


def stream_entities(stream: DataFrame, classes: str, matches: str, checkpoint: str, threshold: float, vector: str = "embedding", key: str = "id"):
    """Write (key, class_id, similarity, version) of arriving vectors at or above ``threshold`` below ``matches``.

    Every batch reads the newest finished version of the class table in the folder ``classes``, so a new class
    is met from the next batch on. Vectors and classes meet block by block (``vectors.block_join``): no
    class table goes through the driver or whole to a task. Equal similarities go to the lowest class.
    """

    def match(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = committed(spark, classes, "v")
        if not versions:
            return
        known = spark.read.schema("class_id bigint, class_vector array<double>").parquet(f"{classes}/v={versions[-1]}")
        rows = batch.select(F.col(key).cast("bigint").alias(key), vector).persist()
        try:
            found = nearest_class(rows, known, threshold, key, vector, max_classes=0)
            found.withColumn("version", F.lit(versions[-1])).write.mode("overwrite").parquet(f"{matches}/batch={batch_id}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint)
