"""Incremental rule scan on Structured Streaming."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from corpuswarden.operators.findings import KEY
from corpuswarden.plans.scan import rule_scan
from corpuswarden.schema import FILES, FINDINGS
from corpuswarden.session import TASKS_PER_CORE, fine_scans, settings, workspace


# How long a key is remembered, so that a file that comes again soon stores nothing new.
HORIZON = "1 day"

# Every batch plans its jobs, opens all partitions of the state and looks through its keys for
# old ones, so a replay makes batches of this size, however many files they are. Row groups
# are far smaller than a batch, so that a few large files keep all cores busy.
BATCH_BYTES = 256 << 20
GROUP_BYTES = 8 << 20


def read_batches(spark: SparkSession, path: str, files_per_batch: int = 1000,
                 oldest: str = "3650d", bytes_per_batch: int | None = None) -> DataFrame:
    """Files tables dropped into a folder, as a stream.

    A batch takes `files_per_batch` tables, or with `bytes_per_batch` as many as that holds.
    Spark leaves out files that are older than the newest one by more than `oldest`, seven
    days unless told; a table copied with its old time would be lost. The names of the
    tables within that age are kept on the driver, one per table of many files.
    """
    limit = ("maxFilesPerTrigger", files_per_batch) if bytes_per_batch is None else (
        "maxBytesPerTrigger", bytes_per_batch)
    return spark.readStream.schema(FILES).option(*limit).option("maxFileAge", oldest).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All findings stored so far, one per key.

    Every batch is a folder of its own, and a batch that runs again after a failure
    replaces it. A key stored several times, in spans of time further apart than the
    horizon, keeps the row that was seen first.
    """
    schema = T.StructType([*FINDINGS.fields, T.StructField("seen_at", T.TimestampType())])
    first = F.min(F.struct("seen_at", "snippet", "confidence", "evidence")).alias("first")
    return spark.read.schema(schema).parquet(f"{path}/run=*/batch=*").groupBy(*KEY).agg(first).select(
        *KEY, "first.snippet", "first.confidence", "first.evidence")


def new_findings(files: DataFrame, checks=None, horizon: str = HORIZON) -> DataFrame:
    """Findings of a stream of files with `seen_at`, one per key within the horizon.

    The clock is the arrival of a batch, not the time of a file: arrivals never go back, so
    a file that comes late is scanned like any other, where the watermark of a file time
    would drop it. The state holds the keys of the last `horizon` and no more.
    """
    found = rule_scan(files, checks).withColumn("seen_at", F.current_timestamp())
    return found.withWatermark("seen_at", horizon).dropDuplicatesWithinWatermark(KEY)


def stream_rule_scan(files: DataFrame, out: str, state: str, checks=None,
                     horizon: str = HORIZON) -> StreamingQuery:
    """Scan every arriving file once and add its findings to `out`.

    A batch reads its own files and the state store; what was stored before is never
    read. Folders carry the stream, told by its checkpoint, and the number of the batch.
    """
    run = hashlib.sha256(state.encode()).hexdigest()[:16]

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/run={run}/batch={number}")

    return (
        new_findings(files, checks, horizon).writeStream.foreachBatch(add)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )


def replay(files: DataFrame, checks=None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Write a files table as arriving batches and stream it to the end.

    The state keeps its number of partitions for good. The session's number may be meant
    for large shuffles; a batch that opens them all pays for each, so a few per core do.
    """
    spark = files.sparkSession
    base = f"{workspace(spark).folder}/{uuid.uuid4().hex}"
    files.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{base}/in")
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    partitions = min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with settings(spark, {"spark.sql.shuffle.partitions": partitions, **fine_scans(spark)}):
        running = stream_rule_scan(
            read_batches(spark, f"{base}/in", bytes_per_batch=batch_bytes), f"{base}/out", f"{base}/state", checks)
        running.awaitTermination()
    return stored(spark, f"{base}/out")
