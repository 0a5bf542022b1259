"""Findings kept in buckets of their key, so that a diff moves only the newer run.

Rows are stored once per key, in files by the hash of the whole key and sorted by it. A
later run is shuffled to the same number of buckets and joined; the stored side is read
where it lies, however many runs are compared with it. The key of a hot repository has
its files, checks and lines in it, so its findings spread over all buckets. Keys must not
be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuswarden.operators.findings import KEY
from corpuswarden.schema import FINDINGS

BUCKETS = 64  # tasks that read the table; a few hundred MB each at most is a good size
PAYLOAD = ["snippet", "confidence", "evidence"]


def _one_per_key(findings: DataFrame) -> DataFrame:
    """The greatest row of each key, as in a diff of two runs."""
    return findings.groupBy(*KEY).agg(F.max(F.struct(*PAYLOAD)).alias("row")).select(*KEY, "row.*")


def store(findings: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Write `findings` below `path` as the bucketed table `table`, replacing it."""
    # Dealt as the buckets are, each task writes one file of one bucket.
    _one_per_key(findings).select(FINDINGS.names).repartition(buckets, *KEY).write.mode("overwrite").bucketBy(
        buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(table)


def attach(spark: SparkSession, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The stored table under its name, for a session whose catalog doesn't know it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in FINDINGS)
    keys = ", ".join(f"`{name}`" for name in KEY)
    place = path.replace("'", "\\'")
    spark.sql(f"create table if not exists {table} ({columns}) using parquet clustered by ({keys}) "
              f"sorted by ({keys}) into {buckets} buckets location '{place}'")
    return spark.table(table)


def diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Status of each finding key since the stored run, with the whole newer row."""
    old = stored.select(*KEY, F.struct(*PAYLOAD).alias("old"))
    new = _one_per_key(current).select(*KEY, F.struct(*PAYLOAD).alias("new"))
    status = (F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "fixed")
              .otherwise("unchanged"))
    return old.hint("merge").join(new, KEY, "full").select(
        *KEY, status.alias("status"), F.coalesce("new", "old").alias("row")).select(*KEY, "status", "row.*")
