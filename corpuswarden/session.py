"""Session settings, written intermediate tables and size-checked joins."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side counted below this many rows is sent to every executor. The rows joined
# through `sized_join` are narrow (keys and a few numbers), so this stays near 100 MB.
BROADCAST_ROWS = 1_000_000
# Splits of a scan per core where patterns run on what is read: texts of equal size take very
# different times.
TASKS_PER_CORE = 3
# Keeps the state of streams on disk rather than in executors' memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(cores: str = "*", shuffle_partitions: int = 8, **settings) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpus-audit")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
    )
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


_OWN_DIRS: dict[str, str] = {}
_RUNS: dict[str, list[Workspace]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that must outlive a lost executor.

    It is the one the cluster names in `spark.checkpoint.dir`. Only a local session
    that names none gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _OWN_DIRS:
        _OWN_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="corpus-audit-")
    return _OWN_DIRS[context.applicationId]


class Workspace:
    """Owner of the intermediate tables of one run; closing it deletes them.

    Inside `with Workspace(spark):` every intermediate table is written under the run's
    folder. What a run returns must be stored or collected before it closes.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"

    def __enter__(self) -> Workspace:
        _RUNS.setdefault(self.spark.sparkContext.applicationId, []).append(self)
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        """Delete the folder; the file system may be any that Spark reads."""
        runs = _RUNS.get(self.spark.sparkContext.applicationId, [])
        if self in runs:
            runs.remove(self)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def workspace(spark: SparkSession) -> Workspace:
    """The innermost open workspace; without any, one that lasts as long as the session."""
    runs = _RUNS.setdefault(spark.sparkContext.applicationId, [])
    if not runs:
        runs.append(Workspace(spark))
    return runs[-1]


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Session settings for what is started inside; what held before holds again afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def fine_scans(spark: SparkSession) -> dict[str, object]:
    """Settings under which a scan has several splits per core."""
    return {"spark.sql.files.minPartitionNum": TASKS_PER_CORE * spark.sparkContext.defaultParallelism}


def write_once(df: DataFrame, partition_by: str | None = None, **options: str) -> DataFrame:
    """Write `df` to the workspace's folder and read it back.

    The result is read many times by the relational checks. A written table keeps
    the costly text pass from running again, survives lost executors, and gives
    Catalyst true sizes for its join choices. Before a partitioned write the rows are
    rebalanced on the partition column: AQE sizes the files and splits a hot value, so
    there are not as many files as tasks times values. `options` go to the writer.
    """
    spark = df.sparkSession
    path = f"{workspace(spark).folder}/{uuid.uuid4().hex}"
    if partition_by:
        df.hint("rebalance", partition_by).write.options(**options).partitionBy(partition_by).parquet(path)
    else:
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large left side to a narrow right side that is usually small.

    The right side is written and counted. Up to `max_rows` it is broadcast and the
    left side does not move; beyond that both sides shuffle on the key and AQE
    splits hot partitions.
    """
    right = write_once(right)
    if right.count() <= max_rows:
        right = F.broadcast(right)
    else:
        right = right.hint("merge")
    return left.join(right, on, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition an input that has fewer splits than the cluster has cores.

    Pattern matching is bound by CPU, so a table stored as one small file would use
    one core. A large table already has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores, *keys)
