"""Session construction and lineage-cut helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Target size of one shuffle partition: large enough to amortise task
# overhead, small enough to sort and aggregate in executor memory without
# heavy spilling.
PARTITION_BYTES = 256 * 1024 * 1024


def shuffle_partitions_for(shuffle_bytes: int, partition_bytes: int = PARTITION_BYTES,
                           floor: int = 200) -> int:
    """Initial shuffle partitions for a job whose largest shuffle moves
    ``shuffle_bytes``.

    AQE only merges small post-shuffle partitions (and splits skewed join
    partitions); it never splits an oversized aggregate partition. So the
    initial count must fit the largest shuffle, and AQE coalesces it down
    for the smaller ones. The row-level shuffles here move keys, partial
    per-document sums or the rare-token tail, not texts, so they are a small
    share of the input: 5 TB of shuffle gives 20,480 partitions."""
    return max(floor, -(-int(shuffle_bytes) // int(partition_bytes)))


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "driftlens", extra: dict | None = None,
                  shuffle_bytes: int | None = None) -> SparkSession:
    """A session tuned for the library: AQE on (coalescing, skew-join split),
    UI off, UTC, Arrow for pandas transfer. On a cluster, pass ``master=None``
    and let spark-submit decide; shuffle partitions then come from the cluster
    config, or from ``shuffle_bytes`` (see ``shuffle_partitions_for``), and AQE
    coalesces them at run time towards ``PARTITION_BYTES``."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions is None and shuffle_bytes:
        shuffle_partitions = shuffle_partitions_for(shuffle_bytes)
        conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = str(PARTITION_BYTES)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only when it is unset, and on a local
    master only (as in tests), is a fresh temporary folder set. On a cluster a machine-local folder would not
    survive the loss of the executor that wrote it, so an unset folder is
    an error there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get(CHECKPOINT_CONF, None)
    if not conf and not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder (e.g. on HDFS or an "
                           "object store) before cutting lineage on a cluster")
    path = conf or tempfile.mkdtemp(prefix="driftlens-ckpt-")
    if not conf:
        os.makedirs(path, exist_ok=True)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the
    loss of executors, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCOPES: list[list[str]] = []   # scratch paths made inside the open scopes


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, removed by the scope that it is made in."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Remove the scratch tables made inside once the block is left: for work whose result
    has been written or collected by then. A table that shall outlive an inner scope is
    written after it."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove_path(spark, path)


def write_scratch(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the checkpoint folder and read back: like
    ``cut_lineage``, but with column pruning and pushed filters for tables that are
    read several times."""
    spark = df.sparkSession
    path = scratch_path(spark, "scratch")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
