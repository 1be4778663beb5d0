"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every ferrule job relies on.  AQE re-plans joins at runtime: a side
# is broadcast only when its *measured* size is below the broadcast threshold,
# otherwise the sort-merge plan stays -- that is the size check behind every
# dimension join in this package.  Skew-join splitting covers hot tags.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # streaming state (windows, dedup) off-heap in RocksDB rather than on the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ferrule") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    # Python workers import this package too: they inherit the path of the process that starts the JVM
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        os.environ["PYTHONPATH"] = os.pathsep.join([home, *filter(None, known)])
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    elif not master:
        # cluster: AQE can merge small shuffle partitions but never split an oversized
        # one, so start from many and let the 128 MB advisory size coalesce them
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                                 os.environ.get("FERRULE_INITIAL_PARTITIONS", "8192"))
    builder = builder.config("spark.driver.memory", os.environ.get("FERRULE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_SCRATCH: dict = {}


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``)."""
    try:
        value = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001 -- some deployments hide core confs from the session
        value = None
    if not value:
        try:
            value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) \
                or spark.sparkContext.getCheckpointDir()
        except Exception:  # noqa: BLE001 -- no SparkContext (remote session)
            value = None
    return value or _LOCAL_SCRATCH.get(id(spark))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; without that setting a session whose executors
    are other processes is refused, since a driver-made local folder would be a different
    folder on every executor.  Only a plain local session gets a private folder under /tmp.
    """
    existing = checkpoint_dir(spark)
    if existing:
        return existing
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(
            "spark.checkpoint.dir must name a folder that the driver and all executors share "
            f"(master is {master!r})")
    local = tempfile.mkdtemp(prefix="ferrule-ckpt-", dir="/tmp")
    _LOCAL_SCRATCH[id(spark)] = local
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder; what is written there goes when the application ends."""
    path = os.path.join(ensure_checkpoint_dir(spark), kind, uuid.uuid4().hex)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut_lineage(df):
    """Cut lineage by writing the frame as a Parquet table under the shared checkpoint
    folder and reading it back.

    Preferred over ``Dataset.checkpoint``: an eager checkpoint computes its plan twice
    (count, then write), and the checkpointed relation keeps the partitioning claim of
    the pre-AQE plan even when AQE coalesced the partitions -- a later join can then
    zip mismatched partitions.  A read-back table claims nothing, carries real size
    statistics for AQE's broadcast decision, and survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, "tables")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # known schema: no footer inference


def cut_lineage_counting(df, **metrics):
    """``cut_lineage`` that also returns the values of aggregate expressions over the written rows, taken
    while they are written: an iterative algorithm then needs one job a round."""
    from pyspark.sql import Observation

    seen = Observation()
    out = cut_lineage(df.observe(seen, *[column.alias(name) for name, column in metrics.items()]))
    return out, seen.get
