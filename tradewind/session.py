"""Session defaults and the shared folder for materialised intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
# Spark judges a table that it reads by the size of its packed files, whose rows take ten times that and more in the
# driver; what it has shuffled it knows by the size of the rows.
BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
# A task reads so many packed bytes of a shuffle, and a partition from the second figure on is split in a join. Equal
# texts pack to a thirtieth and less, so 64 MB, Spark's default, become gigabytes in the sorts of a task.
TASK_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32m"}


def build_session(app: str = "tradewind", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle partition counts are left to the cluster: adaptive execution merges
    small partitions and splits skewed ones, so the initial number may be generous.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **BROADCAST,
        **TASK_BYTES,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_broadcasts(spark: SparkSession) -> None:
    """The settings of BROADCAST for a session made elsewhere; one that chose a threshold keeps it."""
    if spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b":  # Spark's default
        for key, value in BROADCAST.items():
            spark.conf.set(key, value)


def bound_tasks(spark: SparkSession) -> None:
    """The settings of TASK_BYTES for a session made elsewhere; one that chose a size keeps it."""
    if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "67108864b":  # Spark's default
        for key, value in TASK_BYTES.items():
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only on one machine, where `spark.checkpoint.dir` is unset (tests), a fresh local folder
    is made and remembered in the session; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tradewind-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Owns the intermediate tables written inside the block and removes them when it ends.

    Results that read such tables have to be written or collected inside the block.
    """
    before = len(_WRITTEN)
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for path in _WRITTEN[before:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        del _WRITTEN[before:]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    Used where a result feeds several later branches: it is computed once, and a
    lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
