"""Session settings."""

from pyspark.sql import functions as F

from tradewind.session import BROADCAST, TASK_BYTES, bound_broadcasts, bound_tasks, materialise


def test_small_files_with_many_rows_are_not_broadcast(spark):
    """Files below Spark's 10 MB whose rows take far more meet by merge; a threshold that a session chose stays."""
    rows = materialise(spark.range(900_000).select("id", F.lit("a name that many rows share").alias("name")), "packed")
    rows.limit(1).collect()
    kept = {key: spark.conf.get(key) for key in BROADCAST}
    try:
        for key in BROADCAST:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760b")
        join = lambda: rows.join(rows.select("id", F.col("name").alias("other")), "id")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" in join()
        bound_broadcasts(spark)
        assert "Broadcast" not in join()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
        bound_broadcasts(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "256k"
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_well_packed_rows_are_read_by_many_tasks(spark):
    """Texts that pack to a hundredth would all meet in a few tasks; a size that a session chose stays."""
    kept = {key: spark.conf.get(key) for key in [
        *TASK_BYTES, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.shuffle.partitions"]}
    rows = spark.range(400_000, numPartitions=4).select(F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    tasks = lambda: len(rows.repartition("id").select("text", F.spark_partition_id().alias("task")).groupBy(
        "task").agg(F.max("text")).collect())
    try:
        for key in TASK_BYTES:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        before = tasks()
        bound_tasks(spark)
        assert before == 1 and tasks() > 2
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20m")
        bound_tasks(spark)
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "20m"
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
