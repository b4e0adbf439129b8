"""Event topics as batch or streaming DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import TOPICS, from_wire

#: What a message bus delivers of a record, and what files of its records hold.
RECORD = "value string, partition int, offset long"


def read_events(spark: SparkSession, topic: str, path: str | None = None, *, fmt: str = "parquet",
                streaming: bool = False, records: bool = False, **options: str) -> DataFrame:
    """Rows of a topic with its fixed schema, columns in snake_case.

    Files (parquet, json) are read with the declared schema, never an inferred one. With `records` they hold records
    of a bus (RECORD) instead, one event as JSON in `value`. Other formats, such as a message bus whose connector the
    cluster provides, deliver such a `value` too.
    """
    schema = TOPICS[topic]
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if fmt in ("parquet", "json", "orc"):
        if records:
            return events_of(reader.schema(RECORD).load(path), topic)
        return from_wire(reader.schema(schema).load(path))
    raw = reader.load(path) if path else reader.load()
    return events_of(raw, topic)


def read_records(spark: SparkSession, path: str, *, fmt: str = "parquet", streaming: bool = False, **options: str) -> DataFrame:
    """Records of a bus (RECORD) from files, in a batch or as a stream."""
    return (spark.readStream if streaming else spark.read).format(fmt).options(**options).schema(RECORD).load(path)


def events_of(records: DataFrame, topic: str) -> DataFrame:
    """The events in the `value` of records. Values that are no JSON object give no row."""
    parsed = records.select(F.from_json(F.col("value").cast("string"), TOPICS[topic]).alias("e"))
    first = TOPICS[topic].fields[0].name
    return from_wire(parsed.where(F.col("e").isNotNull() & F.col(f"e.{first}").isNotNull()).select("e.*"))


@dataclass(frozen=True)
class OffsetLog:
    """How far each partition of a topic has been taken, one small table for each batch of a stream.

    A bus delivers a partition's records in order and may deliver some again. `fresh` leaves those that no earlier batch
    took; a batch that runs again sees the marks it saw before, so it gives the same rows and replaces its own mark.
    """

    root: str

    def _marks(self, spark: SparkSession, before: int | None) -> DataFrame:
        stored = spark.read.schema("partition int, upto long, batch long")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], "partition int, upto long")
        marks = stored.parquet(self.root)
        marks = marks if before is None else marks.where(F.col("batch") < before)
        return marks.groupBy("partition").agg(F.max("upto").alias("upto"))

    def marks(self, spark: SparkSession) -> DataFrame:
        """(partition, upto): the last offset taken of each partition."""
        return self._marks(spark, None)

    def fresh(self, records: DataFrame, batch: int) -> DataFrame:
        """Records of a batch that no earlier batch took, each once."""
        marks = self._marks(records.sparkSession, batch)
        new = records.join(F.broadcast(marks), "partition", "left").where(  # one row for each partition of the topic
            F.col("upto").isNull() | (F.col("offset") > F.col("upto"))).drop("upto")
        return new.dropDuplicates(["partition", "offset"])

    def commit(self, records: DataFrame, batch: int) -> None:
        """Mark the records of a batch as taken; called after its rows are written."""
        records.groupBy("partition").agg(F.max("offset").alias("upto")).write.mode("overwrite").parquet(
            f"{self.root}/batch={batch}")
