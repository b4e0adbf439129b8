"""A keyword index kept up to date: segments of postings, each with the products it replaces.

Below the root, `postings/segment=N` and `blocks/segment=N` hold the postings of segment N and their blocks, `dead/segment=N`
the ids that segment N changed or removed: postings of these ids in older segments no longer count. `manifests/snapshot=S`
lists the segments of a snapshot. A batch of changes writes a segment of the changed products alone; segments of like size
are merged, newest first, so that there are few of them and a posting is rewritten a logarithmic number of times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fresh_path

MANIFEST = "segment long, born long, postings long, snapshot long"
POSTINGS = ("term string, product_id string, weight long, by_length long, length int, level int, price double, "
            "rating double, segment long")
BLOCKS = ("term string, level int, n long, top long, top_by_length long, _low double, _high double, _best double, "
          "segment long")
DEAD = "product_id string, born long, segment long"
MERGE_RATIO = 2


@dataclass(frozen=True)
class SearchIndex:
    """A snapshot: its segments, oldest first, as (number, the snapshot its contents are of, postings)."""

    root: str
    snapshot: int
    segments: tuple[tuple[int, int, int], ...]

    def _read(self, spark: SparkSession, what: str, schema: str, segments=None) -> DataFrame:
        numbers = [s[0] for s in (self.segments if segments is None else segments)]
        if not numbers:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.root}/{what}").where(F.col("segment").isin(numbers))

    def _live(self, spark: SparkSession, segments) -> DataFrame:
        """Postings of segments without those that a newer segment of the snapshot replaced."""
        rows = self._read(spark, "postings", POSTINGS, segments)
        later = [s for s in self.segments if s[1] > min((s[1] for s in segments), default=0)]
        if not later:
            return rows.drop("segment")
        dead = self._read(spark, "dead", DEAD, later).groupBy("product_id").agg(F.max("born").alias("_dead"))
        born = F.create_map(*[F.lit(x).cast("long") for s in self.segments for x in (s[0], s[1])])
        aged = rows.withColumn("_born", F.element_at(born, F.col("segment")))
        return aged.join(dead, "product_id", "left").where(
            F.col("_dead").isNull() | (F.col("_born") >= F.col("_dead"))).drop("_dead", "_born", "segment")

    def postings(self, spark: SparkSession) -> DataFrame:
        return self._live(spark, self.segments)

    def blocks(self, spark: SparkSession) -> DataFrame:
        """Blocks of all segments. Replaced postings are still counted in them, so their bounds are never too low."""
        rows = self._read(spark, "blocks", BLOCKS)
        return rows if len(self.segments) < 2 else rows.groupBy("term", "level").agg(
            F.sum("n").alias("n"), F.max("top").alias("top"), F.max("top_by_length").alias("top_by_length"),
            F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_best").alias("_best"))


def _write_segment(index: SearchIndex, rows: DataFrame, dead: DataFrame, number: int) -> int:
    """Write postings, their blocks and the dead ids of a segment; the number of postings."""
    from ..operators.search import term_blocks

    spark = rows.sparkSession
    rows = rows.select("term", F.col("product_id").cast("string").alias("product_id"), "weight", "by_length", "length", "level",
                       F.col("price").cast("double").alias("price"), F.col("rating").cast("double").alias("rating"))
    path = f"{index.root}/postings/segment={number}"
    rows.repartitionByRange("term", "level").sortWithinPartitions("term", "level").write.mode("overwrite").parquet(path)
    own = spark.read.schema(POSTINGS.replace(", segment long", "")).parquet(path)
    term_blocks(own).write.mode("overwrite").parquet(f"{index.root}/blocks/segment={number}")
    dead.write.mode("overwrite").parquet(f"{index.root}/dead/segment={number}")
    return own.count()


def _write_manifest(spark: SparkSession, index: SearchIndex) -> SearchIndex:
    spark.createDataFrame(list(index.segments), MANIFEST.replace(", snapshot long", "")).coalesce(1).write.mode(
        "overwrite").parquet(f"{index.root}/manifests/snapshot={index.snapshot}")
    return index


def open_search_index(spark: SparkSession, root: str, snapshot: int | None = None) -> SearchIndex:
    """A snapshot of a stored index, the newest by default."""
    stored = spark.read.schema(MANIFEST).parquet(f"{root}/manifests")
    if snapshot is None:
        snapshot = stored.agg(F.max("snapshot")).first()[0]
    rows = stored.where(F.col("snapshot") == snapshot).collect()  # a few segments
    return SearchIndex(root, snapshot, tuple(sorted(((r.segment, r.born, r.postings) for r in rows), key=lambda s: s[1])))


def build_search_index(products: DataFrame, root: str | None = None) -> SearchIndex:
    """The postings of all active products as the first segment below `root` (default: a new folder)."""
    from ..operators.search import postings

    spark = products.sparkSession
    index = SearchIndex(root or fresh_path(spark, "search-index"), 0, ())
    n = _write_segment(index, postings(products), spark.createDataFrame([], "product_id string, born long"), 0)
    return _write_manifest(spark, SearchIndex(index.root, 0, ((0, 0, n),)))


def update_search_index(spark: SparkSession, index: SearchIndex, changed: DataFrame, deleted: DataFrame | None = None,
                        merge_ratio: int = MERGE_RATIO) -> SearchIndex:
    """A new snapshot in which the rows of `changed` replace the products of their ids and the ids in `deleted` are gone.

    Only the changed products are tokenised. Products that are no longer active only lose their postings. While the newest
    segment has at least 1 / merge_ratio of the postings of the one before, the two are merged, replaced postings left
    out. Files of older snapshots stay.
    """
    from ..operators.search import postings

    born = index.snapshot + 1
    ids = changed.select(F.col("id").cast("string").alias("product_id"))
    if deleted is not None:
        ids = ids.unionByName(deleted.select(F.col("id").cast("string").alias("product_id")))
        changed = changed.join(deleted.select("id"), "id", "left_anti")
    number = 1 + max(born, max((s[0] for s in index.segments), default=0))
    dead = ids.distinct().withColumn("born", F.lit(born).cast("long"))
    n = _write_segment(index, postings(changed), dead, number)
    segments = [*index.segments, (number, born, n)]
    while len(segments) > 1 and segments[-1][2] * merge_ratio >= segments[-2][2]:
        whole = SearchIndex(index.root, born, tuple(segments))
        pair, number = segments[-2:], number + 1
        # what the older one replaced in still older segments stays replaced
        dead = whole._read(spark, "dead", DEAD, pair).groupBy("product_id").agg(F.max("born").alias("born"))
        n = _write_segment(whole, whole._live(spark, pair), dead, number)
        segments = [*segments[:-2], (number, born, n)]
    return _write_manifest(spark, SearchIndex(index.root, born, tuple(segments)))
