"""A vector index that outlives a search: centres beside a table partitioned by leaf, changed leaf by leaf.

Below the root, `vectors/version=V/leaf=L` holds the vectors that version V wrote for a leaf, and
`manifests/snapshot=S` says for every leaf its centre, its number of vectors, how far they lie from the centre and which
version holds them. A change writes the leaves it touches under a new version and then a new manifest; files of older
snapshots stay as they are, so whoever reads one keeps its rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import fresh_path

CENTRE_BYTES = 32 * 1024 * 1024  # bound of the leaf centres that the driver and every task get
TRAINING_FACTOR, TRAINING_STEPS = 8, 4  # vectors per centre that train the centres, and rounds
LEAF_VECTORS = 1024
SPLIT_FACTOR = 4  # a leaf is split when it has so many times the vectors of an average one
VECTORS = ("id string, embedding array<float>, category_id string, brand string, price double, rating double, "
           "angle double, version long, leaf int")
MANIFEST = ("leaf int, centre array<double>, vectors long, radius double, version long, dimension int, bound long, "
            "snapshot long")
COLUMNS = ["id", "embedding", "category_id", "brand", "price", "rating"]


def index_rows(index: DataFrame) -> DataFrame:
    return index.select(
        F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"),
        F.col("category_id").cast("string").alias("category_id"), F.lower("brand").alias("brand"),
        F.col("price").cast("double").alias("price"), F.col("rating").cast("double").alias("rating"))


def unit_rows(embeddings: pd.Series) -> np.ndarray:
    """Unit vectors as rows; a zero vector stays zero and matches nothing."""
    if not len(embeddings):
        return np.zeros((0, 0))
    return unit(np.stack(embeddings.to_numpy()))


def unit(matrix: np.ndarray) -> np.ndarray:
    m = matrix.astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def of_dimension(rows: DataFrame, dimension: int) -> DataFrame:
    """Rows whose vector has that many numbers and no null among them."""
    return rows.filter((F.size("embedding") == dimension) & ~F.exists("embedding", lambda x: x.isNull()))


def _dimension(rows: DataFrame) -> tuple[int, int]:
    """The vector length that most rows have, and how many do; (0, 0) without vectors."""
    sizes = rows.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.col("n").desc(), "d").limit(1).collect()
    return (most[0]["d"], most[0]["n"]) if most else (0, 0)


def leaf_count(vectors: int, dimension: int) -> int:
    """Leaves of an index: the square root of its size, as long as a leaf has LEAF_VECTORS on average and the centres
    stay below CENTRE_BYTES. Smaller leaves would only send every query to more places."""
    return max(1, min(math.isqrt(max(vectors, 1)), -(-vectors // LEAF_VECTORS), CENTRE_BYTES // (8 * max(dimension, 1))))


def _centres_of(vectors: np.ndarray, leaves: int) -> np.ndarray:
    """Unit centres by a few rounds of spherical k-means."""
    centres = vectors[:leaves].copy()
    for _ in range(TRAINING_STEPS):
        at = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def train_centres(rows: DataFrame, leaves: int) -> np.ndarray:
    """Centres trained on a bounded sample: the TRAINING_FACTOR * leaves vectors with the smallest id hashes."""
    some = rows.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(TRAINING_FACTOR * leaves)
    return _centres_of(unit_rows(some.toPandas()["embedding"]), leaves)


def _nearest(leaves: np.ndarray, centres: np.ndarray):
    """The nearest of the given leaves, and the angle to its centre."""
    @F.pandas_udf("leaf int, angle double")
    def leaf(embeddings: pd.Series) -> pd.DataFrame:
        if not len(embeddings):
            return pd.DataFrame({"leaf": np.zeros(0, "int32"), "angle": np.zeros(0)})
        sims = unit_rows(embeddings) @ centres.T
        at = sims.argmax(axis=1)
        return pd.DataFrame({"leaf": leaves[at].astype("int32"),
                             "angle": np.arccos(np.clip(sims[np.arange(len(at)), at], -1, 1))})
    return leaf


@dataclass(frozen=True)
class LeafIndex:
    """A snapshot of a stored index; one row of each array for each leaf."""

    root: str
    snapshot: int
    dimension: int
    bound: int
    leaf: np.ndarray
    centre: np.ndarray
    vectors: np.ndarray
    radius: np.ndarray
    version: np.ndarray

    def manifest(self, spark: SparkSession) -> DataFrame:
        """The manifest's rows; at most one for each leaf, so it may be broadcast."""
        return spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests").where(
            (F.col("snapshot") == self.snapshot) & (F.col("vectors") > 0))

    def of_leaves(self, spark: SparkSession, leaves: DataFrame) -> DataFrame:
        """Vectors of the leaves in `leaves` (leaf, version, ...: at most one row a leaf), with its columns. Other leaves'
        folders are not read: Spark prunes the partitions by the rows of `leaves`."""
        return self._stored(spark).join(F.broadcast(leaves), ["leaf", "version"])

    def rows(self, spark: SparkSession) -> DataFrame:
        """The index as a plain table."""
        return self.of_leaves(spark, self.manifest(spark).select("leaf", "version")).select(*COLUMNS)

    def _stored(self, spark: SparkSession) -> DataFrame:
        if not self.vectors.sum():
            return spark.createDataFrame([], VECTORS)
        return spark.read.schema(VECTORS).parquet(f"{self.root}/vectors")


def _write_leaves(placed: DataFrame, root: str, version: int) -> dict[int, tuple[int, float]]:
    """Write rows (COLUMNS, leaf, angle) of a version; the number of vectors and the radius of each leaf."""
    path = f"{root}/vectors/version={version}"
    placed.hint("rebalance", "leaf").write.mode("overwrite").partitionBy("leaf").parquet(path)
    spark = placed.sparkSession
    found = spark.read.schema(VECTORS.replace(", version long", "")).parquet(path).groupBy("leaf").agg(
        F.count("*").alias("n"), F.max("angle").alias("far")).collect()  # at most one row a leaf
    return {r["leaf"]: (r["n"], r["far"]) for r in found}


def _write_manifest(spark: SparkSession, index: LeafIndex) -> LeafIndex:
    rows = [(int(a), [float(x) for x in c], int(n), float(r), int(v), index.dimension, index.bound)
            for a, c, n, r, v in zip(index.leaf, index.centre, index.vectors, index.radius, index.version)]
    spark.createDataFrame(rows, MANIFEST.replace(", snapshot long", "")).coalesce(1).write.mode("overwrite").parquet(
        f"{index.root}/manifests/snapshot={index.snapshot}")
    return index


def build_leaf_index(index: DataFrame, root: str | None = None, leaves: int | None = None) -> LeafIndex:
    """Train centres and write all vectors by leaf as the first snapshot below `root` (default: a new folder).

    Rows without a vector, or with one of another dimension than most, are left out. Leaves grow with the square root of
    the index.
    """
    spark, rows = index.sparkSession, index_rows(index)
    root = root or fresh_path(spark, "leaf-index")
    dimension, n = _dimension(rows)
    leaves = min(leaves or leaf_count(n, dimension), n)
    rows = of_dimension(rows, dimension)
    centres = train_centres(rows, leaves) if leaves else np.zeros((0, dimension))
    number = np.arange(len(centres))
    stats = {} if not leaves else _write_leaves(
        rows.withColumn("_at", _nearest(number, centres)("embedding")).select(*COLUMNS, "_at.leaf", "_at.angle"), root, 0)
    return _write_manifest(spark, LeafIndex(
        root, 0, dimension, SPLIT_FACTOR * max(LEAF_VECTORS, -(-n // max(leaves, 1))), number, centres,
        np.array([stats.get(i, (0, 0.0))[0] for i in number], dtype=np.int64),
        np.array([stats.get(i, (0, -np.pi))[1] for i in number]), np.zeros(len(number), np.int64)))


def open_leaf_index(spark: SparkSession, root: str, snapshot: int | None = None) -> LeafIndex:
    """A snapshot of a stored index, the newest by default."""
    stored = spark.read.schema(MANIFEST).parquet(f"{root}/manifests")
    if snapshot is None:
        snapshot = stored.agg(F.max("snapshot")).first()[0]
    rows = stored.where(F.col("snapshot") == snapshot).orderBy("leaf").collect()  # at most CENTRE_BYTES of centres
    dimension = rows[0]["dimension"] if rows else 0
    column = lambda name, kind: np.array([r[name] for r in rows], dtype=kind)
    return LeafIndex(root, snapshot, dimension, rows[0]["bound"] if rows else SPLIT_FACTOR * LEAF_VECTORS,
                     column("leaf", np.int64), column("centre", float).reshape(len(rows), dimension),
                     column("vectors", np.int64), column("radius", float), column("version", np.int64))


def update_leaf_index(spark: SparkSession, index: LeafIndex, upserts: DataFrame | None = None,
                      deletes: DataFrame | None = None) -> LeafIndex:
    """A new snapshot with the rows of `upserts` added or replaced by id and the ids of `deletes` gone.

    New vectors go to the nearest stored centre. Touched are the leaves that get one and those that hold a changed id (the
    ids of the index are read for that, nothing else of them); only these are read and written. A touched leaf over
    the index's bound is split by centres of its own, so leaves keep their size. An id must be once in `upserts`. Without an
    earlier vector the update builds the index.
    """
    if not len(index.leaf):
        if upserts is None:
            return index
        built = build_leaf_index(upserts if deletes is None else upserts.join(deletes.select("id"), "id", "left_anti"), index.root)
        return built
    ids = None
    for part in (upserts, deletes):
        if part is not None:
            own = part.select(F.col("id").cast("string").alias("id"))
            ids = own if ids is None else ids.unionByName(own)
    if ids is None:
        return index
    ids = ids.distinct()
    manifest = index.manifest(spark).select("leaf", "version")
    held = index.of_leaves(spark, manifest).select("id", "leaf").join(ids, "id", "left_semi").select("leaf").distinct()
    touched = {r["leaf"] for r in held.collect()}  # at most one row a leaf
    new = None
    if upserts is not None:
        rows = of_dimension(index_rows(upserts), index.dimension)
        if deletes is not None:
            rows = rows.join(deletes.select(F.col("id").cast("string").alias("id")), "id", "left_anti")
        new = rows.withColumn("_at", _nearest(index.leaf, index.centre)("embedding")).select(*COLUMNS, "_at.leaf", "_at.angle")
        touched |= {r["leaf"] for r in new.select("leaf").distinct().collect()}
    if not touched:
        return index
    snapshot = index.snapshot + 1
    own = spark.createDataFrame([(int(i),) for i in sorted(touched)], "leaf int")
    kept = index.of_leaves(spark, manifest.join(F.broadcast(own), "leaf")).select(*COLUMNS, "leaf", "angle").join(
        ids, "id", "left_anti")
    placed = kept if new is None else kept.unionByName(new)
    leaf, centre = list(index.leaf), list(index.centre)
    split, placed = _split(placed, index, leaf, centre)
    touched |= split
    stats = _write_leaves(placed, index.root, snapshot)
    state = {int(i): (n, r, v) for i, n, r, v in zip(index.leaf, index.vectors, index.radius, index.version)}
    state.update({i: (*stats.get(i, (0, -np.pi)), snapshot) for i in touched})
    return _write_manifest(spark, LeafIndex(
        index.root, snapshot, index.dimension, index.bound, np.array(leaf), np.array(centre),
        *[np.array([state[int(i)][c] for i in leaf]) for c in range(3)]))


def _split(placed: DataFrame, index: LeafIndex, leaf: list, centre: list) -> tuple[set[int], DataFrame]:
    """Numbers of new leaves and the rows with leaves over the bound split; `leaf` and `centre` get the new leaves."""
    counts = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    room = CENTRE_BYTES // (8 * index.dimension) - len(leaf)
    target, parts = -(-index.bound // SPLIT_FACTOR), {}
    for own in sorted(i for i, n in counts.items() if n > index.bound):
        parts[own] = min(-(-counts[own] // target), room + 1)
        room -= parts[own] - 1
    parts = {i: n for i, n in parts.items() if n > 1}
    if not parts:
        return set(), placed
    spark = placed.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(int(i), int(n)) for i, n in parts.items()], "leaf int, parts int"))
    first = F.row_number().over(W.partitionBy("leaf").orderBy(F.xxhash64("id"), "id"))
    some = placed.select("id", "embedding", "leaf").join(wanted, "leaf").withColumn("_n", first).where(
        F.col("_n") <= TRAINING_FACTOR * F.col("parts")).orderBy("leaf", "_n").toPandas()  # bounded like the centres
    below, added = {}, set()
    for own, sample in some.groupby("leaf"):
        centres = _centres_of(unit_rows(sample["embedding"]), parts[own])
        numbers = [own, *range(max(leaf) + 1, max(leaf) + len(centres))]
        centre[leaf.index(own)] = centres[0]
        leaf += numbers[1:]
        centre += list(centres[1:])
        added |= set(numbers)
        below[own] = (np.array(numbers), centres)

    @F.pandas_udf("leaf int, angle double")
    def again(embeddings: pd.Series, leaves: pd.Series, angles: pd.Series) -> pd.DataFrame:
        out_leaf, out_angle = leaves.to_numpy().astype("int32"), angles.to_numpy().astype(float)
        for own in np.intersect1d(out_leaf, list(below)):
            numbers, centres = below[own]
            at = np.flatnonzero(leaves.to_numpy() == own)
            sims = unit_rows(embeddings.iloc[at]) @ centres.T
            best = sims.argmax(axis=1)
            out_leaf[at] = numbers[best]
            out_angle[at] = np.arccos(np.clip(sims[np.arange(len(at)), best], -1, 1))
        return pd.DataFrame({"leaf": out_leaf, "angle": out_angle})

    moved = placed.withColumn("_at", again("embedding", "leaf", "angle")).select(*COLUMNS, "_at.leaf", "_at.angle")
    return added, moved
