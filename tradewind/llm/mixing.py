"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .common import WORD, packed_rows

BLOCK = 256  # documents that one step of the reduction tree pairs with each other
NEAR = 1e-9  # a probability this near to 0 or 1 is 0 or 1


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """source, source_size, rank, target for the sources of (source, size) rows.

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes; none gets more than
    `cap` times its own size, and the excess goes to the others by weight. The share of weight 1 at which that comes
    to rest is found by one pass over the sources in the order in which they reach their caps. Windows without
    a partition see one row per source, never documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    sources = sources.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
    limit = F.col("source_size") * F.lit(float(cap))
    by_ratio = Window.orderBy("ratio", "rank")
    sources = sources.withColumn("limit", limit).withColumn("ratio", limit / F.col("weight"))
    everywhere = Window.partitionBy()
    sources = sources.withColumn("total", F.sum("source_size").over(everywhere).cast("double")).withColumn(
        "capped", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ).withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))).withColumn(
        "share", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    # the first source, in that order, whose cap is not below its share fixes the share of all that follow
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumn("level", F.first(
        F.when(F.col("ratio") >= F.col("share"), F.col("share")), ignorenulls=True).over(whole))
    return sources.select("source", "source_size", "rank",
                          F.least("limit", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def _unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on its parts alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") / F.lit(float(2 ** 53))


def _settle_pair(state: Column, item: Column, seed: int) -> Column:
    """Move probability between the open item and the next one until one of them is 0 or 1.

    What moves is mass, probability times words, so the words taken stay the same; the direction is drawn so that
    each probability keeps its mean.
    """
    a, b = state["open"], item
    ratio = b["mass"] / a["mass"]
    up = F.least(1 - a["p"], b["p"] * ratio)  # a gains what b can give
    down = F.least(a["p"], (1 - b["p"]) * ratio)
    rises = _unit(seed, a["key"], b["key"]) * (up + down) < down
    snap = lambda p: F.when(p < NEAR, 0.0).when(p > 1 - NEAR, 1.0).otherwise(p)
    pa = snap(a["p"] + F.when(rises, up).otherwise(-down))
    pb = snap(b["p"] - F.when(rises, up).otherwise(-down) / ratio)
    shape = lambda x, p: F.struct(x["key"].alias("key"), x["mass"].alias("mass"), p.alias("p"))
    first, second = shape(a, pa), shape(b, pb)
    settled = pa.isin(0.0, 1.0)
    done = F.concat(state["done"], F.array(F.when(settled, first).otherwise(second)))
    return F.struct(F.when(settled, second).otherwise(first).alias("open"), done.alias("done"))


def round_probabilities(items: DataFrame, seed: int = 11, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Settled items (key, up) and the open ones left, one a rank at most (rank, key, mass, p).

    items: (rank, key, mass > 0, 0 < p < 1); rank is the group whose mass is kept. A distributed reduction tree:
    the items of a group are dealt to blocks of some `block` items by hash, each block is folded pair by pair from the
    heaviest item down, which leaves one open item, and the open items of all blocks are the next level's
    items. A hot group has more blocks, not larger ones.
    """
    items, settled, level = materialise(items.select("rank", "key", "mass", "p"), "mix-items"), [], 0
    plain = lambda x: F.struct(x["key"].alias("key"), x["mass"].alias("mass"), x["p"].alias("p"))
    while True:
        counts = materialise(items.groupBy("rank").count(), "mix-counts")
        most = counts.agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        dealt = items.join(counts, "rank").withColumn("blocks", F.ceil(F.col("count") / block)).withColumn(
            "block", F.pmod(F.xxhash64(F.lit(seed + level), "key"), "blocks"))
        shape = F.struct((-F.col("mass")).alias("order"), "key", "mass", "p")
        lists = dealt.groupBy("rank", "block").agg(F.array_sort(F.collect_list(shape)).alias("list"))
        first = plain(F.element_at("list", 1))
        empty = F.filter(F.array(first), lambda x: F.lit(False))
        folded = lists.select("rank", F.aggregate(
            F.slice("list", 2, F.size("list")), F.struct(first.alias("open"), empty.alias("done")),
            lambda state, item: _settle_pair(state, item, seed)).alias("state"))
        folded = materialise(folded.select("rank", "state.open", "state.done"), "mix-folded")
        settled.append(folded.select(F.explode("done").alias("d")).select("d.key", (F.col("d.p") == 1).alias("up")))
        rest, done = folded.select("rank", "open.key", "open.mass", "open.p"), F.col("p").isin(0.0, 1.0)
        settled.append(rest.where(done).select("key", (F.col("p") == 1).alias("up")))
        items, level = materialise(rest.where(~done), "mix-open"), level + 1
    out = items.where("false").select("key", F.lit(True).alias("up"))
    for more in settled:
        out = out.unionByName(more)
    return out, items


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 11,
                tiers: tuple[int, ...] = (2048, 256, 0), id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, key.

    size is the number of words (runs of anything but ASCII white space); `target` the words its source shall give
    (`source_targets`); copies how often the mix takes the whole document (0 to `cap`), taken = copies * size.
    Every document of a source expects target / source_size copies: the whole part is taken as it is, the rest
    is a probability for one more. Probabilities are rounded in pairs with words as mass (`round_probabilities`),
    heavy documents first: `tiers` are the sizes above which documents are rounded together. What a tier's last open
    document takes too much or too little is given back by the probabilities of all lighter documents of its source,
    as far as they can bear either outcome, so probabilities keep their means and a source's taken words differ from
    its target by about one light document. The draws hash ids and texts: reruns agree, whatever the partitioning.

    Null texts have size 0 and are taken 0 words; null sources are one source, ranked last; null ids are told apart
    by their texts. Rows that agree in source, id and text are one item of their joint mass and get the same
    number of copies. An empty table gives no rows. Other columns are not looked at. key is the 64-bit hash of
    source, id and text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialise(rows.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"),
                                   row_key("doc_id", "source", "text").alias("key")), "mix-sizes")
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap))))
    sources = source_targets(rows, weights, cap).withColumn("expected", F.coalesce(expected, F.lit(0.0)))
    sources = materialise(sources.withColumn("whole", F.floor(F.col("expected") + NEAR)).withColumn(
        "p", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0))), "mix-sources")
    rows = rows.withColumnRenamed("source", "own").join(
        sources, F.col("own").eqNullSafe(F.col("source"))).drop("own", "source")
    items = materialise(rows.where((F.col("size") > 0) & (F.col("p") > NEAR)).groupBy("rank", "key").agg(
        F.sum("size").cast("double").alias("mass")), "mix-masses")
    lighter = materialise(items.groupBy("rank").agg(*[
        F.coalesce(F.sum(F.when(F.col("mass") <= t, F.col("mass"))), F.lit(0.0)).alias(f"below_{t}") for t in tiers]),
        "mix-lighter")
    shares, ups, upper = sources.select("rank", "p"), [], None
    for tier in tiers:
        own = items.where(F.col("mass") > tier) if upper is None else items.where(
            (F.col("mass") > tier) & (F.col("mass") <= upper))
        own = own.join(shares, "rank")
        ups.append(own.where(F.col("p") >= 1 - NEAR).select("key"))
        settled, left = round_probabilities(own.where((F.col("p") > NEAR) & (F.col("p") < 1 - NEAR)), seed)
        ups.append(settled.where("up").select("key"))
        left = left.select("rank", "key", "mass", F.col("p").alias("q")).withColumn(
            "up", _unit(seed, F.col("key")) < F.col("q"))
        ups.append(left.where("up").select("key"))
        most = F.greatest("q", 1 - F.col("q")) * F.col("mass")
        more = F.when(F.col("up"), 1 - F.col("q")).otherwise(-F.col("q")) * F.col("mass")
        below, p = F.col(f"below_{tier}"), F.col("p")
        part = F.least(F.lit(1.0), p * (1 - p) * below / most)  # the same for either outcome, so means are kept
        moved = F.when(more.isNotNull() & (below > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p - part * more / below)))
        shares = materialise(shares.join(lighter, "rank", "left").join(left, "rank", "left").select(
            "rank", F.coalesce(moved, p).alias("p")), "mix-shares")
        upper = tier
    taken_more = ups[0]
    for more in ups[1:]:
        taken_more = taken_more.unionByName(more)
    copies = F.col("whole") + F.coalesce(F.col("more"), F.lit(0))
    return rows.join(taken_more.select("key", F.lit(1).alias("more")), "key", "left").withColumn(
        "copies", copies.cast("long")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "key")


def row_key(id_col: str, source_col: str, text_col: str) -> Column:
    """The key that tells documents apart in the mix."""
    return F.xxhash64(F.col(source_col).cast("string"), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """The mix itself: every document, with all its columns, as often as `mix_sources` takes it."""
    taken = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where(
        F.col("copies") > 0).groupBy("key").agg(F.max("copies").alias("copies")).withColumnRenamed("key", "taken_key")
    taken = materialise(taken, "mix-taken")
    keyed = packed_rows(docs, key=row_key(id_col, source_col, text_col))
    # most documents are taken, so this side grows with the documents and is merged at every size
    return keyed.join(taken.hint("merge"), F.col("key") == F.col("taken_key")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
