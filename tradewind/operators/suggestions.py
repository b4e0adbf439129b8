"""Product suggestions for all users at once.

Three strategies fill a user's list: products matching the user's searches (at most 40 %),
products like the first viewed one (at most 30 %), and well rated products of the user's
categories (the rest). Everything per user is bounded: at most five searches, eight
categories and a few dozen candidates, so candidates of one user are small arrays and rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import strip_blanks
from ..functions.text import cut_after, suggestion_reason
from ..session import materialise
from .merchandising import top_rated_per_category
from .profiles import price_range, with_signal_flags
from .search import expand_category_names
from .vectors import SIMILARITY_THRESHOLD, plain_index, vector_search

# ---- fixed values -------------------------------------------------------------------------
DEFAULT_LIMIT, MAX_LIMIT = 12, 50
INTENT_SHARE, SIMILAR_SHARE = 0.4, 0.3
AI_QUERIES, SEARCH_QUERIES = 2, 3
MIN_FETCH, FETCH_FACTOR = 10, 3
MAX_CATEGORIES = 8
# -------------------------------------------------------------------------------------------


def clamp_limit(limit: int | None) -> int:
    return DEFAULT_LIMIT if limit is None else max(1, min(MAX_LIMIT, limit))


def user_searches(profiles: DataFrame) -> DataFrame:
    """(user_id, step, expanded, query, max_price): the searches tried for a user, in order."""
    def pick(column: str, n: int) -> Column:
        return F.slice(strip_blanks(F.col(column)), 1, n)
    searches = F.concat(
        F.transform(pick("ai_search_queries", AI_QUERIES), lambda q: F.struct(F.lit(True).alias("expanded"), q.alias("query"))),
        F.transform(pick("recent_search_queries", SEARCH_QUERIES), lambda q: F.struct(F.lit(False).alias("expanded"), q.alias("query"))))
    return profiles.select(
        "user_id", F.when(F.col("ai_max_budget") > 0, F.col("ai_max_budget")).alias("max_price"),
        F.posexplode(searches).alias("step", "s")
    ).select("user_id", "step", "s.expanded", "s.query", "max_price")


def _search_hits(searches: DataFrame, query_vectors: DataFrame, index: DataFrame, limit: int,
                 threshold: float) -> DataFrame:
    """(expanded, query, max_price, variants, variant, id, similarity, rank) for the distinct searches.

    Each distinct (text, price ceiling) is searched once, far enough for any number of
    missing products; a user's shorter fetch is a prefix by rank.
    """
    most = max(MIN_FETCH, FETCH_FACTOR * limit)
    distinct = searches.select("expanded", "query", "max_price").distinct()
    counted = query_vectors.groupBy("query").agg(F.count("*").alias("variants"))
    asked = (
        distinct.join(query_vectors, "query").join(counted, "query")
        .filter(F.col("expanded") | (F.col("variant") == 0))
        .withColumn("variants", F.when(F.col("expanded"), F.col("variants")).otherwise(F.lit(1)))
        .withColumn("query_id", F.sha2(F.to_json(F.struct("expanded", "query", "max_price", "variant")), 256))
    )
    found = vector_search(asked.select("query_id", "embedding", "max_price"), index, most, threshold)
    return found.join(asked.select("query_id", "expanded", "query", "max_price", "variants", "variant"), "query_id").drop("query_id")


def ai_intent(profiles: DataFrame, products: DataFrame, categories: DataFrame, index: DataFrame,
              query_vectors: DataFrame, limit: int = DEFAULT_LIMIT,
              threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """(user_id, id, rank, context): products matching the user's own searches.

    Searches are taken in order until enough products are found. Results outside the user's
    categories are dropped, unless that leaves nothing of the search. `query_vectors` holds
    (query, variant, embedding); variant 0 is the text itself, assistant searches use all.
    """
    quota = math.ceil(limit * INTENT_SHARE)
    users = with_signal_flags(profiles).filter("has_intent")
    searches = user_searches(users)
    hits = _search_hits(searches, query_vectors, index, quota, threshold)
    names = products.select("id", "category_name")
    null_safe = searches.alias("s").join(
        hits.alias("h"),
        (F.col("s.expanded") == F.col("h.expanded")) & (F.col("s.query") == F.col("h.query"))
        & F.col("s.max_price").eqNullSafe(F.col("h.max_price")))
    rows = null_safe.select("s.user_id", "s.step", "s.expanded", "s.query", "h.variants", "h.variant", "h.id",
                            "h.similarity", "h.rank").join(names, "id")

    interests = users.select("user_id", F.array_distinct(F.concat(
        strip_blanks(F.col("ai_search_categories")), strip_blanks(F.col("recent_categories")))).alias("_base"))
    wanted = interests.select("user_id", F.explode("_base").alias("requested"))
    allowed = (
        wanted.join(expand_category_names(wanted, categories), "requested")
        .select("user_id", "category_name").distinct().withColumn("_in", F.lit(True)))
    rows = rows.join(allowed, ["user_id", "category_name"], "left").join(
        interests.select("user_id", (F.size("_base") == 0).alias("_any")), "user_id")
    rows = rows.withColumn("fits", F.col("_any") | F.col("_in").isNotNull())

    # At most five searches of bounded length per user are gathered, then folded in order.
    item = F.struct(F.col("similarity").alias("s"), F.col("id"), F.col("rank").alias("r"), F.col("fits"))
    steps = rows.groupBy("user_id", "step", "expanded", "query").agg(
        F.max("variants").alias("n"), F.collect_list(item).alias("hits"))
    lists = steps.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("step", "expanded", "query", "n", "hits"))).alias("steps"))

    def better_first(hits: Column) -> Column:
        return F.array_sort(hits, lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1)
                            .when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))

    def ids(values: Column) -> Column:
        return F.transform(values, lambda x: x["id"])

    def fold(taken: Column, step: Column) -> Column:
        missing = F.lit(quota) - F.size(taken)
        fetch = F.greatest(F.lit(MIN_FETCH), missing * FETCH_FACTOR)
        per_variant = F.when(step["n"] > 1, F.greatest(F.lit(3), F.ceil(fetch / step["n"]).cast("int") + 1)).otherwise(fetch)
        near = better_first(F.filter(step["hits"], lambda h: h["r"] <= per_variant))
        # The same product from several variants counts once, at its best similarity.
        near_ids = ids(near)
        unique = F.filter(near, lambda h, i: F.array_position(near_ids, h["id"]) == i + 1)
        new = F.filter(F.slice(unique, 1, fetch), lambda h: ~F.array_contains(ids(taken), h["id"]))
        fitting = F.filter(new, lambda h: h["fits"])
        chosen = F.when(F.size(fitting) > 0, fitting).otherwise(new)
        width = F.when(step["expanded"], F.lit(40)).otherwise(F.lit(30))
        short = F.when(F.length(step["query"]) > width, F.concat(
            F.substring(step["query"], F.lit(1), width - 3), F.lit("..."))).otherwise(step["query"])
        added = F.transform(F.slice(chosen, 1, F.greatest(missing, F.lit(0))), lambda h: F.struct(
            h["id"].alias("id"), short.alias("context")))
        return F.when(missing > 0, F.concat(taken, added)).otherwise(taken)

    start = F.array().cast("array<struct<id:string,context:string>>")
    return lists.select("user_id", F.posexplode(F.aggregate("steps", start, fold)).alias("rank", "p")).select(
        "user_id", "p.id", (F.col("rank") + 1).alias("rank"), "p.context")


def similar_to_viewed(profiles: DataFrame, products: DataFrame, index: DataFrame, taken: DataFrame,
                      limit: int = DEFAULT_LIMIT, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """(user_id, id, rank, context): products of the same category near the user's first listed view.

    Each distinct viewed product is searched once for all its viewers.
    """
    quota = math.ceil(limit * SIMILAR_SHARE)
    details = products.select("id", "name", F.lower("category_name").alias("category_name"))
    counts = taken.groupBy("user_id").agg(F.count("*").alias("_taken"))
    viewers = (
        profiles.filter(F.size("recent_product_ids") > 0)
        .select("user_id", F.get("recent_product_ids", F.lit(0)).alias("item_id"))
        .join(counts, "user_id", "left")
        .withColumn("room", F.least(F.lit(limit) - F.coalesce("_taken", F.lit(0)), F.lit(quota))).filter("room > 0")
        .join(details.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"),
                             F.col("category_name").alias("item_category")), "item_id"))
    wanted = viewers.select(F.col("item_id").alias("id")).distinct()
    queries = plain_index(profiles.sparkSession, index).join(wanted, "id", "left_semi").select(F.col("id").alias("query_id"), "embedding")
    found = vector_search(queries, index, FETCH_FACTOR * quota, threshold)
    near = (
        found.withColumnRenamed("query_id", "item_id").filter(F.col("id") != F.col("item_id"))
        .join(details.select("id", F.col("category_name")), "id"))
    rows = (
        viewers.join(near, "item_id")
        .filter((F.col("rank") <= F.col("room") * FETCH_FACTOR) & (F.col("category_name") == F.col("item_category")))
        .join(taken.select("user_id", "id"), ["user_id", "id"], "left_anti"))
    w = W.partitionBy("user_id").orderBy(F.col("similarity").desc(), "id")
    return (rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("room"))
            .select("user_id", "id", "rank", cut_after(F.col("item_name"), 30).alias("context")))


def user_categories(profiles: DataFrame) -> DataFrame:
    """(user_id, place, category, categories): the user's categories, cart before assistant before viewed."""
    combined = F.slice(F.array_distinct(F.concat(*[
        strip_blanks(F.col(c)) for c in ("cart_categories", "ai_search_categories", "recent_categories")])),
        1, MAX_CATEGORIES)
    return profiles.select("user_id", "price_preference", F.size(combined).alias("categories"),
                           F.posexplode(combined).alias("place", "category"))


def category_affinity(profiles: DataFrame, products: DataFrame, taken: DataFrame,
                      limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(user_id, id, rank, context): best rated products of the user's categories in turn.

    Per category the best few in the price band are taken before products already suggested
    are removed. The lists depend only on (category, band), so they are ranked once for all
    users.
    """
    counts = taken.groupBy("user_id").agg(F.count("*").alias("_taken"))
    users = (
        user_categories(profiles).join(counts, "user_id", "left")
        .withColumn("room", F.lit(limit) - F.coalesce("_taken", F.lit(0))).filter("room > 0")
        .withColumn("per", F.greatest(F.lit(2), F.floor(F.col("room") / F.col("categories")) + 1))
        .withColumn("band", F.coalesce("price_preference", F.lit("ANY"))))
    bands = F.array(*[F.lit(b) for b in ("BUDGET", "MID_RANGE", "PREMIUM", "ANY")])
    low, high = price_range(F.col("band"))
    banded = (
        products.select("id", "category_name", "price", "rating", "review_count", "status", F.explode(bands).alias("band"))
        .filter((low.isNull() | (F.col("price") >= low)) & (high.isNull() | (F.col("price") <= high))))
    lists = top_rated_per_category(banded, limit + 1, ["category_name", "band"]).select(
        F.col("category_name").alias("category"), "band", "id", F.col("rank").alias("place_in"))
    users = users.withColumn("band", F.when(F.col("band").isin("BUDGET", "MID_RANGE", "PREMIUM"), F.col("band")).otherwise("ANY"))
    rows = (
        users.join(lists, ["category", "band"]).filter(F.col("place_in") <= F.col("per"))
        .join(taken.select("user_id", "id"), ["user_id", "id"], "left_anti"))
    turn = W.partitionBy("user_id", "place").orderBy("place_in")
    order = W.partitionBy("user_id").orderBy("_turn", "place")
    return (rows.withColumn("_turn", F.row_number().over(turn))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("room"))
            .select("user_id", "id", "rank", F.col("category").alias("context")))


def suggest(users: DataFrame, profiles: DataFrame, products: DataFrame, categories: DataFrame, index: DataFrame,
            query_vectors: DataFrame, limit: int | None = None, threshold: float = SIMILARITY_THRESHOLD,
            materialise=materialise) -> DataFrame:
    """(user_id, position, id, strategy, reason, personalised) for every requested user.

    Users without a profile keep one row without product, personalised false. `materialise`
    may write the strategies' results out once, as each later strategy reads the earlier ones.
    """
    limit = clamp_limit(limit)
    mine = materialise(profiles.join(users.select("user_id"), "user_id", "left_semi"), "profiles")
    intent = materialise(ai_intent(mine, products, categories, index, query_vectors, limit, threshold), "intent")
    alike = materialise(similar_to_viewed(mine, products, index, intent, limit, threshold), "similar")
    so_far = intent.select("user_id", "id").unionByName(alike.select("user_id", "id"))
    affine = category_affinity(mine, products, so_far, limit)
    tagged = None
    for i, (name, part) in enumerate((("ai_intent", intent), ("similar_products", alike), ("category_affinity", affine))):
        part = part.select("user_id", "id", "context", F.lit(name).alias("strategy"), F.lit(i).alias("_s"), "rank")
        tagged = part if tagged is None else tagged.unionByName(part)
    w = W.partitionBy("user_id").orderBy("_s", "rank", "id")
    listed = tagged.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit).select(
        "user_id", "position", "id", "strategy", suggestion_reason(F.col("strategy"), F.col("context")).alias("reason"))
    known = mine.select("user_id").distinct().withColumn("personalised", F.lit(True))
    return (users.select("user_id").distinct().join(known, "user_id", "left").join(listed, "user_id", "left")
            .withColumn("personalised", F.coalesce("personalised", F.lit(False))))


def strategy_counts(suggestions: DataFrame) -> DataFrame:
    """Products per user and strategy."""
    count = lambda s: F.count_if(F.col("strategy") == s)
    return suggestions.groupBy("user_id").agg(
        count("ai_intent").alias("ai_intent"), count("similar_products").alias("similar_products"),
        count("category_affinity").alias("category_affinity"), F.count("id").alias("total"))
