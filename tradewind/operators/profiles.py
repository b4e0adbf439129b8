"""User profiles: build from activity, merge over sessions, look up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import default_blank, latest_time_text, merge_lists, not_blank, sorted_field
from ..schemas import PROFILE
from .ranking import top_k

# ---- fixed values -------------------------------------------------------------------------
BUDGET_BELOW, MID_RANGE_BELOW = 500, 2000
PRICE_BANDS = {"BUDGET": (0.0, 500.0), "MID_RANGE": (500.0, 2000.0), "PREMIUM": (2000.0, None)}
LIST_CAPS = {
    "recent_product_ids": 20, "recent_categories": 10, "recent_search_queries": 10,
    "cart_product_ids": 20, "cart_categories": 10,
    "ai_search_queries": 15, "ai_search_categories": 10,
}
# -------------------------------------------------------------------------------------------
# Taken from the newest row as is.
NEWEST = ["session_id", "avg_view_duration_ms", "current_cart_total", "current_cart_items"]
# Newest positive value; never positive gives 0.
POSITIVE_COUNT = [
    "total_product_views", "cart_adds", "session_duration_ms", "total_page_views", "product_page_views",
    "cart_page_views", "checkout_page_views", "ai_search_count", "ai_product_searches", "ai_product_comparisons",
    "total_orders",
]
# Newest positive value; never positive gives the oldest one.
POSITIVE_AMOUNT = ["avg_product_price", "total_spent", "avg_order_value", "last_order_total"]
# Newest value that is neither null nor the named placeholder; else the oldest one.
MEANINGFUL = {"price_preference": "UNKNOWN", "preferred_payment_method": "NONE", "device_type": None}


def price_preference(ai_max_budget: Column, avg_price: Column) -> Column:
    """A stated budget decides; without one the average viewed price does."""
    budget, price = F.coalesce(ai_max_budget, F.lit(0.0)), F.coalesce(avg_price, F.lit(0.0))
    basis = F.when(budget > 0, budget).otherwise(price)
    return (F.when(basis < BUDGET_BELOW, "BUDGET").when(basis < MID_RANGE_BELOW, "MID_RANGE").otherwise("PREMIUM"))


def price_range(preference: Column) -> tuple[Column, Column]:
    """Inclusive price bounds of a preference; null means open."""
    low = high = F.lit(None).cast("double")
    for name, (lo, hi) in PRICE_BANDS.items():
        low = F.when(preference == name, F.lit(lo)).otherwise(low)
        high = F.when(preference == name, F.lit(hi).cast("double")).otherwise(high)
    return low, high


def build_user_profiles(product: DataFrame, cart: DataFrame, session: DataFrame, ai: DataFrame, order: DataFrame,
                        ttl_seconds: int | None = None) -> DataFrame:
    """Profiles for every (user, session) with product views; the other four are optional.

    With `ttl_seconds` a right row is used only while its last event is at most that much
    older than the left row's.
    """
    p = product.alias("p")
    joined = p
    for name, frame, keys in (("c", cart, ["user_id", "session_id"]), ("s", session, ["user_id", "session_id"]),
                              ("a", ai, ["user_id"]), ("o", order, ["user_id"])):
        cond = reduce(lambda x, y: x & y, [F.col(f"p.{k}") == F.col(f"{name}.{k}") for k in keys])
        if ttl_seconds is not None:
            cond = cond & (F.col(f"{name}.last_event_time")
                           >= F.col("p.last_event_time") - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))
        joined = joined.join(frame.alias(name), cond, "left")

    zero, none, blank = F.lit(0).cast("bigint"), F.lit(0.0), lambda c: default_blank(F.col(c))
    long0 = lambda c: F.coalesce(F.col(c), zero)
    dbl0 = lambda c: F.coalesce(F.col(c), none)
    cols = {
        "user_id": F.col("p.user_id"), "session_id": F.col("p.session_id"),
        "recent_product_ids": F.col("recent_product_ids"), "recent_categories": F.col("recent_categories"),
        "recent_search_queries": F.col("recent_search_queries"),
        "total_product_views": F.col("total_product_views"),
        "avg_view_duration_ms": F.col("avg_view_duration_ms"), "avg_product_price": F.col("avg_product_price"),
        "price_preference": price_preference(F.col("ai_max_budget"), F.col("avg_product_price")),
        "current_cart_total": dbl0("current_cart_total"), "current_cart_items": long0("current_cart_items"),
        "cart_adds": long0("cart_adds"), "cart_product_ids": blank("cart_product_ids"),
        "cart_categories": blank("cart_categories"),
        "device_type": F.coalesce(F.col("device_type"), F.lit("UNKNOWN")),
        "session_duration_ms": long0("session_duration_ms"), "total_page_views": long0("total_page_views"),
        "product_page_views": long0("product_page_views"), "cart_page_views": long0("cart_page_views"),
        "checkout_page_views": long0("checkout_page_views"),
        "ai_search_count": long0("ai_search_count"), "ai_search_queries": blank("ai_search_queries"),
        "ai_search_categories": blank("ai_search_categories"), "ai_max_budget": dbl0("ai_max_budget"),
        "ai_product_searches": long0("ai_product_searches"),
        "ai_product_comparisons": long0("ai_product_comparisons"),
        "total_orders": long0("total_orders"), "total_spent": dbl0("total_spent"),
        "avg_order_value": dbl0("avg_order_value"), "last_order_total": dbl0("last_order_total"),
        "preferred_payment_method": F.coalesce(F.col("preferred_payment_method"), F.lit("NONE")),
        "last_updated": latest_time_text(*[F.col(f"{t}.last_event_time") for t in "pcsao"]),
    }
    return joined.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in PROFILE])


def merge_profiles(existing: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """Merge one incoming profile per user into one stored profile per user.

    Users on one side only are kept unchanged. `as_of` stamps `last_updated` of written rows.
    """
    e, i = existing.alias("e"), incoming.alias("i")
    both = e.join(i, F.col("e.user_id") == F.col("i.user_id"), "full_outer")
    old, new = (lambda c: F.col(f"e.{c}")), (lambda c: F.col(f"i.{c}"))

    def merged(c: str) -> Column:
        if c in LIST_CAPS:
            return merge_lists(new(c), old(c), LIST_CAPS[c])
        if c in POSITIVE_COUNT:
            return F.when(new(c) > 0, new(c)).otherwise(F.coalesce(old(c), F.lit(0)))
        if c in POSITIVE_AMOUNT:
            return F.when(new(c) > 0, new(c)).otherwise(old(c))
        if c in MEANINGFUL:
            ok = new(c).isNotNull() & (new(c) != F.lit(MEANINGFUL[c]) if MEANINGFUL[c] else F.lit(True))
            return F.when(ok, new(c)).otherwise(old(c))
        if c == "ai_max_budget":
            return F.greatest(F.coalesce(new(c), F.lit(0.0)), F.coalesce(old(c), F.lit(0.0)))
        return new(c)

    out = []
    for f in PROFILE:
        c = f.name
        value = merged(c)
        if c == "last_updated":
            value = F.lit(as_of)
            out.append(F.when(new("user_id").isNull(), old(c)).otherwise(value).alias(c))
            continue
        out.append(F.when(new("user_id").isNull(), old(c)).when(old("user_id").isNull(), new(c))
                   .otherwise(value).cast(f.dataType).alias(c))
    return both.select(*out)


def fold_profiles(history: DataFrame, order: list[str], as_of: str | None = None) -> DataFrame:
    """Replay `merge_profiles` over all profile rows of each user, in the given order.

    The step-by-step merge is expressed by rows that a user keeps: the newest and the oldest one as they are, for every
    column with a rule the newest value that passes it, and of a merged list the first `cap` distinct non-blank
    values reading the rows newest first. Each is a first row per group, which Spark cuts before the shuffle.
    A user with one row keeps it as is.
    """
    rows = history.withColumn("_t", F.struct(*order))
    latest_first, earliest_first = [F.col("_t").desc()], [F.col("_t").asc()]
    count = rows.groupBy("user_id").agg(F.count("*").alias("_rows"), F.max("ai_max_budget").alias("_budget"))
    newest = top_k(rows, ["user_id"], latest_first, 1, "_first").select(
        "user_id", *[F.col(f.name).alias(f"_new_{f.name}") for f in PROFILE if f.name != "user_id"])
    oldest = top_k(rows, ["user_id"], earliest_first, 1, "_first").select(
        "user_id", *[F.col(c).alias(f"_old_{c}") for c in (*POSITIVE_AMOUNT, *MEANINGFUL)])

    def passes(c: str) -> Column:
        if c not in MEANINGFUL:
            return F.col(c) > 0
        ok = F.col(c).isNotNull()
        return ok & (F.col(c) != MEANINGFUL[c]) if MEANINGFUL[c] else ok

    # Values of all columns with a rule, as text; numbers come back from it unchanged.
    ruled = F.array_compact(F.array(*[
        F.when(passes(c), F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")))
        for c in (*POSITIVE_COUNT, *POSITIVE_AMOUNT, *MEANINGFUL)]))
    kept = top_k(rows.select("user_id", "_t", F.inline(ruled)), ["user_id", "kind"], latest_first, 1, "_first")
    kept = kept.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "value"))).alias("_kept"))
    scalars = count.join(newest, "user_id").join(oldest, "user_id").join(kept, "user_id", "left")
    types = {f.name: f.dataType for f in PROFILE}

    def scalar(c: str) -> Column:
        new, found = F.col(f"_new_{c}"), F.col("_kept").getItem(c).cast(types[c])
        if c in POSITIVE_COUNT:
            return F.when(F.col("_rows") == 1, new).otherwise(F.coalesce(found, F.lit(0)))
        if c in POSITIVE_AMOUNT or c in MEANINGFUL:
            return F.coalesce(found, F.col(f"_old_{c}"))
        if c == "ai_max_budget":
            return F.when(F.col("_rows") == 1, new).otherwise(F.greatest(F.coalesce("_budget", F.lit(0.0)), F.lit(0.0)))
        return new

    # All seven lists in one pass: (user, list, value) with the newest row and lowest position it appears at.
    lists = F.array(*[F.struct(F.lit(c).alias("kind"), F.lit(cap).alias("cap"), F.col(c).alias("vals"))
                      for c, cap in LIST_CAPS.items()])
    elements = (
        rows.select("user_id", "_t", F.explode(lists).alias("l"))
        .select("user_id", "_t", "l.kind", "l.cap", F.posexplode("l.vals").alias("pos", "value"))
        .filter(not_blank(F.col("value")))
    )
    nearest = [F.col("_t").desc(), F.col("pos").asc()]
    elements = top_k(elements, ["user_id", "kind", "value"], nearest, 1, "_first")
    capped = top_k(elements, ["user_id", "kind"], nearest, max(LIST_CAPS.values()), "_rn").filter(F.col("_rn") <= F.col("cap"))
    merged = capped.groupBy("user_id").agg(*[
        sorted_field(F.collect_list(F.when(F.col("kind") == c, F.struct("_rn", "value"))), "value").alias(f"_list_{c}")
        for c in LIST_CAPS])
    both = scalars.join(merged, "user_id", "left")
    empty = F.array().cast("array<string>")
    out = []
    for f in PROFILE:
        c = f.name
        if c in LIST_CAPS:
            col = F.when(F.col("_rows") == 1, F.col(f"_new_{c}")).otherwise(F.coalesce(F.col(f"_list_{c}"), empty))
        elif c == "last_updated" and as_of is not None:
            col = F.when(F.col("_rows") == 1, F.col("_new_last_updated")).otherwise(F.lit(as_of))
        else:
            col = F.col(c) if c == "user_id" else scalar(c)
        out.append(col.cast(f.dataType).alias(c))
    return both.select(*out)


def live_profiles(profiles: DataFrame, as_of: str, ttl_seconds: int = 3600) -> DataFrame:
    """Profiles written within the time to live before `as_of`."""
    written = F.expr("try_to_timestamp(last_updated)")
    return profiles.filter(written + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS") > F.lit(as_of).cast("timestamp"))


def lookup_profiles(profiles: DataFrame, user_ids: DataFrame, as_of: str, ttl_seconds: int = 3600) -> DataFrame:
    """Live profiles of the given users."""
    return live_profiles(profiles, as_of, ttl_seconds).join(user_ids.select("user_id"), "user_id", "left_semi")


def with_signal_flags(profiles: DataFrame) -> DataFrame:
    """Add has_intent, has_categories and has_views."""
    some = lambda c: F.coalesce(F.exists(F.col(c), not_blank), F.lit(False))
    categories = some("recent_categories") | some("cart_categories") | some("ai_search_categories")
    return profiles.select(
        "*",
        (some("ai_search_queries") | some("recent_search_queries") | categories
         | F.coalesce(F.col("ai_max_budget") > 0, F.lit(False))).alias("has_intent"),
        categories.alias("has_categories"),
        F.coalesce(F.size("recent_product_ids") > 0, F.lit(False)).alias("has_views"))
