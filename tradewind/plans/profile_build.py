"""Events of the five topics to one profile row per user and session, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import activity
from ..operators.events import flatten_order_items, timed_ai_events, timed_events
from ..operators.profiles import build_user_profiles


def build_profiles_from_events(views: DataFrame, carts: DataFrame, users: DataFrame, ai: DataFrame,
                               orders: DataFrame, keep: str = "first", ttl_seconds: int | None = None) -> DataFrame:
    return build_user_profiles(
        activity.product_activity(timed_events(views), keep),
        activity.cart_activity(timed_events(carts)),
        activity.session_activity(timed_events(users)),
        activity.ai_activity(timed_ai_events(ai), keep),
        activity.order_activity(flatten_order_items(timed_events(orders)), keep),
        ttl_seconds)
