"""Row types of the event topics, catalogue tables and profiles, and their fixed values."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T

S, L, I, D, B, TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)
MONEY = T.DecimalType(10, 2)
RATING = T.DecimalType(2, 1)
TEXTS = T.ArrayType(S)

# ---- fixed values -------------------------------------------------------------------------
CART_ACTIONS = ["ADD", "REMOVE", "UPDATE_QUANTITY", "CLEAR"]
EVENT_TYPES = ["LOGIN", "LOGOUT", "PAGE_VIEW", "SESSION_START", "SESSION_END"]
PAGE_TYPES = ["HOME", "CATEGORY", "PRODUCT", "CART", "CHECKOUT"]
DEVICE_TYPES = ["MOBILE", "DESKTOP", "TABLET"]
VIEW_SOURCES = ["SEARCH", "RECOMMENDATION", "CATEGORY", "DIRECT", "CART", "HOME", "AI_CHAT"]
PAYMENT_METHODS = ["UPI", "CARD", "NETBANKING", "COD", "WALLET"]
PAYMENT_STATUSES = ["PENDING", "PAID", "FAILED", "REFUNDED"]
ORDER_STATUSES = ["PENDING", "PLACED", "CONFIRMED", "PROCESSING", "SHIPPED", "DELIVERED", "CANCELLED", "REFUNDED"]
PRODUCT_STATUSES = ["ACTIVE", "OUT_OF_STOCK", "DISCONTINUED"]
PATH_DELIMITER = " >> "
# -------------------------------------------------------------------------------------------


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ORDER_ITEM = _struct(("productId", S), ("productName", S), ("category", S), ("quantity", I), ("price", D))

# Wire schemas, as the topics carry them.
TOPICS: dict[str, T.StructType] = {
    "user-events": _struct(
        ("eventId", S), ("userId", S), ("sessionId", S), ("eventType", S), ("pageType", S), ("pageUrl", S),
        ("deviceType", S), ("referrer", S), ("timestamp", S)),
    "product-views": _struct(
        ("eventId", S), ("userId", S), ("sessionId", S), ("productId", S), ("productName", S), ("category", S),
        ("price", D), ("source", S), ("searchQuery", S), ("viewDurationMs", L), ("timestamp", S)),
    "cart-events": _struct(
        ("eventId", S), ("userId", S), ("sessionId", S), ("action", S), ("productId", S), ("productName", S),
        ("category", S), ("quantity", I), ("price", D), ("cartTotal", D), ("cartItemCount", I), ("timestamp", S)),
    "order-events": _struct(
        ("eventId", S), ("userId", S), ("orderId", S), ("items", T.ArrayType(ORDER_ITEM)), ("subtotal", D),
        ("discount", D), ("total", D), ("paymentMethod", S), ("status", S), ("shippingCity", S),
        ("shippingState", S), ("timestamp", S)),
    "ai-events": _struct(
        ("eventId", S), ("userId", S), ("sessionId", S), ("query", S), ("searchType", S), ("toolName", S),
        ("category", S), ("minPrice", D), ("maxPrice", D), ("minRating", D), ("resultsCount", I),
        ("returnedProductIds", TEXTS), ("processingTimeMs", L), ("timestamp", S)),
}

# The profile row: (column, type, list cap used when profiles are merged).
PROFILE = _struct(
    ("user_id", S), ("session_id", S),
    ("recent_product_ids", TEXTS), ("recent_categories", TEXTS), ("recent_search_queries", TEXTS),
    ("total_product_views", L), ("avg_view_duration_ms", L), ("avg_product_price", D),
    ("price_preference", S),
    ("current_cart_total", D), ("current_cart_items", L), ("cart_adds", L),
    ("cart_product_ids", TEXTS), ("cart_categories", TEXTS),
    ("device_type", S), ("session_duration_ms", L), ("total_page_views", L), ("product_page_views", L),
    ("cart_page_views", L), ("checkout_page_views", L),
    ("ai_search_count", L), ("ai_search_queries", TEXTS), ("ai_search_categories", TEXTS),
    ("ai_max_budget", D), ("ai_product_searches", L), ("ai_product_comparisons", L),
    ("total_orders", L), ("total_spent", D), ("avg_order_value", D), ("last_order_total", D),
    ("preferred_payment_method", S), ("last_updated", S),
)

PRODUCT_FILE = _struct(
    ("uniq_id", S), ("product_name", S), ("short_description", S), ("long_description", S), ("brand_name", S),
    ("selling_price", T.DecimalType(18, 4)), ("list_price", T.DecimalType(18, 4)), ("currency", S),
    ("image_urls", TEXTS), ("primary_category_name", S), ("sub_category_name", TEXTS), ("stock_status", S),
    ("star_ratings", T.DecimalType(18, 4)), ("reviews_count", I), ("product_rank", I), ("gender", S),
)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.capitalize() for p in rest)


def from_wire(df: DataFrame) -> DataFrame:
    """Wire names (camelCase, nested item fields too) to the snake_case used by the operators."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            inner = T.StructType([T.StructField(snake(f.name), f.dataType) for f in field.dataType.elementType])
            col = col.cast(T.ArrayType(inner))
        out.append(col.alias(snake(field.name)))
    return df.select(*out)


def to_wire(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(camel(c)) for c in df.columns])
