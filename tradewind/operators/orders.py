"""Orders, carts, prices and stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialise

# ---- fixed values -------------------------------------------------------------------------
TAX_RATE = "0.08"
FREE_SHIPPING_FROM = "50.00"
STANDARD_SHIPPING = "5.99"
CANCELLABLE = ["PENDING", "CONFIRMED"]
# -------------------------------------------------------------------------------------------
STEP_BLOCK = 1_000_000  # steps of all products together in one block of their order


def _dec(text: str) -> Column:
    return F.lit(text).cast("decimal(10,2)")


def orders_by(orders: DataFrame, *, user_id: str | None = None, status: str | None = None,
              order_number: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Orders by any combination of user, status, number and inclusive creation time."""
    for column, value in (("user_id", user_id), ("status", status), ("order_number", order_number)):
        if value is not None:
            orders = orders.filter(F.col(column) == value)
    if start is not None:
        orders = orders.filter(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        orders = orders.filter(F.col("created_at") <= F.lit(end).cast("timestamp"))
    return orders


def order_summary(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Line count, total quantity and line amount per order; orders without lines count 0."""
    totals = lines.groupBy(F.col("order_id").alias("id")).agg(
        F.count("*").alias("line_count"), F.sum("quantity").alias("total_items"), F.sum("subtotal").alias("lines_amount"))
    return orders.join(totals, "id", "left").select(
        "id", "order_number", "status", "total_amount", F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.coalesce("total_items", F.lit(0)).alias("total_items"),
        F.coalesce("lines_amount", F.lit(0)).cast("decimal(18,2)").alias("lines_amount"))


def cart_summary(carts: DataFrame, lines: DataFrame) -> DataFrame:
    """Total quantity and amount per cart; empty carts count 0."""
    totals = lines.groupBy(F.col("cart_id").alias("id")).agg(
        F.count("*").alias("line_count"), F.sum("quantity").alias("total_items"),
        F.sum(F.col("unit_price") * F.col("quantity")).alias("total_amount"))
    return carts.join(totals, "id", "left").select(
        "id", "user_id", F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.coalesce("total_items", F.lit(0)).alias("total_items"),
        F.coalesce("total_amount", F.lit(0)).cast("decimal(18,2)").alias("total_amount"))


def with_lines(headers: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Headers with their lines, one row per line; headers without lines stay with null line fields."""
    return headers.join(lines.withColumnRenamed(key, "id"), "id", "left")


def order_count_by_user(orders: DataFrame) -> DataFrame:
    return orders.groupBy("user_id").agg(F.count("*").alias("order_count"))


def price_orders(carts: DataFrame, lines: DataFrame) -> DataFrame:
    """Subtotal, shipping, tax and total of every cart that has lines."""
    subtotal = F.col("total_amount")
    priced = cart_summary(carts, lines).filter("line_count > 0").select(
        "id", "user_id", subtotal.alias("subtotal"),
        F.when(subtotal >= _dec(FREE_SHIPPING_FROM), _dec("0.00")).otherwise(_dec(STANDARD_SHIPPING)).alias("shipping"),
        F.round(subtotal * F.lit(TAX_RATE).cast("decimal(3,2)"), 2).cast("decimal(18,2)").alias("tax"))
    return priced.withColumn("total", (F.col("subtotal") + F.col("shipping") + F.col("tax")).cast("decimal(18,2)"))


def check_stock(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Per cart: whether it can be ordered, else the reason of its first failing line (by product id)."""
    stock = products.select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), "stock_quantity", "status")
    checked = lines.join(stock, "product_id", "left").withColumn(
        "reason",
        F.when(F.col("status").isNull(), "product not found")
        .when((F.col("status") != "ACTIVE") | (F.col("stock_quantity") <= 0), "not available")
        .when(F.col("stock_quantity") < F.col("quantity"), "insufficient stock"))
    failed = F.col("reason").isNotNull()
    return checked.groupBy("cart_id").agg(
        F.bool_and(~failed).alias("orderable"),
        F.min(F.when(failed, F.struct("product_id", "reason")))["reason"].alias("reason"),
        F.min(F.when(failed, F.col("product_id"))).alias("failed_product_id"))


def _with_blocks(steps: DataFrame, order: list[str]) -> DataFrame:
    """Steps with the block of the order they are in, about STEP_BLOCK steps each: the parts of a range partitioning.

    Only the number of steps comes to the driver; the parts are written, so that their numbers stay as they are.
    """
    blocks = -(-steps.count() // STEP_BLOCK)
    if blocks <= 1:
        return steps.withColumn("_block", F.lit(0))
    return materialise(steps.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id()), "steps")


def _fold_steps(rows):
    """Products one after the other, each in step order: a step below zero is refused, the others change stock and status."""
    import pandas as pd

    held, out = None, []
    for batch in rows:
        for id, stock, status, delta in zip(batch["id"], batch["stock_quantity"], batch["status"], batch["delta"]):
            if held is None or held[0] != id:
                if held:
                    out.append(held)
                held = [id, int(stock), status, 0]
            new = held[1] + int(delta)
            if new < 0:
                held[3] += 1
                continue
            held[1] = new
            held[2] = "OUT_OF_STOCK" if new == 0 else "ACTIVE" if held[2] == "OUT_OF_STOCK" else held[2]
        yield pd.DataFrame(out, columns=["id", "_stock", "_status", "_refused"])
        out = []
    if held:
        yield pd.DataFrame([held], columns=["id", "_stock", "_status", "_refused"])


def apply_stock_deltas(products: DataFrame, deltas: DataFrame, order: list[str]) -> DataFrame:
    """New stock and status after all deltas (product_id, delta, order columns), applied step by step.

    A step that would take the stock below zero is refused and changes nothing; `went_negative` marks products with
    such a step and `refused` counts them. For products without one the result is a sum. Whether there is one shows
    in the running minimum, found per block of the order and then over blocks, so a product with very many deltas
    is not one window. Only the flagged products' steps are sorted and folded, in constant memory.
    """
    steps = deltas.filter(F.col("delta").isNotNull())
    tagged = _with_blocks(steps, order)
    inner = W.partitionBy("product_id", "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    runs = tagged.withColumn("_run", F.sum("delta").over(inner))
    blocks = runs.groupBy("product_id", "_block").agg(
        F.sum("delta").alias("_sum"), F.min("_run").alias("_low"))
    outer = W.partitionBy("product_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(outer), F.lit(0)))
    total = blocks.groupBy(F.col("product_id").alias("id")).agg(
        F.sum("_sum").alias("_delta"), F.min(F.col("_before") + F.col("_low")).alias("_lowest"))
    held = F.coalesce(F.col("stock_quantity"), F.lit(0))
    stock = materialise(products.select("id", "stock_quantity", "status").join(total, "id", "left"), "stock")
    negative = F.coalesce(held + F.col("_lowest") < 0, F.lit(False))

    flagged = stock.filter(negative).select("id", held.alias("stock_quantity"), "status")
    mine = steps.select(F.col("product_id").alias("id"), "delta", *order).join(flagged, "id")
    folded = mine.repartition("id").sortWithinPartitions("id", *order).select(
        "id", "stock_quantity", "status", "delta").mapInPandas(
        _fold_steps, f"id {flagged.schema['id'].dataType.simpleString()}, _stock long, _status string, _refused long")

    touched = F.col("_lowest").isNotNull()
    new = held + F.coalesce("_delta", F.lit(0))
    # Stock that was 0 at some step has been OUT_OF_STOCK since, so restocking activates it.
    was_out = (F.col("status") == "OUT_OF_STOCK") | (held + F.col("_lowest") <= 0)
    status = (F.when(~touched, F.col("status")).when(new == 0, "OUT_OF_STOCK")
              .when(was_out & (new > 0), "ACTIVE").otherwise(F.col("status")))
    return stock.join(folded, "id", "left").select(
        "id", F.col("stock_quantity").alias("old_quantity"),
        F.when(touched, F.coalesce(F.col("_stock"), new)).otherwise(F.col("stock_quantity")).cast("long").alias("new_quantity"),
        F.col("status").alias("old_status"), F.coalesce("_status", status).alias("new_status"),
        negative.alias("went_negative"), F.coalesce("_refused", F.lit(0)).alias("refused"))


def order_states(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Order state after payment and status changes (order_id, changed_at, kind, value).

    PAID while PENDING confirms the order. Later status changes override, so only the newest
    status change and the payments after it matter.
    """
    status = F.when(F.col("kind") == "STATUS", F.struct("changed_at", "value"))
    pay = F.when(F.col("kind") == "PAYMENT", F.struct("changed_at", "value"))
    paid = F.when((F.col("kind") == "PAYMENT") & (F.col("value") == "PAID"), F.col("changed_at"))
    latest = changes.groupBy(F.col("order_id").alias("id")).agg(
        F.max(status).alias("_status"), F.max(pay).alias("_pay"), F.max(paid).alias("_paid"))
    joined = orders.join(latest, "id", "left")
    current = F.coalesce(F.col("_status.value"), F.col("status"))
    confirms = F.col("_paid").isNotNull() & (
        F.col("_status").isNull() | (F.col("_paid") >= F.col("_status.changed_at")))
    final = F.when((current == "PENDING") & confirms, "CONFIRMED").otherwise(current)
    return joined.select(
        "id", final.alias("status"), F.coalesce(F.col("_pay.value"), F.lit("PENDING")).alias("payment_status"),
        final.isin(CANCELLABLE).alias("cancellable"))


def cart_lines(adds: DataFrame) -> DataFrame:
    """Repeat adds of a product to a user's cart become one line with the summed quantity."""
    return adds.groupBy("user_id", "product_id").agg(F.sum("quantity").alias("quantity"))
