"""Parsing rules for imported product fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import not_blank

# ---- fixed values -------------------------------------------------------------------------
CURRENCIES = ["INR", "USD", "EUR", "GBP", "AED", "SGD", "AUD", "CAD"]
GENDERS = {
    "MEN": ["MEN", "MALE", "MENS", "MEN'S"],
    "WOMEN": ["WOMEN", "FEMALE", "WOMENS", "WOMEN'S"],
    "UNISEX": ["UNISEX"],
    "BOYS": ["BOYS", "BOY"],
    "GIRLS": ["GIRLS", "GIRL"],
    "KIDS": ["KIDS", "CHILDREN", "KID"],
}
STOCK_STATUSES = {
    "ACTIVE": ["in_stock", "instock", "available"],
    "OUT_OF_STOCK": ["out_of_stock", "outofstock", "unavailable"],
    "DISCONTINUED": ["discontinued"],
}
# -------------------------------------------------------------------------------------------


def _lookup(value: Column, table: dict[str, list[str]], otherwise: Column) -> Column:
    out = otherwise
    for result, spellings in table.items():
        out = F.when(value.isin(spellings), F.lit(result)).otherwise(out)
    return out


def parse_currency(text: Column) -> Column:
    code = F.upper(F.trim(text))
    return F.when(code.isin(CURRENCIES), code).otherwise(F.lit("INR"))


def parse_gender(text: Column) -> Column:
    return _lookup(F.upper(F.trim(text)), GENDERS, F.lit(None).cast("string"))


def parse_stock_status(text: Column) -> Column:
    return _lookup(F.lower(F.trim(text)), STOCK_STATUSES, F.lit("ACTIVE"))


def money(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(10,2)")


def compare_at_price(list_price: Column, price: Column) -> Column:
    return F.when(list_price > price, money(list_price))


def valid_product(uniq_id: Column, name: Column, price: Column) -> Column:
    return not_blank(uniq_id) & not_blank(name) & F.coalesce(price > 0, F.lit(False))


def seeded_int(key: Column, seed: int, salt: str, n: int) -> Column:
    """A repeatable draw from 0..n-1 for a key."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(n))


def default_rating(rating: Column, key: Column, seed: int = 42) -> Column:
    """Given rating, else a repeatable one between 3.5 and 5.0; one decimal, half up."""
    drawn = F.lit(35) + seeded_int(key, seed, "rating", 16)
    return F.coalesce(F.round(rating, 1).cast("decimal(2,1)"), (drawn / 10).cast("decimal(2,1)"))


def default_reviews(reviews: Column, rating: Column, key: Column, seed: int = 42) -> Column:
    drawn = F.floor(rating) * 20 + seeded_int(key, seed, "reviews", 100)
    return F.when(F.coalesce(reviews, F.lit(0)) == 0, drawn).otherwise(reviews).cast("int")


def default_stock(status: Column, key: Column, seed: int = 42) -> Column:
    return F.when(status == "ACTIVE", F.lit(10) + seeded_int(key, seed, "stock", 491)).otherwise(F.lit(0)).cast("int")


def order_number(created_at: Column, key: Column, seed: int = 42) -> Column:
    """`ORD-yyyyMMddHHmmss-nnnn`, with a repeatable four-digit suffix."""
    suffix = F.lit(1000) + seeded_int(key, seed, "order", 8999)
    return F.concat(F.lit("ORD-"), F.date_format(created_at, "yyyyMMddHHmmss"), F.lit("-"), suffix.cast("string"))
