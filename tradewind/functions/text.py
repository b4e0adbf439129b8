"""Text built from products: embedding input, rerank input, suggestion reasons, truncation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import not_blank

# ---- fixed values -------------------------------------------------------------------------
# (words contained in the lower-cased category name, exact names, words that must all be contained, synonyms);
# the first rule that applies wins.
CATEGORY_SYNONYMS = [
    (["smartphone"], ["mobiles"], [], "mobile phones, cell phones, handsets, cellular phones"),
    (["television"], ["tvs"], [], "TVs, TV sets, smart TVs, LED TV, OLED TV"),
    (["laptop"], [], [], "notebooks, portable computers, ultrabooks"),
    (["headphone", "earphone"], [], [], "earbuds, earphones, headsets, audio accessories"),
    (["tablet"], [], [], "iPad, Android tablet, tab, portable tablet"),
    (["camera"], [], [], "DSLR, mirrorless, digital camera, photography"),
    ([], [], ["watch", "smart"], "fitness tracker, wearable, smartwatch"),
    (["refrigerator", "fridge"], [], [], "fridge, freezer, refrigerator, cooling appliance"),
    (["washing machine"], [], [], "washer, laundry machine, clothes washer"),
    (["air conditioner"], ["acs"], [], "AC, cooling system, air cooler, split AC"),
    (["kurta", "kurti"], [], [], "Indian wear, ethnic wear, traditional dress"),
    (["saree", "sari"], [], [], "traditional wear, Indian dress, ethnic saree"),
    (["t-shirt", "tshirt"], [], [], "tee, casual wear, top"),
    (["jeans"], [], [], "denim, pants, trousers"),
    (["sneaker", "sports shoe"], [], [], "athletic shoes, running shoes, trainers"),
]
# Keyword in the lower-cased query -> brand; the first that applies wins.
QUERY_BRANDS = [
    (["samsung"], "Samsung"), (["apple", "iphone"], "Apple"), (["oneplus"], "OnePlus"),
    (["google", "pixel"], "Google"), (["sony"], "Sony"), (["jbl"], "JBL"), (["bose"], "Bose"),
    (["boat"], "boAt"), (["marshall"], "Marshall"), (["nike"], "Nike"), (["iqoo"], "iQOO"),
]
# strategy -> (text before a non-blank context, text without context)
REASONS = {
    "ai_intent": ("Based on your search for ", "Matches your search preferences"),
    "similar_products": ("Similar to ", "Similar to items you viewed"),
    "category_affinity": ("Popular in ", "Based on your interests"),
    "trending": (None, "Trending now"),
}
REASON_OTHER = "Recommended for you"
# -------------------------------------------------------------------------------------------


def _first_match(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def category_synonyms(name: Column) -> Column:
    """Synonyms of a category name, `''` where no rule applies."""
    low = F.lower(F.coalesce(name, F.lit("")))
    rules = []
    for contains, equals, together, text in CATEGORY_SYNONYMS:
        cond = _any([low.contains(w) for w in contains] + [low == w for w in equals])
        if together:
            cond = cond | _all([low.contains(w) for w in together])
        rules.append((cond, F.lit(text)))
    return _first_match(rules, F.lit(""))


def extract_brand(query: Column) -> Column:
    """Brand named in a query by keyword, null if none."""
    low = F.lower(query)
    rules = [(_any([low.contains(w) for w in words]), F.lit(brand)) for words, brand in QUERY_BRANDS]
    return F.when(query.isNotNull(), _first_match(rules, F.lit(None).cast("string")))


def cut_within(text: Column, n: int) -> Column:
    """Longer than n: first n-3 characters and `...`, so the result has n characters."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def cut_after(text: Column, n: int) -> Column:
    """Longer than n: first n characters, then `...`."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def embedding_text(name: Column, description: Column, brand: Column, category: Column) -> Column:
    synonyms = category_synonyms(category)
    head = F.concat(
        F.lit("Category: "), category,
        F.when(synonyms != "", F.concat(F.lit(" ("), synonyms, F.lit(")"))).otherwise(F.lit("")),
        F.lit(". "))
    parts = [
        F.when(not_blank(category), head).otherwise(F.lit("")),
        F.when(not_blank(name), F.concat(name, F.lit(". "))).otherwise(F.lit("")),
        F.when(not_blank(brand), F.concat(F.lit("Brand: "), brand, F.lit(". "))).otherwise(F.lit("")),
        F.when(not_blank(description), cut_after(description, 800)).otherwise(F.lit("")),
    ]
    return F.trim(F.concat(*parts))


def rerank_text(name: Column, brand: Column, category: Column, description: Column) -> Column:
    return F.concat(
        F.coalesce(name, F.lit("")),
        F.coalesce(F.concat(F.lit(" by "), brand), F.lit("")),
        F.coalesce(F.concat(F.lit(". Category: "), category), F.lit("")),
        F.coalesce(F.concat(F.lit(". "), cut_after(description, 200)), F.lit("")),
    )


def product_query_text(name: Column, category: Column, brand: Column) -> Column:
    return F.trim(F.concat_ws(" ", name, category, brand))


def suggestion_reason(strategy: Column, context: Column) -> Column:
    rules = []
    for key, (prefix, plain) in REASONS.items():
        if prefix:
            rules.append(((strategy == key) & not_blank(context), F.concat(F.lit(prefix), context)))
        rules.append((strategy == key, F.lit(plain)))
    return _first_match(rules, F.lit(REASON_OTHER))


def clean_description(short: Column, long: Column) -> Column:
    """Short text cut before script remnants, else the long text."""
    def cut(text: Column, marker: str) -> Column:
        at = F.instr(text, marker)
        return F.when(at > 1, F.trim(F.substring(text, F.lit(1), at - 1))).otherwise(text)
    return F.when(not_blank(short), cut(cut(short, "var "), "P.when(")).otherwise(long)
