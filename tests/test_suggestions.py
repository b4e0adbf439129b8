"""Suggestions for all users against a step-by-step account of one user at a time."""

import math
import random

import numpy as np
import pytest

from tradewind.operators import suggestions as G
from tradewind.schemas import PROFILE

THRESHOLD = 0.1


def world(seed):
    rng = random.Random(seed)
    np_rng = np.random.default_rng(seed)
    names = [f"Cat{i}" for i in range(6)]
    cats = [("root", "Root", "Root", None, True)] + [(f"k{i}", n, f"Root >> {n}", "root", True) for i, n in enumerate(names)]
    products, index = [], []
    for i in range(90):
        price = rng.choice([100.0, 500.0, 900.0, 2000.0, 7000.0])
        rating = rng.choice([None, 3.0, 4.0, 4.5])
        cat = rng.randrange(6)
        products.append((f"p{i:02d}", f"name of product number {i:02d} and more text", names[cat], price, rating, rng.randrange(3),
                         rng.choice(["ACTIVE", "ACTIVE", "ACTIVE", "OUT_OF_STOCK"])))
        index.append((f"p{i:02d}", [float(x) for x in np_rng.normal(size=4)], f"k{cat}", None, price, rating))
    texts = [f"looking for something quite special number {i}" + " very long" * (i % 4) for i in range(12)]
    vectors = [(t, v, [float(x) for x in np_rng.normal(size=4)]) for i, t in enumerate(texts) for v in range(3 if i % 3 else 1)]
    users = []
    for i in range(25):
        some = lambda pool, n: rng.sample(pool, rng.randrange(n + 1)) or [""]
        row = {f.name: {"bigint": 0, "double": 0.0, "string": "", "array<string>": [""]}[f.dataType.simpleString()] for f in PROFILE}
        row.update(user_id=f"u{i}", recent_product_ids=some([p[0] for p in products], 4), recent_categories=some(names, 3),
                   cart_categories=some(names, 2), ai_search_categories=some([*names, "Root", "Nowhere"], 2),
                   ai_search_queries=some(texts, 4), recent_search_queries=["", *some(texts, 4)],
                   ai_max_budget=rng.choice([0.0, 0.0, 900.0, 5000.0]),
                   price_preference=rng.choice(["BUDGET", "MID_RANGE", "PREMIUM", "UNKNOWN"]))
        users.append(row)
    return cats, products, index, vectors, users


def search(index, vector, k, ceiling=None):
    a = np.asarray(vector, dtype=np.float32).astype(float)
    found = []
    for i, e, _, _, price, _ in index:
        b = np.asarray(e, dtype=np.float32).astype(float)
        s = round(float(a / np.linalg.norm(a) @ (b / np.linalg.norm(b))), 9)
        if s >= THRESHOLD and (ceiling is None or price <= ceiling):
            found.append((-s, i))
    return sorted(found)[:k]


def one_user(u, cats, products, index, vectors, limit):
    by_id = {p[0]: p for p in products}
    parent_of_all = {c[1] for c in cats if c[0] != "root"} | {"Root"}
    filled = lambda c: [x for x in u[c] if x.strip()]
    base = list(dict.fromkeys(filled("ai_search_categories") + filled("recent_categories")))
    allowed = set(base) | (parent_of_all if "Root" in base else set())
    ceiling = u["ai_max_budget"] if u["ai_max_budget"] > 0 else None
    quota, out, seen = math.ceil(limit * 0.4), [], set()
    steps = [(True, q) for q in filled("ai_search_queries")[:2]] + [(False, q) for q in filled("recent_search_queries")[:3]]
    for expanded, q in steps:
        missing = quota - len(out)
        if missing <= 0:
            break
        fetch = max(10, 3 * missing)
        own = [v for t, n, v in vectors if t == q and (expanded or n == 0)]
        each = fetch if len(own) == 1 else max(3, math.ceil(fetch / len(own)) + 1)
        best = {}
        for v in own:
            for s, i in search(index, v, each, ceiling):
                best[i] = min(s, best.get(i, 9))
        new = [i for _, i in sorted((s, i) for i, s in best.items())[:fetch] if i not in seen]
        fit = [i for i in new if not base or by_id[i][2] in allowed] or new
        width = 40 if expanded else 30
        text = q if len(q) <= width else q[:width - 3] + "..."
        for i in fit[:missing]:
            seen.add(i)
            out.append((i, "ai_intent", f"Based on your search for {text}"))
    room = min(limit - len(out), math.ceil(limit * 0.3))
    first = u["recent_product_ids"][0]
    if room > 0 and first in by_id:
        vector = next(e for i, e, *_ in index if i == first)
        near = [i for _, i in search(index, vector, 3 * room) if i != first and i not in seen and by_id[i][2] == by_id[first][2]]
        name = by_id[first][1]
        for i in near[:room]:
            seen.add(i)
            out.append((i, "similar_products", f"Similar to {name[:30]}..."))
    room = limit - len(out)
    mine = list(dict.fromkeys(filled("cart_categories") + filled("ai_search_categories") + filled("recent_categories")))[:8]
    if room > 0 and mine:
        lo, hi = {"BUDGET": (0, 500), "MID_RANGE": (500, 2000), "PREMIUM": (2000, 1e9)}.get(u["price_preference"], (0, 1e9))
        per = max(2, room // len(mine) + 1)
        lists = []
        for c in mine:
            rows = [p for p in products if p[2] == c and p[6] == "ACTIVE" and lo <= p[3] <= hi]
            rows.sort(key=lambda p: (-(p[4] or -1), -p[5], p[0]))
            lists.append([(p[0], c) for p in rows[:per] if p[0] not in seen])
        turns = [x[t] for t in range(per) for x in lists if t < len(x)]
        out += [(i, "category_affinity", f"Popular in {c}") for i, c in turns[:room]]
    return out[:limit]


@pytest.mark.parametrize("seed,limit", [(1, 12), (2, 5), (3, 1)])
def test_suggestions(spark, seed, limit):
    cats, products, index, vectors, users = world(seed)
    make = spark.createDataFrame
    c = make(cats, "id string, name string, path string, parent_id string, active boolean")
    p = make(products, "id string, name string, category_name string, price double, rating double, review_count int, status string")
    i = make(index, "id string, embedding array<float>, category_id string, brand string, price double, rating double")
    v = make(vectors, "query string, variant int, embedding array<float>")
    asked = make([(u["user_id"],) for u in users] + [("stranger",)], "user_id string")
    got = {}
    for r in G.suggest(asked, make(users, PROFILE), p, c, i, v, limit, THRESHOLD).collect():
        if r.id is not None:
            got.setdefault(r.user_id, []).append((r.position, r.id, r.strategy, r.reason))
        assert r.personalised == (r.user_id != "stranger")
    for u in users:
        want = one_user(u, cats, products, index, vectors, limit)
        assert [x[1:] for x in sorted(got.get(u["user_id"], []))] == want, u["user_id"]


def test_limit_is_clamped():
    assert [G.clamp_limit(n) for n in (None, 0, 7, 99)] == [12, 1, 7, 50]
