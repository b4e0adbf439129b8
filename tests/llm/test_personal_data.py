import hashlib
import re

import pytest

from tradewind.llm.boosting import BoostedTrees, tree_value
from tradewind.llm.personal_data import CUES, VALUES, personal_data, redacted

from .conftest import by_id

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
            "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    found = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, pattern) in enumerate(PLAIN.items())
             for m in re.finditer(pattern, text or "") if passes(kind, m[0])]
    shown = ",".join(s for _, _, s in sorted(found))
    return (*[sum(r == i for _, r, _ in found) for i in range(4)], hashlib.sha256(shown.encode()).hexdigest()), shown


def check(df, texts):
    for i, r in by_id(df).items():
        want, shown = brute(texts[i])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want, texts[i]
        spans = [s for s in r["spans"].split(",") if s]
        assert ",".join(s for s in spans if s.split(":")[0] in PLAIN) == shown
        assert len(spans) == sum(want[:4]) + r["n_added"]
        assert spans == sorted(spans, key=lambda s: int(s.split(":")[1]))


ODD = [None, "", "a@b", "a@b.c_d@e.f", "x.@-.-", "@a.b", "a@b.c@d.e", "é.a+b%c@mail.example.com.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.01.1.1",
       "00000000000255.1.1.1", "1.1.1.99999999999999999999", "4539 1488 0343 6467", "4539-1488-0343-6467x", "4539  1488 0343 6467",
       "4539148803436467 4539148803436467", "0" * 19, "0" * 20, "+1 (017) 555-7713", "+1----", "+12345678+123456789", "+1.2.3.4.5.6.7.8.9",
       "+" * 50 + "1 23456789", "🙂 a@b.cd 🙂 +123456789", "1" * 9000, "a." * 5000 + "@b.c", "1 " * 9000 + "5th", "+1" + "-" * 9000, "\n1.2.3.4\n5.6.7.8"]


def test_base_spans_of_odd_texts(make):
    check(personal_data(make(list(enumerate(ODD)))), dict(enumerate(ODD)))


def test_base_spans_of_random_texts(make, rng):
    bits = ["a", "Z", "9", "1", "12", "255", "256", ".", "..", "@", "-", "_", "+", " ", "(", ")", "é", "\n", "4539148803436467", "+1 "]
    texts = {i: "".join(rng.choice(bits) for _ in range(rng.randrange(60))) for i in range(1500)}
    check(personal_data(make(list(texts.items()))), texts)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(personal_data(docs), {r.doc_id: r.text for r in docs.collect()})


def test_trees_add_what_looks_like_personal_data(make, rng):
    """Numbers after a word for a phone are nearly always phones; those in prices never. One phone lacks its plus."""
    number = lambda: f"({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    rows = [(i, f"call tel. +1 {number()} today") for i in range(400)]
    rows += [(1000 + i, f"pay ${rng.randrange(10 ** 8, 10 ** 9)} now") for i in range(400)]
    rows += [(2000, "call tel. 1 (482) 555-7163 today"), (2001, "pay $123456789 now")]
    got = by_id(personal_data(make(rows)))
    assert got[2000]["spans"] == "number:10:26" and got[2000]["n_added"] == 1
    assert got[2000]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all(got[i]["n_added"] == 0 for i in got if i != 2000)
    shown = {r.doc_id: r.text for r in redacted(make(rows + [(None, None)])).collect()}
    assert shown[2000] == "call tel. [NUMBER] today" and shown[0] == "call tel. [PHONE] today"
    assert shown[2001] == "pay $123456789 now" and shown[None] is None


def test_repeats_nulls_and_empty_tables(make):
    rows = personal_data(make([(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.spans) for r in rows) == [
        (0, 0, ""), (0, 1, "email:0:6"), (1, 1, "email:0:6"), (1, 1, "email:0:6")]
    assert personal_data(make([])).collect() == []
    assert redacted(make([])).collect() == []


def test_trees_fit_an_interaction_and_match_their_columns(spark):
    from pyspark.sql import functions as F

    classes = [((a, b), 100, 90 if a != b else 10) for a in (0, 1) for b in (0, 1)] + [((2, 0), 50, 25)]
    trees = BoostedTrees.fit(classes)
    for x, n, positive in classes:
        assert abs(1 / (1 + 2.718281828 ** -trees.margin(x)) - positive / n) < 0.05
    rows = spark.createDataFrame([x for x, _, _ in classes], "a int, b int").withColumn(
        "margin", trees.column([F.col("a"), F.col("b")])).collect()
    assert all(r.margin == pytest.approx(trees.margin((r.a, r.b))) for r in rows)
    least = trees.threshold(classes, 0.9)
    assert {x for x, _, _ in classes if trees.margin(x) >= least} == {(0, 1), (1, 0)}
    assert trees.threshold(classes, 0.99) is None and BoostedTrees.fit([]).trees == [] and tree_value(0.5, (1,)) == 0.5
    assert len(VALUES) == 8 and len(CUES) == VALUES["cue"] - 1
