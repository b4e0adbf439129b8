import re
from collections import Counter

import numpy as np
import pytest

from tradewind.llm import collocations as module
from tradewind.llm.collocations import collocations, part_range
from tradewind.llm.transducer import CountTransducer


def brute(rows, least, covered, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i:i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    best = {}
    for (lang, *words), a in counts.items():
        if len(words) > 1 and a >= least:
            cuts = [(counts[lang, *words[:k]], counts[lang, *words[k:]]) for k in range(1, len(words))]
            best[lang, *words] = min((2000000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts)), a  # noqa: E741
    inside = {(lang, *words[i:i + m]) for (lang, *words), (_, longer) in best.items() for m in range(2, len(words))
              for i in range(len(words) - m + 1) if 100 * longer >= covered * best[lang, *words[i:i + m]][1]}
    out = []
    for lang in {k[0] for k in best}:
        own = sorted((-s[0], -a, " ".join(k[1:]).encode(), s) for k, (s, a) in best.items() if k[0] == lang and k not in inside)
        out += [(lang, i + 1, p.decode(), -a, s[2], s[3], totals[lang], -score)
                for i, (score, a, p, s) in enumerate(own[:top])]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, rng, monkeypatch, small):
    if small:  # shards, ranges, unions and lanes of a few phrases
        for name, value in (("SHARD_WORDS", 60), ("RANGE_BYTES", 900), ("PENDING", 40), ("LANE_ROWS", 3)):
            monkeypatch.setattr(module, name, value)
    words = ["a", "B", "the", "é", "É", "x\xa0y", "new", "york", "city", "\x1c", "🙂"]
    joints = [" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", " new york city ", " a the a the "]
    rows = [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words) + rng.choice(joints) for _ in range(rng.randrange(40))))
            for _ in range(300)] + [("en", None), ("fr", ""), (None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, rank int").repartition(3)
    for least, covered, top in ((3, 80, 2000), (5, 100, 7)):
        assert rows_of(collocations(docs, least, covered, top)) == brute(rows, least, covered, top)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert rows_of(collocations(docs)) == brute([(r.lang, r.text) for r in docs.collect()], 30, 80, 2000)


def test_one_word_that_begins_most_phrases(spark, rng, monkeypatch):
    monkeypatch.setattr(module, "RANGE_BYTES", 2_000)
    rows = [("en", " ".join(rng.choice(["the the", "the of", str(rng.randrange(60))]) for _ in range(50))) for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(collocations(docs, 4)) == brute(rows, 4, 80, 2000)
    assert len({part_range(f"the the {i}".encode(), 50) for i in range(60)}) > 20


def test_empty_tables_and_texts(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations(docs).collect() == []
    docs = spark.createDataFrame([(None, None), ("en", " \t\n.,")], "lang string, text string")
    assert collocations(docs, 1).collect() == []


def test_scores_pass_64_bits(spark):
    spark.range(1).createOrReplaceTempView("one")
    a = 9 * 10 ** 13
    row = spark.sql(f"select cast(2000000 * cast(cast({a} as long) as decimal(20,0)) div (cast(cast({a} as long) as decimal(20,0)) "
                    f"+ cast({a + 1} as long)) as long) s from one").first()
    assert row.s == 2000000 * a // (2 * a + 1)


def test_transducers_unite_and_compose(rng):
    def phrases(n):
        got = Counter()
        for _ in range(n):
            got[b" ".join(rng.choice([b"a", b"b", b"c", "é".encode()]) for _ in range(rng.randrange(1, 5)))] += rng.randrange(1, 4)
        return got

    def automaton(counted):
        words = sorted({w for p in counted for w in p.split(b" ")})
        grams = np.full((len(counted), 4), -1, np.int32)
        for i, p in enumerate(counted):
            own = [words.index(w) for w in p.split(b" ")]
            grams[i, :len(own)] = own
        return CountTransducer.from_bytes(
            CountTransducer.from_unsorted(words, grams, np.array(list(counted.values()), np.int64)).to_bytes())

    one, two = phrases(60), phrases(90)
    both = CountTransducer.union([automaton(one), automaton(two)])
    total = one + two
    asked = [*total, b"nothing", b"a b c a b", b"a nothing"]
    assert both.compose(asked).tolist() == [total[p] for p in asked]
    arcs = [len({tuple(p.split(b" ")[:d]) for p in total if p.count(b" ") >= d - 1}) for d in range(1, 5)]
    assert [len(w) for _, w, _ in both.levels] == arcs  # one arc for each beginning
    often = both.at_least(5)
    assert often.compose(asked).tolist() == [total[p] if total[p] >= 5 else 0 for p in asked]
    huge = CountTransducer.from_sorted([b"a"], np.array([[0, -1, -1, -1]], np.int32), np.array([2 ** 40]))
    assert CountTransducer.from_bytes(huge.to_bytes()).compose([b"a"]).tolist() == [2 ** 40]
    empty = both.at_least(10 ** 9)
    assert empty.compose([b"a"]).tolist() == [0] and CountTransducer.from_bytes(empty.to_bytes()).words == []
