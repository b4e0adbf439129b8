import numpy as np
import pytest

from tradewind.llm import quality as module
from tradewind.llm.quality import STATISTICS, byte_classes, count, count_long, keep_quality, quality_scores, statistics

from .conftest import by_id


@pytest.fixture
def table(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


def row(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return dict(zip(STATISTICS, statistics(count(data, np.array([len(data)]), byte_classes())[0])[0]))


def test_statistics_of_a_text():
    s = row("Ab ab ab cd!! né | 12\n")
    assert np.isclose(np.expm1(s["log words"]), 7)
    assert np.isclose(s["words equal to the one before"] ** 2, 1 / 7)
    assert np.isclose(s["words that end in two marks or more"] ** 2, 1 / 7)
    assert np.isclose(s["words without letters"] ** 2, 2 / 7)
    assert np.isclose(s["mean word length"], (2 + 2 + 2 + 4 + 2 + 1 + 2) / 7)
    assert np.isclose(np.expm1(s["log longest word"]), 4)
    assert np.isclose(s["letters beyond ASCII"] ** 2, 1 / 22)
    assert set(row("").values()) == {0.0}


def test_documents_do_not_mix():
    texts = ["aa aa", "", "aa", " ", "b" * 3000, "aa x"]
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    together = statistics(count(np.concatenate(data), np.array([len(d) for d in data]), byte_classes())[0])
    alone = [list(row(t).values()) for t in texts]
    assert np.allclose(together, alone)


def test_long_texts_are_read_in_parts(monkeypatch, rng):
    monkeypatch.setattr(module, "CHUNK", 40)
    text = " ".join(rng.choice(["a", "a a", "Né!!", "12", "|", "x\n", "longer"]) for _ in range(300))
    assert np.allclose(statistics(count_long(np.frombuffer(text.encode(), np.uint8), byte_classes())), list(row(text).values()))


def test_held_out_accuracy(table):
    scores = by_id(quality_scores(table("documents"), table("labels")))
    held = [(scores[r.doc_id], r.quality) for r in table("labels").collect() if scores[r.doc_id]["held_out"]]
    assert len(held) > 50
    assert sum(s["predicted"] == q for s, q in held) / len(held) >= 0.97
    assert all(0 <= s["score"] <= 1 for s in scores.values()) and len(scores) == 1000


def test_held_out_labels_are_not_read(table):
    from pyspark.sql import functions as F

    labels = table("labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (by_id(quality_scores(table("documents"), x)) for x in (labels, turned))
    assert all(abs(a[k]["score"] - b[k]["score"]) < 1e-9 for k in a)


def test_odd_rows(make, spark, table):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1), (None, 1), (9, 7)], "doc_id long, quality int")
    rows = [(1, None), (2, ""), (3, "x " * 200_000), (3, "x"), (None, "y"), (None, None)]
    got = quality_scores(make(rows), labels).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    assert quality_scores(make([]), labels).collect() == []
    far = table("documents").select("doc_id", "text").unionByName(make([(10 ** 9 + i, t) for i, (_, t) in enumerate(rows)]).select(
        "doc_id", "text"))
    assert all(0 <= r.score <= 1 for r in quality_scores(far, table("labels")).collect())


def test_rejected_documents_go_and_clean_ones_stay(table):
    docs = table("documents")
    kept = keep_quality(docs, table("labels"))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    label = {r.doc_id: r.quality for r in table("labels").collect()}
    assert all(d in ids for d, q in label.items() if q == 1)
    assert sum(d in ids for d, q in label.items() if q == 0) <= 2


def test_scores_equal_a_plain_computation(table):
    """Means, shrunk covariances, Mahalanobis distances and the logistic function, computed anew without factors or sums."""
    from zlib import crc32

    docs, labels = table("documents"), {r.doc_id: r.quality for r in table("labels").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    x = {i: np.array(list(row(t).values())) for i, t in texts.items()}
    known = [i for i in texts if labels.get(i) in (0, 1) and crc32(str(i).encode()) % 4 != 2]
    rows, label = np.stack([x[i] for i in known]), np.array([labels[i] for i in known])
    mean, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-6)
    z = (rows - mean) / scale
    covs = [np.cov(z[label == k].T, bias=True) for k in (0, 1)]
    pooled = sum(cov * (label == k).mean() for k, cov in enumerate(covs))

    def density(v, k):
        cov = 0.9 * covs[k] + 0.1 * pooled + 0.02 * np.eye(len(v))
        away = np.clip(v, -8, 8) - z[label == k].mean(axis=0)
        return np.log((label == k).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * away @ np.linalg.solve(cov, away)

    def squeezed(v):
        d = density(v, 1) - density(v, 0)
        return np.sign(d) * np.log1p(abs(d))

    d, w = np.array([squeezed(v) for v in z]), np.array([1.0, 0.0])
    for _ in range(200):  # the penalised logistic fit, to its minimum
        p = 1 / (1 + np.exp(-(w[0] * d + w[1])))
        gradient = np.array([(p - label) @ d, (p - label).sum()]) + 0.5 * (w - [1.0, 0.0])
        curve = p * (1 - p)
        w = w - np.linalg.solve(np.array([[curve @ d ** 2, curve @ d], [curve @ d, curve.sum()]]) + 0.5 * np.eye(2), gradient)
    got = {r.doc_id: r.score for r in quality_scores(docs, table("labels")).collect()}
    for i in list(texts)[:200]:
        want = 1 / (1 + np.exp(-(w[0] * squeezed((x[i] - mean) / scale) + w[1])))
        assert got[i] == pytest.approx(want, abs=1e-6)
