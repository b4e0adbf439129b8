"""Keyed rows that are merged when they are read."""

import os
import random

from tradewind.sources import keyed_store as KS

SCHEMA = "user_id string, session_id string, n long, list array<string>"


def rows_of(spark, state):
    return spark.createDataFrame([(*k, *v) for k, v in state.items()], SCHEMA)


def read(df):
    got = [((r.user_id, r.session_id), (r.n, r.list)) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def size(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, own in os.walk(root) for f in own if f.endswith(".parquet")}


def test_changes_equal_a_plain_dictionary(spark):
    rng = random.Random(1)
    state = {(f"u{i}", f"s{i % 3}"): (i, [str(i)] * (i % 4) or None) for i in range(300)}
    store = KS.create_store(rows_of(spark, state), ["user_id", "session_id"], buckets=8)
    versions = [(store, dict(state))]
    for step in range(4):
        changed = {k: (-step, ["x"]) for k in rng.sample(sorted(state), 20)} | {(f"new{step}", "s"): (step, None)}
        gone = rng.sample(sorted(state), 9) + [("nobody", "s")]
        deletes = spark.createDataFrame(gone, "user_id string, session_id string")
        store = KS.change_store(spark, store, rows_of(spark, changed), deletes, 0.2 if step > 1 else None)
        state = {k: v for k, v in (state | changed).items() if k not in gone}
        assert read(store.rows(spark)) == state
        assert KS.open_store(spark, store.root) == store
        versions.append((store, dict(state)))
    assert any(not s[1] for s in store.state.values())  # some buckets were rewritten
    for old, want in versions:
        assert read(old.rows(spark)) == want
        assert read(KS.open_store(spark, store.root, old.snapshot).rows(spark)) == want
    asked = [("u5", "s2"), ("u6", "s0"), ("new3", "s"), ("nobody", "s"), ("u5", "s9")]
    got = store.lookup(spark.createDataFrame(asked * 2, "user_id string, session_id string"))
    assert read(got) == {k: v for k, v in state.items() if k in asked}


def test_a_small_change_writes_few_bytes_and_a_lookup_reads_few_buckets(spark):
    state = {(f"u{i}", "s"): (i, [f"word{i * 7919 % 5000}"] * 5) for i in range(20_000)}
    store = KS.create_store(rows_of(spark, state), ["user_id", "session_id"], buckets=10)
    before = size(f"{store.root}/rows")
    changed = {(f"u{i}", "s"): (-i, ["changed"]) for i in range(200)}
    new = KS.change_store(spark, store, rows_of(spark, changed))
    after = size(f"{store.root}/rows")
    assert {f: after[f] for f in before} == before
    assert sum(after.values()) - sum(before.values()) < 0.15 * sum(before.values())  # footers of ten small files
    assert new.rows(spark).where("n < 0").count() == 199
    found = new.lookup(spark.createDataFrame([("u7", "s")], "user_id string, session_id string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert [r.n for r in found.collect()] == [-7]


def test_empty_stores_and_repeated_runs(spark):
    store = KS.create_store(rows_of(spark, {("a", "s"): (1, None)}).limit(0), ["user_id", "session_id"])
    assert store.rows(spark).collect() == [] and KS.open_store(spark, store.root) == store
    one = KS.change_store(spark, store, rows_of(spark, {("a", "s"): (1, None)}))
    again = KS.change_store(spark, store, rows_of(spark, {("a", "s"): (1, None)}))  # a batch that runs twice
    assert read(again.rows(spark)) == {("a", "s"): (1, None)} and again == one
    none = KS.change_store(spark, again, None, rows_of(spark, {("a", "s"): (1, None)}).select("user_id", "session_id"))
    assert none.rows(spark).collect() == [] and KS.change_store(spark, none) is none
    assert read(KS.change_store(spark, none, rows_of(spark, {("b", "s"): (2, ["x"])})).rows(spark)) == {("b", "s"): (2, ["x"])}
