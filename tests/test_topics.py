"""Records of a message bus: values, offsets, replays."""

import json

from tradewind.session import fresh_path
from tradewind.sources.topics import RECORD, OffsetLog, events_of, read_events, read_records


def value(i, **more):
    return json.dumps({"eventId": f"e{i}", "userId": "u", "timestamp": "2024-01-01T00:00:00", **more})


def test_values_become_events(spark, tmp_path):
    rows = [(value(1, price=2.5, unknown=1), 0, 0), ("{broken", 0, 1), (None, 0, 2), ("[]", 1, 0), (value(2), 1, 1)]
    records = spark.createDataFrame(rows, RECORD)
    got = {r.event_id: r.price for r in events_of(records, "product-views").collect()}
    assert got == {"e1": 2.5, "e2": None}
    records.write.parquet(str(tmp_path / "p"))
    again = read_events(spark, "product-views", str(tmp_path / "p"), records=True)
    assert {r.event_id for r in again.collect()} == {"e1", "e2"} and "user_id" in again.columns


def test_a_batch_that_runs_again_and_records_that_come_again_repeat_nothing(spark):
    log = OffsetLog(fresh_path(spark, "offsets"))
    batch = lambda *places: spark.createDataFrame([(value(f"{p}-{o}"), p, o) for p, o in places], RECORD)
    taken = lambda df: sorted((r.partition, r.offset) for r in df.collect())
    first = batch((0, 0), (0, 1), (1, 0), (0, 1))
    assert taken(log.fresh(first, 0)) == [(0, 0), (0, 1), (1, 0)]
    log.commit(log.fresh(first, 0), 0)
    second = batch((0, 1), (0, 2), (2, 5), (1, 0))
    for _ in range(2):  # the batch fails after its commit and runs again
        assert taken(log.fresh(second, 1)) == [(0, 2), (2, 5)]
        log.commit(log.fresh(second, 1), 1)
    assert sorted(map(tuple, log.marks(spark).collect())) == [(0, 2), (1, 0), (2, 5)]
    assert taken(log.fresh(batch((2, 5), (2, 4), (3, 0)), 2)) == [(3, 0)]
    log.commit(log.fresh(batch(), 2), 2)  # an empty batch
    assert taken(log.fresh(batch((2, 6)), 3)) == [(2, 6)]


def test_a_stream_that_stops_and_goes_on(spark, tmp_path):
    path, log, out = str(tmp_path / "topic"), OffsetLog(fresh_path(spark, "offsets")), str(tmp_path / "out")

    def write(batch, number):
        fresh = log.fresh(batch, number)
        events_of(fresh, "product-views").write.mode("overwrite").parquet(f"{out}/b={number}")
        log.commit(fresh, number)

    for own in ([(0, 0), (0, 1)], [(0, 1), (0, 2), (1, 0)]):
        spark.createDataFrame([(value(f"{p}-{o}"), p, o) for p, o in own], RECORD).coalesce(1).write.mode("append").parquet(path)
        stream = read_records(spark, path, streaming=True)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(write).trigger(
            availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["e0-0", "e0-1", "e0-2", "e1-0"]
