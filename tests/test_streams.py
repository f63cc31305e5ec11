"""Event-time state and the keyed queue over many starts from one checkpoint."""

import datetime as dt

from corpusloom.plans import stream_queries as S
from corpusloom.streaming import ingest as I

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_closed_windows_leave_the_state_and_late_rows_stay_out(spark, tmp_path):
    rows = [(DAY + dt.timedelta(days=5 * k, hours=h), "a" if h % 2 else "b", k) for k in range(6) for h in range(96)]
    rows.append((DAY + dt.timedelta(days=4, hours=20), "b", 1))  # a day late: in time, as the mark is at 1 day 23 h
    rows.append((DAY + dt.timedelta(hours=1, minutes=5), "a", 3))  # days late: its window has been given out
    events = spark.createDataFrame(rows, "ts timestamp, event_type string, arrival int")
    reports = S.arrive_and_run(spark, events, str(tmp_path), 6, lambda s: I.closed_windows(s, "ts", "1 hour", "2 days", ["event_type"]))
    got = {(r.start.isoformat(), r.event_type): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    closes = DAY + dt.timedelta(days=25, hours=95) - dt.timedelta(days=2)
    want = {}
    for ts, kind, k in rows:
        start = ts.replace(minute=0, tzinfo=None)
        if (k, kind, ts.minute) != (3, "a", 5) and ts.replace(minute=0) + dt.timedelta(hours=1) <= closes:
            want[start.isoformat(), kind] = want.get((start.isoformat(), kind), 0) + 1
    assert got == want
    sizes = [I.state_rows(r) for r in reports]
    assert max(map(max, sizes)) > 90
    assert all(s[-1] <= 49 for s in sizes)  # after each arrival, windows of two days are open
    assert len(reports) == 6 and sum(r["stateOperators"][0]["numRowsDroppedByWatermark"] for s in reports for r in s) == 1


def test_queue_gives_each_key_once_and_reads_only_what_arrives(spark, tmp_path):
    keys = spark.range(2000).selectExpr("id % 700 k", "cast(id % 20 as int) arrival")
    reports = S.arrive_and_run(spark, keys, str(tmp_path), 20, lambda s: I.new_keys(s, ["k"]))
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(700))
    assert [sum(r["numInputRows"] for r in s) for s in reports] == [100] * 20
    assert I.state_rows(reports[-1])[-1] == 700
    assert all(len(r["sources"]) == 1 for s in reports for r in s)


def test_session_settings_come_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with I.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before
