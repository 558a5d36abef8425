"""Files of events, questions, tracks and competition series."""

import json

import pytest
from pyspark.sql import functions as F

from pastcast.sources import text


def test_events(spark, tmp_path):
    lines = tmp_path / "e.jsonl"
    one = {"event_id": "a", "timestamp": "2024-01-02T00:00:00", "event_type": "x", "title": "t", "tags": ["p"], "impact": {"asset": "s"}, "extra": 1}
    lines.write_text(json.dumps(one) + "\n\n" + json.dumps(one | {"event_id": "b"}) + "\n")
    doc = tmp_path / "s.json"
    doc.write_text(json.dumps({"name": "n", "events": [one, one | {"event_id": "b"}]}, indent=1))
    got = [sorted((r.event_id, tuple(r.tags), r.impact["asset"]) for r in text.read_events(spark, str(p)).collect()) for p in (lines, doc)]
    assert got[0] == got[1] == [("a", ("p",), "s"), ("b", ("p",), "s")]
    text.write_events(text.read_events(spark, str(doc)), str(tmp_path / "out"))
    assert text.read_events(spark, str(tmp_path / "out")).count() == 2


def test_event_problems(spark):
    rows = [("a", "2024-01-01", "x", "t", 0), ("a", "2024-01-01", "x", "", 1), (None, "never", "x", "t", 2), ("c", "2030-01-01", "x", "t", 3), ("d", "", "x", "t", 4)]
    e = spark.createDataFrame(rows, "event_id string, timestamp string, event_type string, title string, place int")
    got = {(r.place, r.problem) for r in text.event_problems(e, "place", F.lit("2024-06-01").cast("timestamp")).collect()}
    assert got == {(1, "empty title"), (1, "same id as 0"), (2, "empty event_id"), (2, "bad timestamp"), (3, "in the future"), (4, "empty timestamp")}


def test_questions(spark, tmp_path):
    q = {"questions": [{"question_id": "1", "category": "b", "source": "s", "resolved": True, "resolution": True, "prices": [{"timestamp": "2024-02", "probability": 0.9}, {"timestamp": "2024-01", "probability": 0.1}]}, {"question_id": "2", "category": "a", "source": "s", "resolved": False}]}
    p = tmp_path / "q.json"
    p.write_text(json.dumps(q))
    questions, prices = text.read_questions(spark, str(p))
    assert [r.probability for r in prices.orderBy("place").collect()] == [0.1, 0.9]
    s = text.question_summary(questions, prices).first()
    assert (s.questions, s.resolved, s.categories, s.sources) == (2, 1, ["a", "b"], ["s"]) and s.brier == pytest.approx(0.01)


def test_tracks(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("AL012020, ONE, 2,\n20200601, 0600, L, TS, 28.0N, 94.8W, 40, 1005,\n20200601, 1200, , HU, 10.5S, 95.4E, -99, -999,\nAL022020, TWO, 1,\n20200701, 0000, , TD, 1.0N, 2.0W, -99, 1000,\n")
    got = text.read_tracks(spark, str(p)).orderBy("fix_idx").collect()
    assert [(r.storm_id, r.name, r.year, r.fix_idx, r.lat, r.lon, r.max_wind_kt, r.min_pressure_mb, r.status) for r in got] == [("AL012020", "ONE", 2020, 0, 28.0, -94.8, 40.0, 1005.0, "TS"), ("AL012020", "ONE", 2020, 1, -10.5, 95.4, None, None, "HU")]
    assert str(got[1].datetime_utc) == "2020-06-01 12:00:00"


def test_wide_series(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text('"D1","1","2",,"4"\nD2,5,5,5\nD3,1,x\nD4,1\nT1:2020:7,8,9\n')
    rows = text.read_wide(spark, str(p))
    assert sorted((r.series_id, r.pos, r.value) for r in rows.collect()) == [("D1", 0, 1.0), ("D1", 1, 2.0), ("D1", 2, 4.0), ("T1", 0, 7.0), ("T1", 1, 8.0), ("T1", 2, 9.0)]
    assert text.held_back(rows, 1).filter("test").count() == 2


def test_ledger(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    entry = lambda run, at, lane, **m: json.dumps({"run_id": run, "timestamp": at, "lane_id": lane, "status": "done", "metrics_after": m, "more": [1]})
    path.write_text("\n".join([entry("a", "2024-01-01", "x", crps=1.0, hit=0.5), '{"run_id": "b", "timest', "", "not json", entry("b", "2024-01-03", "x", crps=0.5, new=2.0), entry("a", "2024-01-02", "y", crps=3.0, hit=0.25), entry("c", "2024-01-03", "x"), "   "]))
    e = text.read_ledger(spark, str(path))
    assert [r.run_id for r in e.orderBy("line").collect()] == ["a", "b", "a", "c"]
    assert {r.lane_id: (r.entries, r.run_id) for r in text.latest_runs(e).collect()} == {"x": (3, "c"), "y": (1, "a")}
    got = {r.metric: (r.a, r.b, r.delta) for r in text.compared_runs(e, "a", "b").collect()}
    assert got == {"crps": (3.0, 0.5, -2.5), "hit": (0.25, None, None), "new": (None, 2.0, None)}
    with pytest.raises(LookupError):
        text.compared_runs(e, "a", "z")


def test_resumed_work(spark, tmp_path):
    work, path, ran = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "series long, system string"), str(tmp_path / "r"), []
    run = lambda df: df.withColumn("mae", F.col("series") * 1.5)
    assert text.resumed(work.filter("series < 3"), path, ["series", "system"], run).count() == 2
    got = text.resumed(work, path, ["series", "system"], lambda df: (ran.append(df.count()), run(df))[1])
    assert sorted((r.series, r.mae) for r in got.collect()) == [(1, 1.5), (2, 3.0), (3, 4.5)] and ran[-1] == 1
