"""Sources that read files, on small ones."""

import io
import zipfile

import zstandard

from viaduct.sources import payloads as py
from viaduct.sources import providers as pv


def test_packed_feed_is_read_once(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("stops.txt", '﻿stop_id,stop_name\nA,"One, ""two"""\nB,"line\nbreak"\n')
        z.writestr("calendar_dates.txt", "service_id,date,exception_type\nV,20240105,1\nV,20240101,2\n")
        z.writestr("other.txt", "x\n1\n")
    (tmp_path / "feed.zip").write_bytes(held.getvalue())
    rows = py.packed_feed(spark, str(tmp_path))
    assert sorted(tuple(r) for r in py.feed_table(rows, "stops", ["stop_id", "stop_name", "zone"]).collect()) == [("A", 'One, "two"', None), ("B", "line\nbreak", None)]
    assert tuple(py.feed_days(rows).first()) == ("20240101", "20240105")
    assert py.packed_feed(spark, str(tmp_path), [py.digest(held.getvalue())]).isEmpty()


def test_positional_times(spark, tmp_path):
    (tmp_path / "t.txt").write_text('any,header,at,all,x\nT1,25:01:02,25:02,S1,3\nT1,8:00:00,8:00:30,S2\nT1,8:00:00,8:00\n"T2",1:00:00,1:00:00,S1,1\nT3,bad,1:00:00,S3,x\n')
    got = sorted(tuple(r) for r in py.positional_times(spark, str(tmp_path)).collect())
    assert got == [("T1", 0, "S2", 28800, 28830), ("T1", 3, "S1", 90062, 90120), ("T3", 0, "S3", None, 3600)]


def test_packed_payloads_and_reports(spark, tmp_path):
    (tmp_path / "a.zst").write_bytes(zstandard.ZstdCompressor().compress('{"è": 1}'.encode()))
    (tmp_path / "b.json").write_text("{}")
    assert [r.payload for r in py.packed_payloads(spark, str(tmp_path)).collect()] == ['{"è": 1}']
    for day in ("2024-01-03", "2024-01-01", "2024-01-02", "latest"):
        (tmp_path / f"backtest-{day}.md").write_text(f"# {day}")
    assert [tuple(r) for r in py.reports(spark, str(tmp_path), "backtest", 2).collect()] == [("2024-01-03", "# 2024-01-03"), ("2024-01-02", "# 2024-01-02")]


def test_second_feed(spark, tmp_path):
    (tmp_path / "stops.txt").write_text('\ufeffstop_id,stop_name,stop_lat,stop_lon\n1,"Duomo, M1",45.46,9.19\n2,Cadorna,x,9.17\n', encoding="utf-8")
    (tmp_path / "routes.txt").write_text("route_id,route_short_name,route_type\nM1,1,1\n")
    (tmp_path / "trips.txt").write_text("route_id,service_id,trip_id\nM1,W,T1\n")
    (tmp_path / "stop_times.txt").write_text('trip_id,arrival_time,departure_time,stop_id,stop_sequence\r\nT1,25:01:00,25:02:00,1,3\r\nT1,"8:00",x,2,4\r\nT1,1,2\r\nT1,08:00:00,,2,\r\n')
    (tmp_path / "calendar.txt").write_text("service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nW,1,0,0,0,0,0,1,20240101,20240108\nN,1,1,1,1,1,1,1,,20240108\n")
    (tmp_path / "calendar_dates.txt").write_text("service_id,date,exception_type\nW,20240107,2\nW,20240103,1\nS,20240106,\n")
    got = pv.metro_feed(spark, str(tmp_path))
    rows = lambda name: sorted(tuple(r) for r in got[name].collect())
    assert rows("stops") == [("1", "Duomo, M1", 45.46, 9.19), ("2", "Cadorna", None, 9.17)] and rows("routes") == [("M1", "1", None, 1)] and rows("trips") == [("T1", "M1", "W")]
    assert rows("stop_times") == [("T1", 0, "2", 28_800, None), ("T1", 3, "1", 90_060, 90_120)]
    assert [(a, str(d), t) for a, d, t in rows("calendar_dates")] == [("S", "2024-01-06", 1), ("W", "2024-01-01", 1), ("W", "2024-01-03", 1), ("W", "2024-01-07", 2), ("W", "2024-01-08", 1)]
    (tmp_path / "calendar.txt").unlink()
    (tmp_path / "calendar_dates.txt").unlink()
    assert pv.metro_feed(spark, str(tmp_path))["calendar_dates"].isEmpty()
