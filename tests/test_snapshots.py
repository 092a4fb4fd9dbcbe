"""Providers' snapshots, on payloads made by hand."""

import json

from viaduct.sources import snapshots as sn

H = 3_600_000
MIDNIGHT = 1_717_192_800_000  # 1 June 2024 in Rome


def station(k, name):
    return {"station_id": k, "station_ori_name": name}


MIA = [{
    "date": "20240601", "dep_time": "23:30:00", "arr_time": "24:20", "dep_station": station("S1", "Milano"), "arr_station": {},
    "journey_list": [{"train": {"train_id": "", "train_name": "2613", "delay": 2.5, "actual_time": "23:41", "status": "V", "has_live_info": True, "actual_station_mir": "S1", "actual_station": "MILANO", "average_crowding": 40, "average_crowding_label": "LOW"}, "pass_list": [
        {"station": station("S1", "Milano"), "dep_date_time": "2024-06-01T23:30:00+02:00", "platform": "4", "is_actual_platform": True, "cancelled": False, "actual_data": {"dep_actual_time": "23:32", "dep_delay_actual": 2}},
        {"station": station("S2", "Lodi"), "arr_date_time": "2024-06-02T00:10:00+02:00", "platform": "", "actual_data": {"arr_estimated_time": "00:12:30", "arr_delay_actual": "x"}},
        {"station": station("S3", None), "arr_time": "00:20", "cancelled": True},
    ]}],
}]


def test_first_provider(spark):
    raw = spark.createDataFrame([(json.dumps(MIA),), ("broken",), ("[]",), ("{}",), (None,), (json.dumps([{"date": "20240601", "journey_list": [{"train": {}}]}]),), (json.dumps([{"journey_list": [{"train": {"train_id": "1"}}]}]),)], "raw string")
    rows = sn.mia(raw).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.source_key, r.service_date, r.train_number, r.operator, r.origin_stop_id, r.destination_stop_id) == ("20240601|2613", "2024-06-01", "2613", "TRENORD", "S1", "S3")
    assert (r.sched_dep_sec, r.sched_arr_sec, r.delay_seconds, r.status, r.has_live_info, r.location_id, r.location_name) == (84_600, 87_600, 150, "V", True, "S1", "MILANO")
    assert (r.observed_at, r.cancelled, r.crowding, r.crowding_label) == (MIDNIGHT + 23 * H + 41 * 60_000, True, 40.0, "LOW")
    a, b, c = sorted(sn.mia_calls(raw).collect(), key=lambda x: x.stop_sequence)
    assert (a.stop_sequence, a.sched_dep_epoch, a.sched_arr_epoch, a.actual_dep_epoch, a.dep_delay_sec, a.platform, a.platform_is_actual, a.cancelled) == (1, MIDNIGHT + 23 * H + 1_800_000, None, MIDNIGHT + 23 * H + 1_920_000, 120, "4", True, False)
    assert (b.stop_name, b.sched_arr_epoch, b.op_pred_arr_epoch, b.arr_delay_sec, b.platform) == ("Lodi", MIDNIGHT + 24 * H + 600_000, MIDNIGHT + 24 * H + 750_000, None, None)  # past midnight
    assert (c.stop_name, c.sched_arr_epoch, c.cancelled) == (None, MIDNIGHT + 1_200_000, True)  # without an instant the time stands on the service day
    assert {x.source_key for x in (a, b, c)} == {r.source_key}


VT = {
    "ritardo": 3, "tipoTreno": "PG", "oraUltimoRilevamento": MIDNIGHT + 8 * H, "idStazioneUltimoRilevamento": "S01", "stazioneUltimoRilevamento": "LODI", "fermateSoppresse": [{"id": "S9"}],
    "fermate": [
        {"id": "S00", "stazione": "MILANO", "progressivo": 1, "partenza_teorica": MIDNIGHT + 7 * H, "programmata": MIDNIGHT + 7 * H, "partenzaReale": MIDNIGHT + 7 * H + 60_000, "ritardoPartenza": 1, "binarioEffettivoPartenzaCodice": "5", "binarioProgrammatoPartenzaCodice": "4"},
        {"id": "S02", "stazione": "PIACENZA", "progressivo": 3, "arrivo_teorico": (MIDNIGHT + 9 * H) // 1000, "ritardoArrivo": 0, "binarioProgrammatoArrivoCodice": "2"},
    ],
}


def test_second_provider(spark):
    raw = spark.createDataFrame([("2613", "S00", MIDNIGHT, json.dumps(VT)), ("1", "S7", MIDNIGHT, "{}"), ("2", "S7", MIDNIGHT, None)], "train_number string, origin string, departure long, raw string")
    rows = {r.train_number: r for r in sn.vt(raw).collect()}
    r = rows["2613"]
    assert (r.source_key, r.service_date, r.operator, r.origin_stop_id, r.destination_stop_id, r.sched_dep_sec, r.sched_arr_sec) == (f"2613|S00|{MIDNIGHT}", "2024-06-01", "RFI", "S00", "S02", 7 * 3600, 9 * 3600)
    assert (r.delay_seconds, r.status, r.has_live_info, r.location_id, r.observed_at, r.cancelled) == (180, "PG", True, "S01", MIDNIGHT + 8 * H, True)
    a, b = sorted(sn.vt_calls(raw).collect(), key=lambda x: x.stop_sequence)
    assert (a.op_pred_dep_epoch, a.actual_dep_epoch, a.dep_delay_sec, a.platform, a.platform_is_actual) == (MIDNIGHT + 7 * H + 60_000, MIDNIGHT + 7 * H + 60_000, 60, "5", True)
    assert (b.stop_sequence, b.sched_arr_epoch, b.op_pred_arr_epoch, b.actual_arr_epoch, b.arr_delay_sec, b.platform, b.platform_is_actual) == (3, MIDNIGHT + 9 * H, MIDNIGHT + 9 * H + 180_000, None, 0, "2", False)
    assert (rows["1"].origin_stop_id, rows["1"].cancelled, rows["1"].has_live_info) == ("S7", None, False) and "2" not in rows
    none = spark.createDataFrame([], "raw string")
    assert sn.mia(none).columns == sn.vt(raw).columns and sn.mia_calls(none).columns == sn.vt_calls(raw).columns and sn.mia_calls(none).isEmpty()
