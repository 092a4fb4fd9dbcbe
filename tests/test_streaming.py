import pytest

from viaduct.operators import quality, upserts
from viaduct.streaming import ingest, live

SHAPE = "run_id long, id long, ts long, source string, delay_seconds long"
ROWS = [(1, k, 1_700_000_000_000 + k * 40_000, "ab"[k % 2], 10 * (k // 4) ** 2) for k in range(24)] + [(2, 90, 1_700_000_000_000, "a", None)]


def stream(spark, tmp_path, rows):
    for n, part in enumerate((rows[:12], rows[12:])):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def drained(df, tmp_path, spark, mode="append"):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # or time-outs by the clock keep it running
    query = df.writeStream.format("memory").queryName("t").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table("t").collect()


def test_coverage_stream_equals_batch(spark, tmp_path):
    batch = {tuple(r) for r in live.coverage(spark.createDataFrame(ROWS, SHAPE)).collect()}
    found = drained(live.coverage(stream(spark, tmp_path, ROWS)), tmp_path, spark, "complete")
    assert {tuple(r) for r in found} == batch


def test_repeats_are_dropped_once(spark, tmp_path):
    found = drained(live.first_seen(stream(spark, tmp_path, ROWS + ROWS), ["id"]), tmp_path, spark)
    assert sorted(r.id for r in found) == sorted(r[1] for r in ROWS)


OBS = "run_id long, id long, ts long, source string, observed_at long, delay_seconds long, location_id string, name string"
MANY = [(k % 5, k, 1_700_000_000_000 + k * 41_000 % 3_000_000, "ab"[k % 2], None if k % 9 == 0 else 1_700_000_000_000 + k * 71_000 % 2_500_000, None if k % 7 == 0 else k * k * 911 % 9000, f"S{k % 4}", ["Bivio X", "Y", None][k % 3]) for k in range(60)]


def both(spark, tmp_path, rows, shape, run, order=None, mode="append"):
    """What ``run`` gives for a batch and for the same rows as a stream of three files."""
    rows = sorted(rows, key=order) if order else rows
    batch = sorted(map(str, map(tuple, run(spark.createDataFrame(rows, shape)).collect())))
    for n in range(3):
        part = spark.createDataFrame(rows[n * len(rows) // 3 : (n + 1) * len(rows) // 3], shape)
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    found = drained(run(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))), tmp_path, spark, mode)
    return batch, sorted(map(str, map(tuple, found)))


BY_TIME = lambda r: (r[2], r[1])


def test_sliding_windows_stream_equals_batch(spark, tmp_path):
    batch, found = both(spark, tmp_path, MANY, OBS, live.sliding, mode="complete")
    assert batch == found and len(batch) > 10


def test_sessions_stream_equals_batch(spark, tmp_path):
    run = lambda df: live.sessions(df, gap="3 minutes")
    batch, found = both(spark, tmp_path, MANY, OBS, run, mode="complete")
    assert batch == found and len(batch) > 5


def test_flags_stream_equals_batch_and_drops_nothing(spark, tmp_path):
    batch, found = both(spark, tmp_path, MANY, OBS, live.flagged, BY_TIME)
    assert batch == found and len(batch) == len(MANY)
    seen = {flag for row in batch for flag in row.split("'")[1].split(",")}
    assert seen == {"", "OUT_OF_ORDER", "DELAY_JUMP", "STALE_SOURCE"}


ESTIMATES = "run_id long, id long, ts long, p50 long, operator_eta long"


def test_throttle_keeps_moves_unknown_and_due_rows(spark, tmp_path):
    rows = [(k % 2, k, 1_000_000 + k * 20_000, 5_000_000 + (k // 6) ** 2 * 9_000, None if 20 < k < 25 else 7_000_000 + k // 10 * 40_000) for k in range(40)]
    want, last = [], {}
    for run, key, ts, p50, eta in rows:
        old = last.get(run)
        moved = old is None or any(a is None or b is None or abs(a - b) > 30_000 for a, b in ((p50, old[1]), (eta, old[2])))
        if moved or ts - old[0] > 120_000:
            last[run] = (ts, p50, eta)
            want.append(str((run, key)))
    batch, found = both(spark, tmp_path, rows, ESTIMATES, live.throttled)
    assert batch == found == sorted(want) and len(want) < len(rows)
    assert sorted(str(tuple(r)) for r in quality.throttled(spark.createDataFrame(rows, ESTIMATES)).collect()) == sorted(want)


def test_pushes_tell_each_thing_once_and_wait(spark, tmp_path):
    m = 60_000
    shape = "watch string, id long, ts long, status string, p50 long, risk boolean"
    rows = [("w", 1, 0, "running", 0, False), ("w", 2, 1 * m, "running", 3 * m, False), ("w", 3, 5 * m, "running", 9 * m, True), ("w", 4, 12 * m, "running", 4 * m, True), ("w", 5, 23 * m, "cancelled", 20 * m, True), ("w", 6, 40 * m, "cancelled", 20 * m, True), ("w", 7, 55 * m, "cancelled", 40 * m, True)]
    batch, found = both(spark, tmp_path, rows, shape, live.pushes)
    assert batch == found == sorted(map(str, [("w", 2, "eta"), ("w", 4, "risk"), ("w", 5, "cancelled"), ("w", 7, "eta")]))


def test_outcomes_join_two_streams(spark, tmp_path):
    h = 3_600_000
    shapes = "prediction_id long, run_id long, stop_id string, generated_at long, our_p50 long, operator_eta long", "run_id long, stop_id string, actual_arr_epoch long"
    said = [(1, 1, "A", 10 * h, 11 * h, None), (2, 1, "A", 12 * h, 11 * h, 11 * h), (3, 2, "B", 10 * h, 11 * h, 11 * h), (4, 3, "B", 1 * h, 11 * h, 11 * h)]
    came = [(1, "A", 11 * h + 90_000), (2, "B", 10 * h), (3, "B", 11 * h)]
    batch = {tuple(r) for r in live.outcomes(*map(spark.createDataFrame, (said, came), shapes)).collect()}
    assert batch == {(1, 11 * h + 90_000, 90, None), (3, 10 * h, -3600, -3600)}
    for name, rows, shape in zip(("said", "came"), (said, came), shapes, strict=True):
        spark.createDataFrame(rows, shape).coalesce(1).write.json(str(tmp_path / name))
    streams = [spark.readStream.schema(shape).json(str(tmp_path / name)) for name, shape in zip(("said", "came"), shapes, strict=True)]
    assert {tuple(r) for r in drained(live.outcomes(*streams), tmp_path, spark)} == batch


REPEATED = sorted([r for k, row in enumerate(MANY) for r in [row] + [(row[0], 1000 + 10 * k + j, row[2] + 9_000 * (j + 1), *row[3:]) for j in range(k % 3)]], key=BY_TIME)


@pytest.mark.parametrize("cuts", [(1, 2, 3), (20, 40, 70), (59, 60, 61), ()])
def test_ingest_is_the_same_for_any_cut_into_batches(spark, tmp_path, cuts):
    ends = [0, *cuts, len(REPEATED)]
    for low, high in zip(ends, ends[1:], strict=False):
        spark.createDataFrame(REPEATED[low:high], OBS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    ingest.snapshots(stream, str(tmp_path / "out"), str(tmp_path / "cp"), None).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out/observations")).drop("batch")
    whole = ingest.judged(spark.createDataFrame(REPEATED, OBS)).where("changed").drop("changed").select(kept.columns)
    assert sorted(map(str, kept.collect())) == sorted(map(str, whole.collect())) and len(MANY) * 0.7 < kept.count() < len(REPEATED)
    assert {f for r in kept.collect() for f in r.flags.split(",")} == {"", "OUT_OF_ORDER", "DELAY_JUMP", "STALE_SOURCE"}
    places = upserts.rail_locations(spark.createDataFrame(REPEATED, OBS).where("name IS NOT NULL").selectExpr("id", "name", "ts AS seen_at", "CAST(NULL AS STRING) AS type", "CAST(NULL AS DOUBLE) AS lat", "CAST(NULL AS DOUBLE) AS lon"))
    state = ingest.registry(spark, str(tmp_path / "out"), len(cuts))
    assert sorted(map(str, state.select(sorted(state.columns)).collect())) == sorted(map(str, places.select(sorted(state.columns)).collect()))


def test_three_equal_snapshots_in_three_batches_are_one_observation(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(1, k, 1_700_000_000_000 + k * 30_000, "a", None, 60, "S1", "X")], OBS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    ingest.snapshots(stream, str(tmp_path / "out"), str(tmp_path / "cp"), None).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out/observations")).collect()] == [0]
    assert ingest.registry(spark, str(tmp_path / "out"), 2).first().observation_count == 3


def test_file_sink_lays_rows_out_by_day(spark, tmp_path):
    spark.createDataFrame(MANY, OBS).coalesce(1).write.json(str(tmp_path / "in"))
    ingest.files(spark.readStream.schema(OBS).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), None).awaitTermination()
    ingest.append_observations(spark.createDataFrame(MANY, OBS), str(tmp_path / "twice"))
    ingest.append_observations(spark.createDataFrame(MANY, OBS), str(tmp_path / "twice"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(MANY) and spark.read.parquet(str(tmp_path / "twice")).count() == 2 * len(MANY)
    assert "service_date" in spark.read.parquet(str(tmp_path / "out")).columns


def test_a_gap_of_exactly_fifteen_minutes_ends_a_session(spark):
    rows = spark.createDataFrame([(1, 0), (1, 900_000), (2, 0), (2, 899_999), (3, 0), (3, 900_001)], "run_id long, ts long")
    got = sorted(map(tuple, live.sessions(rows).collect()))
    assert got == [(1, 0, 0, 1), (1, 900_000, 900_000, 1), (2, 0, 899_999, 2), (3, 0, 0, 1), (3, 900_001, 900_001, 1)]
