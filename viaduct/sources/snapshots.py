"""Trains as two providers tell them: a row for each snapshot, another for each of its calls, with equal columns.

Both are read with a schema in one pass.  A field of a wrong type is null, text fields that hold a number have
the number's text; payloads that are no such object give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.functions.semantics import hms_to_seconds, rome_ymd
from viaduct.sources.providers import epoch_ms, near_epoch

_STATION = "struct<station_id: string, station_ori_name: string>"
_ACTUAL = "struct<arr_estimated_time: string, dep_estimated_time: string, arr_actual_time: string, dep_actual_time: string, arr_delay_actual: double, dep_delay_actual: double>"
_PASS = f"struct<station: {_STATION}, actual_data: {_ACTUAL}, arr_date_time: string, dep_date_time: string, arr_time: string, dep_time: string, platform: string, cancelled: boolean, is_actual_platform: boolean>"
_TRAIN = "struct<train_id: string, train_name: string, delay: double, actual_time: string, train_operator: string, status: string, has_live_info: boolean, actual_station_mir: string, actual_station: string, suppression_type: string, average_crowding: double, average_crowding_label: string>"
# The keys of the first provider's payload.
MIA = f"array<struct<date: string, dep_time: string, arr_time: string, dep_station: {_STATION}, arr_station: {_STATION}, journey_list: array<struct<train: {_TRAIN}, pass_list: array<{_PASS}>>>>>"
# The keys of the second provider's payload.
VT = (
    "ritardo double, tipoTreno string, codLocOrig string, oraUltimoRilevamento string, idStazioneUltimoRilevamento string, stazioneUltimoRilevamento string, fermateSoppresse array<string>, fermate array<struct<id: string, stazione: string, progressivo: double,"
    " partenza_teorica: string, arrivo_teorico: string, programmata: string, partenzaReale: string, arrivoReale: string, ritardoPartenza: double, ritardoArrivo: double, binarioEffettivoPartenzaCodice: string, binarioEffettivoArrivoCodice: string, binarioProgrammatoPartenzaCodice: string, binarioProgrammatoArrivoCodice: string>>"
)


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _seconds(minutes: Column) -> Column:
    return F.floor(minutes * 60 + 0.5).cast("long")


def _instant(iso: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(_text(iso)))


def _mia_trains(raw: DataFrame, column: str) -> DataFrame:
    j = raw.select(F.get(F.from_json(column, MIA), F.lit(0)).alias("j")).select("j.*")
    j = j.withColumn("leg", F.get("journey_list", F.lit(0))).where("leg IS NOT NULL AND length(date) >= 8")
    day = F.concat_ws("-", F.substring("date", 1, 4), F.substring("date", 5, 2), F.substring("date", 7, 2))
    number = F.coalesce(_text(F.col("leg.train.train_id")), _text(F.col("leg.train.train_name")))
    return j.withColumn("train_number", number).where("train_number IS NOT NULL").withColumn("service_date", day).withColumn("source_key", F.concat("date", F.lit("|"), "train_number"))


def mia(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Snapshots of the first provider: identity, delay, status, place and crowding."""
    train, passes = F.col("leg.train"), F.col("leg.pass_list")
    seen = _text(train["actual_time"])
    observed = F.coalesce(F.when(seen.contains("T"), _instant(seen)), near_epoch(F.col("service_date"), seen, F.lit(None).cast("long")))
    gone = train["suppression_type"].isNotNull() | F.coalesce(F.exists(passes, lambda c: F.coalesce(c["cancelled"], F.lit(False))), F.lit(False))
    return _mia_trains(raw, column).select(
        F.lit("mia").alias("source"), "source_key", "service_date", "train_number", F.coalesce(_text(train["train_operator"]), F.lit("TRENORD")).alias("operator"),
        F.coalesce(_text(F.col("dep_station.station_id")), _text(F.get(passes, F.lit(0))["station"]["station_id"])).alias("origin_stop_id"), F.coalesce(_text(F.col("arr_station.station_id")), _text(F.try_element_at(passes, F.lit(-1))["station"]["station_id"])).alias("destination_stop_id"),
        hms_to_seconds(_text(F.col("dep_time"))).alias("sched_dep_sec"), hms_to_seconds(_text(F.col("arr_time"))).alias("sched_arr_sec"),
        _seconds(train["delay"]).alias("delay_seconds"), _text(train["status"]).alias("status"), train["has_live_info"].alias("has_live_info"), _text(train["actual_station_mir"]).alias("location_id"), _text(train["actual_station"]).alias("location_name"), observed.alias("observed_at"),
        F.when(gone, True).alias("cancelled"), train["average_crowding"].alias("crowding"), _text(train["average_crowding_label"]).alias("crowding_label"),
    )


def mia_calls(raw: DataFrame, column: str = "raw") -> DataFrame:
    """The calls of :func:`mia`'s snapshots.  Local times of day are put on the service date, within half a day of the
    call's planned instant where there is one."""
    j = _mia_trains(raw, column).select("source_key", "service_date", "train_number", F.posexplode("leg.pass_list").alias("k", "p"))
    j = j.withColumn("arr", _instant(F.col("p.arr_date_time"))).withColumn("dep", _instant(F.col("p.dep_date_time"))).withColumn("ref", F.coalesce("arr", "dep"))
    told, none = F.col("p.actual_data"), F.lit(None).cast("long")
    at = lambda c, name: near_epoch(F.col("service_date"), _text(told[c]), F.col("ref")).alias(name)
    plain = lambda c: near_epoch(F.col("service_date"), _text(F.col(f"p.{c}")), none)
    return j.select(
        "source_key", "service_date", "train_number", (F.col("k") + 1).alias("stop_sequence"), _text(F.col("p.station.station_id")).alias("stop_id"), _text(F.col("p.station.station_ori_name")).alias("stop_name"),
        F.coalesce("arr", plain("arr_time")).alias("sched_arr_epoch"), F.coalesce("dep", plain("dep_time")).alias("sched_dep_epoch"),
        at("arr_estimated_time", "op_pred_arr_epoch"), at("dep_estimated_time", "op_pred_dep_epoch"), at("arr_actual_time", "actual_arr_epoch"), at("dep_actual_time", "actual_dep_epoch"),
        _seconds(told["arr_delay_actual"]).alias("arr_delay_sec"), _seconds(told["dep_delay_actual"]).alias("dep_delay_sec"), _text(F.col("p.platform")).alias("platform"), F.col("p.is_actual_platform").alias("platform_is_actual"), F.col("p.cancelled").alias("cancelled"),
    )


def _vt_trains(raw: DataFrame, column: str) -> DataFrame:
    j = raw.select("train_number", "origin", "departure", F.from_json(column, VT).alias("j")).where("j IS NOT NULL").select("train_number", "origin", "departure", "j.*")
    return j.withColumn("source_key", F.concat_ws("|", "train_number", "origin", F.col("departure").cast("string"))).withColumn("service_date", rome_ymd(F.col("departure")))


def vt(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Snapshots of the second provider with the same columns; ``raw`` also has train_number, origin and departure, the
    midnight of the service day in Rome, which the payload lacks."""
    first, last = F.get("fermate", F.lit(0)), F.try_element_at("fermate", F.lit(-1))
    planned = lambda c, key: F.coalesce(epoch_ms(c[key]), epoch_ms(c["programmata"]))
    since = lambda at: F.floor((at - F.col("departure")) / 1000 + 0.5).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    return _vt_trains(raw, column).select(
        F.lit("viaggiatreno").alias("source"), "source_key", "service_date", "train_number", F.lit("RFI").alias("operator"),
        F.coalesce(_text(F.col("codLocOrig")), _text(first["id"]), "origin").alias("origin_stop_id"), _text(last["id"]).alias("destination_stop_id"), since(planned(first, "partenza_teorica")).alias("sched_dep_sec"), since(planned(last, "arrivo_teorico")).alias("sched_arr_sec"),
        _seconds(F.col("ritardo")).alias("delay_seconds"), _text(F.col("tipoTreno")).alias("status"), F.col("oraUltimoRilevamento").isNotNull().alias("has_live_info"), _text(F.col("idStazioneUltimoRilevamento")).alias("location_id"), _text(F.col("stazioneUltimoRilevamento")).alias("location_name"), epoch_ms(F.col("oraUltimoRilevamento")).alias("observed_at"),
        F.when(F.size("fermateSoppresse") > 0, True).alias("cancelled"), none("double").alias("crowding"), none("string").alias("crowding_label"),
    )


def vt_calls(raw: DataFrame, column: str = "raw") -> DataFrame:
    """The calls of :func:`vt`'s snapshots with the same columns as the first provider's.  What has not happened yet is
    expected at its plan and the train's present delay."""
    j = _vt_trains(raw, column).select("source_key", "service_date", "train_number", _seconds(F.col("ritardo")).alias("delay"), F.explode("fermate").alias("f"))
    dep, arr, planned = epoch_ms(F.col("f.partenza_teorica")), epoch_ms(F.col("f.arrivo_teorico")), epoch_ms(F.col("f.programmata"))
    left, came = epoch_ms(F.col("f.partenzaReale")), epoch_ms(F.col("f.arrivoReale"))
    platform = F.coalesce(_text(F.col("f.binarioEffettivoPartenzaCodice")), _text(F.col("f.binarioEffettivoArrivoCodice")))
    plan = F.coalesce(_text(F.col("f.binarioProgrammatoPartenzaCodice")), _text(F.col("f.binarioProgrammatoArrivoCodice")))
    return j.select(
        "source_key", "service_date", "train_number", F.floor(F.col("f.progressivo") + 0.5).cast("int").alias("stop_sequence"), _text(F.col("f.id")).alias("stop_id"), _text(F.col("f.stazione")).alias("stop_name"),
        F.coalesce(arr, planned).alias("sched_arr_epoch"), F.coalesce(dep, planned).alias("sched_dep_epoch"), F.coalesce(came, arr + F.col("delay") * 1000).alias("op_pred_arr_epoch"), F.coalesce(left, dep + F.col("delay") * 1000).alias("op_pred_dep_epoch"), came.alias("actual_arr_epoch"), left.alias("actual_dep_epoch"),
        _seconds(F.col("f.ritardoArrivo")).alias("arr_delay_sec"), _seconds(F.col("f.ritardoPartenza")).alias("dep_delay_sec"), F.coalesce(platform, plan).alias("platform"), platform.isNotNull().alias("platform_is_actual"), F.lit(None).cast("boolean").alias("cancelled"),
    )
