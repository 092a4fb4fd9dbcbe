"""Which of several sources to believe, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How far each source is trusted for a field (others LOW), the sources that see the tracks
# themselves, what a source in trouble loses, and from where on a model's own confidence counts.
LEVELS = ("LOW", "MEDIUM", "HIGH")
TRUST = {
    "actual_stop_time": {"mia": "HIGH", "viaggiatreno": "HIGH"},
    "current_delay": {"viaggiatreno": "HIGH", "mia": "MEDIUM"},
    "future_eta": {"gtfsrt": "HIGH", "mia": "MEDIUM"},
    "position": {},
}
MODELLED = {"future_eta": ("ours",)}
INFRASTRUCTURE = ("mia", "viaggiatreno", "gtfsrt")
LOSES = {"DEGRADED": 1, "PAUSED": 2}
CONFIDENT = ((0.75, 3), (0.5, 2))


def candidate(source: Column, value: Column, observed_at: Column, state: Column | None = None, confidence: Column | None = None) -> Column:
    """What one source says: ``state`` is its health, ``confidence`` a model's own, 0 to 1."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.struct(source.alias("source"), value.alias("value"), observed_at.cast("long").alias("observed_at"), (none("string") if state is None else state).alias("state"), (none("double") if confidence is None else confidence.cast("double")).alias("confidence"))


def _name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), level)


def resolved(rows: DataFrame, candidates: str, field: str, into: str, agreement_sec: float = 0) -> DataFrame:
    """``rows`` with a struct ``into`` made of their array of candidates, and without that array.

    (source, trust, value, observed_at, runner_up, disagreement, reason); null without candidates.

    The most trusted source wins, then the freshest, then the smallest name; a source whose health is
    DEGRADED or PAUSED loses one or two levels.  If the freshest source of all differs from the winner by at
    most ``agreement_sec``, it is taken.  A position is the freshest one of the sources that see the tracks,
    of all sources if there is none; trust counts at equal instants.  Unknown instants are the oldest.
    """
    table, by_track = TRUST[field], field == "position"
    numeric = rows.schema[candidates].dataType.elementType["value"].dataType.typeName() not in ("string", "struct")

    def ranks(c: Column) -> Column:
        base = F.lit(1)
        for name, level in table.items():
            base = F.when(c["source"] == name, LEVELS.index(level) + 1).otherwise(base)
        own = F.lit(1)
        for least, level in reversed(CONFIDENT):
            own = F.when(c["confidence"] >= least, level).otherwise(own)
        base = F.when(c["source"].isin(*MODELLED.get(field, ("",))), own).otherwise(base)
        loss = F.when(c["state"] == "PAUSED", LOSES["PAUSED"]).when(c["state"] == "DEGRADED", LOSES["DEGRADED"]).otherwise(0)
        level, age = F.greatest(F.lit(1), base - loss), F.coalesce(-c["observed_at"], F.lit((1 << 63) - 1))
        first = (age, -level) if by_track else (-level, age)
        return F.struct(first[0].alias("a"), first[1].alias("b"), c["source"].alias("source"), c["value"].alias("value"), c["observed_at"].alias("observed_at"), level.alias("level"), base.alias("base"), c["state"].alias("state"), age.alias("age"))

    known = F.transform(candidates, ranks)
    if by_track:
        near = F.filter(known, lambda c: c["source"].isin(*INFRASTRUCTURE))
        known = F.when(F.size(near) > 0, near).otherwise(known)
    rows = rows.withColumn("_c", F.array_sort(known))
    rows = rows.withColumn("_first", F.get("_c", F.lit(0))).withColumn("_fresh", F.get(F.array_sort(F.transform("_c", lambda c: F.struct(c["age"].alias("age"), c["source"].alias("source"), c.alias("c")))), F.lit(0))["c"])
    swap = F.lit(False)
    if agreement_sec > 0 and not by_track:
        fresher = (F.col("_fresh.source") != F.col("_first.source")) & (F.col("_fresh.observed_at") > F.col("_first.observed_at"))
        swap = F.coalesce(fresher & (F.abs(F.col("_fresh.value") - F.col("_first.value")) <= agreement_sec), F.lit(False))
    rows = rows.withColumn("_swap", swap).withColumn("_won", F.when(F.col("_swap"), F.col("_fresh")).otherwise(F.col("_first")))
    rows = rows.withColumn("_next", F.get(F.filter("_c", lambda c: c["source"] != F.col("_won.source")), F.lit(0)))
    whole = lambda c: F.floor(c + 0.5).cast("long").cast("string")
    apart = F.floor(F.abs(F.col("_won.value") - F.col("_next.value")) + 0.5).cast("long") if numeric else F.lit(None).cast("long")
    trust = F.lit(None).cast("string") if by_track else _name(F.col("_won.level"))

    # The words of the reasons.
    told = lambda c: F.concat(c["source"], F.lit("@"), F.coalesce(c["observed_at"].cast("string"), F.lit("?")))
    won, behind = F.col("_won"), F.col("_next")
    fresher_by = F.when(won["observed_at"].isNotNull() & behind["observed_at"].isNotNull(), F.concat(F.lit(", fresher by "), whole((won["observed_at"] - behind["observed_at"]) / 1000), F.lit("s"))).otherwise("")
    if by_track:
        reason = F.concat(won["source"], F.lit(" wins: freshest infrastructure observation ("), F.array_join(F.transform("_c", told), " vs "), F.lit(")"))
    else:
        agrees = F.concat(won["source"], F.lit(" fresher and agrees with "), F.col("_first.source"), F.lit(f" within {agreement_sec:g}s (delta "), whole(F.abs(F.col("_fresh.value") - F.col("_first.value"))) if numeric else F.lit(""), F.lit(f"s); freshness decides ({field})"))
        sole = F.concat(won["source"], F.lit(f": sole candidate ({field}, trust "), _name(won["level"]), F.lit(")"))
        beats = F.concat(won["source"], F.lit(":"), _name(won["level"]), F.lit(" beats "), behind["source"], F.lit(":"), _name(behind["level"]), F.lit(f" ({field} trust table)"))
        equal = F.concat(won["source"], F.lit(" and "), behind["source"], F.lit(" equal trust "), _name(won["level"]), fresher_by, F.lit(f"; fresher wins ({field})"))
        reason = F.when(F.col("_swap"), agrees).when(behind.isNull(), sole).when(won["level"] > behind["level"], beats).otherwise(equal)
    lost = F.filter("_c", lambda c: c["level"] != c["base"]) if not by_track else F.filter(F.transform(candidates, ranks), lambda c: c["level"] != c["base"])
    lost = F.transform(F.array_sort(F.transform(lost, lambda c: F.struct(c["source"].alias("source"), c["base"].alias("base"), c["level"].alias("level"), c["state"].alias("state")))), lambda c: F.concat(c["source"], F.lit(" "), _name(c["base"]), F.lit("->"), _name(c["level"]), F.lit(" ("), c["state"], F.lit(")")))
    reason = F.concat(reason, F.when(apart.isNotNull(), F.concat(F.lit("; disagreement "), apart.cast("string"), F.lit("s"))).otherwise(""), F.when(F.size(lost) > 0, F.concat(F.lit("; degraded "), F.array_join(lost, ", "))).otherwise(""))
    made = F.struct(won["source"].alias("source"), trust.alias("trust"), won["value"].alias("value"), won["observed_at"].alias("observed_at"), behind["source"].alias("runner_up"), apart.alias("disagreement"), reason.alias("reason"))
    return rows.withColumn(into, F.when(won.isNotNull(), made)).drop("_c", "_first", "_fresh", "_swap", "_won", "_next", candidates)
