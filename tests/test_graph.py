"""The rail graph's two families, canonical keys and the three outcomes of an inference, by hand."""

import pytest

from viaduct.operators import graph as gr

STOPS = [("S1", "Milano  Centrale"), ("S2", "Lodi"), ("S3", "Piacenza"), ("S4", "Fiorenzuola"), ("S9", "lodi ")]
TIMES = [("T1", 1, "S1"), ("T1", 2, "S2"), ("T1", 3, "S2"), ("T1", 5, "S3"), ("T2", 1, "S1"), ("T2", 2, "S2"), ("T3", 1, "S3"), ("T3", 2, "S4")]
#: run, source, ts, id, location_id, location_name, kind
SEEN = [
    (1, "mia", 10, 1, "S1", None, "station"), (1, "mia", 20, 2, "X7", " LODI", "station"), (1, "mia", 30, 3, "S2", None, None), (1, "mia", 40, 4, None, "Bivio d'Adda ", "reporting_point"), (1, "mia", 50, 5, "", "  ", None), (1, "mia", 60, 6, "S3", None, None),
    (1, "vt", 15, 7, "S2", None, None), (1, "vt", 16, 8, "S1", None, None), (2, "mia", 5, 9, "X1", "Nowhere else", None), (2, "mia", 6, 10, "S1", None, None),
]


@pytest.fixture(scope="module")
def built(spark):
    stops = spark.createDataFrame(STOPS, "stop_id string, stop_name string")
    seen = spark.createDataFrame(SEEN, "run_id long, source string, ts long, id long, location_id string, location_name string, location_kind string")
    times = spark.createDataFrame(TIMES, "trip_id string, stop_sequence int, stop_id string")
    return seen, stops, *gr.rail_graph(times, seen, stops)


def test_keys(built):
    seen, stops, *_ = built
    got = {r.id: r.key for r in gr.canonical(seen, stops).collect()}
    assert got == {1: "S1", 2: "S2", 3: "S2", 4: "n:BIVIO-D-ADDA", 5: None, 6: "S3", 7: "S2", 8: "S1", 9: "X1", 10: "S1"}


def test_both_families_are_summed_and_sources_not_mixed(built):
    *_, edges, _ = built
    got = {(r.from_id, r.to_id): (r.scheduled, r.observed, r.n, round(r.p, 4)) for r in edges.collect()}
    assert got == {
        ("S1", "S2"): (2, 1, 3, 1.0), ("S2", "S3"): (1, 0, 1, 0.3333), ("S3", "S4"): (1, 0, 1, 1.0), ("S2", "n:BIVIO-D-ADDA"): (0, 1, 1, 0.3333),
        ("n:BIVIO-D-ADDA", "S3"): (0, 1, 1, 1.0), ("S2", "S1"): (0, 1, 1, 0.3333), ("X1", "S1"): (0, 1, 1, 1.0),
    }


def test_nodes(built):
    *_, nodes = built
    got = {r.key: (r.name, r.kind) for r in nodes.collect()}
    assert got["S4"] == ("Fiorenzuola", "station") and got["n:BIVIO-D-ADDA"] == ("Bivio d'Adda", "reporting_point") and got["X1"] == ("Nowhere else", "reporting_point") and got["S1"][0] == "Milano  Centrale" and len(got) == 7


def test_next_sink_and_unknown(spark, built):
    *_, edges, nodes = built
    last = spark.createDataFrame([(1, "S2", None), (2, "S2", "S1"), (3, "S1", "S2"), (4, "S4", "S3"), (5, "Z", None), (6, None, None), (7, "S2", "elsewhere")], "run_id long, key string, previous string")
    got = {r.run_id: (r.outcome, None if r.plausible is None else [(x.key, round(x.p, 4)) for x in r.plausible], r.segment and (r.segment.to, round(r.segment.p, 4))) for r in gr.inferred(last, edges, nodes, 2).collect()}
    assert got[1] == got[7] == ("next", [("S1", 0.5), ("S3", 0.5)], ("S1", 0.3333))
    assert got[2] == ("next", [("S3", 0.5), ("n:BIVIO-D-ADDA", 0.5)], ("S3", 0.3333))  # where it came from is left out
    assert got[3] == ("next", [("S2", 1.0)], ("S2", 1.0))  # nothing else follows
    assert got[4] == ("sink", [], None) and got[5] == got[6] == ("unknown", None, None)
