import itertools
import random

import pytest
from pyspark.sql import functions as F

from headway.functions import geo
from headway.operators import transfers as tr

#: The harbour of the toy feed in metres: three platforms, a church up the hill, a mill at the edge of a walk, and a far lighthouse.
STOPS = [("QN", 0, 0, "QUAY", 0), ("QS", 40, 0, "QUAY", 1), ("QT", -30, 40, "QUAY", 1), ("HILL", 150, 80, "", 1), ("MILL", -200, -100, "", 0), ("LAMP", 5000, 900, None, 2)]
SCHEMA = "stop_id string, x_m long, y_m long, parent_station string, wheelchair int"
PLATFORMS = {"QN", "QS", "QT"}


def stops(spark, rows=STOPS):
    return spark.createDataFrame(rows, SCHEMA)


def stations(spark, wheelchair=1):
    return spark.createDataFrame([("QUAY", wheelchair)], "stop_id string, wheelchair int")


def declared(spark, *rows):
    return spark.createDataFrame(list(rows), "from_stop_id string, to_stop_id string, min_transfer_time int")


def ids(spark, *names):
    return spark.createDataFrame([(i,) for i in names], "stop_id string")


def pairs(df):
    return {(r.from_stop_id, r.to_stop_id) for r in df.collect()}


def both(a, b):
    return {(x, y) for x in a for y in b if x != y} | {(y, x) for x in a for y in b if x != y}


def test_which_rule_gives_the_time(spark):
    d = declared(spark, ("HILL", "QT", 400), ("HILL", "QT", 90), ("QS", "QN", None), ("LAMP", "QN", 1500), ("LAMP", "ELSEWHERE", 10))
    got = {(r.from_stop_id, r.to_stop_id): (r.min_transfer_time, r.walk_s, r.source) for r in tr.min_transfer_times(stops(spark), d).collect()}
    want = {p: (180, 120 if "QS" in p and "QT" in p else 60, "station") for p in both(PLATFORMS, PLATFORMS)}
    want |= {p: (240, 180, "walk") for p in both(PLATFORMS, {"HILL"})} | {p: (300, 240, "walk") for p in both({"QN", "QT"}, {"MILL"})}
    want |= {("HILL", "QT"): (400, 180, "declared"), ("LAMP", "QN"): (1500, None, "declared")}
    assert got == want


def test_other_rules(spark):
    rules = tr.Rules(station_s=75, walk_margin_s=5, bands=((100, 30),))
    got = {(r.from_stop_id, r.to_stop_id): r.min_transfer_time for r in tr.min_transfer_times(stops(spark, [*STOPS, ("SHOP", 60, 30, "", 1)]), declared(spark), rules).collect()}
    assert got == {p: 75 for p in both(PLATFORMS, PLATFORMS)} | {p: 35 for p in both({"QN", "QS", "QT"}, {"SHOP"})}


def test_wheelchairs_and_lifts(spark):
    ok = tr.accessible_stops(stops(spark), stations(spark))
    assert {r.stop_id for r in ok.collect()} == {"QN", "QS", "QT", "HILL"}  # QN by its station
    assert {r.stop_id for r in tr.accessible_stops(stops(spark), stations(spark, 0)).collect()} == {"QS", "QT", "HILL"}
    t = tr.min_transfer_times(stops(spark), declared(spark))
    all_of = both(PLATFORMS | {"HILL"}, PLATFORMS | {"HILL"})
    assert pairs(tr.accessible(t, ok, ids(spark))) == all_of
    assert pairs(tr.accessible(t, ok, ids(spark, "QT", "LAMP"))) == {p for p in all_of if "QT" not in p}
    assert pairs(tr.accessible(t, ok, ids(spark), tr.Rules(wheelchair_walk_s=120))) == both(PLATFORMS, PLATFORMS)


def test_grid_finds_what_all_pairs_have(spark):
    rng = random.Random(9)
    rows = [(f"s{k}", rng.randint(-900, 2200), rng.randint(-2200, 900), "", 1) for k in range(170)]
    near = {(a[0], b[0]) for a, b in itertools.permutations(rows, 2) if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 250**2}
    assert pairs(tr.walks(stops(spark, rows))) == near


def test_closure_over_chains_and_loops(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "y")]
    got = pairs(tr.closure(ids(spark, "a", "d", "x", "z"), spark.createDataFrame(edges, "from_stop_id string, to_stop_id string")))
    assert got == {("a", t) for t in "abcd"} | {("d", t) for t in "bcd"} | {("x", "x"), ("x", "y"), ("z", "z")}
    chain = [(f"k{k:02d}", 240 * k, 0, "", 1) for k in range(23)]
    s = stops(spark, chain)
    assert len(pairs(tr.closure(s.select("stop_id"), tr.walks(s)))) == 23 * 23


def serves(spark):
    return spark.createDataFrame([("tram", "QT"), ("tram", "HILL"), ("ferry", "QS"), ("ferry", "QN")], "route_id string, stop_id string")


def crowd(n):
    return [*STOPS, *((f"c{k}", 900 + k % 7, 900, "", 0) for k in range(n))]


@pytest.mark.parametrize("rule, rows, times, station", [("V1", crowd(42), [], 1), ("V2", STOPS, [("QS", "HILL", 100)], 1), ("V3", STOPS, [], 2), ("V4", STOPS, [("QT", "LAMP", -5)], 1)])
def test_each_rule_rejects(spark, rule, rows, times, station):
    args = stops(spark, rows), stations(spark, station), declared(spark, *times), serves(spark), ids(spark)
    with pytest.raises(tr.InconsistentTransfers) as e:
        tr.transfer_table(*args)
    assert str(e.value).startswith(f"{rule}: ") and "," not in str(e.value)
    assert tr.transfer_table(*args, check=False).count()


def test_flags_of_the_table(spark):
    t = {(r.from_stop_id, r.to_stop_id): (r.on_foot, r.accessible, r.useful) for r in tr.transfer_table(stops(spark), stations(spark), declared(spark, ("LAMP", "QT", 900)), serves(spark), ids(spark)).collect()}
    assert t["QS", "QT"] == (True, True, True) and t["QN", "QS"] == (True, True, False) and t["HILL", "QT"] == (True, True, False)
    assert t["MILL", "QN"] == (True, False, True) and t["LAMP", "QT"] == (False, False, True) and t["QN", "MILL"] == (True, False, False)


def test_useful_without_all_routes_of_all_pairs(spark, monkeypatch):
    """The same pairs as by comparing all routes, but pairs meet few of their second stop's."""
    rng = random.Random(4)
    routes = {f"s{k}": set(rng.sample(range(60), rng.choice((1, 20, 30)))) for k in range(24)}
    routes |= {"all": set(range(60)), "too": set(range(60)), "most": set(range(59)), "few": set(range(4)), "bare": set()}
    rows = [(r, s) for s, rs in routes.items() for r in rs] + [(None, "few")]
    pairs_ = list(itertools.permutations(routes, 2))
    met = []
    monkeypatch.setattr(tr, "stored", lambda df, real=tr.stored: met.append(real(df)) or met[-1])
    got = tr.useful(spark.createDataFrame(pairs_ + pairs_[:9], "from_stop_id string, to_stop_id string"), spark.createDataFrame(rows * 2, "route_id int, stop_id string")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(a, b) for a, b in pairs_ if b == "few" or routes[b] - routes[a]}
    tried = [df.count() for df in met[1:]]
    assert tried[0] <= len(pairs_) and tried[1] < len(pairs_) / 4 and tried[2] < len(pairs_) / 16


def test_projection_and_bands(spark):
    df = spark.createDataFrame([(60.0, 10.0), (60.002, 10.004)], "stop_lat double, stop_lon double")
    (x0, y0), (x1, y1) = sorted((r.x_m, r.y_m) for r in geo.project(df).collect())
    assert (x0, y0) == (-x1, -y1) and abs(x1 - 111) <= 1 and abs(y1 - 111) <= 1
    bands = spark.createDataFrame([(50**2,), (50**2 + 1,), (200**2,), (250**2,), (250**2 + 1,)], "d long").select(geo.walk_seconds(F.col("d")).alias("s"))
    assert [r.s for r in bands.collect()] == [60, 120, 180, 240, None]


def test_dense_cells_and_stations_are_dealt(spark, monkeypatch):
    """All stops in one cell and one station: the same pairs, in parts of a few stops each."""
    monkeypatch.setattr(tr, "PART", 6)
    rows = [(f"s{k}", k * 7 % 240, k * 11 % 240, "one") for k in range(40)] + [("far", 5000, 0, "one"), ("near", 245, 255, None)]
    stops = spark.createDataFrame(rows, "stop_id string, x_m int, y_m int, parent_station string")
    got = [(r.from_stop_id, r.to_stop_id, r.d2) for r in tr.candidates_grid(stops).collect()]
    want = {(a, b, (x - u) ** 2 + (y - w) ** 2) for a, x, y, _ in rows for b, u, w, _ in rows if a != b and "far" not in (a, b)}
    assert len(got) == len(set(got)) and set(got) == want
    same = [(r.from_stop_id, r.to_stop_id) for r in tr.same_station(stops).collect()]
    assert len(same) == len(set(same)) == 41 * 40
