"""Components, reachability, exact quantiles, numbering and recoveries against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from headway.operators import diagnostics, graphs, network, quantiles, services


def plain_reach(seeds, edges):
    out = set()
    for s in seeds:
        seen, todo = {s}, [s]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(s, t) for t in seen}
    return out


def frame(spark, edges):
    return spark.createDataFrame(edges, "a int, b int")


GRAPHS = {
    "sparse": [(random.Random(1).randint(0, 40) * k % 41, random.Random(k).randint(0, 40)) for k in range(1, 50)],
    "ring with tails": [(k, (k + 1) % 30) for k in range(30)] + [(5, 100), (100, 101), (200, 7), (101, 102)],
    "two rings": [(k, (k + 1) % 9) for k in range(9)] + [(20 + k, 20 + (k + 1) % 7) for k in range(7)] + [(3, 22), (40, 40), (22, 50)],
    "both ways": [(k, k + 1) for k in range(25)] + [(k + 1, k) for k in range(25)] + [(9, 60), (60, 61), (61, 60), (70, 3)],
    "ladder": [(k, k + 1) for k in range(20)] + [(19, 10), (8, 2)],
    "loops only": [(1, 1), (2, 2)],
}


@pytest.mark.parametrize("name, small", [*((name, 100_000) for name in GRAPHS), ("two rings", 0), ("both ways", 3)])
def test_reach(spark, monkeypatch, name, small):
    monkeypatch.setattr(graphs, "PART", 4)
    monkeypatch.setattr(graphs, "SMALL", small)
    edges = GRAPHS[name]
    seeds = sorted({a for a, _ in edges})[::2] + [999]
    got = graphs.reachable(spark.createDataFrame([(s,) for s in seeds], "v int"), frame(spark, edges)).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == plain_reach(seeds, edges)
    strong = {r.v: r.c for r in graphs.strong_components(frame(spark, edges)).collect()}
    every = {x for e in edges for x in e}
    way = plain_reach(every, edges)
    for a in every:
        for b in every:
            assert (strong.get(a, a) == strong.get(b, b)) == ((a, b) in way and (b, a) in way)


def test_components_of_a_long_way(spark, monkeypatch):
    """A way of 3,000 vertices takes few rounds."""
    rounds = []
    cut = graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda df: rounds.append(1) or cut(df))
    got = {r.v: r.c for r in graphs.components(frame(spark, [(k, k + 1) for k in range(3000)] + [(5000, 5001)])).collect()}
    assert set(got.values()) == {0, 5000} and len(got) == 3003 and len(rounds) < 40


def test_no_edges(spark):
    none = frame(spark, [(1, 1)]).limit(0)
    assert [tuple(r) for r in graphs.reachable(spark.createDataFrame([(3,)], "v int"), none).collect()] == [(3, 3)]
    assert graphs.components(none).count() == graphs.strong_components(none).count() == 0


@pytest.mark.parametrize("few", [2048, 4])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "RANGES", 8 if few == 4 else 2048)
    rng = random.Random(3)
    cases = {"spread": [rng.uniform(-5, 5) for _ in range(700)], "hot": [7.0] * 400 + [rng.uniform(0, 9) for _ in range(300)], "far": [rng.expovariate(1) for _ in range(500)] + [1e15, -1e12], "one": [3.5], "two": [1.0, 2.0], "same": [4.0] * 9, "near": [1 + k * 2.0**-52 for k in range(50)]}
    parts = (0.0, 0.1, 0.25, 0.5, 0.999, 1.0)
    for values in cases.values():
        df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double").repartition(3)
        at = sorted(values)
        want = []
        for p in parts:
            k = p * (len(at) - 1)
            lo, hi = at[math.floor(k)], at[math.ceil(k)]
            want.append(lo + (hi - lo) * (k - math.floor(k)))
        assert quantiles.exact_quantiles(df, "x", parts) == want
    assert quantiles.exact_quantiles(df.filter("x IS NULL"), "x", (0.5,)) == [None]


def test_numbering_over_ranges(spark):
    rows = [(k * 7 % 501,) for k in range(501)]
    got = diagnostics.numbered(spark.createDataFrame(rows, "x int").repartition(5), "x").collect()
    assert len(got) == 501 and all(r.k == r.x for r in got)
    assert diagnostics.numbered(spark.createDataFrame(rows, "x int").limit(0), "x").count() == 0


@pytest.mark.parametrize("k, slot", [(1, 900), (2, 900), (3, 50), (2, 10**9)])
def test_recoveries(spark, monkeypatch, k, slot):
    monkeypatch.setattr(network, "SLOT_S", slot)
    rng = random.Random(k)
    trips = [(t, f"R{t % 3}") for t in range(60)]
    times = []
    for t, _ in trips:
        at = rng.randint(0, 3000)
        for seq in range(1, rng.randint(2, 6)):
            at += rng.randint(0, 300)
            times.append((t, seq, rng.choice("abc"), at, at + 10))  # a trip may come to a stop again
    legs = [(n, f"R{rng.randrange(3)}", *rng.sample("abcz", 2), rng.choice([x[4] for x in times])) for n in range(80)]
    want = set()
    for n, route, board, alight, departure in legs:
        found = []
        for t, r in trips:
            for _, seq, stop, _, dep in (x for x in times if x[0] == t):
                later = [x for x in times if x[0] == t and x[1] > seq and x[2] == alight]
                if r == route and stop == board and dep > departure and later:
                    found.append((dep, t, seq, min(later, key=lambda x: x[1])[3]))
        want |= {(n, i, t, dep, arr) for i, (dep, t, _, arr) in enumerate(sorted(found)[:k], 1)}
    df = spark.createDataFrame(times, "trip_id int, seq int, stop_id string, arrival long, departure long")
    got = network.recoveries(df, spark.createDataFrame(trips, "trip_id int, route_id string"), spark.createDataFrame(legs, "leg_id int, route_id string, board_stop string, alight_stop string, departure long"), k).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


@pytest.mark.parametrize("width", [10, 10**6])
def test_as_of(spark, width):
    rng = random.Random(width)
    marks = [(k, rng.randint(-50, 200), f"m{n}") for n, k in enumerate(rng.choice("ab") for _ in range(40))] + [("a", 7, "tie"), ("a", 7, "tie2")]
    rows = [(n, rng.choice("abc"), rng.randint(-60, 260)) for n in range(150)]
    got = services.as_of(spark.createDataFrame(rows, "n int, k string, at int"), spark.createDataFrame(marks, "k string, start int, name string"), F.col("at"), F.col("start"), ("k",), width).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [(s, name) for k, s, name in marks if k == r.k and s <= r["at"]]
        assert (r.mark and (r.mark.start, r.mark.name)) == (max(before) if before else None)
