import itertools
import random

from headway.operators import multileg as ml

I = "instance_id string, legs int, max_transfers long, max_walk_s long, deadline long"  # noqa: E741
L = "instance_id string, leg int, dwell_s long, window_from long, window_to long"
C = "instance_id string, leg int, pos long, ready long, arrival long, transfers long, walk_s long"


def tables(spark, instances, legs, candidates):
    return spark.createDataFrame(instances, I), spark.createDataFrame(legs, L), spark.createDataFrame(candidates, C)


def counter_example(budget):
    legs = [("x", k, 0, None, None) for k in range(3)]
    candidates = [("x", 0, 0, 0, 100, 3, 0), ("x", 0, 1, 0, 150, 1, 0), ("x", 1, 0, 160, 300, 2, 0), ("x", 1, 1, 160, 340, 1, 0), ("x", 2, 0, 350, 500, 2, 0)]
    return [("x", 3, budget, 100, 1000)], legs, candidates


def test_greedy_fails_where_complete_finds(spark):
    t = tables(spark, *counter_example(4))
    assert ml.greedy(*t).count() == 0
    assert [tuple(r) for r in ml.complete(*t).collect()] == [("x", [1, 1, 0], 500)]
    wide = tables(spark, *counter_example(7))
    assert ml.greedy(*wide).first().positions == [0, 0, 0]
    out = {r.instance_id: (r.outcome, r.same_arrival) for r in ml.agreement(wide[0], ml.greedy(*wide), ml.complete(*wide)).collect()}
    assert out == {"x": ("both", True)}


def test_complete_against_all(spark):
    rng = random.Random(3)
    instances, legs, candidates = [], [], []
    for k in range(25):
        n = rng.randint(2, 4)
        name = f"i{k}"
        instances.append((name, n, rng.randint(1, 5), rng.randint(200, 900), 4500))
        for g in range(n):
            legs.append((name, g, rng.choice((0, 100)), rng.choice((None, g * 900)), rng.choice((None, g * 1000 + 900))))
            for p in range(3):
                ready = g * 1000 + rng.randint(0, 500)
                candidates.append((name, g, p, ready, ready + rng.randint(100, 600), rng.randint(0, 2), rng.randint(0, 400)))
    got = {r.instance_id: (r.arrival, r.positions) for r in ml.complete(*tables(spark, instances, legs, candidates)).collect()}
    for name, n, mt, mw, dead in instances:
        best = None
        for choice in itertools.product(*([c for c in candidates if c[:2] == (name, g)] for g in range(n))):
            info = [next(x for x in legs if x[:2] == (name, g)) for g in range(n)]
            fine = all((w[3] is None or c[4] >= w[3]) and (w[4] is None or c[4] <= w[4]) and c[4] <= dead for c, w in zip(choice, info))
            fine &= all(b[3] >= a[4] + w[2] for a, b, w in zip(choice, choice[1:], info)) and sum(c[5] for c in choice) <= mt and sum(c[6] for c in choice) <= mw
            key = (choice[-1][4], [c[2] for c in choice])
            best = min(best, key) if fine and best else key if fine else best
        assert got.get(name) == best


def test_violations_by_name(spark):
    legs = [("x", 0, 50, 100, None), ("x", 1, 0, None, 200)]
    t = tables(spark, [("x", 2, 1, 10, 250)], legs, [("x", 0, 0, 0, 90, 1, 6), ("x", 1, 0, 120, 300, 1, 6)])
    assert ml.violations(t[2], t[1], t[0]).first().violations == ["deadline", "precedence", "transfers", "walk", "window_early", "window_late"]
    problems = tables(spark, [("x", 1, 1, 1, 1)], [("x", 0, 0, 9, 3), ("x", 1, 0, None, None)], [("x", 0, 0, 0, 1, 0, 0)])
    assert {r.problem for r in ml.check_instances(*problems).collect()} == {"few_legs", "inverted_window", "empty_domain"}
