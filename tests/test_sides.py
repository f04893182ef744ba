"""Pairs of names: blocks are copied once for a side, and pairs of no use stay in their task."""

import numpy as np

from tickloom.operators import aggregates, signals
from tickloom.plans import pairs


def days(spark, names, times):
    rng = np.random.default_rng(11)
    base = rng.normal(size=times).cumsum()
    rows = [(f"s{i}", t, float(50 + base[t] * (i % 3 - 1) + rng.normal())) for i in range(names) for t in range(times) if (i * 7 + t) % 5]
    rows += [("flat", t, 5.0) for t in range(times)] + [(None, 0, 1.0), ("s0", None, 7.0), ("s1", None, 8.0)]
    return spark.createDataFrame(rows, "symbol string, bar long, price double")


def found(df):
    return {(r["a"], r["b"]): tuple(r)[2:] for r in df.collect()}


def test_sides_are_as_large_as_a_task_can_hold():
    # 90,000 and 540,000 names of 30 days: 8 copies of a block, where 22 and 132 groups are.
    assert [-(-g // pairs._span(g, n, 30)) for g, n in ((22, 90_000), (132, 540_000))] == [8, 8]
    assert pairs._span(1, 10, 30) == 1 and pairs._span(40, 10_000, 10**6) == 2


def test_sides_give_all_pairs_once(spark, monkeypatch):
    df = days(spark, 23, 9)
    want = found(pairs.centred_moments(df, groups=1, slices=1, diagonal=True))
    monkeypatch.setattr(pairs, "NAMES_PER_GROUP", 3)
    monkeypatch.setattr(pairs, "MOST_NAMES", 3)
    for fewest, side in ((2, 1 << 21), (3, 1 << 21), (2, 60)):
        monkeypatch.setattr(pairs, "FEWEST_GROUPS", fewest)
        monkeypatch.setattr(pairs, "SIDE", side)
        assert pairs._span(9, 24, 10) > 1
        got = found(pairs.centred_moments(df, diagonal=True))
        assert got.keys() == want.keys()
        for k, v in got.items():
            assert np.allclose(*(np.array([np.nan if x is None else x for x in r], dtype=float) for r in (v, want[k])), equal_nan=True)


def test_pairs_below_the_bounds_stay_in_their_task(spark):
    df = days(spark, 40, 30)
    passed = []
    for least, corr, z in ((12, 0.4, 1.5), (12, 0.0, 1e-9), (2, 0.9, 0.1)):
        every = found(signals.pair_discovery(df, min_corr=corr, min_z=z, least=least, keep=None))
        some = found(signals.pair_discovery(df, min_corr=corr, min_z=z, least=least))
        assert some.keys() == every.keys()
        assert all(np.allclose(*([x for x in r if isinstance(x, (int, float))] for r in (v, every[k]))) for k, v in some.items())
        passed.append(len(every))
    assert passed[0] and passed[1] > passed[0]
    plan = signals.pair_discovery(df, min_corr=0.4, min_z=1.5, least=12, groups=1, slices=1)
    moved = plan._jdf.queryExecution().executedPlan()
    plan._jdf.queryExecution().toRdd().count()
    text = moved.toString()
    assert "FlatMapGroupsInArrow" in text
    made = [int(n.metrics().apply("numOutputRows").value()) for n in nodes(moved) if n.nodeName() == "FlatMapGroupsInArrow" and "numOutputRows" in str(n.metrics().keys())]
    assert not made or min(made) < 41 * 40 // 4
    assert len(found(aggregates.correlation_matrix(df))) == 41 * 40 // 2


def nodes(plan):
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    out = [plan]
    children = plan.children()
    for i in range(children.size()):
        out += nodes(children.apply(i))
    return out
