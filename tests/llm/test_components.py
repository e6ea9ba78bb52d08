"""Components against a plain union of sets, and how much they shuffle."""

import random

import pytest
from chainloom.llm import common, components
from edge_rows import by_id


def plain(edges):
    group = {}
    for x, y in edges:
        if None not in (x, y) and x != y:
            whole = group.get(x, {x}) | group.get(y, {y})
            group.update(dict.fromkeys(whole, whole))
    return {x: (min(whole),) for x, whole in group.items()}


@pytest.mark.parametrize("bound", [0, 500_000])
def test_random_and_known(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    q = random.Random(bound)
    edges = [(q.randint(0, 150), q.randint(0, 150)) for _ in range(90)] + [(None, 3), (4, None), (7, 7), (200, 200)]
    edges += [(300 + k, 340 - k) for k in range(20)] + [(340 - k, 301 + k) for k in range(19)]  # a way of ups and downs
    df = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert by_id(components.components(df(edges)), "component", key="node") == plain(edges)
    for known in (edges[:40], edges[40:], []):
        rest = [e for e in edges if e not in known]
        got = by_id(components.components(df(rest), known=components.components(df(known))), "component", key="node")
        assert got == plain(edges)
    assert components.components(df([])).count() == components.components(df([(1, 1)])).count() == 0


def test_a_star_takes_two_shuffles(spark, monkeypatch):
    """One for the hooks of a round and one for the least nodes; each costs a task a partition, however few the rows are."""
    shuffles = []

    def counted(df):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return common.written(df)

    monkeypatch.setattr(components, "written", counted)
    edges = spark.createDataFrame([(k // 8, k) for k in range(1, 200)], "a long, b long")
    got = components.components(common.written(edges))
    assert {x.component for x in got.collect()} == {0} and got.count() == 200
    assert sum(shuffles) == 2
