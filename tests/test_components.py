import random

from driftmark.plans.cluster import ranked, running
from driftmark.plans.components import components


def _plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


def test_components_of_a_mixed_graph(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 130)]
    star = [(500, i) for i in range(400, 460)]
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    edges = chain + star + loose + star[:5] + [(b, a) for a, b in chain[:5]]
    df = spark.createDataFrame([*edges, (None, 1), (7, 7)], "a long, b long")
    rows = [(r["id"], r["component"]) for r in components(df).collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == _plain([e for e in edges if e[0] != e[1]])


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks_are_gapless_and_fixed(spark):
    rows = [(i, i % 3 if i % 2 else 0, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g long, w long")
    got = {r["id"]: (r["g"], r["rank"]) for r in ranked(df, ["g"], ["id"], "rank", 8).collect()}
    for g in (0, 1, 2):
        own = sorted(r for x, r in got.values() if x == g)
        assert own == list(range(len(own)))
    assert got == {r["id"]: (r["g"], r["rank"]) for r in ranked(df.repartition(7), ["g"], ["id"], "rank", 8).collect()}
    sums = sorted((r["g"], r["before"], r["w"]) for r in running(df, ["g"], ["id"], "w", "before", 8).collect())
    at = {}
    for g, before, w in sums:
        assert before == at.get(g, 0) or w == 0 and before <= at.get(g, 0)
        at[g] = max(at.get(g, 0), before + w)
