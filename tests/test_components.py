import random

from strandloom.operators.components import connected_components


def by_hand(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            root.setdefault(a, a), root.setdefault(b, b)
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200), (None, 1), (300, 301), (301, 300)]
    for contract in (False, True):
        for kind in ("long", "int"):
            got = connected_components(spark.createDataFrame(edges, f"src {kind}, dst {kind}").repartition(3), contract=contract)
            assert {r.id: r.component for r in got.collect()} == by_hand(edges) and got.schema["id"].dataType.simpleString() in ("bigint", "int")
    assert connected_components(spark.createDataFrame([], "src long, dst long"), contract=True).count() == 0
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
