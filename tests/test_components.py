import random

from specmint.operators.components import connected_components


def brute(edges):
    label = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], moved = low, True
    return label


def check(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute([e for e in edges if None not in e])


def test_random_graph(spark):
    rng = random.Random(3)
    check(spark, [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)])


def test_path_star_self_and_null(spark):
    path = [(i, i + 1) for i in range(100, 130)]
    star = [(500, i) for i in range(501, 540)]
    check(spark, [*path, *star, (7, 7), (None, 3), (500, 501), (501, 500)])


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
