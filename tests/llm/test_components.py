import numpy as np

from gridloom.llm.components import components


def test_labels_are_the_least_ids(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(4000, 4100)] + [(7, 7)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
