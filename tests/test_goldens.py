"""Small cases with known results, and every variant against the brute-force twin."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions import geometry as G
from gridloom.operators import cache, knn, nbody, pairs, ray, rect, tree, verify
from gridloom.sources import sinks, workloads

THREE = [(0, 0, 10, 0, 10), (1, 15, 20, 15, 20), (2, 5, 15, 5, 15)]


def table(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"id long, x1 {kind}, x2 {kind}, y1 {kind}, y2 {kind}")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def as_pairs(df):
    got = [tuple(r) for r in df.select("id_a", "id_b").collect()]
    assert len(got) == len(set(got))
    return sorted(got)


def test_three_boxes(spark):
    df = table(spark, THREE)
    for found in (pairs.naive(df), pairs.grid(df), pairs.sweep(df), tree.pairs(tree.build(df))):
        assert as_pairs(found) == [(0, 2), (1, 2)]
    assert sorted(map(tuple, pairs.degree(df, pairs.grid(df)).collect())) == [(0, 1), (1, 1), (2, 2)]
    assert ids(rect.inside(df, (0, 15, 0, 15))) == [0, 2] and ids(rect.not_inside(df, (0, 15, 0, 15))) == [1]
    assert ids(rect.intersecting(df, (-5, 1, -5, 1))) == [0]


def test_cached_key(spark):
    df = B.from_key(spark.createDataFrame([(0, 0), (1, 4), (2, 8)], "id long, a long"), lambda d: (F.col("a"), F.col("a") + 5, F.lit(0).cast("long"), F.lit(10).cast("long")))
    got = df.join(pairs.degree(df, pairs.grid(df)), "id").select((F.col("a") + F.col("degree")).alias("v"))
    assert sorted(r["v"] for r in got.collect()) == [1, 6, 9]


def test_replay(spark):
    df = table(spark, [(0, 0, 10, 0, 10), (1, 0, 10, 5, 20), (2, 0, 10, 12, 15)])
    with cache.Session(df) as session:
        kept, elems = session.colliding_pairs(), session.elements()
        seen = pairs.ends(session.replay(kept, 100)).select("id").unionByName(session.replay(elems, 100).select("id"))
        assert [r["id"] + r["count"] for r in seen.groupBy("id").count().orderBy("id").collect()] == [200, 301, 202]
        with pytest.raises(ValueError):
            cache.Session(df).handle(kept)
    with pytest.raises(ValueError):
        session.handle(kept)


def test_nearest(spark):
    df = table(spark, [(0, 0, 10, 0, 10), (1, 2, 4, 2, 4), (2, 6, 8, 6, 8)])
    centre = lambda px, py: (F.col("x1") + F.col("x2") - 2 * px) * (F.col("x1") + F.col("x2") - 2 * px) + (F.col("y1") + F.col("y2") - 2 * py) * (F.col("y1") + F.col("y2") - 2 * py)
    got = knn.nearest(df, 30, 30, 2, centre)
    assert [r["id"] for r in got.orderBy("rank").collect()] == [2, 0] and tuple(knn.sizes(got).first()) == (2, 2)
    tie = table(spark, [(0, 5, 10, 0, 10), (1, 6, 10, 0, 10)])
    assert tuple(knn.sizes(knn.nearest(tie, 15, 30, 2)).first()) == (2, 1)
    far = table(spark, [(0, 729.75, 731.25, -0.75, 0.75), (1, 1517.25, 1518.75, -0.75, 0.75)], "double")
    assert tuple(knn.sizes(knn.nearest(far, 627.0, 727.5, 1)).first()) == (1, 1)
    assert knn.nearest(df, 0, 0, 0).count() == 0


def test_rays(spark):
    df = table(spark, THREE)
    assert [(r["id"], r["t"]) for r in ray.cast(df, -10, 1, 1, 0).collect()] == [(0, 10.0)]
    tie = table(spark, [(0, 0, 10, 0, 20), (1, 5, 10, 0, 20)])
    assert sorted((r["id"], r["t"]) for r in ray.cast(tie, 15, 4, -1, 0).collect()) == [(0, 5.0), (1, 5.0)]
    assert [(r["id"], r["t"]) for r in ray.cast(df, 2, 2, 1, 0).collect()] == [(0, 0.0)]  # from inside
    assert [r["id"] for r in ray.cast(df, -5, 0, 1, 0).collect()] == [0]  # along an edge
    assert ray.cast(df, -5, -1, 1, 0).count() == 0 and ray.cast(df, -5, 0, 0, 0).count() == 0


def test_tiny_trees(spark):
    for rows, n in (([], 0), ([(0, 0, 0, 0, 0)], 1), ([(i, 0, 0, 0, 0) for i in range(40)], 40)):
        t = tree.build(table(spark, rows))
        assert t.levels == 1 and [(r["n"], r["div"]) for r in t.nodes.collect()] == [(n, None)]
        assert all(r["n"] == 0 for r in tree.violations(t).collect())
    assert pairs.accumulate(pairs.grid(table(spark, [(i, 0, 0, 0, 0) for i in range(40)])), F.count("*").alias("n")).first()["n"] == 780
    assert [tree.num_nodes(k) for k in (1, 2, 3, 4)] == [1, 3, 7, 15]
    assert [tree.default_levels(n) for n in (80, 319, 320, 1280, 15_000, 60_000, 150_000, 600_000)] == [1, 1, 3, 5, 7, 9, 11, 13]


def test_section(spark):
    df = spark.createDataFrame([(1, 4), (3, 6), (5, 20), (6, 50), (11, 15)], "x1 long, x2 long")
    assert df.where(G.range_intersects(F.col("x1"), F.col("x2"), F.lit(5), F.lit(10))).count() == 3


def random_boxes(seed, n, extent=300, widest=30):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randint(-extent, extent), rng.randint(-extent, extent)
        w, h = rng.choice([0, 1, rng.randint(0, widest), rng.randint(0, widest)]), rng.randint(0, widest)
        rows.append((i, x, x + w, y, y + h))
    rows += [(n, -10 * extent, 10 * extent, -10 * extent, 10 * extent), (n + 1, 0, 10 * extent, 3, 3), (n + 2, 4, 4, 4, 4), (n + 3, 4, 4, 4, 4)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_the_twin(spark, seed):
    df = table(spark, random_boxes(seed, 600)).cache()
    want = as_pairs(pairs.naive(df))
    assert as_pairs(pairs.grid(df)) == want and as_pairs(pairs.grid(df, (7.0, 3.0))) == want
    assert as_pairs(pairs.sweep(df)) == want
    t = tree.build(df)
    assert t.levels == 3 and as_pairs(tree.pairs(t)) == want
    assert all(r["n"] == 0 for r in tree.violations(t).collect())
    assert verify.check_pairs(df) == {"grid": True, "sweep": True} and verify.candidates(df) >= len(want)


def test_a_giant_box_does_not_coarsen_the_grid(spark):
    n, side = 20_000, 10**9
    df = spark.range(n).selectExpr("id", "id % 200 * 3 x1", "id % 200 * 3 + 1 x2", "id div 200 * 3 y1", "id div 200 * 3 + 1 y2")
    df = df.unionByName(table(spark, [(n, -5, side, -5, side)]))
    assert verify.candidates(df) == n
    for got in (pairs.grid(df), pairs.sweep(df), pairs.between(df.where(f"id = {n}"), df.where(f"id < {n}"), "intersects")):
        assert got.count() == n
    assert rect.inside_many(df.where(f"id < {n}"), df.where(f"id = {n}").withColumnRenamed("id", "rect_id")).count() == n
    point = spark.createDataFrame([(1, 301, 301), (2, -1, -1)], "pt_id long, px long, py long")
    assert verify.same(knn.naive_many(df, point, 3), knn.nearest_many(df, point, 3))


def test_tiny_boxes_among_large_ones(spark):
    """A cluster of tiny boxes, points among them, within the place of one usual box; and boxes of any scale."""
    rng = random.Random(4)
    rows = [(i, x := rng.uniform(0, 1e6), x + rng.uniform(50, 150), y := rng.uniform(0, 1e6), y + rng.uniform(50, 150)) for i in range(600)]
    rows += [(i, x := rng.uniform(5000, 5060), x + rng.choice([0.0, 0.01, 0.2]), y := rng.uniform(5000, 5060), y + rng.choice([0.0, 0.01, 0.2])) for i in range(600, 1000)]
    for scale in (1.0, 1e-7):
        df = spark.createDataFrame([(i, *(v * scale for v in r)) for i, *r in rows], "id long, x1 double, x2 double, y1 double, y2 double")
        assert verify.check_pairs(df) == {"grid": True, "sweep": True}
        assert verify.candidates(df) < 20_000
    points = spark.createDataFrame([(k, 5000.0 + k, 5030.0) for k in range(20)] + [(50, 0.0, -1e5), (51, 5e5, 5e5)], "pt_id long, px double, py double")
    df = spark.createDataFrame(rows, "id long, x1 double, x2 double, y1 double, y2 double")
    assert verify.same(knn.naive_many(df, points, 4), knn.nearest_many(df, points, 4))


def test_checks_against_the_twins(spark):
    df = table(spark, random_boxes(1, 300))
    assert all(verify.check_nearest(df, 50, 60, 5).values())
    assert all(verify.check_rect(df, (20, 90, 10, 80)).values())
    for r in ((-10, 40, 1, 0), (50, 50, 0, -1), (50, -9, 1, 3), (50, 50, 0, 0), (-5, -5, -1, -1), (200, 3, -7, 1)):
        assert all(verify.check_ray(df, *r).values()), r


def test_rays_of_every_direction(spark):
    rng = random.Random(5)
    boxes = random_boxes(9, 400, extent=2000) + [(1000, 0, 2000, 700, 701), (1001, 900, 900, 0, 2000), (1002, 5, 5, 5, 5)]
    df = table(spark, boxes)
    rays = [(k, rng.randint(-500, 2500), rng.randint(-500, 2500), rng.randint(-5, 5), rng.randint(-5, 5)) for k in range(300)]
    rays = spark.createDataFrame(rays, "ray_id long, px long, py long, dx long, dy long")
    assert verify.same(ray.naive_many(df, rays), ray.cast_many(df, rays))
    assert ray.cast_many(df.limit(0), rays).count() == 0


def test_two_sets(spark):
    a, b = table(spark, random_boxes(3, 200)), table(spark, random_boxes(4, 150))
    rows_a, rows_b = random_boxes(3, 200), random_boxes(4, 150)
    inside = sorted((p[0], q[0]) for p in rows_a for q in rows_b if q[1] <= p[1] and p[2] <= q[2] and q[3] <= p[3] and p[4] <= q[4])
    touch = sorted((p[0], q[0]) for p in rows_a for q in rows_b if p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4])
    assert as_pairs(pairs.between(a, b)) == inside and as_pairs(pairs.between(a, b, "intersects")) == touch
    none = a.limit(0)
    assert pairs.between(none, b).count() == 0 and pairs.between(a, none, "intersects").count() == 0 and pairs.grid(none).count() == 0


def test_nearest_many(spark):
    rows = random_boxes(5, 300)
    df = table(spark, rows)
    points = [(i, x, y) for i, (x, y) in enumerate([(0, 0), (-300, 299), (5000, 5000), (17, -40), (299, 299), (-4000, 0)])]
    got = sorted(map(tuple, knn.nearest_many(df, spark.createDataFrame(points, "pt_id long, px long, py long"), 4).collect()))
    want = []
    for p, px, py in points:
        dist = {r[0]: max(r[1] - px, px - r[2], 0) ** 2 + max(r[3] - py, py - r[4], 0) ** 2 for r in rows}
        rank = {d: k + 1 for k, d in enumerate(sorted(set(dist.values()))[:4])}
        want += [(p, i, d, rank[d]) for i, d in dist.items() if d in rank]
    assert got == sorted(want)


def test_build_in_memory_by_window_and_by_histogram(spark, monkeypatch):
    df = table(spark, random_boxes(6, 900, extent=10**6))
    whole = tree.build(df, 5)
    want = sorted(map(tuple, whole.nodes.collect()))
    places = {r["id"]: r["node_id"] for r in whole.elements.collect()}
    monkeypatch.setattr(tree, "BINS", 16)
    for subtree, window in ((300, 10**6), (0, 10**6), (0, 10), (120, 10)):
        t = tree.build(df, 5, subtree, window)
        assert sorted(map(tuple, t.nodes.collect())) == want
        assert {r["id"]: r["node_id"] for r in t.elements.collect()} == places


def test_saving(spark):
    df = table(spark, random_boxes(7, 400))
    t = tree.build(df)
    back = sinks.round_trip(spark, t, df)
    assert verify.same(t.elements, back.elements) and back.levels == t.levels
    path = sinks.folder(spark, "index")
    tree.save(t, path)
    with pytest.raises(ValueError):
        tree.restore(spark, df.where("id > 3"), path)


def test_bodies(spark):
    rows = [(i, (i * 37) % 101, (i * 53) % 97, 1 + i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, px long, py long, mass long").withColumns({"x1": F.col("px"), "x2": F.col("px"), "y1": F.col("py"), "y2": F.col("py")})
    want = {r["id"]: (r["fx"], r["fy"]) for r in nbody.naive(df).collect()}
    t = tree.build(df)
    for near, tolerance in ((float("inf"), 1e-9), (60.0, 0.3)):
        for r in nbody.approximate(t, near).collect():
            fx, fy = want[r["id"]]
            assert abs(r["fx"] - fx) + abs(r["fy"] - fy) <= tolerance * (1 + abs(fx) + abs(fy))
    total = nbody.node_masses(t).where("node_id = 1").first()
    assert total["mass"] == sum(r[3] for r in rows)


def test_boxes_to_reject(spark):
    nan = float("nan")
    df = table(spark, [(0, 0.0, 1.0, 0.0, 1.0), (1, 2.0, 1.0, 0.0, 1.0), (2, nan, 1.0, 0.0, 1.0), (3, None, 1.0, 0.0, 1.0)], "double")
    assert ids(B.validate(df)) == [0]
    edge = B.border(df.limit(0)).first()
    assert tuple(edge) == (None,) * 4


def test_spirals(spark):
    for n in (0, 20, 40):
        df = workloads.spiral_boxes(spark, n, 4.0)
        assert as_pairs(pairs.grid(df)) == as_pairs(pairs.naive(df))
    assert workloads.grid_points(spark, 3, 2).count() == 6 and workloads.sweep_values(spark, 0, 1).count() == 120
    assert tree.regions(tree.build(workloads.spiral_boxes(spark, 500, 4.0)), (0, 800, 0, 800)).count() == 7
    assert sorted(r["place"] for r in pairs.sweep_list(workloads.spiral_boxes(spark, 300, 2.0)).collect()) == list(range(300))


def test_stream(spark, tmp_path):
    from gridloom.streaming import replay

    table(spark, THREE).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long, x1 long, x2 long, y1 long, y2 long").parquet(str(tmp_path / "in"))
    q = replay.each_batch(stream, pairs.grid, lambda df, epoch: seen.extend(map(tuple, df.collect())))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [(0, 2), (1, 2)]


def test_bodies_by_frontiers(spark):
    rows = [(i, (i * 37) % 101, (i * 53) % 97, 1 + i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, px long, py long, mass long").withColumns({"x1": F.col("px"), "x2": F.col("px"), "y1": F.col("py"), "y2": F.col("py")})
    want = {r["id"]: (r["fx"], r["fy"]) for r in nbody.naive(df).collect()}
    for levels, near in ((1, 5.0), (4, float("inf"))):
        got = nbody.by_frontiers(tree.build(df, levels), near, near).collect()
        assert len(got) == 200
        assert all(abs(r["fx"] - want[r["id"]][0]) + abs(r["fy"] - want[r["id"]][1]) < 1e-9 for r in got)


def test_merge(spark):
    # 1 outweighs 2 and 3; 4 would join 3, which is taken itself; 5 and 6 weigh the same; 7 touches none
    df = spark.createDataFrame([(1, 9, 1, 0), (2, 3, 5, 4), (3, 2, -7, 0), (4, 1, 8, 8), (5, 4, 2, 2), (6, 4, 4, 0), (7, 5, 3, 1)], "id long, mass long, vx long, vy long")
    pair = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (5, 6)], "id_a long, id_b long")
    got = {r["id"]: tuple(r)[1:] for r in pairs.merge(df, pair).collect()}
    assert got == {1: (14, 10 / 14, 12 / 14, None), 2: (0, 0.0, 0.0, 1), 3: (0, 0.0, 0.0, 1), 4: (1, 8.0, 8.0, None), 5: (8, 3.0, 1.0, None), 6: (0, 0.0, 0.0, 5), 7: (5, 3.0, 1.0, None)}
