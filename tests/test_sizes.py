"""Forms that large tables take, on small ones: against the plain loops."""

from pyspark.sql import functions as F

from gridloom.operators import cache, pairs, ray, rect, tree, verify

from .test_goldens import as_pairs, random_boxes, table


def test_rectangles_in_blocks_equal_the_loop(spark):
    df, rects = table(spark, random_boxes(11, 900) + [(5000, None, 4, 0, 1)]), table(spark, random_boxes(12, 700)).withColumnRenamed("id", "rect_id")
    for mode in ("contained", "intersects"):
        assert verify.same(rect.naive_many(df, rects, mode), rect.naive_many(df, rects, mode, plain=0))
    assert rect.naive_many(df.limit(0), rects, plain=-1).count() == 0


def test_pairs_in_blocks_equal_the_loop(spark):
    df = table(spark, random_boxes(13, 900))
    assert as_pairs(pairs.naive(df, plain=0)) == as_pairs(pairs.naive(df))
    assert pairs.blocks(df, 904).groupBy("block").count().agg({"count": "max"}).first()[0] <= pairs.BLOCK


def test_rays_in_steps_and_blocks_equal_the_loop(spark, monkeypatch):
    df = table(spark, random_boxes(14, 500, extent=3000) + [(900, 2990, 2991, -3000, 3000)])
    rays = spark.createDataFrame([(k, -3000 + 37 * k % 6000, 3000 - 53 * k % 6000, k % 5 - 2, k % 3 - 1) for k in range(200)], "ray_id long, px long, py long, dx long, dy long")
    want = ray.naive_many(df, rays)
    for steps in ((1, 3), ()):
        monkeypatch.setattr(ray, "STEPS", steps)
        assert verify.same(want, ray.cast_many(df, rays))
    assert verify.same(want, ray.naive_many(df, rays, plain=0))


def test_paths_of_rays_are_not_broadcast(spark):
    own = spark.range(3).selectExpr("id ray_id", "id px", "id py", "1L dx", "0L dy", "0.0D t1", "9.0D t2", "9.0D leave")
    home = spark.range(9).selectExpr("id", "id x1", "id x2", "id y1", "id y2", "0 size", "id cx", "id cy")
    assert "Broadcast" not in ray._met(own, home, (1.0, 1.0), [0])._jdf.queryExecution().executedPlan().toString()


def test_large_boxes_of_a_two_set_join_meet_few_small_ones(spark):
    small = spark.range(40_000).selectExpr("id", "id % 200 x1", "id % 200 x2", "id div 200 y1", "id div 200 y2").withColumns({c: F.col(c) * 3 + d for c, d in (("x1", 0), ("x2", 1), ("y1", 0), ("y2", 1))})
    large = spark.range(100).selectExpr("id", "id % 10 * 60 + 1 x1", "id % 10 * 60 + 7 x2", "id div 10 * 60 + 1 y1", "id div 10 * 60 + 7 y2")
    cell = pairs._base(small.unionByName(large))
    left, right = (pairs._cells(df.withColumn("own", pairs._size_class(cell, pairs.SPAN)), cell, [0]) for df in (small, large))
    assert left.join(right, ["size", "cx", "cy"]).count() < 4 * 100 * 9
    assert pairs.between(small, large, "intersects").count() == 100 * 9
    assert pairs.between(small, large).count() == 100 * 4


def test_tree_pairs_meet_only_what_reaches_a_node(spark):
    df = spark.range(20_000).selectExpr("id", "id * 7919 % 20011 x1", "id * 7919 % 20011 + 2 x2", "id * 104729 % 20021 y1", "id * 104729 % 20021 + 40 y2")
    t = tree.build(df)
    assert as_pairs(tree.pairs(t)) == as_pairs(pairs.naive(df))
    assert tree._binned_pairs(t)[1].count() < 4 * 20_000


def test_folded_pairs_are_kept_by_element(spark):
    df = table(spark, random_boxes(15, 300))
    with cache.Session(df) as session:
        kept = session.folded_pairs(F.count("*").alias("n"))
        want = pairs.degree(df, pairs.grid(df)).where("degree > 0").withColumnRenamed("degree", "n")
        assert verify.same(want, kept) and session.replay(kept, 3).count() == 3 * want.count()
