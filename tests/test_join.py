"""Spatial joins over skewed places and sizes, against cross joins."""

import random

import pytest
from pyspark.sql import functions as F

from cartolith import functions as st
from cartolith.operators import join, spatial_join


def square(x, y, w):
    return f"POLYGON(({x} {y},{x + w} {y},{x + w} {y + w},{x} {y + w},{x} {y}))"


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the points in one place; boxes of all sizes, two of them huge."""
    r = random.Random(7)
    points = [(i, r.uniform(-500, 500), r.uniform(-500, 500)) for i in range(400)] + [(1000 + i, 3.25, 3.25) for i in range(200)] + [(5000, None, 1.0)]
    shapes = [(j, square(r.randint(-500, 500), r.randint(-500, 500), r.choice([0.5, 1, 2, 3, 17, 130]))) for j in range(60)]
    shapes += [(100, square(-1e6, -1e6, 2e6)), (101, square(-700, -700, 900)), (102, None), (103, "POLYGON EMPTY"), (104, "POINT(3.25 3.25)"), (105, square(3, 3, 1)), (105, square(3, 3, 1))]
    return spark.createDataFrame(points, "i int, x double, y double").select("i", st.st_point("x", "y").alias("p")), spark.createDataFrame(shapes, "j int, w string")


@pytest.fixture(scope="module")
def pairs(skewed):
    points, shapes = skewed
    return sorted(map(tuple, points.crossJoin(shapes).where(st.st_intersects("p", st.st_geomfromtext("w"))).select("i", "j").collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("options", [{}, {"broadcast": 0, "hot": 7, "salt": 2}, {"broadcast": 0, "cell": 90.0, "hot": 20}])
def test_skewed_sides(skewed, pairs, options):
    points, shapes = skewed
    assert sorted(map(tuple, spatial_join(points, shapes, "p", "w", **options).select("i", "j").collect())) == pairs and len(pairs) > 1400
    turned = spatial_join(shapes, points, "w", "p", **options)
    assert sorted(map(tuple, turned.select("i", "j").collect())) == pairs and "CartesianProduct" not in plan(turned) and "NestedLoop" not in plan(turned)


def test_only_small_sides_are_broadcast(skewed):
    points, shapes = skewed
    assert "BroadcastHashJoin" in plan(spatial_join(points, shapes, "p", "w")) and "Exchange hashpartitioning(_level" not in plan(spatial_join(points, shapes, "p", "w"))
    wide = shapes.withColumn("z", F.repeat(F.lit("x"), 20_000))
    sizes = join._side(join._boxed(wide, "w"))
    assert sizes.count == 65 and sum(sizes.bytes.values()) > 65 * 20_000


def test_one_huge_shape_costs_one_level(skewed):
    points, shapes = skewed
    sides = [join._side(join._boxed(df, g)) for df, g in ((points, "p"), (shapes, "w"))]
    used = sorted(join._levels(sides[1], 1.0))
    assert used[-1] >= 21 and len(used) <= 6
    listed = join._listed(join._boxed(points, "p"), 1.0, used)
    assert listed.count() == 600 * len(used)
    # and rows are on no level that the statistics don't know
    assert {r._l for r in join._listed(join._boxed(shapes, "w"), 1.0, [0]).select("_l").distinct().collect()} <= set(used)


def test_crowded_cells_are_dealt_in_parts(skewed):
    points, shapes = skewed
    a, b = join._boxed(points, "p"), join._boxed(shapes, "w")
    sides = [join._side(x) for x in (a, b)]
    used = tuple(sorted(join._levels(x, 1.0)) for x in sides)
    crowded = join._crowded(a, b, (600, 65), 1.0, used, 50)
    of = {(r._level, r._cx, r._cy): (r._na, r._nb) for r in crowded.collect()}
    assert of[0, 3, 3] == (4, 1)
    parted = join._parted(join._listed(a, 1.0, used[1]), crowded, "_na", "_nb", ("_sa", "_sb"), 1)
    assert parted.groupBy("_level", "_cx", "_cy", "_sa", "_sb").count().agg(F.max("count")).first()[0] < 110
    assert join._crowded(a, b, (600, 65), 1.0, used, 10_000) is None


def test_other_joins_of_skewed_sides(skewed, pairs):
    points, shapes = skewed
    met, every = {i for i, _ in pairs}, [r.i for r in points.select("i").collect()]
    for how, wanted in (("left_semi", True), ("left_anti", False)):
        assert sorted(r.i for r in spatial_join(points, shapes, "p", "w", how=how, broadcast=0, hot=30).select("i").collect()) == sorted(i for i in every if (i in met) is wanted)


def test_empty_sides(skewed):
    points, shapes = skewed
    assert spatial_join(points.where("false"), shapes, "p", "w").count() == 0
    assert spatial_join(points, shapes.where("j = 102"), "p", "w", how="left").count() == 601
    assert spatial_join(points.where("i = 1000"), shapes.where("j = 104"), "p", "w", "equals").count() == 1
