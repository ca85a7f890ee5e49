import pytest

from pointlake.functions.geometry import Box
from pointlake.operators import generators as g

BOX = Box((0.0, 0.0, 0.0), (2.0, 1.0, 4.0))
MADE = {
    "uniform": lambda s, seed: g.uniform(s, 5000, BOX, seed),
    "linear": lambda s, seed: g.linear_gradient(s, 10_000, BOX, seed),
    "exponential": lambda s, seed: g.exponential_gradient(s, 5000, BOX, seed),
    "spheres": lambda s, seed: g.spheres(s, 5000, 4, BOX, seed),
    "cut box": lambda s, seed: g.cut_box(s, 5000, BOX, (1.0, 0.5, 2.0), seed),
}


@pytest.mark.parametrize("name", MADE)
def test_inside_and_repeatable(spark, name):
    df = MADE[name](spark, 3)
    rows = df.collect()
    assert len(rows) == (9950 if name == "linear" else 5000)
    assert all(BOX.contains_point((r.x, r.y, r.z)) for r in rows)
    assert sorted(rows) == sorted(MADE[name](spark, 3).repartition(3).collect()) and sorted(rows) != sorted(MADE[name](spark, 4).collect())
    if name == "cut box":
        assert not any(r.x < 0.999 and r.y < 0.499 and r.z < 1.999 for r in rows)
        assert abs(sum(r.x >= 1 for r in rows) / 5000 - 4 / 7) < 0.03
    if name == "linear":
        assert sum(r.x < 1 for r in rows) < 0.3 * len(rows)


@pytest.mark.parametrize("seed", [1, 3])
def test_no_position_of_a_sphere_repeats(spark, seed):
    rows = g.spheres(spark, 5000, 5, BOX, seed).collect()
    assert len({(r.x, r.y, r.z) for r in rows}) == len(rows)


def test_thin_and_flat_spheres(spark):
    for height in (1e-2, 0.0):
        box = Box((0.0, 0.0, 0.0), (1.0, 1.0, height))
        rows = g.spheres(spark, 300, 3, box, 2).collect()
        assert len({(r.x, r.y) for r in rows}) == 300 and all(0 <= r.x <= 1 and 0 <= r.y <= 1 and -1e-9 <= r.z <= height + 1e-9 for r in rows)


def test_attributes_and_steps(spark):
    df = g.uniform(spark, 500, BOX, 1)
    out = g.with_attributes(g.with_attributes(df, "normal", 2), "sphere", 1, spatial=BOX, double=True)
    assert out.columns[4:] == ["non-spatial-normal0", "non-spatial-normal1", "spatial-sphere0"]
    lo, hi = g.attribute_range(0)
    assert all(lo - 1e-2 <= r["non-spatial-normal0"] <= hi + 1e-2 for r in out.collect())
    steps = [df]
    while steps[-1].count() and len(steps) < 9:
        steps.append(g.advected(steps[-1], (0.4, 0.0, 0.0), BOX))
    assert steps[-1].count() == 0 and steps[1].count() < 500
