import pytest

from tessella.operators import inference


@pytest.fixture(scope="module")
def pairs(spark):
    x, y = [3, 4, 5, 8, 9, 1, 2, 4, 5], [6, 19, 3, 2, 14, 4, 5, 17, 1]
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")


def test_tests(spark, pairs):
    assert inference.t_test(pairs, "x", "y", 2, 1).first().p == pytest.approx(0.196016, abs=1e-6)
    assert inference.t_test(pairs, "x", "y", 2, 2).first().p == pytest.approx(0.191996, abs=1e-5)
    assert inference.t_test(pairs, "x", "y", 2, 3).first().p == pytest.approx(0.202294, abs=1e-5)
    z = spark.createDataFrame([(float(v),) for v in (3, 6, 7, 8, 6, 5, 4, 2, 1, 9)], "x double")
    assert inference.z_test(z, "x", 4).first().p == pytest.approx(0.090574, abs=1e-6)
    f = spark.createDataFrame([(6.0, 20.0), (7.0, 28.0), (9.0, 31.0), (15.0, 38.0), (21.0, 40.0)], "x double, y double")
    assert inference.f_test(f, "x", "y").first().p == pytest.approx(0.648318, abs=1e-6)


def test_lines(spark, pairs):
    line = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0)], "x double, y double")
    assert tuple(inference.linest(line, "y", "x").first()) == pytest.approx((2.0, 1.0))
    new = spark.createDataFrame([(10.0,)], "x double")
    assert inference.trend(line, "y", "x", new).first().trend == pytest.approx(21.0)
    curve = spark.createDataFrame([(1.0, 6.0), (2.0, 18.0), (3.0, 54.0)], "x double, y double")
    assert tuple(inference.logest(curve, "y", "x").first()) == pytest.approx((3.0, 2.0))
    assert inference.growth(curve, "y", "x", new).first().growth == pytest.approx(2 * 3**10)
