import pytest
from pyspark.sql import functions as F

from codonframe.functions.tajima import SIZES, critical_values, harmonic, tajima_d, with_significance


def test_documented_example(spark):
    df = spark.createDataFrame([(1000, 15, 0.05), (1, 3, 0.1), (10, 0, 0.0)], "n int, s int, pi double").withColumn("D", tajima_d(F.col("n"), F.col("s"), F.col("pi")))
    found = with_significance(df).collect()
    by = {r.n: r for r in found}
    assert by[1000].D == pytest.approx(-2.142552, abs=1e-6) and by[1000].significance == "0.01"
    assert by[1].D is None and by[1].significance == "n.s." and by[10].D is None


@pytest.mark.parametrize("n,level,low,high", [(1000, 0.001, -2.369, 3.722), (1000, 0.1, -1.505, 1.772), (800, 0.01, -2.072, 2.873), (4, 0.05, -0.876, 2.232)])
def test_published_bounds(n, level, low, high):
    found = {(a, b): (c, d) for a, b, c, d in critical_values()}
    assert found[n, level] == (pytest.approx(low, abs=0.0016), pytest.approx(high, abs=0.0016))


def test_sizes():
    assert len(SIZES) == 73 and SIZES == sorted(SIZES)


def test_harmonic_sums_need_no_step_for_each_term(spark):
    df = spark.createDataFrame([(m,) for m in (0, 1, 2, 30, 31, 32, 33, 100, 5000)], "m long").select("m", *[c.alias(n) for c, n in zip(harmonic(F.col("m")), "ab")])
    for r in df.collect():
        assert abs(r.a - sum(1 / i for i in range(1, r.m + 1))) < 1e-12 and abs(r.b - sum(1 / i**2 for i in range(1, r.m + 1))) < 1e-12
