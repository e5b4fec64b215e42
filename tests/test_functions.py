import math
from datetime import datetime

from pyspark.sql import functions as F

from kernelweave import functions as K


def test_functions(spark):
    rows = [([1, 5, 5], [1.0, 2.0], [4.0, 6.0], float("nan")), ([7], [0.0], [3.0], float("inf")), ([2, 1], [1.0], [1.0], 2.5)]
    df = spark.createDataFrame(rows, "s array<int>, a array<double>, b array<double>, x double")
    got = df.select(
        K.argmax(F.col("s")).alias("top"), K.minkowski(F.col("a"), F.col("b")).alias("d"), K.finite(F.col("x")).alias("x"),
        K.log_or_null(F.col("x") - 2.5).alias("none"), K.rolling_hash(F.col("s")).alias("h"),
    ).collect()
    assert [r.top for r in got] == [1, 0, 0] and [r.d for r in got] == [5.0, 3.0, 0.0] and [r.x for r in got] == [0, 0, 2.5]
    assert got[2].none is None and got[0].h == (1 * 31 + 5) * 31 + 5
    assert K.stamped("r", datetime(2024, 1, 2, 3, 4, 5)) == "r_20240102_030405" and math.isclose(got[0].d, 5)
