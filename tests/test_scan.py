from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.scan import keyed_running


def test_keyed_running_equals_window_with_hot_key(spark):
    data = [(k, i, float(i % 7), ("m" if i % 5 == 0 else None)) for k in (1, 2) for i in range(300)]
    data += [(3, i, float(-i), None) for i in range(3)]
    df = spark.createDataFrame(data, "k long, o long, v double, m string")
    got = keyed_running(df, "k", [F.col("o")],
                        [("c", "count", None), ("s", "sum", "v"), ("x", "max", "v"), ("l", "last", "m")],
                        partitions=6)
    w = W.partitionBy("k").orderBy("o")
    exp = df.select("k", "o", F.row_number().over(w).alias("c"), F.sum("v").over(w).alias("s"),
                    F.max("v").over(w).alias("x"), F.last("m", True).over(w).alias("l"))
    a = sorted(tuple(r) for r in got.select("k", "o", "c", "s", "x", "l").collect())
    b = sorted(tuple(r) for r in exp.collect())
    assert a == b
