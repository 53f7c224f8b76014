"""Defaults for values that say nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.functions.labels import falsy_default


def test_what_says_nothing(spark):
    df = spark.createDataFrame([("0", 0, 0.0, False, [], "x"), ("", 5, -0.0, True, [0], None), ("false", None, 1e-9, None, None, "[]")], "t string, i int, d double, b boolean, a array<int>, s string")
    given = {"t": F.lit("-"), "i": F.lit(9), "d": F.lit(9.0), "b": F.lit(True), "a": F.array(F.lit(7)), "s": F.lit("-")}
    rows = [tuple(r) for r in df.select(*[falsy_default(F.col(c), v).alias(c) for c, v in given.items()]).collect()]
    assert rows == [("0", 9, 9.0, True, [7], "x"), ("-", 5, 9.0, True, [0], "-"), ("false", 9, 1e-9, True, [7], "[]")]
