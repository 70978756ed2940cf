import time

from pyspark.sql import functions as F

from clipmill.functions import text as T


def test_long_texts_are_compared_soon(spark):
    """Six thousand lines against as many: each line is trimmed once, not once for each other line."""
    rows = [("\n".join(f" line {i} " for i in range(6000)), "\n".join(f"line {i}" for i in range(5, 6005))), ("a\n\na\nb", None), (None, "a"), ("", "")]
    df = spark.createDataFrame(rows, "own string, other string")
    start = time.time()
    assert [r[0] for r in df.select(T.diff_side(F.col("own"), F.col("other"))).collect()] == ["\n".join(f" line {i} " for i in range(5)), "", None, ""]
    assert time.time() - start < 30
