from pyspark.sql import functions as F

from docloom.functions import releases as R

NINE = "1.2.3.4.5.6.7.8"


def test_all_components_count(spark):
    rows = [(f"{NINE}.1", f"{NINE}.2", -1), (f"{NINE}.10", f"{NINE}.9", 1), (f"{NINE}.0.0", NINE, 0), (f"{NINE}.xxxx", f"{NINE}.9998", 1), ("0.0", "0", 0), ("10.0.1", "10", 1), ("10.x", "10.0.0", 0)]
    d = spark.createDataFrame(rows, "a string, b string, want int")
    found = d.select("a", "b", "want", R.compare_releases(F.col("a"), F.col("b")).alias("is"), R.compare_releases(F.col("b"), F.col("a")).alias("back")).collect()
    assert all(r["is"] == r.want == -r.back for r in found), found
