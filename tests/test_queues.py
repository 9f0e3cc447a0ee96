"""Places in a whole queue against a plain sort, over many ranges and with ties."""
import random

from pyspark.sql import functions as F

from pkgsieve.operators import queues as Q


def test_positions_equal_sorting(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([0, 7, 7, 7, 10]), f"p{rnd.randrange(5)}", f"{rnd.randrange(3)}", rnd.randrange(40), rnd.randrange(4)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "suspicion int, project string, version string, last_serial int, seq int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges
    try:
        got = Q.positions(df, Q.priority_order(df)).orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["position"] for r in got] == list(range(3000))
    key = lambda r: (-r[0], *r[1:])
    assert [key(tuple(r)[:5]) for r in got] == sorted(map(key, rows))
    assert Q.positions(df.where(F.lit(False)), Q.priority_order(df)).count() == 0


def test_file_path_goes_before_the_task_number(spark):
    rows = [(5, "p", "1", 9, 1, "b"), (5, "p", "1", 3, 2, "c"), (5, "p", "1", 7, 3, "a")]
    df = spark.createDataFrame(rows, "suspicion int, project string, version string, last_serial int, seq int, filename string")
    names = lambda *extra: [r["filename"] for r in Q.positions(df, Q.priority_order(df, *extra)).orderBy("position").collect()]
    assert names() == ["c", "a", "b"] and names("filename") == ["a", "b", "c"]
