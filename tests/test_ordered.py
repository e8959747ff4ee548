import random

from pyspark.sql import functions as F

from pyspark.sql.window import Window

from lawloom.operators import ordered


def table(spark):
    """One key holds most rows."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i * 3 + rng.randint(0, 2), rng.choice([None, "x", "y"]))
            for i in range(2000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, at int, v string")


def table_with_nulls(spark):
    """Null keys, null and equal order values; the second order column makes the order unique."""
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.choice([None, *range(40)]), i, rng.choice([None, "x", "y"])) for i in range(1500)]
    return spark.createDataFrame(rows, "k string, at int, i int, v string")


def test_nulls_and_ties_agree_with_plain_windows(spark):
    df, keys, order = table_with_nulls(spark), ["k"], ["at", "i"]
    w = Window.partitionBy(*keys).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    for rows in (20, 10_000):
        same(ordered.numbered(df, keys, order, "n", max_rows=rows), df.withColumn("n", F.row_number().over(w).cast("bigint")))
        same(
            ordered.running_last(df, keys, order, F.col("v"), "x", max_rows=rows),
            df.withColumn("x", F.last("v", ignorenulls=True).over(running)),
        )
        same(ordered.previous(df, keys, order, F.col("v"), "x", max_rows=rows), df.withColumn("x", F.lag("v").over(w)))


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def test_split_groups_give_the_same_rows(spark):
    df = table(spark)
    same(ordered.numbered(df, ["k"], ["at"], "n"), ordered.numbered(df, ["k"], ["at"], "n", max_rows=50))
    value = F.col("v")
    same(
        ordered.running_last(df, ["k"], ["at"], value, "last"),
        ordered.running_last(df, ["k"], ["at"], value, "last", max_rows=50),
    )
    same(
        ordered.previous(df, ["k"], ["at"], value, "before"),
        ordered.previous(df, ["k"], ["at"], value, "before", max_rows=50),
    )


def test_split_groups_are_really_split(spark):
    plan = ordered.numbered(table(spark), ["k"], ["at"], "n", max_rows=50)._jdf.queryExecution().toString()
    assert "__bucket" in plan


def test_top_per_key_limits_before_the_shuffle(spark):
    out = ordered.top_per_key(table(spark), ["k"], [F.col("at").desc()], 3)
    assert out.groupBy("k").count().agg(F.max("count")).first()[0] == 3
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
