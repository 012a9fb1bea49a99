"""One key holds a third of all rows or more; results must equal the plain computation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.operators.skew import hot_hashes, lookup, ordinal, scan_before


def skewed(spark, n=3000):
    return spark.range(n).select(
        F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 400).cast("int").alias("k"),
        F.when(F.col("id") % 7 == 0, F.col("id") * 2).alias("v"),
    )


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_scan_before(spark):
    spread = {
        "dense": F.col("id"),
        "sparse": F.col("id") * 1_000_003,
        "huge steps": F.col("id") * F.lit(1 << 40) - F.lit(1 << 50),
    }
    for order in spread.values():
        df = skewed(spark).withColumn("id", F.col("pos")).withColumn("pos", order).drop("id").repartition(5)
        for group in (["k"], []):
            w = Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
            plain = df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
            assert rows(scan_before(df, group, "pos", F.col("v"), "s", "sum")) == rows(plain)
            plain = df.withColumn("l", F.last("v", True).over(w)).withColumn("m", F.last("k", True).over(w))
            both = {"l": F.col("v"), "m": F.col("k")}
            assert rows(scan_before(df, group, "pos", both, how="last")) == rows(plain)


def test_scan_before_with_null_groups_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7)], "k string, pos long, v long")
    got = {(r.k, r.pos): r.s for r in scan_before(df, ["k"], "pos", F.col("v"), "s").collect()}
    assert got == {(None, 1): 0, (None, 2): 5, ("a", 1): 0}
    assert scan_before(df.limit(0), ["k"], "pos", F.col("v"), "s").count() == 0


def test_texts_move_once_in_a_concatenation(spark, sf):
    from sluice.plans import QUERIES

    plan = QUERIES["multi_file_concat"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan[: plan.index("Join")] and plan.count("posexplode") == 1


def test_ordinal(spark):
    df = skewed(spark)
    got = ordinal(df.repartition(7), ["k", "pos"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(3000))
    assert [(r.k, r.pos) for r in got] == sorted((r.k, r.pos) for r in got)


def test_lookup(spark):
    big = skewed(spark)
    small = spark.range(0, 400, 2).select(F.col("id").cast("int").alias("k"), (F.col("id") + 1).alias("w"))
    assert len(hot_hashes(big, ["k"], 0.2)) >= 1
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(lookup(big, small, ["k"], how, salt=True, share=0.2)) == rows(
            big.join(small, ["k"], how)
        )
