"""Series and panels over the test tables, on which the registered queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUT = "2001-08-01"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sales(spark: SparkSession, sf: str) -> DataFrame:
    li = _table(spark, sf, "lineitem").filter(F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz"))
    return li.withColumn("rev", F.col("l_extendedprice") * (1 - F.col("l_discount")))


def brand_month(spark: SparkSession, sf: str) -> DataFrame:
    """date, asset_id, rev: revenue of each brand and month."""
    parts = _table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset_id"))
    sales = _sales(spark, sf).select("l_partkey", F.last_day("l_shipdate").alias("date"), "rev")
    return sales.join(parts, "l_partkey").groupBy("date", "asset_id").agg(F.sum("rev").alias("rev")).cache()  # small, and used by several parts of a plan


def growth(panel: DataFrame, value: str = "rev") -> DataFrame:
    """Return of each asset from the panel date before, where both exist."""
    dates = panel.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    cells = panel.join(F.broadcast(dates), "date").select("asset_id", "date", "i", F.col(value).alias("v"))
    w = Window.partitionBy("asset_id").orderBy("i")
    r = F.when(F.lag("i").over(w) == F.col("i") - 1, F.col("v") / F.lag("v").over(w) - 1)
    return cells.select("date", "asset_id", r.alias("value")).filter("value is not null")


def brand_returns(spark: SparkSession, sf: str) -> DataFrame:
    return growth(brand_month(spark, sf))


def brand_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Reversal: the last return with its sign changed."""
    return brand_returns(spark, sf).withColumn("value", -F.col("value"))


def brand_week(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly returns of each brand, dated on Fridays."""
    parts = _table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset_id"))
    week = F.date_add(F.date_trunc("week", F.col("l_shipdate").cast("date")).cast("date"), 4)
    sales = _sales(spark, sf).select("l_partkey", week.alias("date"), "rev").join(parts, "l_partkey")
    return growth(sales.groupBy("date", "asset_id").agg(F.sum("rev").alias("rev")).cache())


def legs(spark: SparkSession, sf: str) -> DataFrame:
    """formation_date, leg, asset_id: highest and lowest fifth of the reversal signal each month."""
    q = F.ntile(5).over(Window.partitionBy("date").orderBy("value", "asset_id"))
    s = brand_signal(spark, sf).withColumn("q", q).filter("q in (1, 5)")
    return s.select(F.col("date").alias("formation_date"), F.when(F.col("q") == 5, "long").otherwise("short").alias("leg"), "asset_id")


def factors(spark: SparkSession, sf: str) -> DataFrame:
    """date, mkt: mean weekly return of all brands."""
    return brand_week(spark, sf).groupBy("date").agg(F.avg("value").alias("mkt"))


def factors3(spark: SparkSession, sf: str) -> DataFrame:
    """date, mkt, odd, hi, rf: three spreads over brands and a constant rate."""
    w = brand_week(spark, sf).withColumn("k", F.substring("asset_id", -1, 1).cast("int"))
    pick = lambda c: F.coalesce(F.avg(F.when(c, F.col("value"))) - F.avg(F.when(~c, F.col("value"))), F.lit(0.0))
    return w.groupBy("date").agg(F.avg("value").alias("mkt"), pick(F.col("k") % 2 == 1).alias("odd"), pick(F.col("k") > 3).alias("hi")).withColumn("rf", F.lit(0.0005))


def supplier_month(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly revenue of each supplier, in thousands."""
    s = _sales(spark, sf).groupBy(F.col("l_suppkey").cast("string").alias("series_id"), F.last_day("l_shipdate").alias("date"))
    return s.agg((F.sum("rev") / 1000).alias("value"))


def day_series(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue of each ship date, in thousands."""
    s = _sales(spark, sf).groupBy(F.lit("day").alias("series_id"), F.col("l_shipdate").cast("date").alias("date"))
    return s.agg((F.sum("rev") / 1000).alias("value"))


def event_day(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of each event type and day."""
    e = _table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("date")).agg(F.sum("value").alias("value"))


def strategy(spark: SparkSession, sf: str) -> DataFrame:
    """Next month's mean return of the highest fifth of the signal less that of the lowest, dated when it is earned."""
    r = brand_returns(spark, sf)
    dates = brand_month(spark, sf).select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    held = legs(spark, sf).join(F.broadcast(dates.withColumnRenamed("date", "formation_date")), "formation_date").withColumn("i", F.col("i") + 1)
    earned = held.join(r.join(F.broadcast(dates), "date"), ["i", "asset_id"])
    side = lambda leg: F.avg(F.when(F.col("leg") == leg, F.col("value")))
    return earned.groupBy("date").agg((side("long") - side("short")).alias("value")).filter("value is not null").select(F.lit("strategy").alias("series_id"), "date", "value")
