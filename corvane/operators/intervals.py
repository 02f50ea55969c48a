"""Sets of sequence numbers kept as disjoint closed intervals (lane, lo, hi).

Lanes are independent sequences, as the partitions of a log are; every window below runs
within one lane, so the number of lanes sets the parallelism.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _merged(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("lane").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = df.select("lane", "lo", "hi", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0).alias("new"))
    islands = starts.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("lane", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lane", "lo", "hi")


def merge(df: DataFrame) -> DataFrame:
    """Union of intervals: overlapping and adjacent ones become one. Nulls and empty intervals (hi < lo) vanish."""
    return _merged(df.select("lane", "lo", "hi").where("lane is not null and lo <= hi"))


def from_points(points: DataFrame) -> DataFrame:
    """(lane, seq) -> disjoint intervals of consecutive numbers."""
    return merge(points.select("lane", F.col("seq").alias("lo"), F.col("seq").alias("hi")))


def subtract(available: DataFrame, processed: DataFrame) -> DataFrame:
    """The parts of ``available`` that ``processed`` doesn't cover, by a sweep over the ends."""

    def ends(df: DataFrame, a: int, p: int) -> DataFrame:
        ok = df.where("lane is not null and lo <= hi")
        return ok.select("lane", F.inline(F.array(
            F.struct(F.col("lo").alias("pos"), F.lit(a).alias("da"), F.lit(p).alias("dp")),
            F.struct((F.col("hi") + 1).alias("pos"), F.lit(-a).alias("da"), F.lit(-p).alias("dp")),
        )))

    steps = ends(available, 1, 0).unionByName(ends(processed, 0, 1)).groupBy("lane", "pos").agg(F.sum("da").alias("da"), F.sum("dp").alias("dp"))
    w = Window.partitionBy("lane").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    parts = steps.select(
        "lane", F.col("pos").alias("lo"), (F.lead("pos").over(w) - 1).alias("hi"), F.sum("da").over(upto).alias("a"), F.sum("dp").over(upto).alias("p")
    )
    return _merged(parts.where("a > 0 and p = 0 and hi is not null").select("lane", "lo", "hi"))


def inside(items: DataFrame, intervals: DataFrame) -> DataFrame:
    """Items (lane, seq, ...) whose number lies in one of the disjoint intervals: an as-of look-back in one sorted pass."""
    cols = items.columns
    marks = intervals.select("lane", F.col("lo").alias("seq"), F.col("hi").alias("_hi"), F.lit(0).alias("_kind"))
    both = items.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("lane").orderBy("seq", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_upto", F.last("_hi", ignorenulls=True).over(w)).where("_kind = 1 and seq <= _upto").select(*cols)
