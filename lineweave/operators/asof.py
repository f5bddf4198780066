"""Backward as-of and interval joins on time-stamped tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, payload: list[str], within: float) -> DataFrame:
    """Each left row with the payload of the latest right row of its key that is not later, if within so many seconds.

    Both sides are stacked and sorted once per key, and the last right row is carried forward: one
    shuffle, no range join.  Of right rows at one time the greatest payload counts.
    """
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    r = right.select(F.col(by).alias("_k"), seconds(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*payload).alias("_p"), F.lit(None).cast(left_struct(left)).alias("_l"))
    own = left.select(F.col(by).alias("_k"), seconds(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(dict(r.dtypes)["_p"]).alias("_p"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_p").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct("_t", "_p")), ignorenulls=True).over(w)
    out = r.unionByName(own).withColumn("_seen", seen).filter("_side = 1")
    fits = F.col("_t") - F.col("_seen._t") <= within
    return out.select("_l.*", *[F.when(fits, F.col(f"_seen._p.{c}")).alias(c) for c in payload])


def left_struct(df: DataFrame) -> str:
    return "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema.fields) + ">"


def within_interval(left: DataFrame, right: DataFrame, by: list[str], left_at: Column, right_at: Column, width: float) -> DataFrame:
    """Pairs of rows with equal keys whose times differ by at most ``width``.

    The left side looks into three buckets of that width, so the join is a hash join on key and bucket.
    Columns of both sides need different names.
    """
    a = left.withColumns({"_x": left_at, "_b": F.explode(F.array(*[F.floor(left_at / width) + d for d in (-1, 0, 1)]))})
    b = right.withColumns({"_y": right_at, "_b": F.floor(right_at / width)})
    keys = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by] + [F.col("a._b") == F.col("b._b")]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    joined = a.alias("a").join(b.alias("b"), on).filter(F.abs(F.col("_x") - F.col("_y")) <= width)
    return joined.select("a.*", *[f"b.{c}" for c in right.columns if c not in by]).drop("_x", "_b")
