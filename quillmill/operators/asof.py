"""As-of join: to each row of one table the latest row of another at or before its time.

Both tables are stacked, and the last value that isn't null is carried down the
time of each key. A key with more than ``most`` rows is cut into slices of its
own time; each slice carries its own rows, and what the slices before it leave
is carried over their few last rows, so no task sorts a whole hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one task may sort, and slices of a key that has more.
MOST = 1_000_000
SLICES = 256


def _hot(stacked: DataFrame, keys: list[str], most: int, slices: int) -> DataFrame | None:
    """(keys, __cuts): times that cut keys of more than ``most`` rows into even parts; None if there are none. So few keys are hot that Spark may broadcast them."""
    many = stacked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).drop("__n")
    if many.isEmpty():
        return None
    at = [i / slices for i in range(1, slices)]
    return stacked.join(many, keys, "left_semi").groupBy(*keys).agg(F.array_distinct(F.percentile_approx("__at", at, 10 * slices)).alias("__cuts"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str | None = None, values: list[str] | None = None, strict: bool = False, within: Column | None = None, most: int = MOST, slices: int = SLICES) -> DataFrame:
    """``left`` with the ``values`` of the latest ``right`` row of the same key, null where there is none.

    ``strict`` leaves out right rows of the very same time; ``within``, an
    interval, those that are older than it. Of right rows of one time the one
    with the greatest values counts. Rows with a null key or time stay and find
    nothing. A right column that ``left`` also has must be renamed before.
    """
    right_time = right_time or time
    values = values or [c for c in right.columns if c not in by and c != right_time]
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if dict(left.dtypes)[time].startswith("timestamp") else F.col(c)
    keys = [f"__k{i}" for i in range(len(by))]
    named = [F.col(b).alias(k) for b, k in zip(by, keys, strict=True)]
    found = F.struct(F.col(right_time).alias("__time"), *[F.col(v) for v in values])
    once = right.where(F.col(right_time).isNotNull()).select(*named, micros(right_time).alias("__at"), found.alias("__right")).groupBy(*keys, "__at").agg(F.max("__right").alias("__right"))
    own = F.struct(*[F.col(c) for c in left.columns])
    mine = left.select(*named, micros(time).alias("__at"), own.alias("__left"))
    # a right row comes before left rows of its time, or behind them if it must be earlier
    tag = F.when(F.col("__left").isNull(), 1 if strict else -1).otherwise(0)
    stacked = mine.unionByName(once, allowMissingColumns=True)
    hot = _hot(stacked, keys, most, slices)
    if hot is None:
        sliced, parts = stacked, keys
    else:
        cuts = hot.withColumnsRenamed({k: f"{k}h" for k in keys})
        same = [F.col(k) == F.col(f"{k}h") for k in keys]
        number = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__at"))), F.lit(0))
        sliced, parts = stacked.join(cuts, same, "left").withColumn("__slice", number).drop("__cuts", *[f"{k}h" for k in keys]), [*keys, "__slice"]
    down = Window.partitionBy(*parts).orderBy("__at", tag).rowsBetween(Window.unboundedPreceding, 0)
    carried = sliced.withColumn("__last", F.last("__right", ignorenulls=True).over(down)).where(F.col("__left").isNotNull())
    if hot is not None:
        ends = sliced.groupBy(*parts).agg(F.max_by("__right", F.when(F.col("__right").isNotNull(), F.col("__at"))).alias("__end"))
        before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        over = ends.select(*[F.col(k).alias(f"{k}e") for k in keys], F.col("__slice").alias("__s"), F.last("__end", ignorenulls=True).over(before).alias("__before")).where("__before is not null")
        same = [F.col(k) == F.col(f"{k}e") for k in keys] + [F.col("__slice") == F.col("__s")]
        carried = carried.join(over, same, "left").withColumn("__last", F.coalesce("__last", "__before"))
    known = F.col("__at").isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    if within is not None:
        known &= F.col(f"__left.{time}") - F.col("__last.__time") <= within
    return carried.select(*[F.col(f"__left.`{c}`").alias(c) for c in left.columns], *[F.when(known, F.col(f"__last.{v}")).alias(v) for v in values])
