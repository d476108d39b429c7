"""Relational operators that Spark SQL has no syntax for, composed from DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualify(df: DataFrame, window_column: Column, predicate) -> DataFrame:
    """Rows for which ``predicate(window_column)`` holds: QUALIFY."""
    return df.withColumn("_qualify", window_column).where(predicate(F.col("_qualify"))).drop("_qualify")


def between_symmetric(c: Column, a: Column, b: Column) -> Column:
    return c.between(F.least(a, b), F.greatest(a, b))


def top(df: DataFrame, n: int, *order: Column, offset: int = 0) -> DataFrame:
    """FETCH, TOP, and LIMIT with an offset; the order should tell all rows apart."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page, counted from 0, of 1 to 200 rows."""
    size = min(200, max(1, size))
    return top(df, size, *order, offset=max(0, number) * size)


def capped(df: DataFrame, asked: int | None, default: int = 1000, hard: int = 10_000) -> tuple[list, bool]:
    """At most min(asked, hard) rows, and whether there are more."""
    n = min(asked or default, hard)
    rows = df.limit(n + 1).collect()
    return rows[:n], len(rows) > n


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str], inner: bool = False, stretch: float | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before it.

    Both sides go through one shuffle and one sort by key and stretch of time; nothing is paired. Only one row
    for each stretch of a key is walked by key, to carry the last right row into later stretches, so a key
    with a large share of all rows is not sorted in one task. A stretch is a day for timestamps; numbers have
    one of ``stretch``, or none if that is not given. Of right rows at one time the largest values win. Null
    keys and null times meet nothing."""
    right = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull())
    timed = dict(left.dtypes)[left_at].startswith("timestamp")
    place = F.unix_micros(F.col("_at").cast("timestamp")) / 86_400_000_000 if timed else F.col("_at") / stretch if stretch else F.lit(0)
    own = F.struct(F.col(right_at).alias(right_at), *[F.col(v) for v in values])
    rows = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    both = left.select(F.col(key).alias("_key"), F.col(left_at).alias("_at"), F.lit(1).alias("_side"), rows.alias("_left"), F.lit(None).cast(right.select(own).schema[0].dataType).alias("_right")).unionByName(
        right.select(F.col(key).alias("_key"), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(rows).schema[0].dataType).alias("_left"), own.alias("_right"))
    )
    both = both.withColumn("_stretch", F.floor(place).cast("long"))
    w = Window.partitionBy("_key", "_stretch").orderBy("_at", "_side", *[F.col("_right")[v] for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    if timed or stretch:
        last = both.groupBy("_key", "_stretch").agg(F.max("_right").alias("_carried"))
        earlier = Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        last = last.withColumn("_carried", F.last("_carried", ignorenulls=True).over(earlier)).where("_carried is not null")
        found = found.join(last, ["_key", "_stretch"], "left").withColumn("_right", F.coalesce("_right", "_carried"))
    found = found.withColumn("_right", F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), F.col("_right")))
    if inner:
        found = found.where("_right is not null")
    return found.select("_left.*", *[F.col("_right")[c].alias(c) for c in (right_at, *values)])


def sum_excluding_current(value: Column, partition: list[str]) -> Column:
    """SUM(value) OVER (PARTITION BY ... EXCLUDE CURRENT ROW): NULL if no other row has a value."""
    w = Window.partitionBy(*partition)
    others = F.count(value).over(w) - value.isNotNull().cast("int")
    return F.when(others > 0, F.sum(value).over(w) - F.coalesce(value, F.lit(0)))


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """One row, UNIQUE of a table: whether no two rows agree in all columns; rows with a null differ from all."""
    whole = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("_n"))
    return whole.agg(F.coalesce(F.max("_n") <= 1, F.lit(True)).alias("is_unique"))


def multiset(a: Column, b: Column, how: str, distinct: bool = False) -> Column:
    """MULTISET UNION, INTERSECT and EXCEPT of arrays; without ``distinct`` by number, in the order of values."""
    if distinct:
        return F.array_sort({"union": F.array_union, "intersect": F.array_intersect, "except": F.array_except}[how](a, b))
    if how == "union":
        return F.array_sort(F.concat(a, b))
    number = lambda x, v: F.size(F.filter(x, lambda y: y.eqNullSafe(v)))
    keep = lambda v: F.least(number(a, v), number(b, v)) if how == "intersect" else F.greatest(number(a, v) - number(b, v), F.lit(0))
    return F.flatten(F.transform(F.array_sort(F.array_distinct(a)), lambda v: F.array_repeat(v, keep(v))))


def ranked(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """ROW_NUMBER over the whole table without gathering it in one task: rows are dealt by range, counted
    by part, and each part adds the number of rows before it. ``order`` must tell rows apart."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(*order)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.row_number().over(own) + F.col("_before")).drop("_part", "_before")


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points inside [low, high], met by buckets of ``width``: an equality join of each point's bucket
    with every bucket that a range touches, so ranges should not be much wider than a bucket."""
    p = points.withColumn("_bucket", F.floor(F.col(at) / width).cast("long"))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    return p.join(r, "_bucket").where(F.col(at).between(F.col(low), F.col(high))).drop("_bucket")
