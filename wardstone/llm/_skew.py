"""Joins whose left side may hold a large share of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task should take at the most.
HOT = 1 << 12
#: Most hot keys that are broadcast; beyond, every key is spread.
MANY = 100_000
#: Parts of every key then.
PARTS = 16


def spread_join(left: DataFrame, right: DataFrame, on: list[str], counted: DataFrame, n: str, by: str, how: str = "inner", hot: int = HOT, many: int = MANY) -> DataFrame:
    """``left`` joined to ``right``, which has one row for each key.

    ``counted`` has the keys with ``n``, how many rows of ``left`` each has. Rows of a key over ``hot`` are
    dealt to parts by the hash of ``by``, as many as it needs, and its row of ``right`` is repeated for each;
    other keys have one part. Hot keys are counted first: up to ``many`` are broadcast, beyond that all
    keys get PARTS parts. The result is that of a plain join.
    """
    part, have = "part", {c.lower() for c in (*left.columns, *right.columns)}
    while part in have:
        part = "_" + part
    over = counted.where(F.col(n) > hot).select(*on, F.ceil(F.col(n) / hot).cast("int").alias(part))
    found = over.limit(many + 1).count()
    if not found:
        return left.join(right, on, how)
    if found <= many:
        dealt, copied = (x.join(F.broadcast(over), on, "left").withColumn(part, F.coalesce(part, F.lit(1))) for x in (left, right))
    else:
        dealt, copied = (x.withColumn(part, F.lit(PARTS)) for x in (left, right))
    dealt = dealt.withColumn(part, F.pmod(F.xxhash64(F.col(f"`{by}`"), F.lit(7)), F.col(part)).cast("int"))
    copied = copied.withColumn(part, F.explode(F.sequence(F.lit(0), F.col(part) - 1)))
    return dealt.join(copied, [*on, part], how).drop(part)
