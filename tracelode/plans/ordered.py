"""Row numbers and running values over a whole ordered result, without one task that sees it all.

Rows are range-sorted by the frame's order; each partition numbers its own, and
the counts of the partitions (one row each) give the offsets.  Running values
are then taken within blocks of consecutive numbers.  A window of N rows needs
the last N-1 rows of the block before, which are copied there; an unbounded
running count, sum, minimum or maximum needs the totals of the blocks before,
which are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.plans.frame import Frame
from tracelode.session import cut, parallelism

IDX = "__o_idx"
BLOCK = 65_536


def numbered(fr: Frame) -> Frame:
    """The frame with ``__o_idx`` 0, 1, ... in its order, which becomes its order."""
    if fr.order == ((IDX, False),):
        return fr
    keys = fr.sort_keys()
    n = parallelism(fr.df.sparkSession, 1)
    s = fr.df.drop(IDX).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    s = s.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    s = cut(s, "numbered")
    sizes = s.groupBy("__p").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    df = s.join(F.broadcast(offsets.limit(n + 1)), "__p").withColumn(IDX, F.col("__off") + F.col("__i")).drop("__p", "__i", "__off")
    return fr.with_df(df, order=((IDX, False),))


#: Rows of one group that a single task may pass through in a window.
WIDE = 2_000_000


def widest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group; counted with partial aggregation."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0


def hot(df: DataFrame, keys: list[str]) -> bool:
    """Whether a group is too large for one task."""
    return widest(df, keys) > WIDE


def with_halo(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Adds ``__b`` (block) and ``__own``; the last ``rows`` rows of a block also go to the next one."""
    size = max(BLOCK, 8 * rows)
    b = F.floor(F.col(IDX) / size)
    near = F.col(IDX) % size >= size - rows
    x = df.withColumn("__b", F.explode(F.when(near & F.lit(rows > 0), F.array(b, b + 1)).otherwise(F.array(b))))
    return x.withColumn("__own", F.col("__b") == F.floor(F.col(IDX) / size)), size


#: The value over two sets of rows from the values over each.
BOTH = {
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "min": F.least,
    "max": F.greatest,
}


def running(df: DataFrame, by: list[Column], parts: dict[str, tuple[str, Column]], current: bool) -> DataFrame:
    """Adds running values over all earlier rows with equal ``by``.

    ``parts``: output name -> (count | sum | min | max, column)."""
    keys = [f"__run{i}" for i in range(len(by))]
    x = df.withColumns({k: c for k, c in zip(keys, by)} | {"__b": F.floor(F.col(IDX) / BLOCK)})
    src = {f"__s_{n}": c for n, (_, c) in parts.items()}
    x = x.withColumns(src)
    f = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    totals = x.groupBy("__b", *keys).agg(*[f[kind](f"__s_{n}").alias(f"__t_{n}") for n, (kind, _) in parts.items()])
    w0 = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = w0.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    carry = totals.select(*[F.col(k).alias(f"__c{k}") for k in ["__b", *keys]], *[fold[kind](f"__t_{n}").over(before).alias(f"__c_{n}") for n, (kind, _) in parts.items()])
    on = F.col("__b") == F.col("__c__b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__c{k}"))
    x = x.join(carry, on)
    w = Window.partitionBy("__b", *keys).orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    x = x.withColumns({n: BOTH[kind](F.col(f"__c_{n}"), f[kind](f"__s_{n}").over(w)) for n, (kind, _) in parts.items()})
    return x.drop("__b", "__c__b", *keys, *[f"__c{k}" for k in keys], *src, *[f"__c_{n}" for n in parts])
