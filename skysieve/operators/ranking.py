"""Ranks within large groups without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysieve.session import cut


def ranked_within(df: DataFrame, groups: tuple[str, ...], order: tuple[Column | str, ...], rank: str = "rank", size: str | None = None) -> DataFrame:
    """Add the 1-based rank of each row in its group by `order`, which must be a total one, and if asked the size of the group.

    Rows are range-partitioned by group and order, so a large group is spread over tasks; a window ranks within each
    range, and the counts of the ranges before it (as many rows as there are ranges and groups) are added."""
    order = tuple(F.col(o) if isinstance(o, str) else o for o in order)
    keys = [f"__rw_o{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(keys, order)))
    rows = cut(rows.repartitionByRange(*groups, *keys).withColumn("__rw_range", F.spark_partition_id()))
    counts = rows.groupBy(*groups, "__rw_range").agg(F.count(F.lit(1)).alias("__rw_c"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("__rw_range").rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.withColumn("__rw_before", F.coalesce(F.sum("__rw_c").over(before), F.lit(0))).withColumn("__rw_all", F.sum("__rw_c").over(whole))
    renamed = steps.select(*(F.col(g).alias(f"__rw_g{i}") for i, g in enumerate(groups)), F.col("__rw_range").alias("__rw_r"), "__rw_before", "__rw_all")
    on = F.col("__rw_range") == F.col("__rw_r")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__rw_g{i}"))
    within = F.row_number().over(Window.partitionBy(*groups, "__rw_range").orderBy(*keys))
    out = rows.withColumn("__rw_i", within).join(renamed, on).withColumn(rank, F.col("__rw_before") + F.col("__rw_i"))
    if size:
        out = out.withColumn(size, F.col("__rw_all"))
    return out.drop(*keys, "__rw_range", "__rw_i", "__rw_r", "__rw_before", "__rw_all", *(f"__rw_g{i}" for i in range(len(groups))))


def quantiles(df: DataFrame, groups: tuple[str, ...], value: str, shares: tuple[float, ...], out: str = "q") -> DataFrame:
    """groups, out: the quantiles of the values present, interpolated between neighbours and exactly what percentile() gives, in an array by
    shares. Groups without a value have no row, but without groups there is one row always.

    percentile() holds every distinct value of a group in one buffer. Here values are counted in map tasks and range-partitioned by
    group and value; the counts of the ranges before a value and within its range tell which ranks it has, and an aggregation of a few
    numbers a group picks the neighbours of each quantile."""
    names = [f"__q_g{i}" for i in range(len(groups))]
    counts = df.select(*(F.col(g).alias(n) for g, n in zip(groups, names)), F.col(value).cast("double").alias("__q_v")).filter(F.col("__q_v").isNotNull()).groupBy(*names, "__q_v").agg(F.count(F.lit(1)).alias("__q_c"))
    rows = cut(counts.repartitionByRange(*names, "__q_v").withColumn("__q_range", F.spark_partition_id()))
    whole = Window.partitionBy(*names)
    before = whole.orderBy("__q_range").rowsBetween(Window.unboundedPreceding, -1)
    steps = rows.groupBy(*names, "__q_range").agg(F.sum("__q_c").alias("c")).select(
        *(F.col(n).alias(f"{n}s") for n in names), F.col("__q_range").alias("__q_r"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__q_before"), F.sum("c").over(whole).alias("__q_n")
    )
    on = F.col("__q_range") == F.col("__q_r")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}s"))
    within = F.sum("__q_c").over(Window.partitionBy(*names, "__q_range").orderBy("__q_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("__q_i", within).join(steps, on).withColumn("__q_end", F.col("__q_before") + F.col("__q_i"))
    picks = []
    for i, share in enumerate(shares):
        at = (F.col("__q_n") - 1) * F.lit(float(share))
        for end, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            picks.append(F.max(F.when((F.col("__q_end") - F.col("__q_c") <= rank) & (rank < F.col("__q_end")), F.col("__q_v"))).alias(f"{end}{i}"))
    found = placed.groupBy(*names).agg(F.max("__q_n").alias("__q_n"), *picks)

    def between(i: int, share: float) -> Column:
        at, low, high = (F.col("__q_n") - 1) * F.lit(float(share)), F.col(f"low{i}"), F.col(f"high{i}")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*(F.col(n).alias(g) for g, n in zip(groups, names)), F.array(*(between(i, s) for i, s in enumerate(shares))).alias(out))


def with_quantiles(groups_df: DataFrame, groups: tuple[str, ...], found: DataFrame) -> DataFrame:
    """Add the columns of `found` to one row per group; null where a group has none. Null is a group."""
    if not groups:
        return groups_df.crossJoin(found)
    renamed = found.withColumnsRenamed({g: f"__wq_{g}" for g in groups})
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__wq_{g}"))
    return groups_df.join(renamed, on, "left").drop(*(f"__wq_{g}" for g in groups))
