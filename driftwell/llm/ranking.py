"""One ranking from several scores (problem 2): median rank aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.sources.store import cut

#: Rows of a group up to which it is ranked in one window; larger groups are cut into ranges of their order.
HOT = 200_000


def _before(rows: DataFrame, group: str, order: list[Column], weight: str | None, name: str) -> DataFrame:
    """``rows`` with ``name``: how many rows (or how much ``weight``) of the same group come earlier by ``order``.

    The rows are range-partitioned by (group, order), so that a group of any size lies in many partitions; each partition
    counts on its own, and one number for each group and partition carries the sums over.  ``order`` must be total.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    rows = cut(rows.repartitionByRange(parts, F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    w = F.col(weight) if weight else F.lit(1)
    sums = rows.groupBy(group, "_part").agg(F.sum(w).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(group, "_part", F.coalesce(earlier, F.lit(0)).alias("_from"))
    inside = F.sum(w).over(Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(sums, [group, "_part"]).withColumn(name, F.col("_from") + F.coalesce(inside, F.lit(0))).drop("_part", "_from")


def _middle(ranks: dict[str, float]) -> Column:
    """The weighted median: the least rank at which half of the weight is reached."""
    half = sum(ranks.values()) / 2
    pairs = F.array_sort(F.array(*[F.struct(F.col(f"_rank_{c}").alias("r"), F.lit(float(w)).alias("w")) for c, w in ranks.items()]))
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x["w"]
        return F.struct(total.alias("sum"), F.when(acc["at"].isNull() & (total >= F.lit(half)), x["r"]).otherwise(acc["at"]).alias("at"))

    return F.aggregate(pairs, none, step, lambda acc: acc["at"])


def median_rank(rows: DataFrame, group: str, item: str, scores: dict[str, float], hot: int = HOT) -> DataFrame:
    """(group, item, scores, median_rank, mean_rank, place): one order of the items of each group.

    ``scores`` maps a numeric or time column, higher is better, to its weight (> 0).  An item's rank in a score is one more
    than the number of items of its group that are strictly better there, so ties share the better rank; null (and NaN) is
    worse than any value.  Items are ordered by weighted median rank, then weighted mean rank, then ``item``; place counts
    from 1.  ``group`` and ``item`` must name a row; rows where either is null are left out.  Other columns are dropped.
    An empty table gives an empty result.

    A group of more than ``hot`` rows is never sorted in one task: its distinct values are counted and range-partitioned.
    """
    own = rows.select(group, item, *scores).where(F.col(group).isNotNull() & F.col(item).isNotNull())
    for c, kind in own.dtypes:
        if c in scores and kind in ("double", "float"):
            own = own.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    worst_last = {c: F.col(c).desc_nulls_last() for c in scores}
    sizes = own.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(group)
    crowded = bool(sizes.take(1))
    cold = own.join(sizes, group, "left_anti") if crowded else own

    def scored(df: DataFrame) -> DataFrame:
        mean = sum((F.col(f"_rank_{c}") * F.lit(float(w)) for c, w in scores.items()), F.lit(0.0)) / F.lit(float(sum(scores.values())))
        return df.withColumn("median_rank", _middle(scores)).withColumn("mean_rank", mean)

    order = [F.col("median_rank"), F.col("mean_rank"), F.col(item)]
    out = [group, item, *scores, "median_rank", "mean_rank", "place"]
    one = Window.partitionBy(group)
    ranked = scored(cold.select("*", *[F.rank().over(one.orderBy(o)).cast("long").alias(f"_rank_{c}") for c, o in worst_last.items()]))
    ranked = ranked.withColumn("place", F.row_number().over(one.orderBy(*order)).cast("long")).select(*out)
    if not crowded:
        return ranked
    large = own.join(sizes, group, "left_semi")
    for c, o in worst_last.items():
        values = _before(large.groupBy(group, c).agg(F.count(F.lit(1)).alias("_w")), group, [o], "_w", "_better")
        values = values.select(F.col(group).alias("_g"), F.col(c).alias("_v"), (F.col("_better") + 1).cast("long").alias(f"_rank_{c}"))
        large = large.join(values, (F.col(group) == F.col("_g")) & F.col(c).eqNullSafe(F.col("_v"))).drop("_g", "_v")
    large = _before(scored(large), group, order, None, "_earlier").withColumn("place", (F.col("_earlier") + 1).cast("long"))
    return ranked.unionByName(large.select(*out))
