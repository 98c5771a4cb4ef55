"""Running values over groups of any size: a group is cut into ranges of its order, each range is worked out by
itself, and what the ranges before it come to is added. No group is a single task's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import cut


def carried(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), maxima: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """df with, over the rows of the same group that come before a row: before_x, the sum of x (0 if there are
    none), for x in sums; top_x, the largest x or null, for x in maxima; prev_x, the nearest x that is not null, or
    null, for x in last. Rows of a group differ in order; null groups are one group."""
    parts = cut(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    at = F.struct(*order)
    held = {x: F.max(F.when(F.col(x).isNotNull(), F.struct(at.alias("at"), F.col(x).alias("value")))) for x in last}
    totals = parts.groupBy("_part", *group).agg(
        F.count("*").alias("_rows"), *[F.sum(x).alias(f"_sum_{x}") for x in sums], *[F.max(x).alias(f"_max_{x}") for x in maxima], *[v.alias(f"_last_{x}") for x, v in held.items()]
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group],
        *[F.sum(f"_sum_{x}").over(earlier).alias(f"_sum_{x}") for x in sums],
        *[F.max(f"_max_{x}").over(earlier).alias(f"_max_{x}") for x in maxima],
        *[F.last(f"_last_{x}", True).over(earlier).alias(f"_last_{x}") for x in last],
    )
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    above = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(carry, same).select(
        *df.columns,
        *[(F.coalesce(F.sum(x).over(above), F.lit(0)) + F.coalesce(f"_sum_{x}", F.lit(0))).alias(f"before_{x}") for x in sums],
        *[F.greatest(F.max(x).over(above), f"_max_{x}").alias(f"top_{x}") for x in maxima],
        *[F.coalesce(F.last(x, True).over(above), F.col(f"_last_{x}.value")).alias(f"prev_{x}") for x in last],
    )


def ranks(df: DataFrame, group: Sequence[str], value: str, ranked: Sequence[float]) -> DataFrame:
    """(group, p, n, value): for each p in ranked the nearest-rank percentile, the value at place ceil(p * n) of a group's n
    values that are not null, at least the first. Equal values are counted first, and places follow from running
    counts, so that no group's values are held together (AGG-12, AGG-13)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    run = carried(counts, group, [value], sums=["_n"])
    total = run.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.sum("_n").alias("n"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    places = run.join(total, same).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ranked])))
    place = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n") - 1e-9))
    return places.filter((F.col("before__n") < place) & (place <= F.col("before__n") + F.col("_n"))).select(*group, "p", "n", value)


def danish(text: Column | str) -> Column:
    """A text that sorts and compares by Danish rules: æ, ø, å and aa at the end, capitals before small letters (SRT-7)."""
    return F.collate(text, "da")


def sorted_list(df: DataFrame, keys: Sequence[tuple[str, bool]], tie: str) -> DataFrame:
    """df with its position from 1 on in a list sorted by keys (column, descending), texts by Danish rules, nulls last
    either way, then by the column tie, which no two rows share (SRT-7). The list is cut into ranges, so that
    no task sorts or numbers all of it."""
    rank = []
    for i, (name, down) in enumerate(keys):
        own = danish(name) if df.schema[name].dataType.typeName() == "string" else F.col(name)
        # A range has one direction: within it the rank of a value among the distinct ones stands for the value.
        values = df.select(own.alias("_value")).filter(F.col("_value").isNotNull()).distinct()
        place = carried(values.withColumn("_one", F.lit(1).cast("long")), [], ["_value"], sums=["_one"])
        place = place.select("_value", (F.col("before__one") * (-1 if down else 1)).alias(f"_k{i}"))
        df = df.join(place, own.eqNullSafe(F.col("_value")), "left").drop("_value")
        df = df.withColumn(f"_k{i}", F.coalesce(f"_k{i}", F.lit((1 << 62))))
        rank.append(f"_k{i}")
    made = carried(df.withColumn("_one", F.lit(1).cast("long")), [], [*rank, tie], sums=["_one"])
    return made.withColumn("position", F.col("before__one") + 1).drop("before__one", "_one", *rank)
