"""Row numbers and running sums in a total order, without all rows of a list in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import kept

PARTS = 64  #: ranges into which a list is cut


def numbered(df: DataFrame, by: list[str], on: Column, order: list, name: str = "rank", parts: int = PARTS) -> DataFrame:
    """df with `name`, the row's number from 1 within `by` in the total order `order`.

    `on` is a number that never falls along `order` (its first key, negated for a descending one);
    nulls come first. Each list is cut at quantiles of it; ranges are numbered apart and shifted by
    the rows before them, so a list may be as long as the table. One value of `on` is one range: it
    should not be that of most rows.
    """
    keyed = df.select(F.struct("*").alias("row"), *(F.col(c).alias(f"by{i}") for i, c in enumerate(by)), on.cast("double").alias("on"))
    keys = [f"by{i}" for i in range(len(by))]
    cuts = F.percentile_approx("on", F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(100 * parts))
    # written: where lists are few, their cuts are known to be small, and no row moves to meet them
    bounds = kept(keyed.groupBy(*keys).agg(cuts.alias("cuts")), "bounds")
    ranged = keyed.alias("l").join(bounds.alias("r"), _same(keys), "left").select(*(f"l.{k}" for k in keys), "row", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("on"))), F.lit(0)).alias("range"))
    sizes = ranged.groupBy(*keys, "range").agg(F.count("*").alias("n"))
    before = kept(sizes.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("range")) - F.col("n")).drop("n"), "before")
    inside = F.row_number().over(Window.partitionBy(*keys, "range").orderBy(*(_inside(o) for o in order)))
    counted = ranged.withColumn("inside", inside)
    return counted.alias("l").join(before.alias("r"), _same([*keys, "range"])).select("row.*", (F.col("inside") + F.col("before")).alias(name))


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return out


def _inside(order) -> Column:
    """A sort key by column name, as one of the packed row: '-name' falls."""
    return F.desc(f"row.{order[1:]}") if order.startswith("-") else F.asc(f"row.{order}")
