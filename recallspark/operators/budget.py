"""Selection of ranked rows under a token budget.

All take rows with a rank `order` (a list of sort expressions that is total) within `by` (columns;
none for one list). No list is sorted whole: a budget can't hold more rows than it has of the
smallest cost, so only that many of the first rows reach the running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def most_rows(df: DataFrame, tokens: str, budget: int) -> int:
    """The most rows, from the first on, that can lie within a budget: all free ones, and those of the least cost."""
    found = df.agg(F.min(F.when(F.col(tokens) > 0, F.col(tokens))).alias("least"), F.count_if(F.coalesce(F.col(tokens), F.lit(0)) <= 0).alias("free")).first()
    return found["free"] + (max(budget, 0) // found["least"] if found["least"] else 0) + 1


def first_rows(df: DataFrame, by: list, order: list, n: int) -> DataFrame:
    """The first n rows of each list, with rank."""
    if not by:
        return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    # a filter on row_number alone is applied by tasks before rows move
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def prefix_stop(df: DataFrame, by: list, order: list, tokens: str, budget: int | None, early: bool = True) -> DataFrame:
    """Rows in order up to the first that would overflow; the first row always, with `early` none after the budget is reached.

    Adds rank and used; without a budget all rows with rank and used.
    """
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    if budget is None:
        return first_rows(df, by, order, 2**31 - 1).withColumn("used", F.sum(tokens).over(w))
    ranked = first_rows(df, by, order, most_rows(df, tokens, budget)).withColumn("used", F.sum(tokens).over(w))
    fits = F.col("used") <= budget
    if early:
        fits = fits & (F.col("used") - F.col(tokens) < budget)
    return ranked.where((F.col("rank") == 1) | fits)


def skip_and_continue(df: DataFrame, by: list, order: list, tokens: str, budget: int, pool: int = 1000, exempt_first: bool = True, early: bool = True) -> DataFrame:
    """Rows that fit, in order, over-large ones skipped, with `early` until the budget is reached, of the first `pool`.

    With `exempt_first` the first row is always taken. Adds rank (in the list) and used.
    """
    item = F.struct("rank", F.col(tokens).cast("long").alias("t"), F.struct(*[c for c in df.columns]).alias("row"))
    ranked = first_rows(df, by, order, pool)
    grouped = ranked.groupBy(*(F.col(c).alias(f"by{i}") for i, c in enumerate(by)))
    lists = grouped.agg(F.array_sort(F.collect_list(item), lambda a, b: a["rank"] - b["rank"]).alias("items"))
    first = (lambda x: x["rank"] == 1) if exempt_first else (lambda x: F.lit(False))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:int,used:bigint>>").alias("kept"))

    def step(acc, x):
        after = acc["used"] + x["t"]
        fits = after <= budget
        if early:
            fits = fits & (acc["used"] < budget)
        return F.when(first(x) | fits, F.struct(after.alias("used"), F.concat(acc["kept"], F.array(F.struct(x["rank"].alias("rank"), after.alias("used")))).alias("kept"))).otherwise(acc)

    folded = lists.select("items", F.aggregate("items", start, step)["kept"].alias("kept"))
    each = folded.select("items", F.explode("kept").alias("k"))
    return each.select(F.get("items", F.col("k.rank") - 1)["row"].alias("row"), F.col("k.rank").alias("rank"), F.col("k.used").alias("used")).select("row.*", "rank", "used")


def pointer_limit(budget: int) -> int:
    """How many pointers of 40 tokens a budget buys: one at least."""
    return max(1, budget // 40)


def tiered(df: DataFrame, order: list, tokens: str, budget: int, pointer: int = 40) -> DataFrame:
    """Full rows by prefix_stop, then as many pointers to the next rows as the rest of the budget buys.

    Adds rank, used and tier ('full' or 'pointer').
    """
    full = prefix_stop(df, [], order, tokens, budget)
    spent = full.agg(F.coalesce(F.max("used"), F.lit(0)).alias("spent"), F.coalesce(F.max("rank"), F.lit(0)).alias("last")).first()
    more = max(0, budget - spent["spent"]) // pointer
    rest = first_rows(df, [], order, spent["last"] + more).where(F.col("rank") > spent["last"])
    used = spent["spent"] + (F.col("rank") - spent["last"]) * pointer
    return full.withColumn("tier", F.lit("full")).unionByName(rest.withColumns({"used": used.cast("long"), "tier": F.lit("pointer")}))


def item_stop(df: DataFrame, order: list, text: str, budget: int, envelope: int = 130, per_item: int = 18) -> DataFrame:
    """Answer items in order: each costs a third of its bytes, rounded up, and per_item; the envelope is spent first, the first item is exempt.

    Adds cost, rank and used.
    """
    priced = df.withColumn("cost", F.ceil(F.octet_length(text) / 3).cast("long") + per_item)
    kept = prefix_stop(priced, [], order, "cost", budget - envelope, early=False)
    return kept.withColumn("used", F.col("used") + envelope)
