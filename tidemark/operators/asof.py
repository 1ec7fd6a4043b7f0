"""Backward as-of joins with an inclusive staleness bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_STALENESS = 3


def asof_join(left: DataFrame, right: DataFrame, columns: list[str], suffix: str = "_xasset", days: int = MAX_STALENESS) -> DataFrame:
    """Each left row with the last right row at most ``days`` days before it (the same day counts).

    The row is chosen by date alone: a NULL value of the chosen row stays NULL. The bound makes it an equi-join: a right
    row is offered to the days it may serve, and the latest offer of a day wins."""
    value = F.struct(F.col("date").alias("_src"), *columns)
    offers = right.select(F.explode(F.expr(f"sequence(date, date_add(date, {days}))")).alias("date"), value.alias("_v"))
    best = offers.groupBy("date").agg(F.max("_v").alias("_v"))
    joined = left.join(best, "date", "left")
    return joined.select(*(left[c] if c != "date" else F.col("date") for c in left.columns), *(F.col(f"_v.{c}").alias(f"{c}{suffix}") for c in columns))


DAY_US = 86_400_000_000


def _micros(df: DataFrame, on: str):
    """Time as a number: microseconds; dates count from their midnight in UTC, whatever the session's zone."""
    return F.unix_date(on).cast("long") * DAY_US if dict(df.dtypes)[on] == "date" else F.unix_micros(F.col(on).cast("timestamp"))


def asof_join_union(
    left: DataFrame, right: DataFrame, columns: list[str], suffix: str = "_xasset", days: float = MAX_STALENESS, by: str = "asset", on: str = "date"
) -> DataFrame:
    """The same for any grain of time: the last right row at most ``days`` days (or a part of one) before each left row.

    Time is cut into buckets as long as the tolerance; a right row is offered to its own bucket and the next, where one sorted
    pass over both sides finds the last offer. A right side without ``by`` serves every key of the left; its rows are offered
    once per bucket, never per key, so keys aren't collected and nothing is broadcast."""
    span = int(days * DAY_US) + 1
    keyed = [by] if by in right.columns else []
    offers = right.select(*keyed, _micros(right, on).alias("_t"), F.struct(*columns).alias("_v"))
    offers = offers.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_k")).select(*keyed, "_t", "_v", (F.floor(F.col("_t") / span) + F.col("_k")).alias("_b"), F.lit(0).alias("_side"))
    rows = left.withColumn("_t", _micros(left, on)).withColumns({"_b": F.floor(F.col("_t") / span), "_side": F.lit(1)})
    both = rows.unionByName(offers, allowMissingColumns=True)
    w = Window.partitionBy(*keyed, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_o", F.last(F.when(F.col("_side") == 0, F.struct("_t", "_v")), ignorenulls=True).over(w)).filter("_side = 1")
    fresh = F.col("_t") - F.col("_o._t") < span
    return both.select(*left.columns, *(F.when(fresh, F.col(f"_o._v.{c}")).alias(f"{c}{suffix}") for c in columns))


def cross_asset(features: DataFrame, wiring: list[tuple[str, str, str]], column: str = "rv_22", days: int = MAX_STALENESS) -> DataFrame:
    """Adds ``{column}_{suffix}`` for each suffix of (target, source, suffix) rows; target "*" stands for every asset but the source.

    Assets without a source in a suffix get NULL; a row that names the asset goes before "*". Sources are named assets: what
    they offer to a day is a map of one value per source, so a single join by date serves all suffixes."""
    sources = sorted({src for _, src, _ in wiring})
    value = F.struct(F.col("date").alias("_src"), F.col(column).alias("_x"))
    offers = features.filter(F.col("asset").isin(sources)).select(F.col("asset").alias("_s"), F.explode(F.expr(f"sequence(date, date_add(date, {days}))")).alias("date"), value.alias("_v"))
    last = offers.groupBy("date", "_s").agg(F.max("_v").alias("_v"))
    daily = last.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("_s", "_v._x"))).alias("_m"))
    out, added = features.join(daily, "date", "left"), []
    for suffix in dict.fromkeys(s for _, _, s in wiring):
        found = F
        for target, src in sorted(((t, s) for t, s, x in wiring if x == suffix), key=lambda r: r[0] == "*"):
            served = F.col("asset") != src if target == "*" else F.col("asset") == target
            found = found.when(served, F.col("_m")[src])
        added.append(found.alias(f"{column}_{suffix}"))
    return out.select(*features.columns, *added)
