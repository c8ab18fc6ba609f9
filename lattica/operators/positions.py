"""Positions without a task that sees everything: occurrence numbers, dense positions, carried values.

Spark has no row order, so frames carry position columns. Anything that needs the n-th row, or the last value so far, cuts
the positions into ranges of about equal rows, sums up one small row a range, and works inside the ranges. Keys that may be
hot are cut likewise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Session setting: "split" cuts each key's rows into ranges when they are numbered or carried along, "whole" keeps a key in
#: one window, which costs a shuffle less; "auto" (the default) splits where the plan's statistics expect over LARGE bytes.
RANGES = "lattica.positional.ranges"
LARGE = 4 << 30
#: Rows that a range is to hold, and most ranges: of each one row goes to a single task.
ROWS, MOST = 100_000, 200_000
#: Of several order columns: most ranges, and rows a range that are looked at for its bounds.
MOST_BOUNDS, SEEN = 1024, 50


def splits(df: DataFrame) -> bool:
    how = df.sparkSession.conf.get(RANGES, "auto")
    if how != "auto":
        return how == "split"
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > LARGE


def order_struct(order: Sequence[str]) -> Column:
    return F.struct(*order)


def single_position(df: DataFrame, order: Sequence[str], name: str = "__pos") -> DataFrame:
    """df with one ascending bigint position in place of several order columns.

    Positions depend on the rows alone, not on how a sort happens to cut its partitions: a plan may be run several times.
    """
    if list(order) == [name] and dict(df.dtypes)[name] in ("bigint", "int"):
        return df
    cut = ranged(df, order)
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    numbered = cut.withColumn("__new", F.shiftleft(F.col("__range").cast("bigint"), 33) + within)
    return numbered.drop(*(c for c in order if c != "__k"), name, "__range").withColumnRenamed("__new", name)


def _tree(x: Column, cuts: list[float], leaf: Callable[[int], Column], low: int = 0) -> Column:
    """leaf(i) for the count i of cuts that are at most x, by halving."""
    if not cuts:
        return leaf(low)
    half = len(cuts) // 2
    right = _tree(x, cuts[half + 1 :], leaf, low + half + 1)
    return F.when(x >= cuts[half], right).otherwise(_tree(x, cuts[:half], leaf, low))


def ranged(df: DataFrame, order: str | Sequence[str], rows: int = ROWS) -> DataFrame:
    """df with __range, in the order of the columns: about rows rows to each, by bounds that are fixed in the plan."""
    order = [order] if isinstance(order, str) else list(order)
    if len(order) == 1 and dict(df.dtypes)[order[0]] in ("bigint", "int"):
        return _ranged_by_number(df, order[0], rows)
    n = df.count()
    wanted = min(MOST_BOUNDS, -(-n // rows))
    if wanted <= 1:
        return df.withColumn("__range", F.lit(0))
    # some rows show where to cut; all are put into ranges
    seen = df.select(*order).sample(min(1.0, wanted * SEEN / n), seed=1).orderBy(*order).collect()
    cuts = list(dict.fromkeys(seen[len(seen) * i // wanted] for i in range(1, wanted))) if seen else []
    if not cuts:
        return df.withColumn("__range", F.lit(0))
    kinds = {f.name: f.dataType for f in df.schema}
    bounds = F.array(*(F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, cut, strict=True))) for cut in cuts))
    # the count of bounds that are at most the row's, by halving
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    return df.withColumn("__range", F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= order_struct(order), at + step).otherwise(at)))


def _ranged_by_number(df: DataFrame, pos: str, rows: int) -> DataFrame:
    """Ranges of one whole-numbered position.

    Quantiles of pos cut the rows into 64 parts at most, and equal spans cut each part again, so that neither gaps nor
    outliers of positions leave more than a part's rows in one range.
    """
    parts = 64
    n, low, high, cuts = df.agg(F.count(pos), F.min(pos), F.max(pos), F.percentile_approx(pos, [i / parts for i in range(1, parts)], 10_000)).first()
    wanted = min(MOST, -(-n // rows))
    if wanted <= 1 or low == high:
        return df.withColumn("__range", F.lit(0))
    cuts = sorted({c for c in cuts if low < c <= high})
    each = max(1, -(-wanted // (len(cuts) + 1)))
    edges = [low, *cuts, high + 1]

    def leaf(i: int) -> Column:
        if each == 1:
            return F.lit(i)
        inner = F.floor((F.col(pos) - F.lit(edges[i])) * (each / (edges[i + 1] - edges[i])))
        return F.lit(i * each) + F.least(F.greatest(inner, F.lit(0)), F.lit(each - 1)).cast("int")

    return df.withColumn("__range", _tree(F.col(pos), cuts, leaf))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    out = left["__range"] == right["__r"]
    for i, k in enumerate(keys):
        out = out & left[k].eqNullSafe(right[f"__k_{i}"])
    return out


def _earlier(keys: Sequence[str]) -> WindowSpec:
    """The ranges before, of a key or of all rows: one row a key and range; without keys few enough for one task."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)


def occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "__occ") -> DataFrame:
    """df with the number of each row (from 1) among the rows of its keys, in order."""
    if keys and not splits(df):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    cut = ranged(df, order)
    counts = cut.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    counts = counts.select(*(F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(_earlier(keys)), F.lit(0)).alias("__before"))
    joined = cut.join(counts if keys else F.broadcast(counts), _same(cut, counts, keys))
    within = Window.partitionBy(*keys, "__range").orderBy(*order)
    numbered = joined.withColumn(name, (F.col("__before") + F.row_number().over(within)).cast("int" if keys else "bigint"))
    return numbered.drop("__range", "__r", "__before", *(f"__k_{i}" for i in range(len(keys))))


def dense(df: DataFrame, order: Sequence[str], name: str = "__at") -> DataFrame:
    """df with the row's place (from 0) in order."""
    return occurrence(df, [], order, name).withColumn(name, F.col(name) - 1)


def dense_by_partition(df: DataFrame, name: str) -> DataFrame:
    """df, as a scan gives it, with places 0, 1, ... in the scan's order: one count a partition, no shuffle of rows."""
    numbered = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright(F.col("__id"), 33)
    counts = numbered.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__p", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    out = numbered.withColumn("__p", part).join(F.broadcast(starts), "__p")  # a row a partition
    return out.withColumn(name, F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__p", "__start")


def carry_forward(df: DataFrame, carried: Column, order: Sequence[str], by: Sequence[str] = (), name: str = "__last") -> DataFrame:
    """df with the last non-null carried at or before each row, over all rows or within the groups of by."""
    if by and not splits(df):
        over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.last(carried, ignorenulls=True).over(over))
    kept = df.withColumn("__carried", carried)
    cut = ranged(kept, order)
    last = cut.groupBy(*by, "__range").agg(F.max_by("__carried", F.when(F.col("__carried").isNotNull(), order_struct(order))).alias("__own"))
    before = last.select(*(F.col(k).alias(f"__k_{i}") for i, k in enumerate(by)), F.col("__range").alias("__r"), F.last("__own", ignorenulls=True).over(_earlier(by)).alias("__before"))
    within = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cut.join(before if by else F.broadcast(before), _same(cut, before, by))
    out = joined.withColumn(name, F.coalesce(F.last("__carried", ignorenulls=True).over(within), F.col("__before")))
    return out.drop("__range", "__r", "__before", "__carried", *(f"__k_{i}" for i in range(len(by))))
