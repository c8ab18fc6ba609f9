"""Reducers: what a column of cells folds to, as Spark aggregate expressions.

A reducer skips NA. Unless it says otherwise, one NM makes the whole result NM. All but the ordered and the collecting
ones combine on the map side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.cells import Cell


class Reducer:
    """agg(cell, order) gives the result as aggregate expressions; order is a struct that sorts the rows."""

    #: Rows of a key, from either end, beyond which the result cannot depend: (n, from the end).
    window: tuple[int, bool] | None = None

    def fold(self, v: Column, order: Column) -> Column:
        raise NotImplementedError

    def agg(self, cell: Cell, order: Column) -> Cell:
        if cell.nm is None:
            return Cell(self.fold(cell.v, order))
        any_nm = F.coalesce(F.bool_or(cell.nm), F.lit(False))
        return Cell(F.when(~any_nm, self.fold(cell.v, order)), any_nm)


class Fold(Reducer):
    """Any aggregate of the values."""

    def __init__(self, f: Callable[[Column], Column]) -> None:
        self.f = f

    def fold(self, v: Column, order: Column) -> Column:
        return self.f(v)


def Count() -> Reducer:
    return Fold(F.count)


def Sum() -> Reducer:
    """0 for no values."""
    return Fold(lambda v: F.coalesce(F.sum(v), F.lit(0)))


def SumNonEmpty() -> Reducer:
    """NA for no values."""
    return Fold(F.sum)


def Product() -> Reducer:
    """1 for no values."""
    return Fold(lambda v: F.coalesce(F.product(v), F.lit(1.0)))


def ProductNonEmpty() -> Reducer:
    return Fold(F.product)


def WholeProduct() -> Reducer:
    """The exact product of whole numbers, as decimal(38,0): 1 for no values, NA if it has over 38 digits.

    Ones, minus ones and zeros are only counted; other values are gathered, of which 127 always overflow.
    """
    kind = "decimal(38,0)"

    def f(v: Column) -> Column:
        rest = F.collect_list(F.when(F.abs(v) > 1, v.cast(kind)))
        product = F.aggregate(rest, F.lit(1).cast(kind), lambda a, x: F.try_multiply(a, x).cast(kind))
        signed = F.when(F.count_if(v == -1) % 2 == 1, -product).otherwise(product)
        return F.when(F.count_if(v == 0) > 0, F.lit(0).cast(kind)).otherwise(signed).cast(kind)

    return Fold(f)


def Mean() -> Reducer:
    return Fold(lambda v: F.avg(v.cast("double")))


def Median() -> Reducer:
    return Fold(F.median)


def Max() -> Reducer:
    return Fold(F.max)


def Min() -> Reducer:
    return Fold(F.min)


def Unique() -> Reducer:
    """The different values, sorted; an empty set for none."""
    return Fold(lambda v: F.array_sort(F.collect_set(v)))


def Quantile(ps: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> Reducer:
    """(p, value) pairs, interpolated at p * (n - 1); NA for no values, empty for no ps."""
    points = F.array(*(F.lit(float(p)) for p in ps)) if ps else F.array().cast("array<double>")

    def f(v: Column) -> Column:
        if not ps:
            return F.when(F.count(v) >= 0, F.array().cast("array<struct<p:double,value:double>>"))
        found = F.percentile(v, list(map(float, ps)))
        return F.when(F.count(v) > 0, F.zip_with(points, found, lambda p, x: F.struct(p.alias("p"), x.alias("value"))))

    return Fold(f)


def Outliers(k: float = 1.5) -> Reducer:
    """(lower, upper) fences k interquartile ranges out, each only if some value lies on or beyond it; NA for no values."""

    def f(v: Column) -> Column:
        q = F.percentile(v, [0.25, 0.75])
        reach = (q[1] - q[0]) * k
        low, high = q[0] - reach, q[1] + reach
        return F.when(F.count(v) > 0, F.struct(F.when(F.min(v) <= low, low).alias("lower"), F.when(F.max(v) >= high, high).alias("upper")))

    return Fold(f)


class _Edge(Reducer):
    """The first or last cell that is not NA, be it NM."""

    def __init__(self, last: bool) -> None:
        self.by = F.max_by if last else F.min_by

    def agg(self, cell: Cell, order: Column) -> Cell:
        if cell.nm is None:
            return Cell(self.by(cell.v, F.when(cell.is_value, order)))
        got = self.by(F.struct(cell.v.alias("v"), cell.nm.alias("nm")), F.when(cell.is_value | cell.nm, order))
        return Cell(got["v"], F.coalesce(got["nm"], F.lit(False)))


def First() -> Reducer:
    return _Edge(False)


def Last() -> Reducer:
    return _Edge(True)


class _EdgeN(Reducer):
    """The first or last n values in order; NA if there are fewer, NM if one lies among them."""

    def __init__(self, n: int, last: bool) -> None:
        if n <= 0:
            raise ValueError("n must be positive")
        self.n, self.window = n, (n, last)

    def agg(self, cell: Cell, order: Column) -> Cell:
        n, last = self.window
        seen = F.when(~cell.is_na, F.struct(order.alias("o"), cell.v.alias("v"), cell.is_nm.alias("nm")))
        rows = F.array_sort(F.collect_list(seen))
        few = F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), F.lit(n)) if last else F.slice(rows, 1, n)
        bad = F.exists(few, lambda x: x["nm"])
        full = F.size(rows) >= n
        # an NM is met before the shortage is known
        return Cell(F.when(full & ~bad, F.transform(few, lambda x: x["v"])), None if cell.nm is None else bad)


def FirstN(n: int) -> Reducer:
    return _EdgeN(n, False)


def LastN(n: int) -> Reducer:
    return _EdgeN(n, True)


class Exists(Reducer):
    """Whether some value satisfies p; always a value, missing cells do not count."""

    def __init__(self, p: Callable[[Column], Column]) -> None:
        self.p = p

    def agg(self, cell: Cell, order: Column) -> Cell:
        return Cell(F.coalesce(F.bool_or(F.when(cell.is_value, self.p(cell.v))), F.lit(False)))


class ForAll(Reducer):
    """Whether all values satisfy p: true for none, false with an NM; always a value."""

    def __init__(self, p: Callable[[Column], Column]) -> None:
        self.p = p

    def agg(self, cell: Cell, order: Column) -> Cell:
        good = F.coalesce(F.bool_and(F.when(cell.is_value, F.coalesce(self.p(cell.v), F.lit(False)))), F.lit(True))
        return Cell(good if cell.nm is None else good & ~F.coalesce(F.bool_or(cell.nm), F.lit(False)))


def _ordered(v: Column, order: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(order.alias("o"), v.alias("v")))))
    return F.transform(rows, lambda x: x["v"])


class MonoidReducer(Reducer):
    """merge over the values in order, from zero."""

    def __init__(self, zero, merge: Callable[[Column, Column], Column]) -> None:
        self.zero, self.merge = zero, merge

    def fold(self, v: Column, order: Column) -> Column:
        zero = self.zero if isinstance(self.zero, Column) else F.lit(self.zero)
        return F.aggregate(_ordered(v, order), zero, self.merge)


class SemigroupReducer(Reducer):
    """merge over the values in order; NA for none."""

    def __init__(self, merge: Callable[[Column, Column], Column]) -> None:
        self.merge = merge

    def fold(self, v: Column, order: Column) -> Column:
        rows = _ordered(v, order)
        return F.reduce(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), F.get(rows, F.lit(0)), self.merge)


class ArrayReducer(Reducer):
    """f of the ordered array of values; NA for none."""

    def __init__(self, f: Callable[[Column], Column]) -> None:
        self.f = f

    def fold(self, v: Column, order: Column) -> Column:
        return F.when(F.count(v) > 0, self.f(_ordered(v, order)))


def PythonReducer(f: Callable, kind: str) -> Reducer:
    """A Python function of the list of values, of Spark type kind: the slow way out for what expressions cannot say."""

    @F.pandas_udf(kind)
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else f(list(x)))

    return ArrayReducer(run)

