"""Cells: a value, not available (NA) or not meaningful (NM), as a pair of Spark expressions.

v holds the value and is NULL for both kinds of missing; nm is true for NM. A cell that cannot be NM has nm None, so plans
carry no marker column for it and Catalyst sees a plain column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[..., Column]


def _flag(x: Column | None) -> Column:
    return F.lit(False) if x is None else x


def _either(a: Column | None, b: Column | None) -> Column | None:
    if a is None or b is None:
        return b if a is None else a
    return a | b


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


@dataclass(frozen=True)
class Cell:
    """One cell a row."""

    v: Column
    nm: Column | None = None

    # what a cell is

    @property
    def is_value(self) -> Column:
        return self.v.isNotNull()

    @property
    def is_non_value(self) -> Column:
        return self.v.isNull()

    @property
    def is_nm(self) -> Column:
        return _flag(self.nm)

    @property
    def is_na(self) -> Column:
        return self.v.isNull() & ~_flag(self.nm)

    def get_or_else(self, default) -> Column:
        return F.coalesce(self.v, as_column(default))

    def fold(self, na, nm, f: Fn) -> Column:
        """na for NA, nm for NM, f(value) else."""
        return F.when(self.is_value, f(self.v)).when(self.is_nm, as_column(nm)).otherwise(as_column(na))

    def to_list(self) -> Column:
        """An array of the value, empty for a missing one."""
        return F.array_compact(F.array(self.v))

    def value_string(self) -> Column:
        return self.fold("NA", "NM", lambda v: v.cast("string"))

    # transforms

    def map(self, f: Fn) -> Cell:
        return Cell(f(self.v), self.nm)

    def flat_map(self, f: Callable[[Column], Cell]) -> Cell:
        inner = f(self.v)
        if inner.nm is None:
            return Cell(F.when(self.is_value, inner.v), self.nm)
        return Cell(F.when(self.is_value, inner.v), F.when(self.is_value, inner.nm).otherwise(_flag(self.nm)))

    def filter(self, p: Fn) -> Cell:
        """A value that fails p becomes NA."""
        return Cell(F.when(p(self.v), self.v), self.nm)

    def filter_not(self, p: Fn) -> Cell:
        return self.filter(lambda v: ~p(v))

    def collect(self, defined: Fn, f: Fn) -> Cell:
        """f where it is defined; NM stays NM, all else NA."""
        return Cell(F.when(defined(self.v), f(self.v)), self.nm)

    def recover(self, na=None, nm=None) -> Cell:
        """Values in place of NA, NM or both."""
        v, left = self.v, self.nm
        if nm is not None and self.nm is not None:
            v, left = F.when(self.is_nm, as_column(nm)).otherwise(v), None
        if na is not None:
            v = F.when(self.is_na, as_column(na)).otherwise(v)
        return Cell(v, left)

    def recover_with(self, na: Cell | None = None, nm: Cell | None = None) -> Cell:
        """Cells in place of NA, NM or both."""
        v, flag = self.v, _flag(self.nm)
        if nm is not None:
            v, flag = F.when(self.is_nm, nm.v).otherwise(v), F.when(self.is_nm, nm.is_nm).otherwise(flag)
        if na is not None:
            v, flag = F.when(self.is_na, na.v).otherwise(v), F.when(self.is_na, na.is_nm).otherwise(flag)
        return Cell(v, flag)

    def or_else(self, that: Cell) -> Cell:
        """The first value, else the second cell as it is."""
        nm = None if that.nm is None else self.v.isNull() & that.nm
        return Cell(F.coalesce(self.v, that.v), nm)

    def or_else_column(self, that: Cell) -> Cell:
        """The first value, else NM if either is NM."""
        v = F.coalesce(self.v, that.v)
        nm = _either(self.nm, that.nm)
        return Cell(v, None if nm is None else v.isNull() & nm)

    def zip_map(self, that: Cell, f: Fn) -> Cell:
        """f of two values; else NA if one is NA, else NM."""
        both = self.is_value & that.is_value
        nm = _either(self.nm, that.nm)
        return Cell(F.when(both, f(self.v, that.v)), None if nm is None else nm & ~self.is_na & ~that.is_na)

    def combine(self, that: Cell, both: Fn, left: Fn = lambda v: v, right: Fn = lambda v: v) -> Cell:
        """NM beats everything; a lone value goes through left or right; two go through both."""
        nm = _either(self.nm, that.nm)
        v = F.when(self.is_value & that.is_value, both(self.v, that.v)).when(self.is_value, left(self.v)).when(that.is_value, right(that.v))
        return Cell(v if nm is None else F.when(~nm, v), nm)

    def exists(self, p: Fn) -> Column:
        return F.coalesce(p(self.v), F.lit(False)) & self.is_value

    def forall(self, p: Fn) -> Column:
        """True for NA, false for NM."""
        return F.when(self.is_value, F.coalesce(p(self.v), F.lit(False))).otherwise(~self.is_nm)

    def order_keys(self) -> list[Column]:
        """Sort by these: NA, then NM, then values."""
        return [F.when(self.is_value, 2).when(self.is_nm, 1).otherwise(0), self.v]

    def equals(self, that: Cell) -> Column:
        """NA = NA and NM = NM, unlike SQL."""
        return self.v.eqNullSafe(that.v) & (self.is_nm == that.is_nm)


def value(x) -> Cell:
    return Cell(as_column(x))


def not_available(kind: str = "string") -> Cell:
    return Cell(F.lit(None).cast(kind))


def not_meaningful(kind: str = "string") -> Cell:
    return Cell(F.lit(None).cast(kind), F.lit(True))


def from_option(x: Column, non_value: Cell | None = None) -> Cell:
    """A NULL becomes non_value, by default NA."""
    return Cell(x) if non_value is None else Cell(x).or_else(non_value)


def safe_div(a: Cell, b: Cell) -> Cell:
    """a / b; a zero divisor gives NM."""
    zero = b.is_value & a.is_value & (b.v == 0)
    out = a.zip_map(b, lambda x, y: F.try_divide(x, y))
    return Cell(out.v, _flag(out.nm) | zero)
