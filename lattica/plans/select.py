"""Selectors: which columns (or rows), read as what, and what then becomes of the cells.

A selector is a small tree that compiles, against a frame's columns, to one cell expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import casts
from lattica.functions.cells import Cell, _flag

#: Cells by column key, with their types; a key that is not there is NA.
Source = Callable[[object], list[tuple[Cell, T.DataType]]]


@dataclass(frozen=True)
class Context:
    """The columns that a selector may read, in order."""

    keys: Sequence
    cell: Callable[[int], Cell]
    kind: Callable[[int], T.DataType]
    strict: bool = False

    def read(self, key, target: str) -> tuple[Cell, str]:
        for i, k in enumerate(self.keys):
            if k == key:
                return casts.cast(self.cell(i), self.kind(i), target)
        if self.strict:
            raise KeyError(f"no column {key!r}; there are {list(self.keys)!r}")
        kind = casts.type_of(target)
        return Cell(F.lit(None).cast(kind)), kind


class Selector:
    """Base of all selectors; axis tells whether it picks columns or rows."""

    axis = "cols"

    def build(self, at: Context) -> Cell:
        raise NotImplementedError

    def keys(self) -> list | None:
        """The keys picked, None for all."""
        return None

    def map(self, f: Callable[[Column], Column]) -> Selector:
        return _Then(self, lambda c: c.map(f))

    def cell_map(self, f: Callable[[Cell], Cell]) -> Selector:
        return _Then(self, f)

    def filter(self, p: Callable[[Column], Column]) -> Selector:
        return _Then(self, lambda c: c.filter(p))

    def recover(self, na=None, nm=None) -> Selector:
        return _Then(self, lambda c: c.recover(na, nm))

    def recover_with(self, na: Cell | None = None, nm: Cell | None = None) -> Selector:
        return _Then(self, lambda c: c.recover_with(na, nm))

    def or_else(self, that: Selector) -> Selector:
        return _Both(self, that, lambda a, b: a.or_else(b))

    def zip_with(self, that: Selector, f: Callable[[Column, Column], Column]) -> Selector:
        return _Both(self, that, lambda a, b: a.zip_map(b, f))

    def zip(self, that: Selector) -> Selector:
        return self.zip_with(that, lambda a, b: F.struct(a.alias("_1"), b.alias("_2")))

    def flat_map(self, cases: dict, default: Selector) -> Selector:
        """The next selector, chosen for each row by the value; a row without a value keeps its cell."""
        return _Choose(self, cases, default)

    def to_rows(self) -> Selector:
        return _Axis(self, "rows")

    def to_cols(self) -> Selector:
        return _Axis(self, "cols")


class _Axis(Selector):
    def __init__(self, inner: Selector, axis: str) -> None:
        self.inner, self.axis = inner, axis

    def build(self, at: Context) -> Cell:
        return self.inner.build(at)

    def keys(self) -> list | None:
        return self.inner.keys()


class _Then(Selector):
    def __init__(self, inner: Selector, f: Callable[[Cell], Cell]) -> None:
        self.inner, self.f, self.axis = inner, f, inner.axis

    def build(self, at: Context) -> Cell:
        return self.f(self.inner.build(at))

    def keys(self) -> list | None:
        return self.inner.keys()


class _Both(Selector):
    def __init__(self, a: Selector, b: Selector, f: Callable[[Cell, Cell], Cell]) -> None:
        if a.axis != b.axis:
            raise ValueError("selectors of two axes cannot be combined")
        self.a, self.b, self.f, self.axis = a, b, f, a.axis

    def build(self, at: Context) -> Cell:
        return self.f(self.a.build(at), self.b.build(at))

    def keys(self) -> list | None:
        return _all_keys(self.a, self.b)


class _Choose(Selector):
    def __init__(self, inner: Selector, cases: dict, default: Selector) -> None:
        self.inner, self.cases, self.default, self.axis = inner, cases, default, inner.axis

    def build(self, at: Context) -> Cell:
        by = self.inner.build(at)
        last = self.default.build(at)
        v, nm = last.v, last.is_nm
        for key, selector in self.cases.items():
            c = selector.build(at)
            v, nm = F.when(by.v == key, c.v).otherwise(v), F.when(by.v == key, c.is_nm).otherwise(nm)
        return Cell(F.when(by.is_value, v), F.when(by.is_value, nm).otherwise(by.is_nm))

    def keys(self) -> list | None:
        return _all_keys(self.inner, self.default, *self.cases.values())


def _all_keys(*selectors: Selector) -> list | None:
    """The keys of all of them, None if one picks everything."""
    found = [s.keys() for s in selectors]
    return None if None in found else list(dict.fromkeys(k for ks in found for k in ks))


class Pick(Selector):
    """Columns by key; read them with as_ or one of the list forms."""

    def __init__(self, keys: Sequence | None, axis: str = "cols") -> None:
        self._keys, self.axis = None if keys is None else list(keys), axis

    def keys(self) -> list | None:
        return self._keys

    def _picked(self, at: Context) -> list:
        return list(at.keys) if self._keys is None else self._keys

    def as_(self, *kinds: str, names: Sequence[str] | None = None) -> Selector:
        """One column as a value, several as a struct (fields _1, _2, ... or names).

        A struct misses if any part does; the right-most missing part says whether as NA or NM.
        """
        return _As(self, kinds or ("any",), names)

    def as_list(self, kind: str = "any") -> Selector:
        """All cells in one array of (v, nm): always a value."""
        return _Many(self, kind, False)

    as_vector = as_list

    def as_array(self, kind: str = "any") -> Selector:
        """All values in one array; the left-most missing cell makes it miss."""
        return _Many(self, kind, True)

    def build(self, at: Context) -> Cell:
        return self.as_().build(at)


class _As(Selector):
    def __init__(self, pick: Pick, kinds: Sequence[str], names: Sequence[str] | None) -> None:
        self.pick, self.kinds, self.names, self.axis = pick, kinds, names, pick.axis
        fixed = pick.keys()
        if fixed is not None and len(kinds) not in (1, len(fixed)):
            raise ValueError(f"{len(fixed)} keys cannot be read as {len(kinds)} types")

    def keys(self) -> list | None:
        return self.pick.keys()

    def build(self, at: Context) -> Cell:
        keys = self.pick._picked(at)
        kinds = list(self.kinds) * (len(keys) if len(self.kinds) == 1 else 1)
        cells = [at.read(k, kind)[0] for k, kind in zip(keys, kinds, strict=True)]
        if len(cells) == 1 and self.names is None:
            return cells[0]
        names = self.names or [f"_{i + 1}" for i in range(len(cells))]
        full = F.lit(True)
        for c in cells:
            full = full & c.is_value
        nm: Column = F.lit(False)
        for c in cells:  # the last missing part decides
            nm = F.when(c.is_non_value, c.is_nm).otherwise(nm)
        v = F.when(full, F.struct(*(c.v.alias(n) for c, n in zip(cells, names, strict=True))))
        return Cell(v, nm if any(c.nm is not None for c in cells) else None)


class _Many(Selector):
    def __init__(self, pick: Pick, kind: str, dense: bool) -> None:
        self.pick, self.kind, self.dense, self.axis = pick, kind, dense, pick.axis

    def keys(self) -> list | None:
        return self.pick.keys()

    def build(self, at: Context) -> Cell:
        cells = [at.read(k, self.kind)[0] for k in self.pick._picked(at)]
        if not self.dense:
            return Cell(F.array(*(F.struct(c.v.alias("v"), c.is_nm.alias("nm")) for c in cells)))
        full, nm = F.lit(True), F.lit(False)
        for c in reversed(cells):  # the first missing cell decides
            full = full & c.is_value
            nm = F.when(c.is_non_value, c.is_nm).otherwise(nm)
        v = F.when(full, F.array(*(c.v for c in cells)))
        return Cell(v, nm if any(c.nm is not None for c in cells) else None)


def cols(*keys) -> Pick:
    """Columns by key, in the order given."""
    return Pick(keys)


def all_cols() -> Pick:
    return Pick(None)


def rows(*keys) -> Pick:
    """Rows by key: the same selectors on the other axis."""
    return Pick(keys, "rows")


def all_rows() -> Pick:
    return Pick(None, "rows")


def flag(cell: Cell) -> Column:
    return _flag(cell.nm)
