"""Casts on reading: exact or lossy as the target allows; a value that does not fit is NM, never an error.

Text and numbers are never turned into one another. Types are known when the plan is built, so a cast between them is
simply NM for every value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.cells import Cell, _flag

_WHOLE = {"int": "int", "long": "bigint", "bigint": "bigint", "bigint38": "decimal(38,0)"}
_LOSSY = {"float": "float", "double": "double", "number": "double"}
_EXACT = {"decimal": "decimal(38,18)", "rational": "decimal(38,18)"}


#: Casts of one's own, by target: the Spark type that they give, and a function of the cell and its type.
_OWN: dict[str, tuple[str, Callable[[Cell, T.DataType], Cell]]] = {}


def register(target: str, kind: str, f: Callable[[Cell, T.DataType], Cell]) -> None:
    """Make target a name that cells can be read as: f turns a cell of any type into one of Spark type kind; what does not
    fit should be NM."""
    _OWN[target] = (kind, f)


def type_of(target: str) -> str:
    """The Spark type that cells read as target have; text for any."""
    if target in _OWN:
        return _OWN[target][0]
    return {"any": "string"}.get(target) or _WHOLE.get(target) or _LOSSY.get(target) or _EXACT.get(target) or target


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _all_nm(cell: Cell, kind: str) -> Cell:
    return Cell(F.lit(None).cast(kind), _flag(cell.nm) | cell.is_value)


def cast(cell: Cell, source: T.DataType, target: str) -> tuple[Cell, str]:
    """The cell read as target, and the Spark type it then has.

    target: any, string, boolean, int, long, bigint38 (whole numbers of any size), float, double, number, decimal,
    rational, or a Spark type name, which only values of that very type have.
    """
    if target == "any":
        return cell, source.simpleString()
    if target in _OWN:
        kind, f = _OWN[target]
        return f(cell, source), kind
    mixed = isinstance(source, T.StructType) and source.fieldNames() == ["num", "str"]
    if mixed:
        # number or text, as delimited files give: read the number, or else the text
        num, text = Cell(cell.v["num"], cell.nm), Cell(cell.v["str"], cell.nm)
        first, kind = cast(num, source["num"].dataType, target)
        second, text_kind = cast(text, source["str"].dataType, target)
        kind = text_kind if target == "string" else kind
        v = second.v if target == "string" else first.v
        return Cell(v, (_flag(cell.nm) | (cell.is_value & v.isNull()))), kind
    if target in _WHOLE:
        kind = _WHOLE[target]
        if not is_numeric(source):
            return _all_nm(cell, kind), kind
        if isinstance(source, T.IntegralType) and T._parse_datatype_string(kind) == source:
            return cell, kind
        whole = cell.v.try_cast(kind)
        fits = whole.isNotNull() & (whole == cell.v)
        return Cell(F.when(fits, whole), _flag(cell.nm) | (cell.is_value & ~F.coalesce(fits, F.lit(False)))), kind
    if target in _LOSSY:
        kind = _LOSSY[target]
        return (Cell(cell.v.cast(kind), cell.nm), kind) if is_numeric(source) else (_all_nm(cell, kind), kind)
    if target in _EXACT:
        kind = _EXACT[target]
        if not is_numeric(source):
            return _all_nm(cell, kind), kind
        got = cell.v.try_cast(kind)
        return Cell(got, _flag(cell.nm) | (cell.is_value & got.isNull())), kind
    kind = target
    if T._parse_datatype_string(kind) == source:
        return cell, kind
    return _all_nm(cell, kind), kind
