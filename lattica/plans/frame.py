"""Frames: columns of cells under row keys and column keys, both ordered, both free to repeat.

Row data is a DataFrame with the key __k, order columns, and a value (and, where cells can be NM, a flag) column for each
frame column under a name of its own. Column keys live on the driver, so they may repeat and be of any type.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import casts
from lattica.functions import reducers as R
from lattica.functions.cells import Cell, _flag
from lattica.operators import positions
from lattica.operators.matching import key_join, key_merge
from lattica.plans.select import Context, Selector
from lattica.plans.series import NA, Series, local_cell

#: A frame of more rows than this is not transposed: its rows become columns of a plan.
MOST_TRANSPOSED = 1000


@dataclass(frozen=True)
class ColumnRef:
    """A frame column: its key and the names of its value and flag in the DataFrame."""

    key: object
    v: str
    nm: str | None = None

    @property
    def names(self) -> list[str]:
        return [self.v, *([self.nm] if self.nm else [])]

    @property
    def cell(self) -> Cell:
        return Cell(F.col(self.v), F.col(self.nm) if self.nm else None)


class Frame:
    """See the module. strict makes selectors raise on columns that are not there; else those are all NA."""

    def __init__(self, df: DataFrame, columns: Sequence[ColumnRef], order: Sequence[str] = ("__pos",), strict: bool = False) -> None:
        self.df, self.columns, self.order, self.strict = df, list(columns), list(order), strict

    # constructors

    @staticmethod
    def from_df(df: DataFrame, row_key: str | Column | None = None, columns: Sequence[str] | dict | None = None, pos: str | Column | None = None, nm: dict[str, Column] | None = None) -> Frame:
        """A DataFrame as a frame. columns: names, or key -> name or expression (default: all but row_key and pos).

        pos orders the rows (default: as the scan gives them); without row_key keys are 0, 1, ... in that order. nm: flag
        expressions by column key, for cells that are not meaningful.
        """
        named = [x for x in (row_key, pos) if isinstance(x, str)]
        columns = [c for c in df.columns if c not in named] if columns is None else columns
        columns = columns if isinstance(columns, dict) else {c: c for c in columns}
        col = lambda x: F.col(x) if isinstance(x, str) else x
        flags = nm or {}
        if row_key is None:
            df = positions.dense_by_partition(df, "__key") if pos is None else positions.dense(df.withColumn("__pos", col(pos).cast("bigint")), ["__pos"], "__key")
            row_key = "__key"
            pos = "__key" if pos is None else "__pos"
        at = F.monotonically_increasing_id() if pos is None else col(pos)
        parts, refs = [col(row_key).alias("__k"), at.cast("bigint").alias("__pos")], []
        for i, (key, source) in enumerate(columns.items()):
            flag = flags.get(key)
            parts.append((col(source) if flag is None else F.when(~flag, col(source))).alias(f"c{i}"))
            if flag is not None:
                parts.append(flag.alias(f"n{i}"))
            refs.append(ColumnRef(key, f"c{i}", f"n{i}" if flag is not None else None))
        return Frame(df.select(*parts), refs)

    @staticmethod
    def of(spark: SparkSession, rows: Sequence[tuple], columns: dict[object, str], key: str = "bigint") -> Frame:
        """From (row key, cell, cell, ...) tuples; columns: column key -> Spark type. Cells are values, NA (None) or NM."""
        kinds = ", ".join(f"c{i} {t}, n{i} boolean" for i, t in enumerate(columns.values()))
        plain = lambda c: None if c is NA or repr(c) == "NM" and not isinstance(c, str) else c
        data = [(r[0], at, *(x for c in r[1:] for x in (plain(c), repr(c) == "NM" and not isinstance(c, str)))) for at, r in enumerate(rows)]
        df = spark.createDataFrame(data, f"__k {key}, __pos bigint" + (", " + kinds if kinds else ""))
        flagged = [i for i in range(len(columns)) if any(d[3 + 2 * i] for d in data)]
        refs = [ColumnRef(k, f"c{i}", f"n{i}" if i in flagged else None) for i, k in enumerate(columns)]
        return Frame(df.drop(*(f"n{i}" for i in range(len(columns)) if i not in flagged)), refs)

    @staticmethod
    def from_rows(spark: SparkSession, rows: Sequence[Sequence], kinds: Sequence[str], keys: Sequence | None = None) -> Frame:
        """Rows of tuples, keys 0, 1, ...; columns keyed 0, 1, ... or by keys."""
        return Frame.of(spark, [(i, *r) for i, r in enumerate(rows)], dict(zip(range(len(kinds)) if keys is None else keys, kinds, strict=True)))

    @staticmethod
    def from_columns(spark: SparkSession, columns: Sequence[Sequence], kinds: Sequence[str], keys: Sequence | None = None) -> Frame:
        return Frame.from_rows(spark, list(zip(*columns, strict=True)), kinds, keys)

    @staticmethod
    def fill(spark: SparkSession, rows: Sequence, cols: Sequence, f: Callable[[Column, object], Column | Cell], key: str = "bigint") -> Frame:
        """A table from a function of the row key (a column) and the column key to a column or a cell."""
        df = spark.createDataFrame([(k, i) for i, k in enumerate(rows)], f"__k {key}, __pos bigint")
        made = [f(F.col("__k"), c) for c in cols]
        cells = [c if isinstance(c, Cell) else Cell(c) for c in made]
        refs = [ColumnRef(k, f"c{i}", f"n{i}" if c.nm is not None else None) for i, (k, c) in enumerate(zip(cols, cells, strict=True))]
        parts = [x for i, c in enumerate(cells) for x in (c.v.alias(f"c{i}"), *([c.nm.alias(f"n{i}")] if c.nm is not None else []))]
        return Frame(df.select("*", *parts), refs)

    @staticmethod
    def empty(spark: SparkSession, key: str = "string") -> Frame:
        return Frame.of(spark, [], {}, key)

    @staticmethod
    def merge_columns(columns: Sequence[tuple[object, Series]], how: str = "outer") -> Frame:
        """Keyed series side by side, the i-th cells of a key together."""
        return fold(lambda a, b: a.merge(b, how), (s.to_frame(k) for k, s in columns))

    @staticmethod
    def merge_rows(rows: Sequence[tuple[object, Series]], how: str = "outer") -> Frame:
        return Frame.merge_columns(rows, how).transpose()

    @staticmethod
    def join_columns(columns: Sequence[tuple[object, Series]], how: str = "outer") -> Frame:
        return fold(lambda a, b: a.join(b, how), (s.to_frame(k) for k, s in columns))

    # parts

    def _kind(self, ref: ColumnRef) -> T.DataType:
        return self.df.schema[ref.v].dataType

    def _context(self) -> Context:
        return Context([c.key for c in self.columns], lambda i: self.columns[i].cell, lambda i: self._kind(self.columns[i]), self.strict)

    def _cell(self, selector: Selector) -> Cell:
        return selector.build(self._context())

    def _like(self, df: DataFrame | None = None, columns: Sequence[ColumnRef] | None = None, order: Sequence[str] | None = None) -> Frame:
        return Frame(self.df if df is None else df, self.columns if columns is None else columns, self.order if order is None else order, self.strict)

    def _pruned(self, columns: Sequence[ColumnRef]) -> Frame:
        names = dict.fromkeys(["__k", *self.order, *(n for c in columns for n in c.names)])
        return self._like(self.df.select(*names), columns)

    def _free(self, n: int = 1) -> list[str]:
        """Names for new cells."""
        used = {int(c.v[1:]) for c in self.columns if c.v[1:].isdigit()}
        start = max(used, default=-1) + 1
        return [str(start + i) for i in range(n)]

    def _add(self, key, cell: Cell, order: Sequence[str] | None = None) -> Frame:
        i = self._free()[0]
        parts = {f"c{i}": cell.v} | ({f"n{i}": cell.nm} if cell.nm is not None else {})
        return self._like(self.df.withColumns(parts), [*self.columns, ColumnRef(key, f"c{i}", f"n{i}" if cell.nm is not None else None)], order)

    def _by_rows(self, selector: Selector, f: Callable[[Frame, Selector], Frame]) -> Frame | None:
        """f on the other axis if the selector picks rows."""
        if selector.axis == "cols":
            return None
        return f(self.transpose(), selector.to_cols()).transpose()

    def result(self, key: str = "key", flags: bool = True) -> DataFrame:
        """The rows as a DataFrame: key, then each column under its key as text, then its flag under that with _nm."""
        parts = [F.col("__k").alias(key)]
        for c in self.columns:
            parts.append(F.col(c.v).alias(str(c.key)))
            if flags and c.nm:
                parts.append(F.col(c.nm).alias(f"{c.key}_nm"))
        return self.df.select(*parts)

    def to_rows(self) -> list[tuple]:
        """(row key, cell, ...) tuples in order, on the driver."""
        return [(r["__k"], *(local_cell(r[c.v], c.nm and r[c.nm]) for c in self.columns)) for r in self.df.orderBy(*self.order).collect()]

    def __str__(self) -> str:
        head = [" ", *(str(c.key) for c in self.columns)]
        table = [head, *([str(x) for x in r] for r in self.to_rows())]
        wide = [max(len(r[i]) for r in table) for i in range(len(head))]
        lines = [" | ".join(x.ljust(w) for x, w in zip(r[1:], wide[1:], strict=True)) for r in table]
        return "\n".join(f"{r[0].ljust(wide[0])} : {line}" for r, line in zip(table, lines, strict=True))

    def equals(self, that: Frame) -> bool:
        """Same keys and cells in the same orders."""
        if [c.key for c in self.columns] != [c.key for c in that.columns]:
            return False
        flat = []
        for f in (self, that):
            at = positions.dense(f.df, f.order)
            flat.append(at.select("__at", "__k", *(x.alias(f"{n}{i}") for i, c in enumerate(f.columns) for n, x in (("c", c.cell.v), ("n", c.cell.is_nm)))))
        return flat[0].exceptAll(flat[1]).isEmpty() and flat[1].exceptAll(flat[0]).isEmpty()

    # shape and keys

    def retain_columns(self, *keys) -> Frame:
        return self._pruned([c for c in self.columns if c.key in keys])

    def drop_columns(self, *keys) -> Frame:
        return self._pruned([c for c in self.columns if c.key not in keys])

    def filter_col_keys(self, p: Callable[[object], bool]) -> Frame:
        return self._pruned([c for c in self.columns if p(c.key)])

    def _has_key(self, keys: Sequence) -> Column:
        """Whether a row's key is one of keys; a number is never a text's key, nor a text a number's."""
        kind = self.df.schema["__k"].dataType
        if casts.is_numeric(kind):
            keys = [k for k in keys if not isinstance(k, (str, bool))]
        elif isinstance(kind, T.StringType):
            keys = [k for k in keys if isinstance(k, str)]
        return F.col("__k").isin(list(keys)) if keys else F.lit(False)

    def retain_rows(self, *keys) -> Frame:
        return self._like(self.df.where(self._has_key(keys)))

    def drop_rows(self, *keys) -> Frame:
        return self._like(self.df.where(~self._has_key(keys)))

    def filter_row_keys(self, p: Callable[[Column], Column]) -> Frame:
        return self._like(self.df.where(p(F.col("__k"))))

    def map_row_keys(self, f: Callable[[Column], Column]) -> Frame:
        if "__k" in self.order:
            order = ["__was" if c == "__k" else c for c in self.order]
            return self._like(self.df.withColumn("__was", F.col("__k")).withColumn("__k", f(F.col("__k"))), order=order)
        return self._like(self.df.withColumn("__k", f(F.col("__k"))))

    def map_col_keys(self, f: Callable[[object], object]) -> Frame:
        return self._like(columns=[replace(c, key=f(c.key)) for c in self.columns])

    def sort_rows(self) -> Frame:
        return self._like(order=["__k", *(c for c in self.order if c != "__k")])

    def sort_columns(self) -> Frame:
        return self._like(columns=sorted(self.columns, key=lambda c: c.key))

    def reverse_rows(self) -> Frame:
        df = positions.single_position(self.df, self.order) if "__k" not in self.order else positions.single_position(self.df.withColumn("__key", F.col("__k")), ["__key" if c == "__k" else c for c in self.order])
        return self._like(df.withColumn("__pos", -F.col("__pos")), order=["__pos"])

    def reverse_columns(self) -> Frame:
        return self._like(columns=self.columns[::-1])

    def with_col_index(self, index: Sequence[tuple[object, int]]) -> Frame:
        """(key, position) of the columns to show, in order: columns may move, repeat or go."""
        return self._pruned([replace(self.columns[i], key=k) for k, i in index])

    def with_row_index(self, index: DataFrame, key: str = "key", pointer: str = "pointer", pos: str = "pos") -> Frame:
        """Rows by a table of (new key, place of the row, new position): rows may move, repeat or go."""
        at = positions.dense(self.df, self.order).drop("__k", *(c for c in self.order if c != "__k"))
        new = index.select(F.col(key).alias("__k"), F.col(pointer).cast("bigint").alias("__at"), F.col(pos).cast("bigint").alias("__pos"))
        return self._like(at.drop("__pos").join(new, "__at").drop("__at"), order=["__pos"])

    def reindex(self, selector: Selector) -> Frame:
        """New row keys from the data; rows whose key misses go. A rows selector gives new column keys."""
        if selector.axis == "rows":
            new = self._turned(selector).reindex(selector.to_cols())
            return self._pruned([replace(self.columns[r["__pos"]], key=r["__k"]) for r in new.df.orderBy(*new.order).select("__pos", "__k").collect()])  # one row a column
        cell = self._cell(selector)
        df = self.df
        order = self.order
        if "__k" in order:
            df, order = df.withColumn("__was", F.col("__k")), ["__was" if c == "__k" else c for c in order]
        return self._like(df.where(cell.is_value).withColumn("__k", cell.v), order=order)

    def col_keys(self) -> list:
        return list(dict.fromkeys(c.key for c in self.columns))

    def row_index(self) -> DataFrame:
        """(key, pointer): each row's key and its place from 0, as with_row_index takes them."""
        return positions.dense(self.df, self.order).select(F.col("__k").alias("key"), F.col("__at").alias("pointer"))

    def row_keys(self) -> DataFrame:
        """The different row keys."""
        return self.df.select(F.col("__k").alias("key")).distinct()

    def num_rows(self) -> int:
        return self.df.count()

    def num_cols(self) -> int:
        return len(self.columns)

    def is_empty(self) -> bool:
        """No value anywhere."""
        if not self.columns:
            return True
        return self.df.where(fold(lambda a, b: a | b, (F.col(c.v).isNotNull() for c in self.columns))).isEmpty()

    def transpose(self, most_rows: int = MOST_TRANSPOSED, kind: str | None = None) -> Frame:
        """Rows as columns. Cells must have one type (numbers are widened, or all are read as kind).

        Rows become columns of a plan, so there may be most_rows at most; a longer frame raises.
        """
        n = self.df.limit(most_rows + 1).count()
        if n > most_rows:
            raise ValueError(f"a frame of over {most_rows} rows cannot be transposed")
        at = positions.dense(self.df, self.order)
        keys = [r["__k"] for r in at.orderBy("__at").select("__k").collect()]
        kinds = {self._kind(c).simpleString() for c in self.columns}
        kind = kind or (kinds.pop() if len(kinds) == 1 else "double" if all(casts.is_numeric(self._kind(c)) for c in self.columns) else "string")
        cells = [casts.cast(c.cell, self._kind(c), kind)[0] if kind in ("double", "string") and self._kind(c).simpleString() != kind else c.cell for c in self.columns]
        any_nm = any(c.nm is not None for c in cells)
        entry = F.array(*(F.struct(F.lit(j).cast("bigint").alias("j"), c.v.cast(kind).alias("v"), c.is_nm.alias("nm")) for j, c in enumerate(cells)))
        flat = at.select("__at", F.explode(entry).alias("e")).select("__at", "e.j", "e.v", "e.nm")
        picks = [F.max(F.when(F.col("__at") == i, F.col("v"))).alias(f"c{i}") for i in range(n)]
        picks += [F.coalesce(F.max(F.when(F.col("__at") == i, F.col("nm"))), F.lit(False)).alias(f"n{i}") for i in range(n) if any_nm]
        spark = self.df.sparkSession
        names = spark.createDataFrame([(j, c.key) for j, c in enumerate(self.columns)], f"__pos bigint, __k {_key_type(self.columns)}")
        # without rows, columns remain as rows without cells
        wide = names.join(flat.groupBy(F.col("j").alias("__pos")).agg(*picks), "__pos", "left") if picks else names
        return self._like(wide, [ColumnRef(k, f"c{i}", f"n{i}" if any_nm else None) for i, k in enumerate(keys)], ["__pos"])

    # access

    def columns_as_series(self) -> dict[int, tuple[object, Series]]:
        return {i: (c.key, self._series(c.cell)) for i, c in enumerate(self.columns)}

    def rows_as_series(self) -> dict[int, tuple[object, Series]]:
        return self.transpose().columns_as_series()

    def _series(self, cell: Cell) -> Series:
        names = dict.fromkeys(["__k", *self.order])
        return Series(self.df.select(*names, cell.v.alias("v"), *([cell.nm.alias("nm")] if cell.nm is not None else [])), self.order)

    def cell(self, row, col, kind: str = "any"):
        """One cell: NA if there is no such row or column, NM if it is not of that kind, the first of several."""
        return self.column(col, kind).get(row)

    def column(self, key, kind: str = "any") -> Series:
        return self._series(self._context().read(key, kind)[0])

    def row(self, key, kind: str = "any") -> Series:
        return self.retain_rows(key).transpose().column(key, kind)

    def get_row(self, key) -> Row | None:
        """The first row of a key as a record of cells, None if there is none."""
        rows = self.df.where(F.col("__k") == key).orderBy(*self.order).limit(1).collect()
        return Row(**{str(c.key): local_cell(rows[0][c.v], c.nm and rows[0][c.nm]) for c in self.columns}) if rows else None

    def get_col(self, key) -> dict | None:
        """A column as a record by row key, None if there is none."""
        if key not in self.col_keys():
            return None
        return dict(reversed(self.column(key).to_list()))

    def get_row_group(self, key) -> Frame:
        return self.retain_rows(key)

    def get_column_group(self, key) -> Frame:
        return self.retain_columns(key)

    def _turned(self, selector: Selector) -> Frame:
        """The transpose of the rows that a selector of rows reads: a few by key, so the frame may be of any length."""
        keys = selector.keys()
        return (self if keys is None else self.retain_rows(*keys)).transpose()

    def get(self, selector: Selector) -> Series:
        """The selector's cell of each row (or column); a column that is not there is all NA."""
        if selector.axis == "rows":
            return self._turned(selector).get(selector.to_cols())
        return self._series(self._cell(selector))

    # computed columns

    def map(self, selector: Selector, to, f: Callable[[Column], Column]) -> Frame:
        """A column to of f of the selected value: put last, in place of one of that key; rows then go in key order."""
        return self.map_with_index(selector, to, lambda _, v: f(v))

    def map_with_index(self, selector: Selector, to, f: Callable[[Column, Column], Column]) -> Frame:
        turned = self._by_rows(selector, lambda g, s: g.map_with_index(s, to, f))
        if turned is not None:
            return turned
        cell = self._cell(selector).map(lambda v: F.when(v.isNotNull(), f(F.col("__k"), v)))
        added = self._add(to, cell)
        kept = [c for c in self.columns if c.key != to]
        return added._pruned([*kept, added.columns[-1]]).sort_rows()

    def filter(self, selector: Selector, p: Callable[[Column], Column]) -> Frame:
        """Rows whose selected value satisfies p; a rows selector filters columns."""
        if selector.axis == "rows":
            kept = self._turned(selector).filter(selector.to_cols(), p)
            places = {r["__pos"] for r in kept.df.select("__pos").collect()}  # one row a column
            return self._pruned([c for i, c in enumerate(self.columns) if i in places])
        return self._like(self.df.where(p(self._cell(selector).v)))

    def sort_by(self, selector: Selector) -> Frame:
        """Rows by selected cell: NA, NM, then values; ties keep their order."""
        if selector.axis == "rows":
            by = self._turned(selector).sort_by(selector.to_cols())
            return self._pruned([self.columns[r["__pos"]] for r in by.df.orderBy(*by.order).select("__pos").collect()])  # one row a column
        kind, v = self._cell(selector).order_keys()
        n = sum(c.startswith("__by") for c in self.df.columns)
        names = [f"__by{n}", f"__by{n + 1}"]
        return self._like(self.df.withColumns(dict(zip(names, (kind, v), strict=True))), order=[*names, *self.order])

    def group(self, selector: Selector) -> Frame:
        """Rows under new keys, in key order; rows whose key misses go."""
        new = self.reindex(selector)
        return new.sort_columns() if selector.axis == "rows" else new.sort_rows()

    # reducing

    def reduce(self, selector: Selector, to, r: R.Reducer) -> Frame:
        """The reduced selected cells, the same in every row of column to."""
        turned = self._by_rows(selector, lambda f, s: f.reduce(s, to, r))
        if turned is not None:
            return turned
        got = r.agg(self._cell(selector), positions.order_struct(self.order))
        one = self.df.agg(got.v.alias("__v"), *([got.nm.alias("__nm")] if got.nm is not None else []))
        kept = self._pruned([c for c in self.columns if c.key != to])
        wide = kept._like(kept.df.join(F.broadcast(one)))  # one row
        return wide._add(to, Cell(F.col("__v"), F.col("__nm") if got.nm is not None else None))._without("__v", "__nm").sort_rows()

    def reduce_by_key(self, selector: Selector, to, r: R.Reducer) -> Frame:
        """The selected cells reduced for each row key, in every row of the key, in column to."""
        turned = self._by_rows(selector, lambda f, s: f.reduce_by_key(s, to, r))
        if turned is not None:
            return turned
        by = self.get(selector).reduce_by_key(r)
        kept = self._pruned([c for c in self.columns if c.key != to])
        # pre-aggregated, then joined: a hot key's rows are never gathered in one window
        small = by.df.select(F.col("__k"), F.col("v").alias("__v"), *([F.col("nm").alias("__nm")] if by.has_nm else []))
        wide = kept._like(kept.df.join(small, "__k"))
        return wide._add(to, Cell(F.col("__v"), F.col("__nm") if by.has_nm else None))._without("__v", "__nm").sort_rows()

    def _without(self, *names: str) -> Frame:
        return self._like(self.df.drop(*names))

    def _read_all(self, kind: str) -> list[tuple[object, Cell]]:
        return [(c.key, casts.cast(c.cell, self._kind(c), kind)[0]) for c in self.columns]

    def reduce_frame(self, r: R.Reducer, kind: str = "double") -> Series:
        """Each column, read as kind, reduced: a series by column key, in one pass over the rows."""
        order = positions.order_struct(self.order)
        got = [(k, r.agg(c, order)) for k, c in self._read_all(kind)]
        aggs = [x for i, (_, g) in enumerate(got) for x in (g.v.alias(f"v{i}"), _flag(g.nm).alias(f"n{i}"))]
        return _spread(self.df.agg(*aggs), [(k, f"v{i}", f"n{i}") for i, (k, _) in enumerate(got)])

    def reduce_frame_by_key(self, r: R.Reducer, kind: str = "double") -> Frame:
        """Each column, read as kind, reduced for each row key."""
        order = positions.order_struct(self.order)
        got = [(k, r.agg(c, order)) for k, c in self._read_all(kind)]
        aggs = [x for i, (_, g) in enumerate(got) for x in (g.v.alias(f"c{i}"), *([g.nm.alias(f"n{i}")] if g.nm is not None else []))]
        return self._like(self.df.groupBy("__k").agg(*aggs), [ColumnRef(k, f"c{i}", f"n{i}" if g.nm is not None else None) for i, (k, g) in enumerate(got)], ["__k"])

    def reduce_frame_with_col(self, key, r: R.Reducer, fixed_kind: str = "double", kind: str = "double", unique_keys: bool = False) -> Series:
        """Each other column paired with column key, value by value, and the pairs (_1, _2) reduced.

        Pairs are those of a join by row key; unique_keys says that no key repeats, which saves the join.
        """
        fixed = self._context().read(key, fixed_kind)[0]
        rest = [(c.key, casts.cast(c.cell, self._kind(c), kind)[0], c) for c in self.columns if c.key != key]
        df, order = self.df.withColumns({"__f": fixed.v, "__fn": fixed.is_nm}), self.order
        if not unique_keys:
            other = df.select("__k", "__f", "__fn", *(F.col(c).alias(f"__x{i}") for i, c in enumerate(order) if c != "__k"))
            df = df.drop("__f", "__fn").join(other, "__k")
            order = [*(f"__x{i}" for i, c in enumerate(order) if c != "__k"), *order]
        pair = Cell(F.col("__f"), F.col("__fn"))
        got = [(k, r.agg(pair.zip_map(c, lambda a, b: F.struct(a.alias("_1"), b.alias("_2"))), positions.order_struct(order))) for k, c, _ in rest]
        aggs = [x for i, (_, g) in enumerate(got) for x in (g.v.alias(f"v{i}"), _flag(g.nm).alias(f"n{i}"))]
        return _spread(df.agg(*aggs), [(k, f"v{i}", f"n{i}") for i, (k, _) in enumerate(got)])

    def map_row_groups(self, f: Callable, schema: str) -> Frame:
        from lattica.operators.groups import map_row_groups

        return map_row_groups(self, f, schema)

    def cogroup(self, that: Frame, f: Callable, schema: str) -> Frame:
        from lattica.operators.groups import cogroup

        return cogroup(self, that, f, schema)

    def summary(self) -> DataFrame:
        from lattica.operators.stats import summary

        return summary(self)

    # two frames

    def _match(self, that: Frame | Series, how: str, by: Callable, key=None) -> Frame:
        that = that.to_frame(key) if isinstance(that, Series) else that
        names, left, right = iter(range(len(self.columns) + len(that.columns))), [], []
        sides = []
        for f, refs in ((self, left), (that, right)):
            renames = {}
            seen: dict[str, ColumnRef] = {}
            for c in f.columns:
                if c.v in seen:  # a column shown twice
                    refs.append(replace(seen[c.v], key=c.key))
                    continue
                i = next(names)
                new = ColumnRef(c.key, f"c{i}", f"n{i}" if c.nm else None)
                renames |= {c.v: f"t{new.v}"} | ({c.nm: f"t{new.nm}"} if c.nm else {})
                seen[c.v] = new
                refs.append(new)
            keep = dict.fromkeys(["__k", *f.order, *renames])
            df = f.df.select(*keep).withColumnsRenamed(renames)
            sides.append(df)
        df, order = by(*sides, self.order, that.order, how)
        df = df.withColumnsRenamed({c: c[1:] for c in df.columns if c[:2] in ("tc", "tn")})
        # a row without a partner is NA there, not unknown whether NM
        flags = {c.nm: F.coalesce(F.col(c.nm), F.lit(False)) for c in [*left, *right] if c.nm}
        return self._like(df.withColumns(flags) if flags else df, [*left, *right], order)

    def join(self, that: Frame | Series, how: str = "inner", key=None) -> Frame:
        """Every left with every right row of a key: inner, left, right or outer. key names a series' column."""
        return self._match(that, how, key_join, key)

    def merge(self, that: Frame | Series, how: str = "outer", key=None) -> Frame:
        """The i-th left with the i-th right row of a key: inner or outer."""
        return self._match(that, how, key_merge, key)

    def append_rows(self, that: Frame) -> Frame:
        """This frame's rows, then that one's, by column key, columns sorted; absent columns are NA.

        Columns of two types become number-or-text pairs, read by casting.
        """
        keys = sorted({c.key for c in [*self.columns, *that.columns]})
        first = [{c.key: c for c in reversed(f.columns)} for f in (self, that)]
        parts = []
        for i, f in enumerate((self, that)):
            df = positions.single_position(f.df.withColumn("__key", F.col("__k")), ["__key" if c == "__k" else c for c in f.order])
            df = df.withColumn("__src", F.lit(i)) if "__key" not in df.columns else df.drop("__key").withColumn("__src", F.lit(i))
            out = ["__k", "__src", "__pos"]
            for j, k in enumerate(keys):
                kinds = [g._kind(by[k]) for g, by in zip((self, that), first, strict=True) if k in by]
                flagged = any(by[k].nm for by in first if k in by)
                cell = first[i][k].cell if k in first[i] else Cell(F.lit(None).cast(kinds[0]))
                clash = len(kinds) == 2 and kinds[0] != kinds[1]
                if clash and all(map(casts.is_numeric, kinds)):
                    cell = Cell(cell.v.cast("double"), cell.nm)
                elif clash:
                    own = f._kind(first[i][k])
                    number = cell.v.cast("double") if casts.is_numeric(own) else F.lit(None).cast("double")
                    text = F.lit(None).cast("string") if casts.is_numeric(own) else cell.v.cast("string")
                    cell = Cell(F.when(cell.is_value, F.struct(number.alias("num"), text.alias("str"))), cell.nm)
                out += [cell.v.alias(f"c{j}"), *([cell.is_nm.alias(f"n{j}")] if flagged else [])]
            parts.append(df.select(*out))
        refs = [ColumnRef(k, f"c{j}", f"n{j}" if any(by[k].nm for by in first if k in by) else None) for j, k in enumerate(keys)]
        return self._like(parts[0].unionByName(parts[1]), refs, ["__src", "__pos"])

    def append_cols(self, that: Frame) -> Frame:
        """Columns side by side under sorted row keys, the i-th rows of a key together."""
        return self.merge(that, "outer")

    def cached(self) -> Frame:
        return self._like(self.df.cache())


def _key_type(columns: Sequence[ColumnRef]) -> str:
    keys = [c.key for c in columns]
    if all(isinstance(k, int) and not isinstance(k, bool) for k in keys):
        return "bigint"
    if all(isinstance(k, float) for k in keys):
        return "double"
    return "string"


def _spread(one: DataFrame, parts: Sequence[tuple[object, str, str]]) -> Series:
    """A one-row aggregate as a series by column key."""
    refs = [ColumnRef(k, v) for k, v, _ in parts]
    kind = _key_type(refs)
    entries = F.array(*(F.struct(F.lit(k if kind != "string" else str(k)).cast(kind).alias("__k"), F.lit(i).cast("bigint").alias("__pos"), F.col(v).alias("v"), F.col(n).alias("nm")) for i, (k, v, n) in enumerate(parts)))
    return Series(one.select(F.explode(entries).alias("e")).select("e.*"))
