"""Series: cells by key, in an order of their own. Keys may repeat.

A series is a plan. Its DataFrame holds the key __k, one or more order columns, the value v and, if cells can be NM, the
flag nm. Sorting happens when rows are collected; operators that define a new order only say by which columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lattica.functions import reducers as R
from lattica.functions.cells import Cell, _flag
from lattica.operators import positions
from lattica.operators.matching import key_join, key_merge


class _Missing:
    def __init__(self, name: str) -> None:
        self.name = name

    def __repr__(self) -> str:
        return self.name

    def __reduce__(self):
        return self.name


#: See _dealt_by_key.
LARGE, PART_ROWS = 16 << 20, 500_000

NA, NM = _Missing("NA"), _Missing("NM")


def local_cell(v, nm) -> object:
    return v if v is not None else NM if nm else NA


def _by_parts(df: DataFrame, names: Sequence[str], has_nm: bool, f: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """f of the tuples of names and the cell, a part at a time; types are those that Arrow gives."""
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for b in batches:
                *rest, v, nm = (c.to_pylist() for c in b.columns)
                yield from zip(*rest, map(local_cell, v, nm), strict=True)

        made = iter(f(tuples()))
        while some := list(islice(made, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], schema=kinds)

    return df.select(*names, "v", F.col("nm") if has_nm else F.lit(False).alias("nm")).mapInArrow(run, schema)


def _dealt_by_key(df: DataFrame) -> DataFrame:
    """df in parts of about PART_ROWS rows by key if it is over LARGE bytes and most keys stand once: sums made before a shuffle
    then merge little, and a task would hold as many as it reads."""
    if df.isStreaming or int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= LARGE:
        return df
    n, keys = df.agg(F.count("*"), F.approx_count_distinct("__k")).first()
    return df.repartition(-(-n // PART_ROWS), "__k") if 2 * keys > n else df


class Series:
    """See the module; build one with of, from_df or from a frame."""

    def __init__(self, df: DataFrame, order: Sequence[str] = ("__pos",)) -> None:
        self.df, self.order = df, list(order)

    # constructors

    @staticmethod
    def of(spark: SparkSession, pairs: Sequence[tuple], key: str = "string", value: str = "int") -> Series:
        """From (key, cell) pairs; a cell is a value, NA (or None) or NM."""
        rows = [(k, i, None if isinstance(c, _Missing) else c, c is NM) for i, (k, c) in enumerate(pairs)]
        df = spark.createDataFrame(rows, f"__k {key}, __pos bigint, v {value}, nm boolean")
        return Series(df if any(c is NM for _, c in pairs) else df.drop("nm"))

    @staticmethod
    def of_values(spark: SparkSession, values: Sequence, value: str = "int") -> Series:
        return Series.of(spark, list(enumerate(values)), "bigint", value)

    @staticmethod
    def from_map(spark: SparkSession, cells: dict, key: str = "string", value: str = "int") -> Series:
        return Series.of(spark, list(cells.items()), key, value)

    @staticmethod
    def empty(spark: SparkSession, key: str = "string", value: str = "int") -> Series:
        return Series.of(spark, [], key, value)

    @staticmethod
    def from_df(df: DataFrame, key: str | Column, value: str | Column, pos: str | Column | None = None, nm: Column | None = None) -> Series:
        """Columns of a DataFrame as a series; pos orders the rows (default: as the scan gives them)."""
        col = lambda x: F.col(x) if isinstance(x, str) else x
        at = F.monotonically_increasing_id() if pos is None else col(pos)
        picked = [col(key).alias("__k"), at.cast("bigint").alias("__pos"), (col(value) if nm is None else F.when(~nm, col(value))).alias("v")]
        return Series(df.select(*picked, *([nm.alias("nm")] if nm is not None else [])))

    # parts

    @property
    def has_nm(self) -> bool:
        return "nm" in self.df.columns

    @property
    def cell(self) -> Cell:
        return Cell(F.col("v"), F.col("nm") if self.has_nm else None)

    @property
    def kind(self) -> T.DataType:
        return self.df.schema["v"].dataType

    def _with(self, cell: Cell, key: Column | None = None) -> Series:
        parts = [(F.col("__k") if key is None else key).alias("__k"), *(c for c in self.order if c != "__k"), cell.v.alias("v")]
        order = self.order
        if key is not None and "__k" in order:
            parts.insert(1, F.col("__k").alias("__was"))
            order = ["__was" if c == "__k" else c for c in order]
        return Series(self.df.select(*parts, *([cell.nm.alias("nm")] if cell.nm is not None else [])), order)

    def result(self, names: tuple[str, str, str] = ("key", "v", "nm")) -> DataFrame:
        """The cells as a DataFrame: key, value and, if cells can be NM, flag."""
        return self.df.select(F.col("__k").alias(names[0]), F.col("v").alias(names[1]), *([F.col("nm").alias(names[2])] if self.has_nm else []))

    # traversal

    def to_list(self) -> list[tuple]:
        """(key, cell) pairs in order, on the driver."""
        return list(self.iterator())

    def iterator(self) -> Iterator[tuple]:
        for r in self.df.orderBy(*self.order).select("__k", "v", *(["nm"] if self.has_nm else [])).toLocalIterator():
            yield r["__k"], local_cell(r["v"], self.has_nm and r["nm"])

    def dense_iterator(self) -> Iterator[tuple]:
        return ((r["__k"], r["v"]) for r in self.df.where("v is not null").orderBy(*self.order).select("__k", "v").toLocalIterator())

    def map_parts(self, f: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
        """The tuples that f gives for the (key, cell) pairs of each part, on the executors, in no order."""
        return _by_parts(self.df, ["__k"], self.has_nm, f, schema)

    def map_places(self, f: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
        """Likewise of (place, key, cell) triples: the places of all cells from 0, in order within each part."""
        return _by_parts(positions.dense(self.df, self.order), ["__at", "__k"], self.has_nm, f, schema)

    def keys(self) -> list:
        return [r["__k"] for r in self.df.orderBy(*self.order).select("__k").toLocalIterator()]

    def cells(self) -> list:
        return [c for _, c in self.iterator()]

    def values(self) -> list:
        return [v for _, v in self.dense_iterator()]

    def foreach_partition(self, f: Callable[[Iterator[tuple]], None]) -> None:
        """f of the (key, cell) pairs of each part, on the executors, in no order: for effects on data of any size."""
        has_nm = self.has_nm
        self.df.select("__k", "v", *(["nm"] if has_nm else [])).foreachPartition(lambda rows: f((r["__k"], local_cell(r["v"], has_nm and r["nm"])) for r in rows))

    def foreach(self, f: Callable) -> None:
        """f(key, cell) in order, on the driver, which fetches one part at a time."""
        for k, c in self.iterator():
            f(k, c)

    def foreach_dense(self, f: Callable) -> None:
        for k, v in self.dense_iterator():
            f(k, v)

    def foreach_keys(self, f: Callable) -> None:
        for k, _ in self.iterator():
            f(k)

    def foreach_cells(self, f: Callable) -> None:
        for _, c in self.iterator():
            f(c)

    def foreach_values(self, f: Callable) -> None:
        for _, v in self.dense_iterator():
            f(v)

    def equals(self, that: Series) -> bool:
        """Same keys and cells in the same order."""
        a, b = (positions.dense(s.df, s.order).select("__at", "__k", "v", (F.col("nm") if s.has_nm else F.lit(False)).alias("nm")) for s in (self, that))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def __str__(self) -> str:
        return "Series(" + ", ".join(f"{k} -> {c}" for k, c in self.iterator()) + ")"

    # size

    def size(self) -> int:
        return self.df.count()

    def has_values(self) -> bool:
        return not self.is_empty()

    def is_empty(self) -> bool:
        """No value anywhere; missing cells do not count."""
        return self.df.where("v is not null").isEmpty()

    # access

    def _nth(self, i: int):
        if i < 0:
            raise IndexError(i)
        rows = self.df.orderBy(*self.order).offset(i).limit(1).collect()
        if not rows:
            raise IndexError(i)
        return rows[0]

    def key_at(self, i: int):
        return self._nth(i)["__k"]

    def index_at(self, i: int) -> tuple:
        """The i-th key and its position, which orders the rows."""
        r = self._nth(i)
        return r["__k"], tuple(r[c] for c in self.order if c != "__k")

    def is_value_at(self, i: int) -> bool:
        return not isinstance(self.cell_at(i), _Missing)

    def cell_at(self, i: int):
        r = self._nth(i)
        return local_cell(r["v"], self.has_nm and r["nm"])

    def value_at(self, i: int):
        c = self.cell_at(i)
        if isinstance(c, _Missing):
            raise ValueError(f"no value at {i}: {c}")
        return c

    def get(self, key):
        """The first cell of a key; NA if there is none."""
        found = self.get_cells(key, 1)
        return found[0] if found else NA

    __call__ = get

    def get_cells(self, key, most: int | None = None) -> list:
        hit = self.df.where(F.col("__k") == key).orderBy(*self.order)
        return [local_cell(r["v"], self.has_nm and r["nm"]) for r in (hit.limit(most) if most else hit).collect()]

    def get_values(self, key) -> list:
        return [c for c in self.get_cells(key) if not isinstance(c, _Missing)]

    def is_ordered(self) -> bool:
        """Whether traversal is in key order."""
        at = positions.dense(self.df, self.order).select("__at", "__k")
        after = at.select((F.col("__at") - 1).alias("__at"), F.col("__k").alias("__next"))
        return at.join(after, "__at").where("__next < __k").isEmpty()

    # transforms

    def map_keys(self, f: Callable[[Column], Column]) -> Series:
        return self._with(self.cell, f(F.col("__k")))

    def map_values(self, f: Callable[[Column], Column]) -> Series:
        return self._with(self.cell.map(f))

    def map_values_with_keys(self, f: Callable[[Column, Column], Column]) -> Series:
        return self._with(self.cell.map(lambda v: F.when(v.isNotNull(), f(F.col("__k"), v))))

    def flat_map_cell(self, f: Callable[[Column], Cell]) -> Series:
        return self._with(self.cell.flat_map(f))

    def cell_map(self, f: Callable[[Cell], Cell]) -> Series:
        return self._with(f(self.cell))

    def cell_map_with_keys(self, f: Callable[[Column, Cell], Cell]) -> Series:
        return self._with(f(F.col("__k"), self.cell))

    def filter_entries(self, p: Callable[[Column, Cell], Column]) -> Series:
        return Series(self.df.where(p(F.col("__k"), self.cell)), self.order)

    def filter_by_keys(self, p: Callable[[Column], Column]) -> Series:
        return Series(self.df.where(p(F.col("__k"))), self.order)

    def filter_by_cells(self, p: Callable[[Cell], Column]) -> Series:
        return Series(self.df.where(p(self.cell)), self.order)

    def filter_by_values(self, p: Callable[[Column], Column]) -> Series:
        """Values that satisfy p; missing cells go."""
        return Series(self.df.where(F.col("v").isNotNull() & p(F.col("v"))).drop("nm"), self.order)

    def sorted(self) -> Series:
        """In key order; equal keys keep their order."""
        return Series(self.df, ["__k", *(c for c in self.order if c != "__k")])

    def reversed(self) -> Series:
        df = positions.single_position(self.df, self.order)
        return Series(df.withColumn("__pos", -F.col("__pos")))

    def compacted(self) -> Series:
        """Positions renumbered from 0 without gaps."""
        df = positions.dense(self.df, self.order)
        return Series(df.drop(*(c for c in self.order if c != "__k" and c in df.columns), "__pos").withColumnRenamed("__at", "__pos"))

    def unzip(self) -> tuple[Series, Series]:
        """The two fields of struct values."""
        a, b = self.kind.fieldNames()[:2]
        return tuple(self._with(self.cell.map(lambda v, n=n: v[n])) for n in (a, b))

    def take(self, n: int) -> Series:
        """The first n cells."""
        return Series(self.df.orderBy(*self.order).limit(n), self.order)

    def cached(self) -> Series:
        return Series(self.df.cache(), self.order)

    def mask(self, keys: Sequence) -> Series:
        """NA at these keys."""
        hit = F.col("__k").isin(list(keys))
        return self._with(Cell(F.when(~hit, F.col("v")), F.col("nm") & ~hit if self.has_nm else None))

    def set_na(self, *places: int) -> Series:
        """NA at these places (from 0) in order."""
        at = positions.dense(self.df, self.order)
        hit = F.col("__at").isin(list(places))
        order = self.order if all(c in at.columns for c in self.order) else ["__pos"]
        return Series(at, order)._with(Cell(F.when(~hit, F.col("v")), F.col("nm") & ~hit if self.has_nm else None))

    def to_frame(self, key="v"):
        from lattica.plans.frame import ColumnRef, Frame

        df = self.df.withColumnsRenamed({"v": "c0", "nm": "n0"})
        return Frame(df, [ColumnRef(key, "c0", "n0" if self.has_nm else None)], self.order)

    # pairs of series

    def _two(self, that: Series, how: str, match: Callable, f: Callable[[Cell, Cell], Cell]) -> Series:
        a, b = self.df.withColumnsRenamed({"v": "va", "nm": "na"}), that.df.withColumnsRenamed({"v": "vb", "nm": "nb"})
        df, order = match(a, b, self.order, that.order, how)
        # a row without a partner is NA there
        side = lambda v, nm, there: Cell(F.col(v), F.coalesce(F.col(nm), F.lit(False)) if there else None)
        cell = f(side("va", "na", self.has_nm), side("vb", "nb", that.has_nm))
        return Series(df, order)._with(cell)

    def zip_map(self, that: Series, f: Callable[[Column, Column], Column]) -> Series:
        return self._two(that, "inner", key_join, lambda a, b: a.zip_map(b, f))

    def zip(self, that: Series) -> Series:
        return self.zip_map(that, lambda a, b: F.struct(a.alias("_1"), b.alias("_2")))

    def combine(self, that: Series, left: Callable, right: Callable, both: Callable) -> Series:
        return self._two(that, "outer", key_merge, lambda a, b: a.combine(b, both, left, right))

    def merge(self, that: Series) -> Series:
        """Numbers add, strings concatenate; a lone value stays."""
        text = isinstance(self.kind, T.StringType)
        return self._two(that, "outer", key_merge, lambda a, b: a.combine(b, (lambda x, y: F.concat(x, y)) if text else (lambda x, y: x + y)))

    def or_else(self, that: Series) -> Series:
        return self._two(that, "outer", key_merge, lambda a, b: a.or_else_column(b))

    def concat(self, that: Series) -> Series:
        """This, then that."""
        a, b = (positions.single_position(s.df, s.order).withColumn("__src", F.lit(i)) for i, s in enumerate((self, that)))
        if self.has_nm != that.has_nm:
            a, b = (d if "nm" in d.columns else d.withColumn("nm", F.lit(False)) for d in (a, b))
        return Series(a.unionByName(b), ["__src", "__pos"])

    # reducing

    def reduce(self, r: R.Reducer):
        """One cell, on the driver."""
        got = r.agg(self.cell, positions.order_struct(self.order))
        row = self.df.agg(got.v.alias("v"), _flag(got.nm).alias("nm")).first()
        return local_cell(row["v"], row["nm"])

    def reduce_by_key(self, r: R.Reducer) -> Series:
        """A cell for each key, in key order."""
        df, cell = self.df, self.cell
        if r.window:
            # rows beyond the n-th that is not NA cannot matter: only so many are gathered for a key
            n, last = r.window
            order = [F.col(c).desc() if last else F.col(c).asc() for c in self.order]
            over = Window.partitionBy("__k").orderBy(cell.is_na, *order)
            df = df.withColumn("__rank", F.row_number().over(over)).where(F.col("__rank") <= n)
        else:
            df = _dealt_by_key(df)
        got = r.agg(cell, positions.order_struct(self.order))
        out = df.groupBy("__k").agg(got.v.alias("v"), *([got.nm.alias("nm")] if got.nm is not None else []))
        return Series(out, ["__k"])

    # along the order

    def roll_forward(self, by: Sequence[str] = ()) -> Series:
        """The last cell that is not NA, so a value or an NM, in place of NA. by=("__k",) keeps to each key."""
        return self._rolled(by, None)

    def roll_forward_up_to(self, delta, by: Sequence[str] = (), distance: Callable[[Column, Column], Column] = lambda a, b: F.abs(a - b)) -> Series:
        """Likewise, if the key it comes from is at most delta away."""
        return self._rolled(by, lambda k, old: distance(k, old) <= delta)

    def _rolled(self, by: Sequence[str], near: Callable | None) -> Series:
        cell = self.cell
        found = F.when(~cell.is_na, F.struct(F.col("v"), cell.is_nm.alias("nm"), F.col("__k").alias("k")))
        df = positions.carry_forward(self.df, found, self.order, by)
        order = self.order if all(c in df.columns for c in self.order) else ["__pos"]
        last = F.col("__last")
        if near is not None:
            last = F.when(near(F.col("__k"), last["k"]), last)
        out = Cell(F.when(cell.is_na, last["v"]).otherwise(F.col("v")), F.coalesce(F.when(cell.is_na, last["nm"]).otherwise(F.col("nm")), F.lit(False)) if self.has_nm else None)
        return Series(df, order)._with(out)

    def shift(self, n: int, by: Sequence[str] = ()) -> Series:
        """The cell n rows before; NA where there is none."""
        if by and not positions.splits(self.df):
            over = Window.partitionBy(*by).orderBy(*self.order)
            return self._with(Cell(F.lag("v", n).over(over), F.coalesce(F.lag("nm", n).over(over), F.lit(False)) if self.has_nm else None))
        at = positions.occurrence(self.df, by, self.order, "__at") if by else positions.dense(self.df, self.order)
        from_ = at.select(*by, (F.col("__at") + n).alias("__at"), F.col("v").alias("__v"), *([F.col("nm").alias("__nm")] if self.has_nm else []))
        df = at.join(from_, [*by, "__at"], "left")
        order = self.order if all(c in df.columns for c in self.order) else ["__pos"]
        return Series(df, order)._with(Cell(F.col("__v"), F.coalesce("__nm", F.lit(False)) if self.has_nm else None))

    def _found(self, p: Callable[[Column, Cell], Column], ascending: bool):
        order = [F.col(c).asc() if ascending else F.col(c).desc() for c in self.order]
        rows = self.df.where(p(F.col("__k"), self.cell)).orderBy(*order).limit(1).collect()
        return (rows[0]["__k"], local_cell(rows[0]["v"], self.has_nm and rows[0]["nm"])) if rows else None

    def find_asc(self, p: Callable[[Column, Cell], Column]):
        """The first (key, cell) that satisfies p, None if none does."""
        return self._found(p, True)

    def find_desc(self, p: Callable[[Column, Cell], Column]):
        return self._found(p, False)

    def find_first_value(self):
        return self.find_asc(lambda _, c: c.is_value)

    def find_last_value(self):
        return self.find_desc(lambda _, c: c.is_value)

    def closest_key_to(self, key, tolerance, distance: Callable[[Column, Column], Column] = lambda a, b: F.abs(a - b)):
        """The key itself if it has a value, else the first key in order within tolerance that has one (not the nearest)."""
        k = F.lit(key)
        exact = self.find_asc(lambda x, c: (x == k) & c.is_value)
        return exact or self.find_asc(lambda x, c: (distance(x, k) <= tolerance) & c.is_value)

    # distributions

    def histogram(self, step: float, low: float | None = None, high: float | None = None) -> DataFrame:
        """(bucket_low, bucket_high, n) of values in [low, high), the last bucket closed; others are ignored."""
        from lattica.operators.stats import histogram

        return histogram(self.df.select("v"), "v", step, low, high)

    def normalized_histogram(self, step: float, low: float | None = None, high: float | None = None) -> DataFrame:
        """Counts over the size of the series, missing cells included."""
        n = self.size()
        h = self.histogram(step, low, high)
        return h.select("bucket_low", "bucket_high", (F.col("n") / F.lit(max(1, n))).alias("share"))

    def summary(self) -> DataFrame:
        from lattica.operators.stats import summary

        return summary(self.to_frame("v"))


def _shorthands() -> None:
    plain = {
        "count": R.Count, "first": R.First, "last": R.Last, "first_n": R.FirstN, "last_n": R.LastN, "max": R.Max, "min": R.Min, "sum": R.Sum,
        "sum_non_empty": R.SumNonEmpty, "product": R.Product, "product_non_empty": R.ProductNonEmpty, "mean": R.Mean, "median": R.Median,
        "unique": R.Unique, "exists": R.Exists, "forall": R.ForAll,
    }
    for name, make in plain.items():

        def whole(self, *args, _make=make):
            return self.reduce(_make(*args))

        def by_key(self, *args, _make=make):
            return self.reduce_by_key(_make(*args))

        whole.__doc__ = f"reduce({make.__name__}(...))"
        by_key.__doc__ = f"reduce_by_key({make.__name__}(...))"
        setattr(Series, name, whole)
        setattr(Series, f"{name}_by_key", by_key)


_shorthands()
