"""Series operators on small series with all kinds of cells."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica import NA, NM, Series
from lattica import reducers as R


def strings(spark, *pairs, value="string", key="string"):
    return Series.of(spark, list(pairs), key, value)


def test_or_else_takes_the_first_value_and_nm_beats_na(spark):
    one = strings(spark, ("a", "a1"), ("b", NA), ("c", NM), ("d", NA), ("e", NM))
    two = strings(spark, ("a", NM), ("b", "b2"), ("c", NA), ("d", NA), ("f", "f2"))
    assert one.or_else(two).to_list() == [("a", "a1"), ("b", "b2"), ("c", NM), ("d", NA), ("e", NM), ("f", "f2")]


def test_merge_lets_nm_beat_everything(spark):
    one = strings(spark, ("a", 1), ("b", NA), ("c", NM), ("d", 4), value="int")
    two = strings(spark, ("a", 10), ("b", 20), ("c", 30), ("e", NM), value="int")
    assert one.merge(two).to_list() == [("a", 11), ("b", 20), ("c", NM), ("d", 4), ("e", NM)]
    assert strings(spark, ("a", "x")).merge(strings(spark, ("a", "y"))).to_list() == [("a", "xy")]


def test_combine_is_positional_within_a_key(spark):
    one = strings(spark, ("a", 1), ("a", 2), ("b", 3), value="int")
    two = strings(spark, ("a", 10), ("c", 30), value="int")
    got = one.combine(two, lambda x: -x, lambda y: y + 1, lambda x, y: x + y)
    assert got.to_list() == [("a", 11), ("a", -2), ("b", -3), ("c", 31)]


def test_zip_map_is_a_cross_product_in_a_key_and_na_beats_nm(spark):
    one = strings(spark, ("a", 1), ("a", 2), ("b", NA), ("c", NM), ("d", NM), value="int")
    two = strings(spark, ("a", 3), ("a", 5), ("b", NM), ("c", 1), ("d", NA), ("x", 1), value="int")
    assert one.zip_map(two, lambda x, y: x + y).to_list() == [("a", 4), ("a", 6), ("a", 5), ("a", 7), ("b", NA), ("c", NM), ("d", NA)]
    a, b = one.zip(two).filter_by_values(lambda v: v["_1"] == 1).unzip()
    assert (a.values(), b.values()) == ([1, 1], [3, 5])


def test_concat_keeps_order_and_shift_leaves_na(spark):
    s = strings(spark, ("b", 1), ("a", NM), value="int").concat(strings(spark, ("a", 3), value="int"))
    assert s.to_list() == [("b", 1), ("a", NM), ("a", 3)]
    assert s.shift(1).cells() == [NA, 1, NM]
    assert s.shift(-1).cells() == [NM, 3, NA]
    assert s.shift(1, by=["__k"]).to_list() == [("b", NA), ("a", NA), ("a", NM)]


@pytest.mark.parametrize(
    ("cells", "rolled"),
    [
        (["a", NA, "b", NA, NA], ["a", "a", "b", "b", "b"]),
        ([NA, NA, "b", NA], [NA, NA, "b", "b"]),
        (["a", NM, NA, "c"], ["a", NM, NM, "c"]),
        ([NA], [NA]),
    ],
)
def test_roll_forward(spark, cells, rolled):
    assert Series.of_values(spark, cells, "string").roll_forward().cells() == rolled


def test_roll_forward_up_to_a_distance(spark):
    s = Series.of(spark, [(0, NA), (1, "a"), (2, NA), (3, NA), (4, NM), (5, "b")], "int", "string")
    assert s.roll_forward_up_to(1).cells() == [NA, "a", "a", NA, NM, "b"]
    assert s.roll_forward_up_to(2).cells() == [NA, "a", "a", "a", NM, "b"]


def test_finding_and_access(spark):
    s = Series.of(spark, [(1.0, NM), (2.0, 7), (3.0, NA), (4.0, 9), (4.0, 8)], "double", "int")
    assert s.find_first_value() == (2.0, 7)
    assert s.find_last_value() == (4.0, 8)
    assert s.find_asc(lambda k, c: c.is_nm) == (1.0, NM)
    assert s.find_desc(lambda k, c: k > 10) is None
    assert s.closest_key_to(3.0, 1.0) == (2.0, 7)
    assert s.closest_key_to(4.0, 0.0) == (4.0, 9)
    assert s.closest_key_to(100.0, 1.0) is None
    assert (s.key_at(2), s.cell_at(2), s.value_at(3)) == (3.0, NA, 9)
    with pytest.raises(ValueError, match="no value"):
        s.value_at(0)
    with pytest.raises(IndexError):
        s.key_at(9)
    assert (s.get(4.0), s(9.0), s.get_cells(4.0), s.get_values(1.0)) == (9, NA, [9, 8], [])


def test_order_and_size(spark):
    s = strings(spark, ("c", 1), ("a", 2), ("b", NA), ("a", 3), value="int")
    assert s.sorted().to_list() == [("a", 2), ("a", 3), ("b", NA), ("c", 1)]
    assert s.reversed().keys() == ["a", "b", "a", "c"]
    assert s.take(2).to_list() == [("c", 1), ("a", 2)]
    assert not s.is_ordered()
    assert s.sorted().is_ordered()
    assert (s.size(), s.has_values(), s.values()) == (4, True, [1, 2, 3])
    assert strings(spark, ("a", NA), ("b", NM)).is_empty()
    assert s.equals(s.sorted().sorted().reversed()) is False
    assert s.equals(s.cached())
    assert s.compacted().equals(s)
    assert Series.empty(spark).to_list() == []


def test_mapping_and_filters(spark):
    s = strings(spark, ("a", 1), ("b", NA), ("c", NM), ("d", 4), value="int")
    assert s.map_values(lambda v: v * 2).cells() == [2, NA, NM, 8]
    assert s.map_keys(F.upper).keys() == ["A", "B", "C", "D"]
    assert s.sorted().map_keys(lambda k: F.lit("x")).cells() == [1, NA, NM, 4]
    assert s.map_values_with_keys(lambda k, v: F.concat(k, v.cast("string"))).cells() == ["a1", NA, NM, "d4"]
    assert s.cell_map(lambda c: c.recover(na=0, nm=-1)).cells() == [1, 0, -1, 4]
    assert s.cell_map_with_keys(lambda k, c: c.filter(lambda v: k == "a")).cells() == [1, NA, NM, NA]
    assert s.filter_by_values(lambda v: v > 1).to_list() == [("d", 4)]
    assert s.filter_by_cells(lambda c: c.is_nm).keys() == ["c"]
    assert s.filter_by_keys(lambda k: k > "b").keys() == ["c", "d"]
    assert s.filter_entries(lambda k, c: (k == "b") | c.exists(lambda v: v == 4)).keys() == ["b", "d"]
    assert s.mask(["a", "c"]).cells() == [NA, NA, NA, 4]


SPARSE = [("a", NA), ("b", 2), ("b", NM), ("b", NA), ("b", 4), ("b", NM), ("c", 5), ("c", NA), ("c", 1), ("d", 0)]


@pytest.mark.parametrize(
    ("reducer", "expected"),
    [
        (R.Count(), [0, NM, 2, 1]),
        (R.First(), [NA, 2, 5, 0]),
        (R.FirstN(1), [NA, [2], [5], [0]]),
        (R.FirstN(2), [NA, NM, [5, 1], NA]),
        (R.Last(), [NA, NM, 1, 0]),
        (R.LastN(1), [NA, NM, [1], [0]]),
        (R.LastN(2), [NA, NM, [5, 1], NA]),
        (R.Max(), [NA, NM, 5, 0]),
        (R.Min(), [NA, NM, 1, 0]),
        (R.Mean(), [NA, NM, 3.0, 0.0]),
        (R.Median(), [NA, NM, 3.0, 0.0]),
        (R.Sum(), [0, NM, 6, 0]),
        (R.SumNonEmpty(), [NA, NM, 6, 0]),
        (R.Product(), [1.0, NM, 5.0, 0.0]),
        (R.ProductNonEmpty(), [NA, NM, 5.0, 0.0]),
        (R.Unique(), [[], NM, [1, 5], [0]]),
        (R.Exists(lambda v: v < 2), [False, False, True, True]),
        (R.ForAll(lambda v: F.lit(False)), [True, False, False, False]),
        (R.ForAll(lambda v: F.lit(True)), [True, False, True, True]),
        (R.ForAll(lambda v: v < 5), [True, False, False, True]),
        (R.MonoidReducer(0, lambda a, b: a + b), [0, NM, 6, 0]),
        (R.SemigroupReducer(lambda a, b: a - b), [NA, NM, 4, 0]),
    ],
)
def test_reducers_by_key(spark, reducer, expected):
    got = strings(spark, *SPARSE, value="int").reduce_by_key(reducer).to_list()
    assert got == list(zip("abcd", expected, strict=True))


def test_quantiles_outliers_and_python_reducers(spark):
    s = strings(spark, *zip("abcd", [1, 2, 4, 5], strict=True), value="int")
    assert [(r["p"], r["value"]) for r in s.reduce(R.Quantile())] == [(0, 1), (0.25, 1.75), (0.5, 3), (0.75, 4.25), (1, 5)]
    assert s.reduce(R.Quantile([])) == []
    assert strings(spark, ("a", NA), value="int").reduce(R.Quantile()) is NA
    assert strings(spark, ("a", NA), value="int").reduce(R.Outliers()) is NA
    far = s.concat(strings(spark, ("z", 100), value="int")).reduce(R.Outliers())
    assert (far["lower"], far["upper"]) == (None, 9.5)
    assert s.reduce(R.PythonReducer(lambda xs: sum(x * x for x in xs), "long")) == 46
    with pytest.raises(ValueError, match="positive"):
        R.FirstN(0)


def test_ordered_concatenation(spark):
    s = Series.of(spark, [(1, "a"), (1, "b"), (2, NA), (2, "c"), (3, "d"), (3, NA), (3, "e"), (3, NA), (3, "e"), (4, NA), (4, NA)], "int", "string")
    assert s.reduce_by_key(R.SemigroupReducer(lambda a, b: F.concat(a, b))).cells() == ["ab", "c", "dee", NA]


def test_shorthands(spark):
    s = strings(spark, *SPARSE, value="int")
    assert s.count() is NM
    assert (s.first(), s.last(), s.exists(lambda v: v == 4), s.forall(lambda v: v < 9)) == (2, 0, True, False)
    assert s.first_n(1) == [2]
    assert s.sum_by_key().cells() == [0, NM, 6, 0]
    assert s.last_n_by_key(1).cells() == [NA, NM, [1], [0]]
    whole = s.filter_by_keys(lambda k: k > "b")
    assert (whole.count(), whole.sum(), whole.mean(), whole.median(), whole.max(), whole.min(), whole.unique()) == (3, 6, 2.0, 1.0, 5, 0, [0, 1, 5])


@pytest.mark.parametrize(("bounds", "counts"), [((0, 4, 2), [1, 3]), ((2, 6, 2), [2, 2]), ((3, 6, 2), [2, 1]), ((0, 5, 2), [1, 2, 2]), ((0, 1, 2), [1]), ((3, 3, 2), [])])
def test_histogram(spark, bounds, counts):
    low, high, step = bounds
    rows = Series.of_values(spark, [1, 2, 3, 4, 5]).histogram(step, low, high).orderBy("bucket_low").collect()
    assert [r["n"] for r in rows] == counts


def test_histogram_of_nothing_and_shares(spark):
    none = Series.empty(spark)
    assert none.histogram(2).collect() == []
    assert [r["n"] for r in none.histogram(2, 0, 10).collect()] == [0] * 5
    shares = Series.of_values(spark, [1, NA, NM, 3]).normalized_histogram(2, 0, 4).orderBy("bucket_low").collect()
    assert [r["share"] for r in shares] == [0.25, 0.25]


@pytest.fixture
def split(spark, monkeypatch):
    """Every key in ranges of seven rows."""
    from lattica.operators import positions

    monkeypatch.setattr(positions, "ROWS", 7)
    monkeypatch.setattr(positions.ranged, "__defaults__", (7,))
    spark.conf.set(positions.RANGES, "split")
    yield positions
    spark.conf.unset(positions.RANGES)


def test_hot_keys_in_ranges(spark, split):
    """Numbering, carrying and shifting with one key that holds most rows equal those of whole windows."""
    rng = random.Random(2)
    cells = [(rng.choice("aaaaaaaab"), rng.choice([NA, NA, NA, NM, i])) for i in range(150)]
    one, two = Series.of(spark, cells), Series.of(spark, cells[::3])
    found = [one.or_else(two).to_list(), one.roll_forward(by=["__k"]).to_list(), one.shift(4, by=["__k"]).to_list(), one.sorted().roll_forward(by=["__k"]).to_list(), one.roll_forward().to_list()]
    spark.conf.set(split.RANGES, "whole")
    assert found == [one.or_else(two).to_list(), one.roll_forward(by=["__k"]).to_list(), one.shift(4, by=["__k"]).to_list(), one.sorted().roll_forward(by=["__k"]).to_list(), one.roll_forward().to_list()]


def test_ranges_hold_about_equal_rows(spark):
    """Whatever gaps and outliers positions have, and in their order."""
    from lattica.operators import positions

    at = F.when(F.col("id") == 0, -(10**15)).when(F.col("id") > 9000, F.col("id") * 10**9).otherwise(F.col("id"))
    df = positions.ranged(spark.range(10_000).select(at.alias("p")), "p", 100)
    sizes = [r["n"] for r in df.groupBy("__range").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 10 * 100
    assert len(sizes) >= 50
    assert df.withColumn("next", F.lead("__range").over(Window.orderBy("p"))).where("next < __range").isEmpty()


def test_whole_products_are_exact(spark):
    from decimal import Decimal

    def product(*cells):
        return Series.of(spark, [(i, c) for i, c in enumerate(cells)], "int", "bigint").reduce(R.WholeProduct())

    assert product(*range(1, 31)) == Decimal(265252859812191058636308480000000)
    assert product(-3, 1, -1, NA, 7) == 21
    assert product(-1, -1, -1) == -1
    assert product(5, 0, -2) == 0
    assert product() == product(NA) == 1
    assert product(2, NM) is NM
    assert product(*[10] * 39) is NA


def test_places_do_not_depend_on_how_a_sort_is_cut(spark, monkeypatch):
    """Places by several columns, some missing, when the plan is run once for counts and again for rows."""
    from lattica.operators import positions

    monkeypatch.setattr(positions.ranged, "__defaults__", (2000,))
    n = 40_000
    at = F.pmod(F.col("id") * 7919, F.lit(n))
    df = spark.range(0, n, 1, 5).select(at.alias("v"), F.when(at >= 9000, F.floor(at / 1000).cast("string")).alias("text"), F.col("id").alias("__k"))
    want = {r["v"]: i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r["text"] is not None, r["text"] or "", r["v"])))}
    assert {r["v"]: r["__at"] for r in positions.dense(df, ["text", "v"]).collect()} == want
    alone = positions.single_position(df.withColumn("w", F.col("v")), ["text", "v"])
    assert [r["w"] for r in alone.orderBy("__pos").select("w").collect()] == sorted(want, key=want.get)


@pytest.mark.parametrize("name", ["series_iterator", "series_keys_cells_values", "series_foreach"])
def test_traversals_send_no_cells_to_the_driver(spark, name, monkeypatch):
    """No cell is fetched by the driver's iterator; they stay on the executors."""
    from lattica import catalog

    cells = spark.range(0, 70, 1, 3).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.lit("error").alias("event_type"), (F.col("id") / 4).alias("value"))
    monkeypatch.setattr(catalog, "_table", lambda *_: cells)
    monkeypatch.setattr(type(cells), "toLocalIterator", lambda self, *a: pytest.fail("cells on the driver"))
    got = catalog.queries()[name](spark, "")
    monkeypatch.undo()
    values = {i: i / 4 for i in range(70) if i % 7 and i % 11}
    if name == "series_iterator":
        assert sorted(map(tuple, got.collect())) == [(i, i, None if i not in values else round(i / 4, 3), bool(i % 7) and i % 11 == 0) for i in range(70)]
    elif name == "series_foreach":
        assert got.first().asDict() == {"pairs": 70, "dense": len(values), "keys": sum(range(70)), "cells": 70, "total": sum(values.values())}
    else:
        assert got.first().asDict() == {"keys": 70, "cells": 70, "n_values": len(values), "total": sum(values.values()), "dense_keys": sum(values)}


def test_different_keys_are_dealt_to_parts_of_so_many_rows(spark, monkeypatch):
    from lattica.plans import series

    monkeypatch.setattr(series, "LARGE", 100)
    monkeypatch.setattr(series, "PART_ROWS", 50)
    rows = spark.range(0, 1000, 1, 1)
    for keys, dealt in ((900, True), (5, False)):
        s = Series.from_df(rows, F.col("id") % keys, "id", "id").sum_by_key()
        assert dict(s.to_list()) == {k: sum(range(k, 1000, keys)) for k in range(keys)}
        assert ("REPARTITION_BY_NUM" in s.df._jdf.queryExecution().toString()) == dealt
