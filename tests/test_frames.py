"""Frame operators on the small frames of the test plan."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica import NA, NM, Frame, Series, all_cols, cols, not_meaningful, rows
from lattica import reducers as R


@pytest.fixture(scope="module")
def people(spark):
    data = [("Bob", "Bob", 32, "Manager"), ("Alice", "Alice", 24, "Employee"), ("Charlie", "Charlie", 44, "Employee")]
    return Frame.of(spark, data, {"Name": "string", "Age": "int", "Level": "string"}, "string")


@pytest.fixture(scope="module")
def sparse(spark):
    return Frame.of(spark, [(0, 1, 2), (0, NA, 3), (1, NA, NM), (1, NA, 2), (2, 5, NA), (2, 6, NA)], {"x": "int", "y": "int"})


def dups(spark):
    return Frame.of(spark, [(k, i + 1, float(i)) for i, k in enumerate("aabccc")], {0: "int", 1: "double"}, "string")


def test_shape_and_keys(people):
    assert people.col_keys() == ["Name", "Age", "Level"]
    assert people.retain_columns("Level", "Age").col_keys() == ["Age", "Level"]
    assert people.drop_columns("Age").col_keys() == ["Name", "Level"]
    assert people.filter_col_keys(lambda k: "e" in k).col_keys() == ["Name", "Age", "Level"]
    assert [r[0] for r in people.retain_rows("Bob", "Charlie").to_rows()] == ["Bob", "Charlie"]
    assert [r[0] for r in people.drop_rows("Bob").to_rows()] == ["Alice", "Charlie"]
    assert [r[0] for r in people.filter_row_keys(lambda k: k < "B").to_rows()] == ["Alice"]
    assert [r[0] for r in people.map_row_keys(F.upper).to_rows()] == ["BOB", "ALICE", "CHARLIE"]
    assert people.map_col_keys(str.lower).col_keys() == ["name", "age", "level"]
    assert [r[0] for r in people.sort_rows().to_rows()] == ["Alice", "Bob", "Charlie"]
    assert people.sort_columns().col_keys() == ["Age", "Level", "Name"]
    assert [r[0] for r in people.reverse_rows().to_rows()] == ["Charlie", "Alice", "Bob"]
    assert [r[0] for r in people.sort_rows().reverse_rows().to_rows()] == ["Charlie", "Bob", "Alice"]
    assert people.reverse_columns().col_keys() == ["Level", "Age", "Name"]
    assert (people.num_rows(), people.num_cols(), people.is_empty()) == (3, 3, False)
    assert sorted(r["key"] for r in people.row_keys().collect()) == ["Alice", "Bob", "Charlie"]


def test_empty_frames(spark):
    assert Frame.empty(spark).is_empty()
    assert Frame.of(spark, [(1, NA), (2, NM)], {"x": "int"}).is_empty()
    assert Frame.empty(spark).to_rows() == []


def test_indexes_may_permute_repeat_and_drop(spark, people):
    assert people.with_col_index([("z", 1), ("a", 0), ("b", 1)]).to_rows()[0] == ("Bob", 32, "Bob", 32)
    index = spark.createDataFrame([("x", 2, 0), ("y", 0, 1), ("x", 2, 2)], "key string, pointer int, pos int")
    assert [r[:2] for r in people.with_row_index(index).to_rows()] == [("x", "Charlie"), ("y", "Bob"), ("x", "Charlie")]


def test_access(people):
    assert people.cell("Alice", "Age") == 24
    assert people.cell("Alice", "Age", "string") is NM
    assert people.cell("Nobody", "Age") is NA
    assert people.cell("Alice", "Height") is NA
    assert people.column("Age", "int").to_list() == [("Bob", 32), ("Alice", 24), ("Charlie", 44)]
    assert people.retain_columns("Age").row("Alice", "int").to_list() == [("Age", 24)]
    assert people.get_row("Bob")["Level"] == "Manager"
    assert people.get_row("X") is None
    assert people.get_col("Age") == {"Bob": 32, "Alice": 24, "Charlie": 44}
    assert people.get_col("X") is None
    assert people.get_column_group("Age").col_keys() == ["Age"]


def test_transpose(spark):
    f = Frame.of(spark, [("r", 1, NA), ("s", 2, NM)], {"a": "int", "b": "int"}, "string")
    assert f.transpose().to_rows() == [("a", 1, 2), ("b", NA, NM)]
    assert f.transpose().transpose().equals(f)
    with pytest.raises(ValueError, match="transposed"):
        f.transpose(most_rows=1)


def test_joins(spark):
    a = Frame.of(spark, [("a", 1), ("b", 2)], {0: "int"}, "string")
    b = Frame.of(spark, [("b", 2.0), ("c", 3.0)], {0: "double"}, "string")
    assert a.join(b, "inner").to_rows() == [("b", 2, 2.0)]
    assert a.join(b, "left").to_rows() == [("a", 1, NA), ("b", 2, 2.0)]
    assert a.join(b, "right").to_rows() == [("b", 2, 2.0), ("c", NA, 3.0)]
    assert a.join(b, "outer").to_rows() == [("a", 1, NA), ("b", 2, 2.0), ("c", NA, 3.0)]
    assert a.join(b).col_keys() == [0]
    assert a.join(a).num_cols() == 2
    none = Frame.of(spark, [], {0: "double"}, "string")
    assert a.join(none, "inner").to_rows() == []
    assert a.join(none, "left").to_rows() == [("a", 1, NA), ("b", 2, NA)]
    two = Frame.of(spark, [("a", 1), ("a", 2)], {0: "int"}, "string")
    assert two.join(Frame.of(spark, [("a", 2.0), ("a", 3.0)], {0: "double"}, "string")).to_rows() == [("a", 1, 2.0), ("a", 1, 3.0), ("a", 2, 2.0), ("a", 2, 3.0)]
    assert a.join(Series.of(spark, [("a", 9)], "string", "int"), "left", "s").to_rows() == [("a", 1, 9), ("b", 2, NA)]
    assert a.join(b, "outer").join(a, "left").to_rows()[0] == ("a", 1, NA, 1)


def test_merges(spark):
    a = Frame.of(spark, [("a", 1), ("a", 2), ("b", 3)], {0: "int"}, "string")
    b = Frame.of(spark, [("c", 9), ("a", 5), ("b", 6), ("b", 7)], {1: "int"}, "string")
    assert a.merge(b, "inner").to_rows() == [("a", 1, 5), ("b", 3, 6)]
    assert a.merge(b, "outer").to_rows() == [("a", 1, 5), ("a", 2, NA), ("b", 3, 6), ("b", NA, 7), ("c", NA, 9)]
    series = [(k, Series.of(spark, [("a", i), ("b", i + 1)], "string", "int")) for i, k in enumerate("xyz")]
    assert Frame.merge_columns(series).to_rows() == [("a", 0, 1, 2), ("b", 1, 2, 3)]
    assert Frame.merge_rows(series).to_rows() == [("x", 0, 1), ("y", 1, 2), ("z", 2, 3)]
    assert Frame.join_columns(series, "inner").to_rows() == [("a", 0, 1, 2), ("b", 1, 2, 3)]


def test_appending(spark):
    a = Frame.of(spark, [(1, "a", 1), (2, "b", 2)], {0: "string", 1: "int"})
    b = Frame.of(spark, [(2, 3, 0.5), (3, NM, 1.5)], {1: "int", 2: "double"})
    assert a.append_rows(b).to_rows() == [(1, "a", 1, NA), (2, "b", 2, NA), (2, NA, 3, 0.5), (3, NA, NM, 1.5)]
    mixed = a.append_rows(Frame.of(spark, [(9, 7)], {0: "int"}))
    assert mixed.column(0, "string").cells() == ["a", "b", NM]
    assert mixed.column(0, "double").cells() == [NM, NM, 7.0]
    assert a.append_cols(b).to_rows() == [(1, "a", 1, NA, NA), (2, "b", 2, 3, 0.5), (3, NA, NA, NM, 1.5)]


def test_computed_columns_and_filters(people):
    older = people.map(cols("Age").as_("int"), "Next", lambda v: v + 1)
    assert older.to_rows()[0] == ("Alice", "Alice", 24, "Employee", 25)
    assert people.map(cols("Age").as_("int"), "Name", lambda v: v * 2).col_keys() == ["Age", "Level", "Name"]
    tagged = people.map_with_index(cols("Age").as_("string"), "t", lambda k, v: F.concat(k, v))
    assert tagged.column("t").cells() == [NM, NM, NM]
    assert [r[0] for r in people.filter(cols("Age").as_("int"), lambda v: v < 40).to_rows()] == ["Bob", "Alice"]
    assert people.retain_columns("Age").filter(rows("Bob").as_("int"), lambda v: v > 100).col_keys() == []


def test_sort_reindex_group(spark, sparse):
    assert sparse.sort_by(cols("y").as_("int")).column("y").cells() == [NA, NA, NM, 2, 2, 3]
    assert sparse.reindex(cols("x").as_("int")).to_rows() == [(1, 1, 2), (5, 5, NA), (6, 6, NA)]
    grouped = dups(spark).group(cols(1).as_("double").map(lambda v: v % 2))
    assert [r[0] for r in grouped.to_rows()] == [0.0, 0.0, 0.0, 1.0, 1.0, 1.0]
    assert [r[1] for r in grouped.to_rows()] == [1, 3, 5, 2, 4, 6]


def test_reduce_into_frame(sparse):
    got = sparse.reduce(cols("x").as_("double"), "sum", R.Sum())
    assert got.column("sum").cells() == [12.0] * 6
    assert sparse.reduce(cols("y").as_("int"), "x", R.Sum()).column("x").cells() == [NM] * 6
    by = sparse.reduce_by_key(cols("y").as_("int"), "s", R.Sum())
    assert by.column("s").cells() == [5, 5, NM, NM, 0, 0]
    assert by.column("s").keys() == [0, 0, 1, 1, 2, 2]


def test_reduce_frame(spark, sparse):
    assert sparse.reduce_frame(R.Max()).to_list() == [("x", 6.0), ("y", NM)]
    assert sparse.reduce_frame_by_key(R.Sum(), "int").to_rows() == [(0, 1, 5), (1, 0, NM), (2, 11, 0)]
    texts = Frame.of(spark, [(1, "a", 2)], {"t": "string", "n": "int"})
    assert texts.reduce_frame(R.Sum()).to_list() == [("t", NM), ("n", 2.0)]
    pairs = Frame.of(spark, [("a", 1, 2), ("a", 3, 4)], {"f": "int", "x": "int"}, "string")
    dot = R.ArrayReducer(lambda a: F.aggregate(a, F.lit(0.0), lambda s, p: s + p["_1"] * p["_2"]))
    assert pairs.reduce_frame_with_col("f", dot).to_list() == [("x", 24.0)]
    assert pairs.reduce_frame_with_col("f", dot, unique_keys=True).to_list() == [("x", 14.0)]


def test_groups_in_python(spark):
    def head(key, g):
        return pd.DataFrame({"n": [len(g)], "last": [g["0"].iloc[-1]]})

    assert dups(spark).map_row_groups(head, "n bigint, last bigint").to_rows() == [("a", 2, 2), ("b", 1, 3), ("c", 3, 6)]
    other = Frame.of(spark, [("b", 1), ("z", 2)], {"v": "int"}, "string")
    both = dups(spark).cogroup(other, lambda k, x, y: pd.DataFrame({"l": [len(x)], "r": [len(y)]}), "l bigint, r bigint")
    assert both.to_rows() == [("a", 2, 0), ("b", 1, 1), ("c", 3, 0), ("z", 0, 1)]


def test_selectors(spark, sparse):
    s = Frame.of(spark, [(0, 1, "a", NA), (1, NM, "b", 2), (2, NA, NM, NM)], {"x": "int", "t": "string", "y": "int"})
    assert s.get(cols("x").as_("int").filter(lambda v: v > 1)).cells() == [NA, NM, NA]
    assert s.get(cols("x").as_("int").recover(na=0)).cells() == [1, NM, 0]
    assert s.get(cols("x").as_("int").or_else(cols("y").as_("int"))).cells() == [1, 2, NM]
    assert s.get(cols("y").as_("int").or_else(cols("x").as_("int"))).cells() == [1, 2, NA]
    assert s.get(cols("x").as_("int").zip_with(cols("y").as_("int"), lambda a, b: a + b)).cells() == [NA, NM, NA]
    both = s.get(cols("x", "y").as_("int"))
    assert both.cells() == [NA, NM, NM]
    assert s.get(cols("x", "y").as_array("int")).cells() == [NA, NM, NA]
    lists = s.get(cols("x", "y").as_list("int")).cells()
    assert [[(c["v"], c["nm"]) for c in x] for x in lists] == [[(1, False), (None, False)], [(None, True), (2, False)], [(None, False), (None, True)]]
    pick = cols("t").as_("string").flat_map({"a": cols("x").as_("int")}, cols("y").as_("int"))
    assert s.get(pick).cells() == [1, 2, NM]
    assert s.get(cols("gone").as_("int")).cells() == [NA, NA, NA]
    assert s.get(all_cols().as_list("string")).size() == 3
    assert sparse.transpose().get(rows(0).as_("int")).size() == 6
    with pytest.raises(ValueError, match="cannot be read"):
        cols("a", "b").as_("int", "int", "int")
    strict = Frame(s.df, s.columns, s.order, strict=True)
    with pytest.raises(KeyError, match="gone"):
        strict.get(cols("gone").as_("int"))


@pytest.mark.parametrize(
    ("kind", "values", "target", "expected"),
    [
        ("double", [1.0, 2.5, 3e10, None, float("nan")], "int", [1, NM, NM, NA, NM]),
        ("double", [1.0, 2.5, 3e10], "long", [1, NM, 30000000000]),
        ("bigint", [2147483647, 2147483648], "int", [2147483647, NM]),
        ("int", [1, None], "double", [1.0, NA]),
        ("int", [7], "string", [NM]),
        ("string", ["7", None], "double", [NM, NA]),
        ("string", ["7"], "any", ["7"]),
        ("boolean", [True], "boolean", [True]),
        ("boolean", [True], "int", [NM]),
        ("double", [2.5, 4.0], "bigint38", [NM, 4]),
        ("float", [0.5], "double", [0.5]),
    ],
)
def test_casts(spark, kind, values, target, expected):
    frame = Frame.of(spark, list(enumerate(values)), {"x": kind})
    assert frame.column("x", target).cells() == expected


def test_constructors(spark):
    assert Frame.from_rows(spark, [("a", 1), ("b", 2)], ["string", "int"]).to_rows() == [(0, "a", 1), (1, "b", 2)]
    assert Frame.from_columns(spark, [("a", "b"), (1, 2)], ["string", "int"], ["s", "n"]).to_rows() == [(0, "a", 1), (1, "b", 2)]
    assert Frame.fill(spark, [1, 2], [10, 20], lambda r, c: r * c).to_rows() == [(1, 10, 20), (2, 20, 40)]
    assert Frame.fill(spark, [1], [10], lambda r, c: not_meaningful("int")).to_rows() == [(1, NM)]
    assert Series.from_map(spark, {"a": 1, "b": NM}).to_list() == [("a", 1), ("b", NM)]
    frame = Frame.from_df(spark.range(5).select((F.col("id") * 2).alias("x")))
    assert sorted(frame.to_rows()) == [(i, 2 * i) for i in range(5)]
    assert "x" in str(frame)


def test_summary(spark, sparse):
    rows_ = {r["column"]: r for r in sparse.summary().collect()}
    assert (rows_["x"]["Mean"], rows_["x"]["Median"], rows_["x"]["Max"], rows_["x"]["Min"], rows_["x"]["nm"]) == (4.0, 5.0, 6.0, 1.0, False)
    assert (rows_["y"]["Mean"], rows_["y"]["nm"]) == (None, True)


def test_plans_stay_in_the_jvm_and_push_down(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).select("id", (F.col("id") * 1.5).alias("x"), F.lit("u").alias("unused")).write.parquet(path)
    frame = Frame.from_df(spark.read.parquet(path), "id", ["x", "unused"], "id")
    out = frame.filter(cols("x").as_("double"), lambda v: v > 10).get(cols("x").as_("double")).mean_by_key().result()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,10.0)" in plan
    assert "unused" not in plan.split("ReadSchema")[1]
    assert "SinglePartition" not in plan
    assert "Python" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_joins_that_make_many_rows_are_dealt_out(spark, how, monkeypatch):
    """Few rows of few keys, on either side, with keys that one side lacks."""
    from lattica.operators import matching

    def sides():
        a = Frame.from_df(spark.range(90).select((F.col("id") % 4).alias("k"), F.col("id").alias("x")), "k", ["x"], "x")
        return a, Frame.from_df(spark.range(50).select((F.col("id") % 4 + 1).alias("k"), F.col("id").alias("y")), "k", ["y"], "y")

    plain = sides()[0].join(sides()[1], how).result()
    monkeypatch.setattr(matching, "MANY", 20)
    dealt = sides()[0].join(sides()[1], how).result()
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, plain.collect()))
    assert (dealt.rdd.getNumPartitions() > 30) == (how != "outer")
