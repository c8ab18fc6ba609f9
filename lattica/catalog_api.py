"""Queries over the rest of the API: constructors, traversal, access, casts, dialects, streams. Whole tables throughout."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattica.catalog import _EV, _cells, _events, _nm, _out, _query, _table, _v, shared_folder
from lattica.functions import casts
from lattica.functions import reducers as R
from lattica.functions.cells import Cell, from_option, not_available, not_meaningful, value
from lattica.operators import positions
from lattica.plans.frame import Frame
from lattica.plans.select import all_cols, cols, rows
from lattica.plans.series import NA, NM, Series, _Missing
from lattica.sources import delimited as D


def _local(spark, sf_dir, name: str, order: str, *columns: str) -> list[tuple]:
    """A table of a few fixed rows, on the driver."""
    return [tuple(r) for r in _table(spark, sf_dir, name).orderBy(order).select(*columns).collect()]


def _nations(spark, sf_dir) -> Frame:
    return Frame.from_df(_table(spark, sf_dir, "nation"), "n_nationkey", {"name": "n_name", "region": "n_regionkey"}, "n_nationkey")


def _plain(spark, sf_dir, key: str = "event_id") -> Series:
    """Event values without NM: NA at every seventh."""
    return Series.from_df(_table(spark, sf_dir, "events"), key, _v(), "event_id")


_PLAIN = "WITH p AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)\n"


# delimited text


def _text(spark, sf_dir, line) -> str:
    return "".join(line(*r) + "\n" for r in _local(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", "n_name", "n_regionkey"))


@_query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region, ';' AS separator FROM nation")
def csv_guess(spark, sf_dir):
    parsed = D.parse_string(spark, _text(spark, sf_dir, lambda k, n, r: f'{k};"{n}";{r}'), D.Guess())
    frame = parsed.to_frame()
    both = frame.column(1, "string").to_frame("name").join(frame.column(2, "int").to_frame("region"))
    return both.result(flags=False).withColumn("separator", F.lit(parsed.dialect.separator))


@_query("SELECT n_nationkey AS key, n_name AS nation FROM nation")
def csv_guess_header(spark, sf_dir):
    text = "number;nation\n" + _text(spark, sf_dir, lambda k, n, r: f"{k};{n}")
    return D.parse_string(spark, text, D.Guess(header=None)).to_frame().column("nation", "string").to_frame("nation").result(flags=False)


@_query("""SELECT n_nationkey + 1 AS "row", 'Expected separator, row delimiter, or end of file' AS message, '"' || n_name || '"x,' || n_regionkey AS context,
  length(n_name) + 3 AS "column" FROM nation WHERE n_nationkey % 5 = 0""")
def csv_errors(spark, sf_dir):
    parsed = D.parse_string(spark, _text(spark, sf_dir, lambda k, n, r: f'"{n}"{"" if k % 5 else "x"},{r}'), D.CSV)
    return parsed.errors().select("row", "message", "context", "column")


@_query("SELECT n_nationkey + 1 AS \"row\", 'Row ' || (n_nationkey + 1) || ': \"' || n_name || '\"x' AS line FROM nation")
def csv_error_description(spark, sf_dir):
    found = [r for r in D.scan(_text(spark, sf_dir, lambda k, n, r: f'"{n}"x'), D.CSV) if isinstance(r, D.RowError)]
    return spark.createDataFrame([(e.row, e.description().splitlines()[2]) for e in found], "row bigint, line string")


@_query("SELECT n_nationkey AS key, n_nationkey || CASE n_regionkey % 3 WHEN 0 THEN '|' || '''' || replace(n_name, '_', '''''') || '''|' WHEN 1 THEN '|-|' ELSE '|bad|' END || n_regionkey AS line FROM nation")
def csv_dialects(spark, sf_dir):
    """Another separator, quote, and texts of empty and invalid cells, there and back."""
    dialect = D.CSV.with_(separator="|", quote="'", quote_escape="'", empty="-", invalid="bad", row_delim=D.UNIX)
    data = [(k, k, [n.replace("_", "'"), NA, NM][r % 3], r) for k, n, r in _local(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", "n_name", "n_regionkey")]
    text = D.to_text(Frame.of(spark, data, {"k": "int", "n": "string", "r": "int"}, "int"), dialect)
    again = D.parse_string(spark, text, dialect).to_text()
    return spark.createDataFrame([(i, line) for i, line in enumerate(again.split("\n"))], "key int, line string")


@_query("SELECT n_nationkey AS key, n_name AS as_text, CAST(n_regionkey AS DOUBLE) AS as_number, true AS text_is_nm FROM nation")
def cast_csv_cell(spark, sf_dir):
    frame = D.parse_string(spark, _text(spark, sf_dir, lambda k, n, r: f"{n},{r}"), D.CSV).to_frame()
    bad = frame.column(0, "double")
    flags = Series(bad.df.withColumn("v", F.col("nm")).drop("nm"), bad.order)
    out = frame.column(0, "string").to_frame("as_text").join(frame.column(1, "double").to_frame("as_number")).join(flags.to_frame("text_is_nm"))
    return out.result(flags=False)


@_query("SELECT 0 AS csv_rows, 0 AS frame_rows, 0 AS frame_columns, 0 AS series_size, true AS all_empty")
def empty_things(spark, sf_dir):
    csv, frame, series = D.empty(spark), Frame.empty(spark), Series.empty(spark)
    sizes = csv.rows.count(), frame.num_rows(), frame.num_cols(), series.size()
    return spark.createDataFrame([(*sizes, frame.is_empty() and series.is_empty() and csv.to_frame().is_empty())], "csv_rows int, frame_rows int, frame_columns int, series_size int, all_empty boolean")


@_query("SELECT s_suppkey AS key, s_name, replace(s_name, '#', chr(10)) || chr(10) || s_suppkey AS note FROM supplier")
def csv_split_files(spark, sf_dir):
    """Quoted line ends in files that Spark may split anywhere."""
    path = f"{shared_folder(spark)}/csv-split-{uuid.uuid4().hex}"
    df = _table(spark, sf_dir, "supplier")
    note = F.concat(F.replace("s_name", F.lit("#"), F.lit("\n")), F.lit("\n"), F.col("s_suppkey").cast("string"))
    frame = Frame.from_df(df, "s_suppkey", {"k": F.col("s_suppkey"), "s_name": "s_name", "note": note}, "s_suppkey")
    dialect = D.CSV.with_(header=True, row_delim=D.UNIX)
    D.write(frame, path, dialect)
    back = D.parse_path(spark, path, dialect).to_frame().reindex(cols("k").as_("long"))
    return back.column("s_name", "string").to_frame("s_name").join(back.column("note", "string").to_frame("note")).result(flags=False)


# constructors


@_query('SELECT n_nationkey AS key, n_name AS "0", n_regionkey AS "1" FROM nation')
def frame_from_rows(spark, sf_dir):
    return Frame.from_rows(spark, _local(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey"), ["string", "int"]).result()


@_query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation")
def frame_from_columns(spark, sf_dir):
    data = _local(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    return Frame.from_columns(spark, list(zip(*data, strict=True)), ["string", "int"], ["name", "region"]).result()


@_query("SELECT n_nationkey AS key, n_nationkey * 10 + 1 AS a, n_nationkey * 10 + 2 AS bb FROM nation")
def frame_fill(spark, sf_dir):
    keys = [k for (k,) in _local(spark, sf_dir, "nation", "n_nationkey", "n_nationkey")]
    return Frame.fill(spark, keys, ["a", "bb"], lambda k, c: k * 10 + len(c), "int").result()


_SIDE_BY_SIDE = """c AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
s AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)"""


@_query(f"WITH {_SIDE_BY_SIDE}, n AS (SELECT n_nationkey AS k, n_name, 1 AS i FROM nation) SELECT coalesce(c.k, s.k, n.k) AS key, c_custkey AS customer, s_suppkey AS supplier, n_name AS nation FROM c FULL JOIN s ON c.k = s.k AND c.i = s.i FULL JOIN n ON coalesce(c.k, s.k) = n.k AND coalesce(c.i, s.i) = n.i")
def merge_columns(spark, sf_dir):
    c = Series.from_df(_table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_custkey")
    s = Series.from_df(_table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "s_suppkey")
    n = Series.from_df(_table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "n_nationkey")
    return Frame.merge_columns([("customer", c), ("supplier", s), ("nation", n)]).result()


_NATION_SIDE = "SELECT '{}' AS key, " + ", ".join(f'max(CASE WHEN n_nationkey = {i} THEN {{}} END) AS "{i}"' for i in range(25)) + " FROM nation"


@_query(_NATION_SIDE.format("region", *["n_regionkey"] * 25) + " UNION ALL " + _NATION_SIDE.format("size", *["length(n_name)"] * 25))
def merge_rows(spark, sf_dir):
    df = _table(spark, sf_dir, "nation")
    region = Series.from_df(df, "n_nationkey", F.col("n_regionkey").cast("bigint"), "n_nationkey")
    size = Series.from_df(df, "n_nationkey", F.length("n_name").cast("bigint"), "n_nationkey")
    return Frame.merge_rows([("region", region), ("size", size)]).result()


@_query("WITH o AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1), e AS (SELECT user_id AS k, count(*) AS events FROM events GROUP BY 1) SELECT coalesce(c_custkey, o.k, e.k) AS key, c_acctbal AS balance, spent, events FROM customer FULL JOIN o ON c_custkey = o.k FULL JOIN e ON coalesce(c_custkey, o.k) = e.k")
def join_columns(spark, sf_dir):
    balance = Series.from_df(_table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", "c_custkey")
    spent = Series.from_df(_table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey").sum_by_key()
    events = Series.from_df(_table(spark, sf_dir, "events"), "user_id", "event_id", "event_id").count_by_key()
    out = Frame.join_columns([("balance", balance), ("spent", spent), ("events", events)]).result()
    return out.withColumn("spent", F.round("spent", 2))


@_query("SELECT n_name AS key, CASE WHEN n_nationkey % 3 > 0 AND n_nationkey % 5 > 0 THEN n_regionkey END AS v, n_nationkey % 3 > 0 AND n_nationkey % 5 = 0 AS nm FROM nation")
def series_of_cells(spark, sf_dir):
    data = _local(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", "n_name", "n_regionkey")
    pairs = [(n, NA if k % 3 == 0 else NM if k % 5 == 0 else r) for k, n, r in data]
    listed, mapped = Series.of(spark, pairs), Series.from_map(spark, dict(pairs))
    assert listed.equals(mapped)
    return mapped.result()


@_query("SELECT n_nationkey AS key, n_name AS v FROM nation")
def series_of_values(spark, sf_dir):
    return Series.of_values(spark, [n for (n,) in _local(spark, sf_dir, "nation", "n_nationkey", "n_name")], "string").result()


@_query("""SELECT event_id AS key, CASE event_type WHEN 'click' THEN 1.5 WHEN 'view' THEN CASE WHEN event_id % 7 <> 0 THEN value END END AS v,
  event_type = 'error' OR (event_type = 'view' AND event_id % 7 = 0) AS nm FROM events""")
def cell_constructors(spark, sf_dir):
    """A value, not available, not meaningful, and an optional value, by event type."""
    made = {"click": value(1.5), "view": from_option(_v(), not_meaningful("double")), "error": not_meaningful("double")}
    cell = not_available("double")
    v, nm = cell.v, cell.is_nm
    for kind, c in made.items():
        v, nm = F.when(F.col("event_type") == kind, c.v).otherwise(v), F.when(F.col("event_type") == kind, c.is_nm).otherwise(nm)
    return Series.from_df(_table(spark, sf_dir, "events"), "event_id", v, "event_id", nm).result()


@_query(_EV + "SELECT event_id AS key, round(v, 3) AS v, nm, CASE WHEN v IS NOT NULL THEN 'value' WHEN nm THEN 'NM' ELSE 'NA' END AS kind FROM ev")
def column_constructors(spark, sf_dir):
    """A column of cells from an expression and a mask."""
    frame = Frame.from_df(_table(spark, sf_dir, "events"), "event_id", {"v": _v()}, "event_id", {"v": _nm()})
    kind = frame.get(cols("v").as_("double").cell_map(lambda c: Cell(c.fold("NA", "NM", lambda _: F.lit("value")))))
    return frame.join(kind.to_frame("kind")).result().select("key", F.round("v", 3).alias("v"), F.col("v_nm").alias("nm"), "kind")


# traversal and text


@_query("WITH t AS (SELECT CAST(r_regionkey AS VARCHAR) AS k, r_name AS n FROM region), w AS (SELECT greatest(max(length(k)), 1) AS a, greatest(max(length(n)), 6) AS b FROM t) SELECT rpad(k, CAST(a AS INTEGER), ' ') || ' : ' || rpad(n, CAST(b AS INTEGER), ' ') AS line FROM t, w UNION ALL SELECT rpad(' ', CAST(a AS INTEGER), ' ') || ' : ' || rpad('r_name', CAST(b AS INTEGER), ' ') FROM w")
def frame_as_text(spark, sf_dir):
    text = str(Frame.from_df(_table(spark, sf_dir, "region"), "r_regionkey", ["r_name"], "r_regionkey"))
    return spark.createDataFrame([(line,) for line in text.split("\n")], "line string")


@_query("SELECT 'Series(' || string_agg(n_nationkey || ' -> ' || CASE WHEN n_regionkey = 0 THEN 'NA' ELSE n_name END, ', ' ORDER BY n_nationkey) || ')' AS text FROM nation")
def series_as_text(spark, sf_dir):
    s = Series.from_df(_table(spark, sf_dir, "nation"), "n_nationkey", F.when(F.col("n_regionkey") > 0, F.col("n_name")), "n_nationkey")
    return spark.createDataFrame([(str(s),)], "text string")


@_query(_EV + "SELECT event_id AS key, row_number() OVER (ORDER BY event_id) - 1 AS place, round(v, 3) AS v, nm FROM ev")
def series_iterator(spark, sf_dir):
    """Every cell, in order, through an iterator of each part, on the executors."""

    def cells(found):
        for i, k, c in found:
            yield k, i, None if isinstance(c, _Missing) else float(c), c is NM

    return _events(spark, sf_dir, "event_id").map_places(cells, "key bigint, place bigint, v double, nm boolean").withColumn("v", F.round("v", 3))


@_query(_EV + "SELECT count(*) AS keys, count(*) AS cells, count(v) AS n_values, round(sum(v), 2) AS total, sum(CASE WHEN v IS NOT NULL THEN event_id END) AS dense_keys FROM ev")
def series_keys_cells_values(spark, sf_dir):
    def seen(pairs):
        n = n_values = total = dense_keys = 0
        for k, c in pairs:
            n += 1
            if not isinstance(c, _Missing):
                n_values, total, dense_keys = n_values + 1, total + c, dense_keys + k
        yield n, n_values, float(total), dense_keys

    parts = _events(spark, sf_dir, "event_id").map_parts(seen, "n bigint, n_values bigint, total double, dense_keys bigint")
    n, values = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_values"))
    some = lambda c: F.when(F.sum("n_values") > 0, F.sum(c))
    return parts.agg(n.alias("keys"), n.alias("cells"), values.alias("n_values"), F.round(some("total"), 2).alias("total"), some("dense_keys").alias("dense_keys"))


@_query(_EV + "SELECT count(*) AS pairs, count(v) AS dense, sum(event_id) AS keys, count(*) AS cells, round(sum(v), 2) AS total FROM ev")
def series_foreach(spark, sf_dir):
    """Effects of each pair, dense pair, key, cell and value, on the executors; what each part has seen is added up."""

    def seen(pairs):
        got = dict.fromkeys(("pairs", "dense", "keys", "cells"), 0)
        total = 0.0
        for k, c in pairs:
            got["pairs"] += 1
            got["keys"] += k
            got["cells"] += 1
            if not isinstance(c, _Missing):
                got["dense"] += 1
                total += c
        yield *got.values(), total

    parts = _events(spark, sf_dir, "event_id").map_parts(seen, "pairs bigint, dense bigint, keys bigint, cells bigint, total double")
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "dense", "cells")]
    return parts.agg(*counts, F.when(F.sum("pairs") > 0, F.sum("keys")).alias("keys"), F.round(F.when(F.sum("dense") > 0, F.sum("total")), 2).alias("total"))


@_query("SELECT true AS same_frame, false AS other_order, false AS other_cells, true AS same_series, false AS other_series")
def equality(spark, sf_dir):
    frame, s = _cells(spark, sf_dir), _events(spark, sf_dir)
    checks = (
        frame.equals(_cells(spark, sf_dir).sort_rows()),
        frame.equals(frame.reverse_rows()),
        frame.retain_columns("user_id").equals(frame.retain_columns("user_id").map(cols("user_id").as_("long"), "user_id", lambda v: v + 1)),
        s.equals(_events(spark, sf_dir)),
        s.equals(s.reversed()),
    )
    return spark.createDataFrame([checks], "same_frame boolean, other_order boolean, other_cells boolean, same_series boolean, other_series boolean")


# keys, order and shape


@_query('SELECT o_orderkey * 2 + 1 AS key, o_custkey AS "O_CUSTKEY", o_orderstatus AS "O_ORDERSTATUS" FROM orders')
def map_keys(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey", "o_orderstatus"], "o_orderkey")
    return frame.map_row_keys(lambda k: k * 2 + 1).map_col_keys(str.upper).result()


@_query("SELECT event_id AS key, event_type, user_id, row_number() OVER (ORDER BY event_id DESC) - 1 AS place FROM events")
def reverse(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "events"), "event_id", ["user_id", "event_type"], "event_id").reverse_rows().reverse_columns()
    assert frame.col_keys() == ["event_type", "user_id"]
    at = positions.dense(frame.df, frame.order)
    return at.select(F.col("__k").alias("key"), *(F.col(c.v).alias(c.key) for c in frame.columns), F.col("__at").alias("place"))


@_query("SELECT (SELECT count(*) FROM orders) AS n_rows, 2 AS n_cols, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_keys, false AS empty, 'o_orderkey,o_totalprice' AS columns")
def frame_sizes(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_totalprice"], "o_orderkey")
    row = (frame.num_rows(), frame.num_cols(), frame.row_keys().count(), frame.is_empty(), ",".join(frame.col_keys()))
    return spark.createDataFrame([row], "n_rows bigint, n_cols int, n_keys bigint, empty boolean, columns string")


@_query("SELECT 'l_quantity' AS name, round(sum(l_quantity), 2) AS total FROM lineitem UNION ALL SELECT 'l_tax', round(sum(l_tax), 2) FROM lineitem")
def columns_as_series(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_quantity", "l_tax"], "l_partkey")
    return spark.createDataFrame([(k, round(float(s.sum()), 2)) for k, s in frame.columns_as_series().values()], "name string, total double")


@_query("SELECT n_nationkey AS row_key, n_nationkey + n_regionkey AS total FROM nation")
def rows_as_series(spark, sf_dir):
    df = _table(spark, sf_dir, "nation")
    turned = Frame.from_df(df, "n_nationkey", {"n_nationkey": F.col("n_nationkey"), "n_regionkey": "n_regionkey"}, "n_nationkey").transpose()
    one = turned.reduce_frame(R.Sum(), "long")  # the sum of each row as a series
    keys = [k for k, _ in turned.columns_as_series().values()]
    assert len(turned.transpose().rows_as_series()) == len(keys)
    return one.df.select(F.col("__k").cast("int").alias("row_key"), F.col("v").cast("bigint").alias("total"))


@_query("SELECT n_nationkey AS place, n_nationkey AS key FROM nation")
def row_index(spark, sf_dir):
    return _nations(spark, sf_dir).row_index().select(F.col("pointer").alias("place"), "key")


@_query(_EV + "SELECT event_id AS key, row_number() OVER (ORDER BY user_id, event_id) - 1 AS place FROM ev")
def series_sorted(spark, sf_dir):
    s = Series.from_df(_table(spark, sf_dir, "events"), "user_id", "event_id", "event_id").sorted()
    return positions.dense(s.df, s.order).select(F.col("v").alias("key"), F.col("__at").alias("place"))


@_query(_EV + "SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, event_id AS key, round(v, 3) AS v FROM ev WHERE v IS NOT NULL")
def series_compacted(spark, sf_dir):
    s = _events(spark, sf_dir, "event_id").filter_by_values(lambda v: v.isNotNull()).compacted()
    return s.df.select(F.col("__pos").alias("place"), F.col("__k").alias("key"), F.round("v", 3).alias("v"))


@_query("SELECT event_id AS key, user_id AS a, event_type AS b FROM events")
def series_unzip(spark, sf_dir):
    a, b = Series.from_df(_table(spark, sf_dir, "events"), "event_id", F.struct("user_id", "event_type"), "event_id").unzip()
    return a.to_frame("a").join(b.to_frame("b")).result()


@_query(_EV + "SELECT count(*) AS size, true AS has_values, false AS is_empty, true AS none_is_empty, max(event_id) + 1 = count(*) AS ordered FROM ev")
def series_sizes(spark, sf_dir):
    s = _events(spark, sf_dir, "event_id")
    gone = s.map_values(lambda v: F.lit(None).cast("double"))
    return spark.createDataFrame([(s.size(), s.has_values(), s.is_empty(), gone.is_empty(), s.is_ordered())], "size bigint, has_values boolean, is_empty boolean, none_is_empty boolean, ordered boolean")


# access


@_query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region, '<none>' AS other FROM nation WHERE n_nationkey IN (0, 7, 24)")
def row_records(spark, sf_dir):
    frame = _nations(spark, sf_dir)
    found = [(k, frame.get_row(k)) for k in (0, 7, 24, 99)]
    return spark.createDataFrame([(k, r["name"], r["region"], r.asDict().get("other", "<none>")) for k, r in found if r is not None], "key int, name string, region int, other string")


@_query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def column_record(spark, sf_dir):
    record = _nations(spark, sf_dir).get_col("name")
    return spark.createDataFrame(list(record.items()), "key int, name string")


@_query("SELECT 3 AS n, (SELECT n_name FROM nation WHERE n_nationkey = 3) AS name, (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) AS region, 'NA' AS no_row, 'NM' AS no_number")
def frame_cell(spark, sf_dir):
    frame = _nations(spark, sf_dir)
    return spark.createDataFrame([(3, frame.cell(3, "name"), frame.cell(3, "region", "int"), str(frame.cell(77, "name")), str(frame.cell(3, "name", "double")))], "n int, name string, region int, no_row string, no_number string")


@_query("SELECT a.event_id AS key_at, a.user_id AS value_at, a.event_id AS index_at, (SELECT count(*) FROM events WHERE user_id = 8) AS n_of_key, (SELECT event_id FROM events WHERE user_id = 8 ORDER BY event_id LIMIT 1) AS first_of_key, true AS is_value, true AS absent FROM (SELECT * FROM events ORDER BY event_id LIMIT 1 OFFSET 5) a")
def series_access(spark, sf_dir):
    df = _table(spark, sf_dir, "events")
    s, by_user = Series.from_df(df, "event_id", "user_id", "event_id"), Series.from_df(df, "user_id", "event_id", "event_id")
    row = (s.key_at(5), s.value_at(5), s.index_at(5)[0], len(by_user.get_values(8)), by_user.get(8), s.is_value_at(5), by_user.get(-1) is NA)
    return spark.createDataFrame([row], "key_at bigint, value_at bigint, index_at bigint, n_of_key bigint, first_of_key bigint, is_value boolean, absent boolean")


@_query(_EV + "SELECT event_id AS key, round(v, 3) AS v, nm FROM ev ORDER BY event_id LIMIT 500")
def series_take(spark, sf_dir):
    return _out(_events(spark, sf_dir, "event_id").take(500))


@_query(_EV + "SELECT event_id AS key, CASE WHEN event_id IN (1, 2, 33) THEN NULL ELSE round(v, 3) END AS v, nm AND event_id NOT IN (1, 2, 33) AS nm FROM ev")
def series_mask(spark, sf_dir):
    return _out(_events(spark, sf_dir, "event_id").mask([1, 2, 33]))


@_query(_EV + ", r AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM ev) SELECT event_id AS key, CASE WHEN i IN (0, 5, 44) THEN NULL ELSE round(v, 3) END AS v, nm AND i NOT IN (0, 5, 44) AS nm FROM r")
def series_set_na(spark, sf_dir):
    return _out(_events(spark, sf_dir, "event_id").set_na(0, 5, 44))


@_query(_EV + "SELECT event_id AS key, round(v * 2, 3) AS v, nm FROM ev")
def series_cached(spark, sf_dir):
    s = _events(spark, sf_dir, "event_id").cached()
    return _out(s.map_values(lambda v: v * 2))


# selectors


@_query(_EV + "SELECT event_id AS key, CASE WHEN v > 50 THEN round(v, 3) END AS v, nm FROM ev")
def selector_filter(spark, sf_dir):
    return _out(_cells(spark, sf_dir).get(cols("v").as_("double").filter(lambda v: v > 50)))


@_query("SELECT 'o_custkey' AS key, CAST(sum(o_custkey) AS DOUBLE) AS v FROM orders WHERE o_orderkey IN (1, 2, 7) UNION ALL SELECT 'o_totalprice', round(sum(o_totalprice), 2) FROM orders WHERE o_orderkey IN (1, 2, 7)")
def selector_of_rows(spark, sf_dir):
    """Rows by key of a frame of any length, as cells of each column."""
    frame = Frame.from_df(_table(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey", "o_totalprice"], "o_orderkey")
    total = rows(1, 2, 7).as_list("double").map(lambda a: F.aggregate(a, F.lit(0.0), lambda s, c: s + c["v"]))
    return _out(frame.get(total), 2)


@_query("SELECT o_orderkey AS key, o_totalprice FROM orders")
def filter_columns_by_rows(spark, sf_dir):
    """Columns whose cell in a row satisfies a condition; selectors turned to the other axis."""
    df = _table(spark, sf_dir, "orders")
    frame = Frame.from_df(df, "o_orderkey", {"o_shippriority": F.lit(0.0), "o_totalprice": "o_totalprice"}, "o_orderkey")
    return frame.filter(cols(1).as_("double").to_rows(), lambda v: v > 0).result()


@_query("SELECT event_id AS key, CAST(2 AS BIGINT) AS n FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, 1 FROM events WHERE event_id % 7 = 0")
def selector_all_columns(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "events"), "event_id", {"v": _v(), "user_id": "user_id"}, "event_id")
    return _out(frame.get(all_cols().as_list("double").map(lambda a: F.size(F.filter(a, lambda c: c["v"].isNotNull())).cast("bigint"))), None).withColumnRenamed("v", "n")


# reducers over whole series, and by functions of one's own


@_query(_PLAIN + """SELECT count(v) AS n, round(sum(v), 2) AS total, round(sum(v), 2) AS total_non_empty, round(avg(v), 4) AS mean, round(median(v), 3) AS middle, round(max(v), 3) AS most, round(min(v), 3) AS least,
  round(arg_min(v, event_id) FILTER (WHERE v IS NOT NULL), 3) AS head, round(arg_max(v, event_id) FILTER (WHERE v IS NOT NULL), 3) AS tail, bool_or(v > 99) AS some, bool_and(v < 99) AS every FROM p""")
def series_reduced(spark, sf_dir):
    s = _plain(spark, sf_dir)
    got = (s.count(), round(s.sum(), 2), round(s.sum_non_empty(), 2), round(s.mean(), 4), round(s.median(), 3), round(s.max(), 3), round(s.min(), 3), round(s.first(), 3), round(s.last(), 3))
    row = (*got, s.exists(lambda v: v > 99), s.forall(lambda v: v < 99))
    return spark.createDataFrame([row], "n bigint, total double, total_non_empty double, mean double, middle double, most double, least double, head double, tail double, some boolean, every boolean")


@_query(_EV + "SELECT 'NM' AS total, 'NM' AS mean, 'false' AS every, (SELECT count(DISTINCT event_type) FROM events) AS kinds, (SELECT string_agg(event_id, ',' ORDER BY event_id) FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 3)) AS few")
def series_reduced_with_nm(spark, sf_dir):
    """One cell that is not meaningful decides, but for what says otherwise."""
    s, df = _events(spark, sf_dir), _table(spark, sf_dir, "events")
    kinds = Series.from_df(df, "event_id", "event_type", "event_id").unique()
    few = Series.from_df(df, "event_id", "event_id", "event_id").reduce(R.FirstN(3))
    row = (str(s.reduce(R.Sum())), str(s.reduce(R.Mean())), str(s.reduce(R.ForAll(lambda v: v < 1e9))).lower(), len(kinds), ",".join(map(str, few)))
    return spark.createDataFrame([row], "total string, mean string, every string, kinds bigint, few string")


@_query(_PLAIN + "SELECT user_id AS key, round(max(v) - min(v), 3) AS v FROM p GROUP BY 1")
def simple_reducer(spark, sf_dir):
    """A reducer as an expression of the ordered values."""
    spread = R.ArrayReducer(lambda a: F.array_max(a) - F.array_min(a))
    return _out(_plain(spark, sf_dir, "user_id").reduce_by_key(spread))


@_query(_PLAIN + "SELECT user_id AS key, round(max(v) - min(v), 3) AS v FROM p GROUP BY 1")
def python_reducer(spark, sf_dir):
    return _out(_plain(spark, sf_dir, "user_id").reduce_by_key(R.PythonReducer(lambda xs: float(max(xs) - min(xs)), "double")))


@_query("SELECT user_id AS key, CAST(list_reduce(list(CAST(event_id % 3 + 1 AS HUGEINT) * CASE event_type WHEN 'error' THEN -1 ELSE 1 END), lambda a, b: a * b) AS VARCHAR) AS v FROM events GROUP BY 1")
def whole_product_by_key(spark, sf_dir):
    """Products beyond the digits of a double."""
    factor = (F.col("event_id") % 3 + 1) * F.when(F.col("event_type") == "error", -1).otherwise(1)
    s = Series.from_df(_table(spark, sf_dir, "events"), "user_id", factor, "event_id").reduce_by_key(R.WholeProduct())
    return _out(s.map_values(lambda v: v.cast("string")), None)


# cells and casts


@_query(_EV + "SELECT event_id AS key, CASE WHEN v > 50 THEN round(v, 3) END AS v, coalesce(nm OR v <= 50, false) AS nm FROM ev")
def series_flat_map_cell(spark, sf_dir):
    s = _events(spark, sf_dir, "event_id").flat_map_cell(lambda v: Cell(F.when(v > 50, v), v <= 50))
    return _out(s).withColumn("nm", F.coalesce("nm", F.lit(False)))


@_query(_EV + "SELECT event_id AS key, CASE WHEN nm THEN -1.0 WHEN v IS NULL THEN event_id ELSE round(v + user_id * 0, 3) END AS v FROM ev")
def series_cell_map(spark, sf_dir):
    s = _events(spark, sf_dir, "event_id").cell_map_with_keys(lambda k, c: Cell(c.fold(k.cast("double"), -1.0, lambda v: v)))
    return _out(s.map_values_with_keys(lambda k, v: v).cell_map(lambda c: Cell(c.v)))


@_query("SELECT o_orderkey AS key, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) END AS v, o_totalprice <> floor(o_totalprice) AS nm FROM orders")
def cast_big_whole(spark, sf_dir):
    s = Frame.from_df(_table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"], "o_orderkey").column("o_totalprice", "bigint38")
    return _out(s.map_values(lambda v: v.cast("string")), None)


@_query("SELECT o_orderkey AS key, round(o_totalprice, 4) AS v, false AS nm FROM orders")
def cast_decimal(spark, sf_dir):
    s = Frame.from_df(_table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"], "o_orderkey").column("o_totalprice", "decimal")
    return _out(s.map_values(lambda v: v.cast("double")), 4)


@_query("SELECT l_orderkey * 100 + l_linenumber AS key, count(*) AS n, round(sum(l_discount * 100), 4) AS v FROM lineitem GROUP BY 1")
def cast_registered(spark, sf_dir):
    """A cast of one's own: shares read as percentages."""
    casts.register("percent", "double", lambda c, kind: Cell(c.v.cast("double") * 100, c.nm))
    frame = Frame.from_df(_table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") * 100 + F.col("l_linenumber")), "k", ["l_discount"], "l_partkey")
    s = frame.column("l_discount", "percent")
    return s.count_by_key().to_frame("n").join(s.sum_by_key().to_frame("v")).result().withColumn("v", F.round("v", 4))


# streams


@_query("SELECT event_type AS key, round(sum(value), 2) AS v FROM events WHERE value > 10 GROUP BY 1")
def stream_reduced(spark, sf_dir):
    """A running reducer by key over a stream of the whole table, read to its end."""
    from lattica.streaming.frames import reduce_by_key, stream_frame

    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    frame = stream_frame(stream, "event_type", ["value"]).filter(cols("value").as_("double"), lambda v: v > 10)
    name = f"stream_{uuid.uuid4().hex}"
    running = reduce_by_key(frame, cols("value").as_("double"), R.Sum()).writeStream.outputMode("complete").format("memory").queryName(name)
    query = running.option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select("key", F.round("v", 2).alias("v"))
