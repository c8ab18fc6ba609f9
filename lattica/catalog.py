"""Queries over the engine's operators, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import reducers as R
from lattica.functions.cells import Cell, safe_div, value
from lattica.operators import positions
from lattica.plans.frame import Frame
from lattica.plans.select import all_cols, cols
from lattica.plans.series import Series

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for files that all executors share; a local session may have its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or "/tmp/lattica"


# the standard sparse cells: every seventh event is NA, some errors are NM
def _nm():
    return (F.col("event_id") % 7 != 0) & (F.col("event_type") == "error") & (F.col("event_id") % 11 == 0)


def _v():
    return F.when(F.col("event_id") % 7 != 0, F.col("value"))


_EV = """WITH ev AS (SELECT event_id, user_id, event_type,
  event_id % 7 <> 0 AND event_type = 'error' AND event_id % 11 = 0 AS nm,
  CASE WHEN event_id % 7 = 0 OR (event_type = 'error' AND event_id % 11 = 0) THEN NULL ELSE value END AS v FROM events)
"""


def _events(spark: SparkSession, sf_dir: str, key: str = "user_id") -> Series:
    return Series.from_df(_table(spark, sf_dir, "events"), key, _v(), "event_id", _nm())


def _out(s: Series, digits: int | None = 3, key: str = "key") -> DataFrame:
    v = F.round("v", digits) if digits is not None else F.col("v")
    return s.result((key, "v", "nm")).withColumn("v", v)


# frames


@_query("SELECT l_returnflag AS key, round(avg(l_extendedprice), 3) AS mean_price, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def filter_group_mean(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_quantity", "l_returnflag", "l_extendedprice"], pos="l_partkey")
    grouped = frame.filter(cols("l_quantity").as_("double"), lambda v: v > 10).group(cols("l_returnflag").as_("string"))
    price = grouped.get(cols("l_extendedprice").as_("double"))
    both = price.mean_by_key().to_frame("mean_price").join(price.count_by_key().to_frame("n"))
    return both.result().withColumn("mean_price", F.round("mean_price", 3))


@_query("SELECT o_orderkey AS key, o_totalprice, o_orderstatus FROM orders")
def select_retain_drop(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "orders"), "o_orderkey", pos="o_orderkey")
    frame = frame.drop_columns("o_orderdate").filter_col_keys(lambda k: k != "o_custkey")
    return frame.retain_columns("o_orderstatus", "o_totalprice").result()


@_query("SELECT o_orderkey AS key, o_orderstatus, round(o_totalprice * 1.1, 3) AS gross FROM orders")
def col_map_append(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice", "o_orderstatus"], pos="o_orderkey")
    return frame.map(cols("o_totalprice").as_("double"), "gross", lambda v: F.round(v * 1.1, 3)).drop_columns("o_totalprice").result()


@_query("SELECT o_orderkey AS key, o_custkey, o_orderkey * 10 + o_custkey AS tag FROM orders")
def map_with_index(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey"], pos="o_orderkey")
    return frame.map_with_index(cols("o_custkey").as_("long"), "tag", lambda k, v: k * 10 + v).result()


@_query("SELECT event_id AS key, event_type FROM events WHERE event_id % 3 = 0")
def filter_row_keys(spark, sf_dir):
    return Frame.from_df(_table(spark, sf_dir, "events"), "event_id", ["event_type"], "event_id").filter_row_keys(lambda k: k % 3 == 0).result()


@_query(_EV + "SELECT event_id AS key, round(v, 3) AS v FROM ev WHERE v > 50")
def filter_by_values(spark, sf_dir):
    return _out(_events(spark, sf_dir, "event_id").filter_by_values(lambda v: v > 50))


@_query(_EV + "SELECT event_id AS key, round(v, 3) AS v, nm FROM ev WHERE event_id % 2 = 0 AND (v IS NULL OR v < 20)")
def filter_entries(spark, sf_dir):
    return _out(_events(spark, sf_dir, "event_id").filter_entries(lambda k, c: (k % 2 == 0) & (c.is_non_value | (c.v < 20))))


@_query(_EV + "SELECT v AS key, user_id FROM ev WHERE v IS NOT NULL")
def reindex_drop_nonvalue(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "events"), "event_id", {"v": _v(), "user_id": "user_id"}, "event_id", {"v": _nm()})
    return frame.reindex(cols("v").as_("double")).drop_columns("v").result()


@_query("SELECT o_orderpriority AS key, o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS place FROM orders")
def group_sorted(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_orderpriority"], "o_orderkey")
    grouped = frame.group(cols("o_orderpriority").as_("string")).drop_columns("o_orderpriority")
    placed = positions.dense(grouped.df, grouped.order)
    return placed.select(F.col("__k").alias("key"), F.col("c0").alias("o_orderkey"), F.col("__at").alias("place"))


@_query(_EV + "SELECT event_id AS key, row_number() OVER (ORDER BY CASE WHEN v IS NOT NULL THEN 2 WHEN nm THEN 1 ELSE 0 END, v, event_id) - 1 AS place FROM ev")
def sort_by_cells(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "events"), "event_id", {"v": _v()}, "event_id", {"v": _nm()})
    by = frame.sort_by(cols("v").as_("double"))
    return positions.dense(by.df, by.order).select(F.col("__k").alias("key"), F.col("__at").alias("place"))


def _two_sides(spark, sf_dir):
    """Whole tables under keys of which each side lacks some: customers stand at one and a half times their key."""
    orders = Frame.from_df(_table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_totalprice"], "o_orderkey")
    shifted = F.floor(F.col("c_custkey") * 3 / 2)
    return orders, Frame.from_df(_table(spark, sf_dir, "customer"), shifted, ["c_name"], "c_custkey")


_SIDES = "WITH o AS (SELECT * FROM orders), c AS (SELECT CAST(floor(c_custkey * 3 / 2.0) AS BIGINT) AS c_custkey, c_name FROM customer)\n"


def _join_query(how: str, sql: str):
    def run(spark, sf_dir):
        left, right = _two_sides(spark, sf_dir)
        return left.join(right, how).result()

    run.__name__ = f"join_{how}"
    _query(_SIDES + f"SELECT coalesce(o_custkey, c_custkey) AS key, o_orderkey, o_totalprice, c_name FROM o {sql} JOIN c ON o_custkey = c_custkey")(run)


for _how, _join in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _join_query(_how, _join)


@_query("SELECT c_nationkey AS key, c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def join_cross_in_key(spark, sf_dir):
    a = Frame.from_df(_table(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"], "c_custkey")
    b = Frame.from_df(_table(spark, sf_dir, "supplier"), "s_nationkey", ["s_suppkey"], "s_suppkey")
    return a.join(b).result()


_OCC = """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT coalesce(o_custkey, user_id) AS key, o_orderkey, event_id FROM o {} JOIN e ON o_custkey = user_id AND o.i = e.i"""


def _merged(spark, sf_dir, how):
    a = Frame.from_df(_table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], "o_orderkey")
    b = Frame.from_df(_table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_id")
    return a.merge(b, how).result()


@_query(_OCC.format("INNER"))
def merge_inner(spark, sf_dir):
    return _merged(spark, sf_dir, "inner")


@_query(_OCC.format("FULL"))
def merge_outer(spark, sf_dir):
    return _merged(spark, sf_dir, "outer")


# series pairs: two event types, keyed by user

_PAIR = _EV + """, a AS (SELECT user_id, v, nm, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ev WHERE event_id % 2 = 0),
b AS (SELECT user_id, v, nm, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ev WHERE event_id % 2 = 1),
m AS (SELECT coalesce(a.user_id, b.user_id) AS key, a.v AS x, b.v AS y, coalesce(a.nm, false) AS xm, coalesce(b.nm, false) AS ym FROM a FULL JOIN b ON a.user_id = b.user_id AND a.i = b.i)
"""


def _pair(spark, sf_dir):
    df = _table(spark, sf_dir, "events")
    return tuple(Series.from_df(df.where(F.col("event_id") % 2 == i), "user_id", _v(), "event_id", _nm()) for i in (0, 1))


@_query(_EV + """SELECT a.user_id AS key, round(a.v * b.v, 6) AS v,
  (a.nm OR b.nm) AND NOT (a.v IS NULL AND NOT a.nm) AND NOT (b.v IS NULL AND NOT b.nm) AS nm
FROM ev a JOIN ev b ON a.user_id = b.user_id WHERE a.event_id % 2 = 0 AND b.event_id % 2 = 1""")
def series_zip_map(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return _out(a.zip_map(b, lambda x, y: x * y), 6)


@_query(_PAIR + """SELECT key, CASE WHEN xm OR ym THEN NULL ELSE round(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x - y WHEN x IS NOT NULL THEN x * 2 ELSE -y END, 3) END AS v, xm OR ym AS nm FROM m""")
def series_combine(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return _out(a.combine(b, lambda x: x * 2, lambda y: -y, lambda x, y: x - y))


@_query(_PAIR + "SELECT key, CASE WHEN xm OR ym THEN NULL ELSE round(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x + y ELSE coalesce(x, y) END, 3) END AS v, xm OR ym AS nm FROM m")
def series_merge_add(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return _out(a.merge(b))


@_query(_PAIR + "SELECT key, round(coalesce(x, y), 3) AS v, coalesce(x, y) IS NULL AND (xm OR ym) AS nm FROM m")
def series_or_else(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return _out(a.or_else(b))


@_query("""SELECT c_nationkey AS key, c_acctbal AS acctbal, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_nationkey, s_acctbal, s_name, NULL FROM supplier""")
def append_rows_missing_cols(spark, sf_dir):
    a = Frame.from_df(_table(spark, sf_dir, "customer"), "c_nationkey", {"name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment"}, "c_custkey")
    b = Frame.from_df(_table(spark, sf_dir, "supplier"), "s_nationkey", {"acctbal": "s_acctbal", "name": "s_name"}, "s_suppkey")
    return a.append_rows(b).result()


@_query(_EV + "SELECT event_id AS key, round(v, 3) AS v, nm FROM ev UNION ALL SELECT user_id, round(v, 3), nm FROM ev")
def series_concat(spark, sf_dir):
    return _out(_events(spark, sf_dir, "event_id").concat(_events(spark, sf_dir, "user_id")))


@_query("""SELECT coalesce(c_nationkey, s_nationkey) AS key, c_custkey, s_suppkey FROM
(SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer)
FULL JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS j FROM supplier) ON c_nationkey = s_nationkey AND i = j""")
def append_cols(spark, sf_dir):
    a = Frame.from_df(_table(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"], "c_custkey")
    b = Frame.from_df(_table(spark, sf_dir, "supplier"), "s_nationkey", ["s_suppkey"], "s_suppkey")
    return a.append_cols(b).result()


# reducers by key


def _reduced(name: str, make, expr: str, guard: bool = True, digits: int | None = 3, kind: str = ""):
    shown = f"round({expr}, {digits})" if digits is not None else expr
    shown = f"CASE WHEN bool_or(nm) THEN NULL ELSE {shown} END" if guard else shown
    sql = _EV + f"SELECT user_id AS key, {shown} AS v{', bool_or(nm) AS nm' if guard else ''} FROM ev GROUP BY user_id"

    def run(spark, sf_dir):
        return _out(_events(spark, sf_dir).reduce_by_key(make()), digits)

    run.__name__ = name
    _query(sql)(run)


_reduced("count_by_key", R.Count, "count(v)", digits=None)
_reduced("sum_by_key", R.Sum, "coalesce(sum(v), 0)")
_reduced("sum_non_empty_by_key", R.SumNonEmpty, "sum(v)")
_reduced("mean_by_key", R.Mean, "avg(v)")
_reduced("median_by_key", R.Median, "median(v)")
_reduced("max_by_key", R.Max, "max(v)")
_reduced("min_by_key", R.Min, "min(v)")
_reduced("exists_by_key", lambda: R.Exists(lambda v: v > 90), "coalesce(bool_or(v > 90), false)", guard=False, digits=None)
_reduced("forall_by_key", lambda: R.ForAll(lambda v: v < 95), "coalesce(bool_and(v < 95), true) AND NOT bool_or(nm)", guard=False, digits=None)


@_query(_EV + "SELECT user_id AS key, CASE WHEN bool_or(nm) THEN NULL ELSE round(coalesce(product(1 + v / 1e6), 1), 6) END AS v, bool_or(nm) AS nm FROM ev GROUP BY 1")
def product_by_key(spark, sf_dir):
    return _out(_events(spark, sf_dir).map_values(lambda v: 1 + v / 1e6).product_by_key(), 6)


@_query(_EV + "SELECT user_id AS key, CASE WHEN bool_or(nm) THEN NULL ELSE round(product(1 + v / 1e6), 6) END AS v, bool_or(nm) AS nm FROM ev GROUP BY 1")
def product_non_empty_by_key(spark, sf_dir):
    return _out(_events(spark, sf_dir).map_values(lambda v: 1 + v / 1e6).product_non_empty_by_key(), 6)


@_query(_EV + "SELECT user_id AS key, CASE WHEN bool_or(nm) THEN NULL ELSE array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE v IS NOT NULL)), ',') END AS v, bool_or(nm) AS nm FROM ev GROUP BY 1")
def unique_by_key(spark, sf_dir):
    s = Series.from_df(_table(spark, sf_dir, "events"), "user_id", F.when(_v().isNotNull(), F.col("event_type")), "event_id", _nm())
    got = s.unique_by_key()
    # an empty set shows as no text
    return _out(Series(got.df.withColumn("v", F.when(F.size("v") > 0, F.array_join("v", ","))), got.order), None)


@_query("SELECT l_returnflag AS key, round(quantile_cont(l_extendedprice, 0.25), 3) AS q25, round(quantile_cont(l_extendedprice, 0.5), 3) AS q50, round(quantile_cont(l_extendedprice, 0.9), 3) AS q90 FROM lineitem GROUP BY 1")
def quantile_by_key(spark, sf_dir):
    s = Series.from_df(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "l_orderkey").reduce_by_key(R.Quantile([0.25, 0.5, 0.9]))
    return s.df.select(F.col("__k").alias("key"), *(F.round(F.col("v")[i]["value"], 3).alias(n) for i, n in enumerate(("q25", "q50", "q90"))))


@_query("""WITH q AS (SELECT l_returnflag AS key, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
SELECT key, CASE WHEN lo <= a - (b - a) * 0.5 THEN round(a - (b - a) * 0.5, 3) END AS lower, CASE WHEN hi >= b + (b - a) * 0.5 THEN round(b + (b - a) * 0.5, 3) END AS upper FROM q""")
def outliers_by_key(spark, sf_dir):
    s = Series.from_df(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "l_orderkey").reduce_by_key(R.Outliers(0.5))
    return s.df.select(F.col("__k").alias("key"), F.round("v.lower", 3).alias("lower"), F.round("v.upper", 3).alias("upper"))


_EDGE = _EV + """SELECT user_id AS key, round(arg_{0}(v, event_id) FILTER (WHERE v IS NOT NULL AND event_id = e), 3) AS v, coalesce(bool_or(nm AND event_id = e), false) AS nm
FROM (SELECT *, {0}(CASE WHEN v IS NOT NULL OR nm THEN event_id END) OVER (PARTITION BY user_id) AS e FROM ev) GROUP BY user_id"""


@_query(_EDGE.format("min"))
def first_by_key(spark, sf_dir):
    return _out(_events(spark, sf_dir).first_by_key())


@_query(_EDGE.format("max"))
def last_by_key(spark, sf_dir):
    return _out(_events(spark, sf_dir).last_by_key())


_EDGE_N = _EV + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id {0}) AS i FROM ev WHERE v IS NOT NULL OR nm),
k AS (SELECT user_id, bool_or(nm) AS nm, count(*) AS n, string_agg(CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY event_id) AS vs FROM r WHERE i <= 2 GROUP BY 1)
SELECT u.user_id AS key, CASE WHEN n = 2 AND NOT nm THEN vs END AS v, coalesce(nm, false) AS nm FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN k ON u.user_id = k.user_id"""


def _joined(s: Series) -> DataFrame:
    return s.result().withColumn("v", F.array_join(F.transform("v", lambda x: F.round(x * 100).cast("bigint").cast("string")), ","))


@_query(_EDGE_N.format("ASC"))
def first_n_by_key(spark, sf_dir):
    return _joined(_events(spark, sf_dir).first_n_by_key(2))


@_query(_EDGE_N.format("DESC"))
def last_n_by_key(spark, sf_dir):
    return _joined(_events(spark, sf_dir).last_n_by_key(2))


@_query("SELECT user_id AS key, coalesce(string_agg(event_type, '' ORDER BY event_id) FILTER (WHERE event_id % 7 <> 0), '') AS v FROM events GROUP BY 1")
def monoid_concat_by_key(spark, sf_dir):
    present = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    return _out(Series.from_df(_table(spark, sf_dir, "events"), "user_id", present, "event_id").reduce_by_key(R.MonoidReducer("", lambda a, b: F.concat(a, b))), None)


@_query("SELECT user_id AS key, string_agg(event_type, '>' ORDER BY event_id) AS v FROM events GROUP BY 1")
def semigroup_concat_by_key(spark, sf_dir):
    s = Series.from_df(_table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")
    return _out(s.reduce_by_key(R.SemigroupReducer(lambda a, b: F.concat(a, F.lit(">"), b))), None)


# reducers into and over frames


@_query("SELECT o_orderkey AS key, o_totalprice, round((SELECT avg(o_totalprice) FROM orders), 3) AS mean FROM orders")
def reduce_into_frame(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"], "o_orderkey")
    return frame.reduce(cols("o_totalprice").as_("double"), "mean", R.Mean()).result().withColumn("mean", F.round("mean", 3))


@_query("SELECT o_custkey AS key, o_orderkey, round(max(o_totalprice) OVER (PARTITION BY o_custkey), 3) AS best FROM orders")
def reduce_by_key_into_frame(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_totalprice"], "o_orderkey")
    return frame.reduce_by_key(cols("o_totalprice").as_("double"), "best", R.Max()).drop_columns("o_totalprice").result().withColumn("best", F.round("best", 3))


_MEASURES = ("l_quantity", "l_discount", "l_extendedprice")


@_query(" UNION ALL ".join(f"SELECT '{c}' AS key, round(avg({c}), 3) AS v, false AS nm FROM lineitem" for c in _MEASURES) + " UNION ALL SELECT 'l_returnflag', NULL, true")
def reduce_frame(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "lineitem"), "l_orderkey", [*_MEASURES, "l_returnflag"], "l_partkey")
    return _out(frame.reduce_frame(R.Mean()))


@_query("SELECT l_returnflag AS key, round(avg(l_quantity), 3) AS l_quantity, round(avg(l_discount), 3) AS l_discount FROM lineitem GROUP BY 1")
def reduce_frame_by_key(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"], "l_orderkey")
    return frame.reduce_frame_by_key(R.Mean()).result().select("key", *(F.round(c, 3).alias(c) for c in ("l_quantity", "l_discount")))


@_query("SELECT 'c_nationkey' AS key, count(*) AS v, false AS nm FROM customer UNION ALL SELECT 'c_custkey', count(*), false FROM customer")
def reduce_frame_with_col(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "customer"), "c_custkey", {"c_acctbal": "c_acctbal", "c_nationkey": "c_nationkey", "c_custkey": F.col("c_custkey")}, "c_custkey")
    return _out(frame.reduce_frame_with_col("c_acctbal", R.Count()), None)


@_query("SELECT c_nationkey AS key, c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 3) AS off FROM customer")
def map_row_groups(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey", "c_acctbal"], "c_custkey")
    out = frame.map_row_groups(lambda k, g: g.assign(off=(g.c_acctbal - g.c_acctbal.mean()))[["c_custkey", "off"]], "c_custkey bigint, off double")
    return out.result().withColumn("off", F.round("off", 3))


@_query("SELECT coalesce(a.k, b.k) AS key, coalesce(n, 0) AS customers, coalesce(m, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY 1) b ON a.k = b.k")
def cogroup_counts(spark, sf_dir):
    import pandas as pd

    a = Frame.from_df(_table(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"], "c_custkey")
    b = Frame.from_df(_table(spark, sf_dir, "supplier"), "s_nationkey", ["s_suppkey"], "s_suppkey")
    return a.cogroup(b, lambda k, x, y: pd.DataFrame({"customers": [len(x)], "suppliers": [len(y)]}), "customers bigint, suppliers bigint").result()


# along the order

_ROLL = _EV + """, l AS (SELECT *, max(CASE WHEN v IS NOT NULL OR nm THEN event_id END) OVER ({0} ORDER BY event_id) AS e FROM ev)
SELECT l.{1} AS key, round(ev.v, 3) AS v, coalesce(ev.nm, false) AS nm FROM l LEFT JOIN ev ON ev.event_id = l.e{2}"""


@_query(_ROLL.format("", "event_id", ""))
def roll_forward(spark, sf_dir):
    return _out(_events(spark, sf_dir, "event_id").roll_forward())


@_query(_ROLL.format("PARTITION BY user_id", "user_id", ""))
def roll_forward_by_key(spark, sf_dir):
    return _out(_events(spark, sf_dir).roll_forward(by=["__k"]))


@_query(_EV + """, s AS (SELECT *, event_id + CASE WHEN event_id % 7 = 0 THEN event_id % 3 ELSE 0 END AS k FROM ev), l AS (SELECT *, max(CASE WHEN v IS NOT NULL OR nm THEN event_id END) OVER (ORDER BY event_id) AS e FROM s)
SELECT l.k AS key, round(s.v, 3) AS v, coalesce(s.nm, false) AS nm FROM l LEFT JOIN s ON s.event_id = l.e AND l.k - s.k <= 2""")
def roll_forward_up_to(spark, sf_dir):
    """Keys of missing cells lie one, two or three beyond the cell before."""
    s = _events(spark, sf_dir, "event_id").map_keys(lambda k: k + F.when(k % 7 == 0, k % 3).otherwise(0))
    return _out(s.roll_forward_up_to(2))


@_query(_EV + "SELECT event_id AS key, round(lag(v, 3) OVER (ORDER BY event_id), 3) AS v, coalesce(lag(nm, 3) OVER (ORDER BY event_id), false) AS nm FROM ev")
def shift(spark, sf_dir):
    return _out(_events(spark, sf_dir, "event_id").shift(3))


@_query(_EV + "SELECT 'first' AS which, event_id AS key, round(v, 3) AS v FROM (SELECT * FROM ev WHERE v > 99 ORDER BY event_id LIMIT 1) UNION ALL SELECT 'last', event_id, round(v, 3) FROM (SELECT * FROM ev WHERE v > 99 ORDER BY event_id DESC LIMIT 1)")
def find_first_last(spark, sf_dir):
    s = _events(spark, sf_dir, "event_id")
    hits = [("first", s.find_asc(lambda k, c: c.v > 99)), ("last", s.find_desc(lambda k, c: c.v > 99))]
    return spark.createDataFrame([(w, k, float(v)) for w, h in hits if h for k, v in [h]], "which string, key bigint, v double").withColumn("v", F.round("v", 3))


@_query(_EV + "SELECT event_id AS key, round(v, 3) AS v FROM (SELECT * FROM ev WHERE v IS NOT NULL AND abs(event_id - 49) <= 5 ORDER BY event_id LIMIT 1)")
def closest_key(spark, sf_dir):
    hit = _events(spark, sf_dir, "event_id").closest_key_to(49, 5)
    return spark.createDataFrame([(hit[0], float(hit[1]))] if hit else [], "key bigint, v double").withColumn("v", F.round("v", 3))


_HIST = "SELECT b * 10.0 AS bucket_low, b * 10.0 + 10 AS bucket_high, {} FROM range(10) r(b) LEFT JOIN (SELECT least(CAST(floor(v / 10) AS BIGINT), 9) AS i, count(*) AS n FROM ev WHERE v BETWEEN 0 AND 100 GROUP BY 1) ON i = b"


@_query(_EV + "SELECT CAST(bucket_low AS DOUBLE) AS bucket_low, CAST(bucket_high AS DOUBLE) AS bucket_high, n FROM (" + _HIST.format("coalesce(n, 0) AS n") + ")")
def histogram(spark, sf_dir):
    return _events(spark, sf_dir).histogram(10, 0, 100)


@_query(_EV + "SELECT CAST(bucket_low AS DOUBLE) AS bucket_low, CAST(bucket_high AS DOUBLE) AS bucket_high, share FROM (" + _HIST.format("round(coalesce(n, 0) / (SELECT count(*) FROM ev), 6) AS share") + ")")
def normalized_histogram(spark, sf_dir):
    return _events(spark, sf_dir).normalized_histogram(10, 0, 100).withColumn("share", F.round("share", 6))


@_query(" UNION ALL ".join(f'SELECT \'{c}\' AS "column", round(avg({c}), 3) AS "Mean", round(median({c}), 3) AS "Median", round(max({c}), 3) AS "Max", round(min({c}), 3) AS "Min", false AS nm FROM part' for c in ("p_size", "p_retailprice")))
def summary_frame(spark, sf_dir):
    s = Frame.from_df(_table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"], "p_partkey").summary()
    return s.select("column", *(F.round(c, 3).alias(c) for c in ("Mean", "Median", "Max", "Min")), "nm")


@_query("SELECT 'n_nationkey' AS key, " + ", ".join(f'CAST((SELECT n_nationkey FROM nation WHERE n_nationkey = {i}) AS INTEGER) AS "{i}"' for i in range(25)) + " UNION ALL SELECT 'n_regionkey', " + ", ".join(f"(SELECT n_regionkey FROM nation WHERE n_nationkey = {i})" for i in range(25)))
def transpose_small(spark, sf_dir):
    return Frame.from_df(_table(spark, sf_dir, "nation"), "n_nationkey", {"n_nationkey": F.col("n_nationkey"), "n_regionkey": "n_regionkey"}, "n_nationkey").transpose().result()


# casts and selectors


@_query("SELECT o_orderkey AS key, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(o_totalprice AS INTEGER) END AS v, o_totalprice <> floor(o_totalprice) AS nm FROM orders")
def cast_checked_int(spark, sf_dir):
    return _out(Frame.from_df(_table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"], "o_orderkey").column("o_totalprice", "int"), None)


@_query("SELECT o_orderkey AS key, CAST(NULL AS DOUBLE) AS v, true AS nm FROM orders")
def cast_text_is_nm(spark, sf_dir):
    return _out(Frame.from_df(_table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderstatus"], "o_orderkey").column("o_orderstatus", "double"), None)


def _cells(spark, sf_dir) -> Frame:
    return Frame.from_df(_table(spark, sf_dir, "events"), "event_id", {"v": _v(), "user_id": "user_id", "type": "event_type"}, "event_id", {"v": _nm()})


@_query(_EV + "SELECT event_id AS key, CASE WHEN v IS NOT NULL THEN event_type || ':' || user_id END AS v, nm FROM ev")
def selector_tuple(spark, sf_dir):
    return _out(_cells(spark, sf_dir).get(cols("type", "user_id", "v").as_("string", "long", "double").map(lambda t: F.concat(t["_1"], F.lit(":"), t["_2"].cast("string")))), None)


@_query(_EV + "SELECT event_id AS key, round(coalesce(v, 0) + user_id, 3) AS v FROM ev")
def selector_list(spark, sf_dir):
    pick = cols("v", "user_id").as_list("double").map(lambda a: F.aggregate(a, F.lit(0.0), lambda s, c: s + F.coalesce(c["v"], F.lit(0.0))))
    return _out(_cells(spark, sf_dir).get(pick))


@_query(_EV + "SELECT event_id AS key, round(coalesce(v, CAST(user_id AS DOUBLE)), 3) AS v FROM ev")
def selector_or_else(spark, sf_dir):
    return _out(_cells(spark, sf_dir).get(cols("v").as_("double").or_else(cols("user_id").as_("double"))))


@_query(_EV + "SELECT event_id AS key, round(CASE WHEN nm THEN -2 WHEN v IS NULL THEN -1 ELSE v END, 3) AS v FROM ev")
def selector_recover(spark, sf_dir):
    return _out(Series(_cells(spark, sf_dir).get(cols("v").as_("double").recover(na=-1.0, nm=-2.0)).df))


@_query(_EV + "SELECT event_id AS key, round(CASE event_type WHEN 'click' THEN v WHEN 'error' THEN user_id ELSE 0 END, 3) AS v, event_type = 'click' AND nm AS nm FROM ev")
def selector_flatmap(spark, sf_dir):
    pick = cols("type").as_("string").flat_map({"click": cols("v").as_("double"), "error": cols("user_id").as_("double")}, cols("v").as_("double").cell_map(lambda c: value(0.0)))
    return _out(_cells(spark, sf_dir).get(pick))


@_query(_EV + "SELECT event_id AS key, round(CASE WHEN v IS NOT NULL THEN v * user_id END, 3) AS v, nm FROM ev")
def selector_zip(spark, sf_dir):
    return _out(_cells(spark, sf_dir).get(cols("v").as_("double").zip_with(cols("user_id").as_("double"), lambda a, b: a * b)))


@_query("SELECT l_orderkey * 10 + l_linenumber AS key, count(*) AS n, sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS meaningless FROM lineitem GROUP BY 1")
def safe_division(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    ratio = safe_div(Cell(F.col("l_tax")), Cell(F.col("l_discount")))
    s = Series.from_df(df, F.col("l_orderkey") * 10 + F.col("l_linenumber"), ratio.v, "l_partkey", ratio.is_nm)
    return s.df.groupBy(F.col("__k").alias("key")).agg(F.count("*").alias("n"), F.sum(F.col("nm").cast("bigint")).alias("meaningless"))


# indexes and files


@_query("SELECT 100 - n_nationkey AS key, n_name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 100 - n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def row_index_permute(spark, sf_dir):
    frame = Frame.from_df(_table(spark, sf_dir, "nation"), "n_nationkey", ["n_name"], "n_nationkey")
    even = _table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select((100 - F.col("n_nationkey")).alias("key"), F.col("n_nationkey").alias("pointer"), (-F.col("n_nationkey")).alias("pos"))
    return frame.with_row_index(even.unionAll(even)).result()


@_query("SELECT n_regionkey AS key, n_name FROM nation WHERE n_regionkey = 2")
def row_group_lookup(spark, sf_dir):
    return Frame.from_df(_table(spark, sf_dir, "nation"), "n_regionkey", ["n_name"], "n_nationkey").get_row_group(2).result()


@_query("SELECT s_suppkey AS key, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def csv_roundtrip(spark, sf_dir):
    from lattica.sources import delimited as D

    path = f"{shared_folder(spark)}/csv-roundtrip"
    dialect = D.CSV.with_(header=True, row_delim=D.UNIX, row_delim_in_quotes=False)
    frame = Frame.from_df(_table(spark, sf_dir, "supplier"), "s_suppkey", ["s_name", "s_acctbal"], "s_suppkey")
    D.write(frame, path, dialect, "overwrite")
    back = D.parse_path(spark, path, dialect).to_frame()
    names = back.column("s_name", "string").to_frame("s_name").join(back.column("s_acctbal", "double").to_frame("s_acctbal"))
    return names.result(flags=False).withColumn("s_acctbal", F.round("s_acctbal", 2))


@_query(_EV + "SELECT event_id AS key, round(v, 3) AS v, nm, CAST(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n FROM ev")
def all_columns(spark, sf_dir):
    frame = _cells(spark, sf_dir).retain_columns("v")
    n = frame.get(all_cols().as_list("double").map(lambda a: F.size(F.filter(a, lambda c: c["v"].isNotNull()))))
    df = frame.join(n.to_frame("n")).result()
    return df.select("key", F.round("v", 3).alias("v"), F.col("v_nm").alias("nm"), "n")


from lattica import catalog_api  # noqa: E402, F401 (its queries join these)
