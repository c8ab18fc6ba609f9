"""Python functions of groups: for what expressions cannot say. A group is held by one task."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from lattica.plans.frame import ColumnRef, Frame


def _named(frame: Frame):
    """The frame's rows with columns named by key, in order within a key."""
    parts = [F.col("__k"), F.struct(*frame.order).alias("__order"), *(F.col(c.v).alias(str(c.key)) for c in frame.columns)]
    return frame.df.select(*parts)


def _framed(df, schema: str, template: Frame) -> Frame:
    names = [f.name for f in df.schema if not f.name.startswith("__")]
    out = df.withColumnsRenamed({n: f"c{i}" for i, n in enumerate(names)})
    return Frame(out, [ColumnRef(n, f"c{i}") for i, n in enumerate(names)], ["__group", "__pos"], template.strict)


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.iloc[sorted(range(len(pdf)), key=lambda i: tuple(pdf["__order"].iloc[i].values() if isinstance(pdf["__order"].iloc[i], dict) else pdf["__order"].iloc[i]))].drop(columns="__order")


def map_row_groups(frame: Frame, f: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> Frame:
    """f(key, rows) for each row key, results stacked in key order; a result keeps the order that f gives it.

    rows has the cells' values by column key (missing as null); f returns columns as in schema and may set __k, the key.
    """
    key_type = dict(frame.df.dtypes)["__k"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(key[0], _ordered(pdf).drop(columns="__k").reset_index(drop=True)).copy()
        if "__k" not in out:
            out["__k"] = key[0]
        out["__group"], out["__pos"] = key[0], range(len(out))
        return out

    df = _named(frame).groupBy("__k").applyInPandas(run, f"{schema}, __k {key_type}, __group {key_type}, __pos bigint")
    return _framed(df, schema, frame)


def cogroup(left: Frame, right: Frame, f: Callable[[object, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> Frame:
    """f(key, left rows, right rows) for each key of either side, results stacked in key order."""
    key_type = dict(left.df.dtypes)["__k"]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = f(key[0], *(_ordered(x).drop(columns="__k").reset_index(drop=True) for x in (a, b))).copy()
        out["__k"], out["__group"], out["__pos"] = key[0], key[0], range(len(out))
        return out

    pair = _named(left).groupBy("__k").cogroup(_named(right).groupBy("__k"))
    return _framed(pair.applyInPandas(run, f"{schema}, __k {key_type}, __group {key_type}, __pos bigint"), schema, left)
