"""Frames over streams: what needs no order works as it is.

A stream has no last row, so positions, joins by occurrence and anything sorted need a batch. Computed columns, filters,
re-keying and map-side combined reducers by key run on a streaming DataFrame like on any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.reducers import Reducer
from lattica.plans.frame import Frame
from lattica.plans.select import Selector


def stream_frame(df: DataFrame, row_key: str, columns: list[str] | None = None, nm: dict[str, Column] | None = None) -> Frame:
    """A frame over a streaming DataFrame; positions are all zero, as a stream's rows have no order."""
    if not df.isStreaming:
        raise ValueError("not a stream")
    return Frame.from_df(df, row_key, columns, pos=F.lit(0), nm=nm)


def reduce_by_key(frame: Frame, selector: Selector, reducer: Reducer) -> DataFrame:
    """(key, v, nm): a running aggregate by row key, for output modes complete or update; order-free reducers only."""
    return frame.get(selector).reduce_by_key(reducer).result()
