"""A PySpark-native engine for labelled frames and series.

>>> from lattica import Frame, cols, reducers as r
>>> frame = Frame.from_df(df, row_key="id")
>>> frame.filter(cols("qty").as_("double"), lambda v: v > 10).group(cols("flag").as_("string")).get(cols("price").as_("double")).mean_by_key()
"""

from lattica.functions import reducers
from lattica.functions.cells import Cell, not_available, not_meaningful, value
from lattica.plans.frame import Frame
from lattica.plans.select import all_cols, all_rows, cols, rows
from lattica.plans.series import NA, NM, Series

__all__ = ["NA", "NM", "Cell", "Frame", "Series", "all_cols", "all_rows", "cols", "not_available", "not_meaningful", "reducers", "rows", "value"]
