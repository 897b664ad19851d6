"""Rows of frames in one comparable form."""

import math

import numpy as np
import pandas as pd


def _text(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return f"{x:.9g}"
    if isinstance(x, (list, np.ndarray)):
        return "[" + ",".join(map(_text, x)) + "]"
    return str(x)


def plain(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(_text(x) for x in row) for row in frame[columns].itertuples(index=False, name=None))
