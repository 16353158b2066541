"""Rows of a Spark and of a DuckDB result in one comparable form."""

import math


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda x: "" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return list(frame.columns), sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))
