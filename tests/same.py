"""Compare two results as bags of rows, columns by name."""

import numpy as np
import pandas as pd


def _text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_, int, float, np.number)):
        return repr(round(float(v), 5) + 0.0)
    return str(v)


def bag(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].dt.tz_localize(None).astype("datetime64[us]")
        df[c] = df[c].map(_text)
    return sorted(map(tuple, df.itertuples(index=False)))
