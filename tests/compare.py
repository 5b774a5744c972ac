"""Comparison of two results without regard to the order of rows."""

import numpy as np
import pandas as pd


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None else str(x) if not isinstance(x, (float, int)) else x)
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str) if s.dtype == object else s).reset_index(drop=True)


def same(got: pd.DataFrame, wanted: pd.DataFrame) -> str:
    """ok, or what differs; exact says whether floats are equal to the last bit."""
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} {sorted(wanted.columns)}"
    if len(got) != len(wanted):
        return f"rows {len(got)} {len(wanted)}"
    got, wanted, exact = canonical(got), canonical(wanted), True
    for c in got.columns:
        a, b = got[c], wanted[c]
        if pd.api.types.is_float_dtype(a) or pd.api.types.is_float_dtype(b):
            x, y = a.to_numpy(float), b.to_numpy(float)
            exact &= bool(np.array_equal(x, y, equal_nan=True))
            if not np.allclose(x, y, rtol=1e-9, atol=1e-9, equal_nan=True):
                return f"values of {c}: {x[~np.isclose(x, y, equal_nan=True)][:3]} {y[~np.isclose(x, y, equal_nan=True)][:3]}"
        elif not (a.astype(str) == b.astype(str)).all():
            k = (a.astype(str) != b.astype(str)).idxmax()
            return f"values of {c}: {a[k]!r} {b[k]!r}"
    return "ok" if exact else "ok but for last bits"
