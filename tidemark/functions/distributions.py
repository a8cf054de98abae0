"""Distribution tails as column functions: vectorised Arrow UDFs, for results that are few rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions import special


def _null(values, *inputs) -> pd.Series:
    out = pd.Series(np.asarray(values, float))
    return out.mask(out.isna() | np.logical_or.reduce([pd.isna(x).to_numpy() for x in inputs]))


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t; null for a null input."""
    return _null(special.t_sf2(t.fillna(0).to_numpy(), df.fillna(1).to_numpy()), t, df)


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return _null([float(special.t_ppf(a, b)) if a == a and b == b else np.nan for a, b in zip(p, df, strict=True)], p, df)


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _null(special.f_sf(f.fillna(0).to_numpy(), d1.fillna(1).to_numpy(float), d2.fillna(1).to_numpy(float)), f, d1, d2)


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return _null([special.chi2_sf(a, b) if a == a and b == b else np.nan for a, b in zip(x, df, strict=True)], x, df)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return _null(2 * special.norm_cdf(-np.abs(z.fillna(0).to_numpy())), z)
