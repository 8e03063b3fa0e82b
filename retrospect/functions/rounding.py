"""Rounding to two places as printf does: by the double's exact value."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


@F.pandas_udf(DecimalType(5, 2))
def percent(x: pd.Series) -> pd.Series:
    """Built-in rounding works on the shortest decimal form and differs (2.675). Meant for the few
    rows of a profile, after all aggregation."""
    return x.map(lambda v: None if pd.isna(v) else Decimal("%.2f" % v))
