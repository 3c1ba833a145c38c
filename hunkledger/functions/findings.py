"""Give findings from different producers one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FINDING_DEFAULTS


def as_findings(df: DataFrame, **columns: Column) -> DataFrame:
    """Project to the full finding shape; fields not given take their zero value."""
    out = []
    for name, (dtype, default) in FINDING_DEFAULTS.items():
        value = columns.get(name)
        if value is None:
            value = F.col(name) if name in df.columns else F.lit(default)
        out.append(value.cast(dtype).alias(name))
    return df.select(*out)
