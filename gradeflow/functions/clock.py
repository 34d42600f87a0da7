"""Time helpers that do not depend on the session time zone for zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wall_micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a zone-free timestamp."""
    c = F.col(c) if isinstance(c, str) else c
    whole = F.unix_date(F.to_date(c)) * F.lit(86400).cast("long") + F.hour(c) * 3600 + F.minute(c) * 60
    micros = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return whole * 1_000_000 + micros


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of either kind of timestamp column."""
    return wall_micros(name) if dict(df.dtypes)[name] == "timestamp_ntz" else F.unix_micros(name)
