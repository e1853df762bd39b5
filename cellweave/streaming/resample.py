from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.series import method


def resample_stream(df: DataFrame, by: Sequence[str], every: str, how: str = "mean", late: str = "1 hour") -> DataFrame:
    """(by..., time, value) of tumbling windows of a stream with the columns time and value; rows over `late` too late are left out."""
    w = F.window("time", every)
    found = df.withWatermark("time", late).groupBy(*by, w.alias("_w")).agg(method(how)(F.col("value")).alias("value"))
    return found.select(*by, F.col("_w.start").alias("time"), "value")
