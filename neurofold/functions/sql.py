"""The scalar rules as SQL functions of a session; all but the rolling percentile stay in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.traces import rolling_rank

#: name: (parameters, result, body)
FUNCTIONS = {
    "round_half_away": ("x DOUBLE", "BIGINT", "CAST(sign(x) * floor(abs(x) + 0.5) AS BIGINT)"),
    "dff": ("f DOUBLE, f0 DOUBLE, offset DOUBLE", "DOUBLE", "(f - f0) / (greatest(f0, 0.0D) + offset)"),
    "linear_index": ("y BIGINT, x BIGINT, height BIGINT", "BIGINT", "(x - 1) * height + y"),
    "index_y": ("ind BIGINT, height BIGINT", "BIGINT", "pmod(ind - 1, height) + 1"),
    "index_x": ("ind BIGINT, height BIGINT", "BIGINT", "(ind - 1) DIV height + 1"),
}


def register(spark: SparkSession) -> list[str]:
    """Adds the functions to the session and returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")

    @F.pandas_udf("array<double>")
    def rolling_percentile(trace: pd.Series, window: pd.Series, percentile: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rolling_rank(np.asarray(t, np.float64), int(w), float(p)) if len(t) else [] for t, w, p in zip(trace, window, percentile, strict=True)])

    spark.udf.register("rolling_percentile", rolling_percentile)
    return [*FUNCTIONS, "rolling_percentile"]
