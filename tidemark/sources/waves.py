"""What a charger draws for a pattern of set-points, and slot series on a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the fitted response: offset of the drawn current, rise rate, fall rate.
OFFSET, RISE, FALL = (0.0221, 0.2831), (0.0327, 0.3787), 4.0


def response(pattern, first_lag: float = 15.0, step_lag: float = 5.0, ramp: float | None = None, tau: int = 60) -> np.ndarray:
    """The current at seconds 1, 2, .. of a pattern: after a lag each step ramps to its level; a ramp that runs long delays the next."""
    total = tau * len(pattern)
    out, level, free = np.zeros(total), 0.0, 0
    for i in range(1, len(pattern)):
        target = pattern[i] - (OFFSET[0] * pattern[i] + OFFSET[1])
        begin = max(tau * i + int(round(first_lag if i == 1 else step_lag)), free)
        up = level < target
        rate = (ramp if ramp is not None else RISE[0] * (pattern[i] - pattern[i - 1]) + RISE[1]) if up else (FALL if ramp is None else min(FALL, ramp))
        n = int(np.ceil(abs(target - level) / rate - 1e-12)) if target != level else 0
        way = level + np.sign(target - level) * rate * np.arange(1, n + 1)
        way = np.minimum(way, target) if up else np.maximum(way, target)
        if begin < total:
            out[begin : begin + n] = way[: max(0, total - begin)]
            out[begin + n :] = target
        level, free = target, begin + n
    return np.round(out, 1)


def response_column(pattern: str, lag: Column | float = 15.0, ramp: Column | None = None) -> Column:
    """The current of a column of patterns; each distinct pattern of a batch is made once."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made: dict = {}
        for patterns, lags, ramps in batches:
            out = []
            for p, a, r in zip(patterns, lags, ramps, strict=True):
                key = (tuple(p), a, None if pd.isna(r) else r) if p is not None else None
                if key and key not in made:
                    if len(made) > 10_000:
                        made.clear()
                    made[key] = response(key[0], first_lag=a, ramp=key[2]).tolist()
                out.append(made[key] if key else None)
            yield pd.Series(out)

    lag = lag if isinstance(lag, Column) else F.lit(float(lag))
    return run(F.col(pattern), lag.cast("double"), (ramp if ramp is not None else F.lit(None)).cast("double"))


def slot_grid(points: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """(slot, t, value) of points (slot, t) over intervals (slot, st, et, wave): the wave repeats from just after the start; 0 outside; of several the last to start."""
    cell = lambda t: F.floor(t / width).cast("long")
    busy = intervals.withColumn("_c", F.explode(F.sequence(cell(F.col("st")), cell(F.col("et"))))).withColumnsRenamed({"slot": "_slot"})
    met = points.withColumn("_p", cell(F.col("t"))).join(busy, (F.col("slot") == F.col("_slot")) & (F.col("_p") == F.col("_c")) & (F.col("t") > F.col("st")) & (F.col("t") <= F.col("et")), "left")
    value = F.expr("get(wave, cast((t - st - 1) % size(wave) as int))")
    return met.groupBy("slot", "t").agg(F.coalesce(F.max_by(value, F.struct("st", "et")), F.lit(0.0)).alias("value"))
