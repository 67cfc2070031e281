"""Sound levels of whole frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@F.pandas_udf(T.DoubleType())
def _levels(frames: pd.Series) -> pd.Series:
    def level(frame: bytes | None) -> float:
        n = len(frame or b"") // 2
        if not n:
            return 0.0
        waves = np.frombuffer(frame, dtype="<i2", count=n).astype(np.float64)
        return float(np.sqrt(waves @ waves / 32768.0**2 / n))

    return pd.Series([level(f) for f in frames], dtype="float64")


def rms(samples: Column) -> Column:
    """Root mean square of little-endian 16-bit PCM (binary), scaled to 0..1; 0 without samples."""
    return _levels(samples)
