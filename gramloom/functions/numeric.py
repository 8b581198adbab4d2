"""Rounding helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RANK_DIGITS = 10


def significant(col: Column, digits: int = 8) -> Column:
    """Round a double to ``digits`` significant digits (and turn -0.0 into 0.0)."""
    rounded = F.format_string(f"%.{digits - 1}e", col.cast("double")).cast("double") + F.lit(0.0)
    return F.when(col.isNotNull(), rounded)


def rank_key(t: np.ndarray) -> np.ndarray:
    """|t| at the precision used for ranking, so that equal columns really tie."""
    size = np.abs(t)
    out = size.copy()
    ok = np.isfinite(size) & (size > 0)
    scale = 10.0 ** (RANK_DIGITS - 1 - np.floor(np.log10(size[ok])))
    out[ok] = np.rint(size[ok] * scale) / scale
    return out
