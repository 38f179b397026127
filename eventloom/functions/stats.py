"""Statistics of few numbers, on the driver."""

from __future__ import annotations

import math


def normal_p(z: float | None) -> float | None:
    """Two-sided p-value of a standard normal statistic."""
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))
