"""Values as text: shortest floats that read back the same, always with a decimal point."""

from __future__ import annotations

import numpy as np


def format_float(x: float, single: bool = False) -> str:
    """Like 1.0, 0.1, 12345678.9, 1e16, 1e-5, NaN, inf, -0.0."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    value = np.float32(x) if single else np.float64(x)
    size = abs(float(x))
    if size != 0 and (size >= 1e16 or size < 1e-4):
        digits, _, power = np.format_float_scientific(value, trim="-").partition("e")
        return f"{digits}e{int(power)}"
    return np.format_float_positional(value, unique=True, trim="0")


def format_value(x: object, single: bool = False) -> str:
    if x is None:
        return ""
    if isinstance(x, float):
        return format_float(x, single)
    return str(x)
