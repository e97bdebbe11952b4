"""Small scales and colours of the pages, as Spark expressions where data meets them, else as plain functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mismatch_level(frequency: Column, floor: float = 0.001) -> Column:
    """0 to 1 on a logarithmic scale: ``floor`` and less give 0, 1 gives 1."""
    decades = -math.log10(floor)
    return F.when(frequency <= floor, F.lit(0.0)).when(frequency >= 1, F.lit(1.0)).otherwise((F.log10(frequency) + decades) / decades)


def window_bounds(center: Column, ref_len: Column, columns: int = 90) -> tuple[Column, Column]:
    """Start and end of a window of ``columns`` around ``center``, shifted to stay inside."""
    start = F.greatest(F.lit(0), F.least(center - columns // 2, ref_len - columns))
    return start, F.least(ref_len, start + columns)


def cell_width(n: int) -> int:
    """Pixels a base: 4, 3 or 2 as the reference grows."""
    return 4 if n < 200 else 3 if n < 500 else 2


def nice_step(length: int, ticks: int = 10) -> int:
    """The ruler step of 1, 2, 2.5 or 5 times a power of ten that gives at most ``ticks`` ticks."""
    raw = max(1.0, length / ticks)
    power = 10 ** math.floor(math.log10(raw))
    return max(1, math.ceil(next(m for m in (1, 2, 2.5, 5, 10) if m * power >= raw) * power))


def rgb(color: str) -> tuple[int, int, int]:
    digits = color.lstrip("#")
    digits = "".join(2 * c for c in digits) if len(digits) == 3 else digits
    return int(digits[:2], 16), int(digits[2:4], 16), int(digits[4:6], 16)


def luminance(color: str) -> float:
    """Relative luminance of sRGB."""
    linear = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in rgb(color)]
    return 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]


def mix(color: str, other: str, share: float) -> str:
    return "#" + "".join(f"{round(a + (b - a) * share):02x}" for a, b in zip(rgb(color), rgb(other)))


def label_color(fill: str) -> str:
    """Black or white, whichever contrasts more."""
    light = luminance(fill)
    return "#000000" if (light + 0.05) / 0.05 >= 1.05 / (light + 0.05) else "#ffffff"
