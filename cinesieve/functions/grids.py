"""Frame features as Column expressions over small pixel grids (array<bigint>, row-major).

All sums are integers, so any engine gets the same doubles. Whole features run inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinesieve.functions.columns import let

#: The scores' scales and the weights of the total.
SHARP_SCALE, CONTRAST_SCALE, COLOR_SCALE, MIDDLE = 600.0, 80.0, 80.0, 128.0
WEIGHTS = {"sharpness": 0.35, "colorfulness": 0.20, "brightness": 0.20, "contrast": 0.15, "composition": 0.10}


def gray(values: Column, scale: float = 40.0) -> Column:
    """Numbers around 0 as pixels around 128."""
    pixel = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + scale * x.cast("double") + 0.5))).cast("long")
    return F.transform(values, pixel)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def variance(xs: Column, n: int) -> Column:
    """Population variance of n integers: (n * sum of squares - square of the sum) / n**2."""
    return let(xs, lambda v: (n * total(F.transform(v, lambda x: x * x)) - F.pow(total(v).cast("double"), F.lit(2.0))) / float(n * n))


def _reflected(i: int, n: int) -> int:
    return -i if i < 0 else 2 * n - 2 - i if i >= n else i


def laplacian(px: Column, height: int = 8, width: int = 8) -> Column:
    """Sum of the four neighbours less four times the pixel; the border is reflected without its edge."""
    around = [[_reflected(y + dy, height) * width + _reflected(x + dx, width) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))] for y in range(height) for x in range(width)]
    places = F.array(*[F.array(*[F.lit(k) for k in four]) for four in around])
    return let(px, lambda p: F.transform(places, lambda four, i: F.get(p, F.get(four, F.lit(0))) + F.get(p, F.get(four, F.lit(1))) + F.get(p, F.get(four, F.lit(2))) + F.get(p, F.get(four, F.lit(3))) - 4 * F.get(p, i)))


def laplacian_variance(px: Column, height: int = 8, width: int = 8) -> Column:
    return variance(laplacian(px, height, width), height * width)


def sharpness(blur_score: Column) -> Column:
    return F.least(blur_score / SHARP_SCALE, F.lit(1.0))


def brightness(px: Column, n: int = 64) -> Column:
    return 1 - F.abs(total(px) / float(n) - MIDDLE) / MIDDLE


def contrast(px: Column, n: int = 64) -> Column:
    return F.least(F.sqrt(variance(px, n)) / CONTRAST_SCALE, F.lit(1.0))


def colorfulness(px: Column, pixels: int = 16, channels: int = 4) -> Column:
    """Mean distances of red to green and of their mean to blue; px holds blue, green, red and, beyond three, unused values."""

    def of(p: Column) -> Column:
        at = F.sequence(F.lit(0), F.lit(pixels - 1))
        b, g, r = (lambda i, c=c: F.get(p, i * channels + c) for c in range(3))
        red_green = F.transform(at, lambda i: F.abs(r(i) - g(i)))
        yellow_blue = F.transform(at, lambda i: F.abs(r(i) + g(i) - 2 * b(i)))  # twice the distance, to stay in integers
        return F.least((total(red_green) / float(pixels) + total(yellow_blue) / float(2 * pixels)) / COLOR_SCALE, F.lit(1.0))

    return let(px, of)


def weighted(**scores: Column) -> Column:
    """The weighted sum of the scores given, in the weights' order."""
    out = None
    for name, weight in WEIGHTS.items():
        if name in scores:
            out = scores[name] * weight if out is None else out + scores[name] * weight
    return out


def hamming_similarity(a: Column, b: Column, bits: int) -> Column:
    """1 - distance / bits of two array<bigint> hashes of equal length."""
    distance = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)
    return 1 - distance / float(bits)
