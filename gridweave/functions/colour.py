"""Colour functions as column expressions: gamma, HSL, HSV, XYZ, Lab, LCh, and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB primaries at D65 to XYZ and back, and the D50 white point.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.9642, 1.0, 0.8249)
EPSILON, KAPPA = 216.0 / 24389.0, 24389.0 / 27.0


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(v, F.lit(high)))


def mix(a: Column, b: Column, share: Column | float) -> Column:
    """`share` of a, the rest of b."""
    return a * share + b * (1 - share) if isinstance(share, float) else share * a + (1 - share) * b


def srgb_gamma(v: Column) -> Column:
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def srgb_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def gamma(v: Column, power: float, start: float, slope: float, add: float) -> Column:
    """A straight start, then a power curve."""
    return F.when(v <= start, v * slope).otherwise(F.pow(v, F.lit(1 / power)) * (1 + add) - add)


def matrix(m, *v: Column) -> tuple[Column, ...]:
    return tuple(sum((F.lit(w) * c for w, c in zip(row[1:], v[1:], strict=True)), F.lit(row[0]) * v[0]) for row in m)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return matrix(RGB_TO_XYZ[1:2], r, g, b)[0]


def saturation(r: Column, g: Column, b: Column) -> Column:
    most = F.greatest(r, g, b)
    return F.when(most > 0, (most - F.least(r, g, b)) / most).otherwise(0.0)


def _hue(r: Column, g: Column, b: Column) -> Column:
    """From 0 to 1; 0 for grey."""
    most, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    h = F.when(most == r, (g - b) / span).when(most == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span) / 6
    return F.when(span <= 0, 0.0).when(h < 0, h + 1).otherwise(h)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return _hue(r, g, b), saturation(r, g, b), F.greatest(r, g, b)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0))
        return v - v * s * clamp(F.least(k, 4 - k))

    return channel(5), channel(3), channel(1)


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    light = (most + least) / 2
    s = F.when(most <= least, 0.0).when(light <= 0.5, (most - least) / (most + least)).otherwise((most - least) / (2 - most - least))
    return _hue(r, g, b), s, light


def hsl_to_rgb(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 12, F.lit(12.0))
        return light - s * F.least(light, 1 - light) * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))

    return channel(0), channel(8), channel(4)


def xyz_to_lab(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    f = lambda v, w: F.when(v / w > EPSILON, F.cbrt(v / w)).otherwise((KAPPA * v / w + 16) / 116)
    fx, fy, fz = (f(v, w) for v, w in zip((x, y, z), WHITE, strict=True))
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def lab_to_xyz(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    fy = (light + 16) / 116
    fx, fz = fy + a / 500, fy - b / 200
    g = lambda f, w: w * F.when(f * f * f > EPSILON, f * f * f).otherwise((116 * f - 16) / KAPPA)
    return g(fx, WHITE[0]), F.lit(WHITE[1]) * F.when(light > KAPPA * EPSILON, fy * fy * fy).otherwise(light / KAPPA), g(fz, WHITE[2])


def lab_to_lch(a: Column, b: Column) -> tuple[Column, Column]:
    return F.hypot(a, b), F.atan2(b, a)


def lch_to_lab(c: Column, h: Column) -> tuple[Column, Column]:
    return c * F.cos(h), c * F.sin(h)


def soft_light(v: Column, strength: float) -> Column:
    """v v (3 - 2 v) in gamma space, blended in."""
    g = srgb_gamma(clamp(v))
    return srgb_linear(mix(g * g * (3 - 2 * g), g, strength))


def film_negative(v: Column, reference: float, exponent: float, most: float = 1.0) -> Column:
    """A power law through the reference, inverted."""
    return F.least(F.pow(F.greatest(v, F.lit(1e-6)) / reference, F.lit(-exponent)), F.lit(most))


def vignette(y: Column, x: Column, size: int, strength: float) -> Column:
    """Gain by the squared distance from the centre, 1 there."""
    c = (size - 1) / 2
    d = ((y - c) * (y - c) + (x - c) * (x - c)) / (2 * c * c)
    return 1 + strength * d


def gradient(y: Column, x: Column, size: int, angle: float, feather: float, stops: float) -> Column:
    """A smooth ramp across a line through the centre, down to `stops` powers of two."""
    from math import cos, sin

    c = (size - 1) / 2
    t = clamp(((y - c) * cos(angle) - (x - c) * sin(angle)) / (feather * size) + 0.5)
    return F.pow(F.lit(2.0), -stops * t * t * (3 - 2 * t))


def compress_gamut(v: Column, achromatic: Column, threshold: float, limit: float, power: float) -> Column:
    """Distance from the achromatic axis beyond a threshold is pressed together so that `limit` lands on 1."""
    d = F.when(achromatic == 0, 0.0).otherwise((achromatic - v) / F.abs(achromatic))
    scale = (limit - threshold) / ((((1 - threshold) / (limit - threshold)) ** -power - 1) ** (1 / power))
    n = (d - threshold) / scale
    pressed = threshold + scale * n / F.pow(1 + F.pow(F.greatest(n, F.lit(0.0)), F.lit(power)), F.lit(1 / power))
    return achromatic - F.when(d < threshold, d).otherwise(pressed) * F.abs(achromatic)


def band_gains(v: Column, gains: tuple[float, ...], width: float = 1.0) -> Column:
    """Tone equaliser: gaussian bands of exposure, two stops apart, each with a gain in stops."""
    ev = F.log2(F.greatest(v, F.lit(1e-4)))
    top, under = F.lit(0.0), F.lit(0.0)
    for k, g in enumerate(gains):
        w = F.exp(-(ev + 2.0 * (len(gains) - 1 - k)) * (ev + 2.0 * (len(gains) - 1 - k)) / (2 * width * width * 4))
        top, under = top + w * g, under + w
    return v * F.pow(F.lit(2.0), top / under)


def lookup(v: Column, table: list[float], clip_below: bool = True, clip_above: bool = True) -> Column:
    """Linear between the entries of a table; beyond its ends the last value, or the line through the last two."""
    from math import inf

    last = len(table) - 1
    values = F.array(*(F.lit(float(t)) for t in table))
    k = F.greatest(F.lit(0), F.least(F.floor(v), F.lit(last - 1))).cast("int")
    low, high = F.get(values, k), F.get(values, k + 1)
    x = F.greatest(v, F.lit(0.0)) if clip_below else F.greatest(v, F.lit(-inf))
    x = F.least(x, F.lit(float(last))) if clip_above else x
    return low + (high - low) * (x - k)
