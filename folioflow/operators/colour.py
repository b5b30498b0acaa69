"""Colours of themes and cells: hue, saturation and lightness, tints and luminance, all as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channels(colour: Column) -> Column:
    """Red, green and blue of ``RRGGBB``, ``#RRGGBB`` or ``AARRGGBB`` as an array of integers; null for anything else."""
    bare = F.regexp_replace(F.trim(colour), "^#", "")
    six = F.when(F.length(bare) == 8, F.right(bare, F.lit(6))).otherwise(bare)
    part = lambda i: F.conv(F.substring(six, i, 2), 16, 10).cast("int")
    return F.when(six.rlike("^[0-9A-Fa-f]{6}$"), F.array(part(1), part(3), part(5)))


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    """``#RRGGBB`` of three numbers, kept within 0 and 255."""
    digits = (F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("long")), 2, "0") for c in (red, green, blue))
    return F.concat(F.lit("#"), *digits)


def luminance(colour: Column) -> Column:
    """Relative brightness from 0 to 1; 1 for what is no colour."""
    c = channels(colour)
    return F.coalesce((c[0] * 0.299 + c[1] * 0.587 + c[2] * 0.114) / 255, F.lit(1.0))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: written out wherever it is used, steps that use the one before several times would grow with a power of their number."""
    return F.transform(F.array(value), body)[0]


def _lightened(colour: Column, lightness) -> Column:
    """The colour with another lightness, hue and saturation kept; what is no colour stays."""

    def ends(c: Column) -> Column:
        return _let(F.struct((F.array_max(c) / 255).alias("high"), (F.array_min(c) / 255).alias("low")), lambda e: parts(c, e.high, e.low))

    def parts(c: Column, high: Column, low: Column) -> Column:
        spread, light = high - low, (high + low) / 2
        saturation = F.when(spread == 0, 0.0).when(light > 0.5, spread / (2 - high - low)).otherwise(spread / (high + low))
        r, g, b = c[0], c[1], c[2]
        sixth = F.when(r / 255 == high, (g - b) / 255 / spread + F.when(g < b, 6.0).otherwise(0.0)).when(g / 255 == high, (b - r) / 255 / spread + 2).otherwise((r - g) / 255 / spread + 4)
        hue = F.when(spread == 0, 0.0).otherwise(sixth / 6)
        new = _let(light, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), lightness(x))))
        return _let(F.struct(hue.alias("hue"), saturation.alias("saturation"), new.alias("new")), lambda p: range_of(p.hue, p.saturation, p.new))

    def range_of(hue: Column, saturation: Column, new: Column) -> Column:
        upper = F.when(new < 0.5, new * (1 + saturation)).otherwise(new + saturation - new * saturation)
        return _let(upper, lambda up: hex_colour(*(channel(hue + shift, saturation, new, up) for shift in (1 / 3, 0.0, -1 / 3))))

    def channel(turn: Column, saturation: Column, new: Column, upper: Column) -> Column:
        def ramp(p: Column) -> Column:
            t, lower = p.t, p.lower
            rising, falling = lower + (upper - lower) * 6 * t, lower + (upper - lower) * (2 / 3 - t) * 6
            return F.when(saturation == 0, new).when(t < 1 / 6, rising).when(t < 1 / 2, upper).when(t < 2 / 3, falling).otherwise(lower)

        return F.floor(_let(F.struct((turn - F.floor(turn)).alias("t"), (2 * new - upper).alias("lower")), ramp) * 255 + 0.5)

    return _let(channels(colour), lambda c: F.when(c.isNull(), colour).otherwise(ends(c)))


def tinted(colour: Column, tint: Column) -> Column:
    """A spreadsheet's tint: above zero towards white, below towards black; zero leaves the text as it is."""
    moved = _lightened(colour, lambda light: F.when(tint < 0, light * (1 + tint)).otherwise(light * (1 - tint) + tint))
    return F.when(tint == 0, colour).otherwise(moved)


def adjusted(colour: Column, modulated: Column, offset: Column) -> Column:
    """A drawing's luminance: multiplied, then moved."""
    return _lightened(colour, lambda light: light * modulated + offset)


def blended(colour: Column, other: Column, share: Column) -> Column:
    """A colour with a share of another; unchanged if either is none."""
    a, b = channels(colour), channels(other)
    parts = [F.floor(a[i] * (1 - share) + b[i] * share + 0.5) for i in range(3)]
    return F.when(a.isNull() | b.isNull(), colour).otherwise(hex_colour(*parts))
