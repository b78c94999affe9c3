"""Small column formulas used across the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Score bounds of the status labels.
WARNING_AT = 0.15
CRITICAL_AT = 0.25


def status_label(score: Column, warning: float = WARNING_AT, critical: float = CRITICAL_AT) -> Column:
    return (F.when(score < warning, F.lit("NORMAL")).when(score < critical, F.lit("WARNING"))
            .otherwise(F.lit("CRITICAL")))


def quality_score(sharpness: Column, noise: Column, variant: str = "service") -> Column:
    """``service`` and ``plugin`` give 0..100, ``plot`` is sharpness over 1 + noise."""
    sharp = F.least(sharpness / 100, F.lit(1.0))
    if variant == "service":
        clean = F.greatest(F.lit(0.0), 1 - noise / 0.5)
    elif variant == "plugin":
        clean = F.greatest(F.lit(0.0), 1 - noise / 50)
    elif variant == "plot":
        return sharpness / (1 + noise)
    else:
        raise ValueError(f"unknown quality variant {variant!r}")
    return (sharp * 0.6 + clean * 0.4) * 100


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def finite_array(xs: Column) -> Column:
    return F.transform(xs, finite)


def finite_map(m: Column) -> Column:
    return F.transform_values(m, lambda _, v: finite(v))


def item_id(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 12)


# The names of the splits.
def split_of_path(path: Column, splits: Sequence[str] = ("train", "valid", "val", "test")) -> Column:
    out = None
    for s in splits:
        hit = path.startswith(s)
        out = F.when(hit, F.lit(s)) if out is None else out.when(hit, F.lit(s))
    return out


def significant(x: Column, digits: int = 6) -> Column:
    """Round to significant digits."""
    magnitude = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))).cast("int"))
    scale = F.pow(F.lit(10.0), digits - 1 - magnitude)
    return F.round(x * scale) / scale


def general_text(x: Column, digits: int = 6) -> Column:
    """Text of a number with up to ``digits`` significant digits, as printf ``%.6g`` gives it."""
    v = significant(x, digits)
    power = F.when(v == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(v))).cast("int"))

    def plain(c: Column) -> Column:
        fixed = F.round(c, 10).cast("decimal(38,10)").cast("string")
        return F.regexp_replace(fixed, r"\.?0+$", "")

    mantissa = significant(v / F.pow(F.lit(10.0), power), digits)
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (F.when(v == 0, F.lit("0"))
            .when((power < -4) | (power >= digits), F.concat(plain(mantissa), F.lit("e"), exponent))
            .otherwise(plain(v)))
