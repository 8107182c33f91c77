"""Ratios, rounding, unit conversion."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero at ``digits`` decimals, on the scaled double."""
    scale = F.lit(10.0**digits)
    return F.round(x * scale) / scale


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """``part / whole`` as a rounded double; NULL when ``whole`` is zero or NULL."""
    return rounded(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def share_pct(part: Column, whole: Column, digits: int) -> Column:
    """``100 * part / whole`` as a rounded double; NULL when ``whole`` is zero or NULL.

    The product is taken before the cast, so it is exact for whole numbers and decimals:
    73.35 of 900 is 8.15 and shows as 8.2.
    """
    hundredfold = (part * F.lit(Decimal(100))).cast("double")
    return rounded(F.try_divide(hundredfold, whole.cast("double")), digits)


def count_where(condition: Column) -> Column:
    """Rows for which ``condition`` is true, 0 (not NULL) on empty input."""
    return F.count_if(condition)


def sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def to_eaches(qty: Column, uom: Column, case_pack: Column) -> Column:
    """Quantity in single units: EACH as is, anything else times the case pack."""
    return F.when(uom == "EACH", qty).otherwise(qty * case_pack)


def to_cases(qty: Column, uom: Column, case_pack: Column) -> Column:
    """Quantity in cases: EACH over the case pack (NULL for a zero pack), else as is."""
    return F.when(uom == "EACH", F.try_divide(qty.cast("double"), case_pack.cast("double"))).otherwise(
        qty.cast("double")
    )


# Pack units, their measure and the factor to its base unit (gram, millilitre).
PACK_UNITS = {
    "G": ("weight", 1),
    "KG": ("weight", 1000),
    "ML": ("volume", 1),
    "L": ("volume", 1000),
}


def pack_in_base_units(value: Column, uom: Column) -> Column:
    """Pack size in grams or millilitres; NULL for an unknown unit."""
    out = F.lit(None).cast("double")
    for unit, (_, factor) in PACK_UNITS.items():
        out = F.when(F.upper(uom) == unit, value.cast("double") * F.lit(float(factor))).otherwise(out)
    return out


def pack_family(uom: Column) -> Column:
    out = F.lit(None).cast("string")
    for unit, (family, _) in PACK_UNITS.items():
        out = F.when(F.upper(uom) == unit, F.lit(family)).otherwise(out)
    return out
