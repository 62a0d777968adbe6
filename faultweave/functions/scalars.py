"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units and their step.
SIZE_STEP = 1024
SIZE_UNITS = ("KB", "MB", "GB")


def guarded_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """`num / den` where `den` is positive, else `default`; never divides by zero."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(default))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def format_bytes(size: Column) -> Column:
    """Human-readable size: plain bytes below 1 KB, else two decimals up to GB."""
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(SIZE_UNITS, start=1):
        floor = SIZE_STEP**power
        scaled = F.format_string(f"%.2f {unit}", size / F.lit(float(floor)))
        text = F.when(size < floor, text).otherwise(scaled)
    return text


def join_ids(ids: Column, sep: str = ",") -> Column:
    """An array of ids as text, in array order."""
    return F.array_join(ids.cast("array<string>"), sep)


def correctness_mark(label: Column, predicted: Column) -> Column:
    return F.when(label == predicted, F.lit("✓")).otherwise(F.lit("✗"))


def with_port(name: Column, port: int) -> Column:
    """`name:port`."""
    return F.concat_ws(":", name, F.lit(port).cast("string"))


def revenue(price: Column, discount: Column) -> Column:
    """`price * (1 - discount)`."""
    return price * (1 - discount)


def charge(price: Column, discount: Column, tax: Column) -> Column:
    """`price * (1 - discount) * (1 + tax)`."""
    return revenue(price, discount) * (1 + tax)
