"""Element-wise column functions with pandas' rules for signs, missing values and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def floordiv(a: Column, b: Column) -> Column:
    """Floor of the quotient; division by zero is missing."""
    return F.floor(F.try_divide(a.cast("double"), b.cast("double"))).cast("double")


def mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; by zero is missing."""
    return a - floordiv(a, b) * b


def compare(a: Column, op: str, b: Column) -> Column:
    """A comparison with a missing value is False, and ``ne`` True."""
    made = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]
    return F.coalesce(made, F.lit(op == "ne"))


def missing(a: Column) -> Column:
    return a.isNull()


def clip(a: Column, lower=None, upper=None) -> Column:
    """A missing value stays missing."""
    out = a
    if lower is not None:
        out = F.when(a.isNotNull(), F.greatest(out, F.lit(lower)))
    if upper is not None:
        out = F.when(a.isNotNull(), F.least(out, F.lit(upper)))
    return out


def between(a: Column, low, high, inclusive: str = "both") -> Column:
    left = compare(a, "ge" if inclusive in ("both", "left") else "gt", F.lit(low))
    right = compare(a, "le" if inclusive in ("both", "right") else "lt", F.lit(high))
    return left & right


def case_when(pairs: list[tuple[Column, object]], default: Column) -> Column:
    """The value of the first condition that holds, else ``default``."""
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return default if out is None else out.otherwise(default)


def cut(a: Column, bins: list[float], labels: list | None = None, right: bool = True, include_lowest: bool = False) -> Column:
    """The label of the interval that holds a value, missing outside of all."""
    out = None
    for k, (low, high) in enumerate(zip(bins, bins[1:])):
        inside = (a > low) & (a <= high) if right else (a >= low) & (a < high)
        if include_lowest and k == 0 and right:
            inside = (a >= low) & (a <= high)
        label = labels[k] if labels else (f"({low}, {high}]" if right else f"[{low}, {high})")
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def replace(a: Column, mapping: dict) -> Column:
    out = None
    for old, new in mapping.items():
        same = a.isNull() if old is None else a == F.lit(old)
        out = F.when(same, F.lit(new)) if out is None else out.when(same, F.lit(new))
    return out.otherwise(a) if out is not None else a
