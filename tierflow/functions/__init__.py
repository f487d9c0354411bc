"""Column expressions shared by the operators."""

from tierflow.functions.exprs import (
    div0,
    div0null,
    next_weekday,
    previous_weekday,
    text,
    zero_trim,
)
from tierflow.functions.sums import exact_sums

__all__ = [
    "div0",
    "div0null",
    "exact_sums",
    "next_weekday",
    "previous_weekday",
    "text",
    "zero_trim",
]
