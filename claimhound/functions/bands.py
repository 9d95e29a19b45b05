"""Labelled bands of a value."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds and labels of the bands. The last label also takes unknown values.
AGE_BELOW = [
    (18, "0-17  Minor"),
    (35, "18-34 Young Adult"),
    (50, "35-49 Middle Age"),
    (65, "50-64 Pre-Senior"),
]
AGE_REST = "65+ Elderly"
EXPERIENCE_UP_TO = [(5, "0-5 yrs"), (10, "6-10 yrs"), (20, "11-20 yrs")]
EXPERIENCE_REST = "20+ yrs"
SCORE_ZERO = "0 Clean"
SCORE_UP_TO = [(20, "1-20 Low"), (50, "21-50 Moderate"), (70, "51-70 High")]
SCORE_REST = "71-99 Critical"
ACTION_ABOVE = [
    (120, "IMMEDIATE ACTION — Refer to SIU"),
    (80, "URGENT — Full Audit Required"),
    (50, "SCHEDULE — Desk Review"),
]
ACTION_REST = "MONITOR — Low Priority"


def banded(
    value: Column,
    test: Callable[[Column, int], Column],
    steps: Sequence[tuple[int, str]],
    rest: str,
    first=F,
) -> Column:
    """The label of the first step whose bound passes ``test``, else ``rest``."""
    chain = first
    for bound, label in steps:
        chain = chain.when(test(value, bound), label)
    return chain.otherwise(rest)
