"""Reuse of column expressions.

A column is an unresolved expression, independent of any frame, but building one of a few
hundred nodes takes thousands of calls into the JVM. Builders without column arguments are
therefore run once per JVM.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext


def built_once(builder: Callable) -> Callable:
    """Cache a builder's result per JVM and (hashable) arguments."""
    kept: dict = {}

    @functools.wraps(builder)
    def build(*args, **kwargs):
        key = (id(SparkContext._gateway), args, tuple(sorted(kwargs.items())))
        if key not in kept:
            kept[key] = builder(*args, **kwargs)
        return kept[key]

    return build
