"""Cache keys and content hashes. Empty or missing parts have no key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values ------------------------------------------------------------
PREFIXES = ("ai_score:", "embedding:", "snapshot:", "recommendation:")
# -------------------------------------------------------------------------------


def _given(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def content_key(text: Column) -> Column:
    return F.when(_given(text), F.sha2(text, 256))


def versioned_key(text: Column, version: Column) -> Column:
    """Key of a text under a rubric or model version."""
    return F.when(_given(text) & _given(version), F.sha2(F.concat(text, version), 256))


def joint_hash(*values: Column) -> Column:
    """One hash of several texts; the delimiter keeps ('ab', 'c') and ('a', 'bc') apart."""
    present = F.lit(bool(values))
    for v in values:
        present = present & v.isNotNull()
    return F.when(present, F.sha2(F.concat_ws("||", *values), 256))


def namespaced_key(prefix: str, text: Column, version: Column) -> Column:
    if prefix not in PREFIXES:
        return F.lit(None).cast("string")
    return F.concat(F.lit(prefix), joint_hash(text, version))


def short_hash(text: Column) -> Column:
    return F.substring(content_key(text), 1, 16)


def identical(left: Column, right: Column) -> Column:
    return F.coalesce(_given(left) & _given(right) & (F.sha2(left, 256) == F.sha2(right, 256)), F.lit(False))


def verify(text: Column, expected: Column) -> Column:
    return F.coalesce(_given(expected) & (content_key(text) == expected), F.lit(False))
