"""Expressions over answers: membership, edits, completeness, classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.relations import HIGH_RISK_USES


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_of(array: Column | str, wanted: Sequence[str]) -> Column:
    """Whether any element is among wanted; never null, whatever the array holds."""
    return F.coalesce(F.exists(_c(array), lambda x: F.coalesce(x.isin(*wanted), F.lit(False))), F.lit(False))


def has(array: Column | str, value: Column) -> Column:
    return F.coalesce(F.array_contains(F.array_compact(_c(array)), value), F.lit(False))


def without(array: Column | str, value: Column) -> Column:
    return F.filter(_c(array), lambda x: ~x.eqNullSafe(value))


def toggled(array: Column | str, value: Column) -> Column:
    """The array without value, or with it at the end if it wasn't there."""
    return F.when(has(array, value), without(array, value)).otherwise(F.array_append(_c(array), value))


def toggled_all(clicks: Column | str) -> Column:
    """What an ordered array of clicks leaves selected, click by click."""
    return F.aggregate(_c(clicks), F.array().cast("array<string>"), lambda now, x: toggled(now, x))


def is_complete(multi: Column, chosen: Column | str, single: Column | str) -> Column:
    """A multiple choice needs one option at least, a single choice a text that isn't empty."""
    return F.when(multi, F.coalesce(F.size(_c(chosen)) > 0, F.lit(False))).otherwise(F.coalesce(_c(single) != "", F.lit(False)))


def is_selected(multi: Column, chosen: Column | str, single: Column | str, option: Column) -> Column:
    return F.when(multi, has(chosen, option)).otherwise(_c(single).eqNullSafe(option))


def classify(uses: Column | str, in_scope: Column | str, high_risk: Sequence[str] = HIGH_RISK_USES) -> Column:
    """high, low or unsure; the first rule that holds decides."""
    high, scope = any_of(uses, high_risk), F.coalesce(_c(in_scope), F.lit(""))
    return F.when(scope == "Not sure", "unsure").when(high & (scope == "Yes"), "high").when(~high | (scope == "No"), "low").otherwise("unsure")


def at(array: Column | str, index: Column) -> Column:
    """The element at an index from 0, null where there is none."""
    return F.try_element_at(_c(array), (index + 1).cast("int"))
