"""Document filters: facets, ranges, nested tiers, names; a request is compiled to one predicate."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions import text as t


class BadRequest(ValueError):
    """A request with an unknown field, too many or too long values, or a range whose ends aren't numbers."""


def is_active(wanted) -> bool:
    """An empty string, list or mapping, or a range without ends, is no filter."""
    if isinstance(wanted, Mapping):
        return any(v not in (None, "") for v in wanted.values())
    return wanted not in (None, "", [], ())


def any_of(values: Column, wanted: list[str]) -> Column:
    """A multi-valued cell has one of the wanted values; a blank cell fails."""
    return F.arrays_overlap(values, F.array(*map(F.lit, wanted)))


def in_range(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Within a range whose ends are included and may be open; what isn't a number fails."""
    number = value.try_cast("double")
    tests = ([number >= low] if low is not None else []) + ([number <= high] if high is not None else [])
    return F.coalesce(reduce(and_, tests, number.isNotNull()), F.lit(False))


def within_tier(value: Column, tiers: list[str], level: str) -> Column:
    """At or below a level of ordered tiers. A blank cell passes, an unlisted value fails, an unknown level filters nothing."""
    if level not in tiers:
        return F.lit(True)
    return (F.trim(F.coalesce(value, F.lit(""))) == "") | value.isin(tiers[: tiers.index(level) + 1])


def validate(request: Mapping, fields: set[str], most: int = 64, longest: int = 256) -> None:
    for field, wanted in request.items():
        if field not in fields:
            raise BadRequest(f"unknown field {field}")
        values = list(wanted.values()) if isinstance(wanted, Mapping) else wanted if isinstance(wanted, (list, tuple)) else [wanted]
        if len(values) > most or any(len(str(v)) > longest for v in values):
            raise BadRequest(f"too many or too long values in {field}")
        if isinstance(wanted, Mapping) and any(v not in (None, "") and not isinstance(v, (int, float)) for v in values):
            raise BadRequest(f"the range of {field} has an end that is no number")


def predicate(request: Mapping, multi: dict[str, Column]) -> Column:
    """All active filters of a request together; ``multi`` has each field's array of values."""
    validate(request, set(multi))
    tests = []
    for field, wanted in request.items():
        if not is_active(wanted):
            continue
        if isinstance(wanted, Mapping):
            tests.append(in_range(F.get(multi[field], F.lit(0)), wanted.get("from"), wanted.get("to")))
        else:
            tests.append(any_of(multi[field], [str(v) for v in (wanted if isinstance(wanted, (list, tuple)) else [wanted])]))
    return reduce(and_, tests, F.lit(True))


def named(title: Column, words: str) -> Column:
    """All words, folded, stand in the folded title."""
    wanted = t.fold(F.lit(words))
    return F.forall(F.filter(F.split(wanted, r"\s+"), lambda w: w != ""), lambda w: F.contains(t.fold(title), w))


def require(frame: DataFrame, columns: set[str]) -> DataFrame:
    """Only classified columns leave: any other column is an error."""
    if unknown := set(frame.columns) - columns:
        raise ValueError(f"unclassified columns: {sorted(unknown)}")
    return frame


def open_rows(frame: DataFrame, access: str = "access") -> DataFrame:
    """Rows of open access; a blank or unknown value is an error, not a guess."""
    sound = F.coalesce(F.col(access).isin("open", "restricted"), F.lit(False))
    return frame.where(F.when(F.assert_true(sound, F.lit("unknown access")).isNull(), F.col(access) == "open"))
