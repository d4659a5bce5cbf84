"""Column builders for single contribution rows.

Only built-in Spark functions are used, so every expression stays inside the JVM and
keeps SQL's three-valued logic: a value list test on an absent key is NULL, not FALSE.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from editpulse.functions import rules
from editpulse.functions.rules import TagTest


def ratio(numerator: Column, denominator: Column) -> Column:
    """Floating division that yields NULL for a zero or missing denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def sql_list(values: Iterable[str]) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _condition(value: str, test: TagTest) -> str:
    """SQL condition of one tag test on the text expression ``value``."""
    if test.values is not None:
        return f"{value} IN ({sql_list(test.values)})"
    if test.excluded is not None:
        return f"({value} IS NOT NULL AND {value} <> '{test.excluded}')"
    return f"{value} IS NOT NULL"


def feature_flag(tags: str, tests: Iterable[TagTest]) -> Column:
    """TRUE when any of the tests holds on the tag map column named ``tags``."""
    return F.expr(" OR ".join(_condition(f"{tags}['{test.key}']", test) for test in tests))


def feature_flags(tags: str) -> dict[str, Column]:
    return {name: feature_flag(tags, tests) for name, tests in rules.FEATURE_FLAGS.items()}


def _entry_category(entry: str, branches: Iterable[tuple[str, TagTest]]) -> str:
    """First matching category of a map entry, as a CASE expression."""
    cases = "".join(
        f" WHEN {entry}.key = '{test.key}' AND {_condition(f'{entry}.value', test)} THEN '{category}'"
        if test.values or test.excluded
        else f" WHEN {entry}.key = '{test.key}' THEN '{category}'"
        for category, test in branches
    )
    return f"CASE{cases} ELSE '{rules.OTHER}' END"


def keys_only_in(tags: str, other: str) -> Column:
    """Keys of ``tags`` that ``other`` lacks; an empty list when ``other`` is NULL."""
    return F.expr(f"filter(map_keys({tags}), k -> NOT array_contains(map_keys({other}), k))")


def categories_only_in(tags: str, other: str, branches: Iterable[tuple[str, TagTest]]) -> Column:
    """Category of every entry of ``tags`` whose key ``other`` lacks, one per entry."""
    return F.expr(
        f"transform(filter(map_entries({tags}), e -> NOT map_contains_key({other}, e.key)), "
        f"e -> {_entry_category('e', branches)})"
    )


def editor_category(editor: str) -> Column:
    """Editor family by case-insensitive pattern; a missing editor is ``other``."""
    cases = "".join(f" WHEN {editor} ILIKE '{pattern}' THEN '{label}'" for pattern, label in rules.EDITOR_PATTERNS)
    return F.expr(f"CASE{cases} ELSE '{rules.OTHER}' END")


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end``, independent of the session time zone."""
    return ((end - start).cast("interval second").cast("decimal(24,6)") * 1_000_000).cast("long")


def timestamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def country_member(code: str, countries: str = "countries") -> Column:
    """Row filter for one country code or pseudo country."""
    if code == rules.STATELESS:
        return F.expr(f"size({countries}) = 0")
    if code == rules.SPECIAL_REGIONS:
        return F.expr(f"arrays_overlap({countries}, array({sql_list(rules.SPECIAL_REGION_CODES)}))")
    return F.array_contains(countries, code)


def inside_box(inner: Column, outer: Column) -> Column:
    """TRUE when box ``inner`` lies fully inside box ``outer``, borders included."""
    return (
        (inner["xmin"] >= outer["xmin"])
        & (inner["xmax"] <= outer["xmax"])
        & (inner["ymin"] >= outer["ymin"])
        & (inner["ymax"] <= outer["ymax"])
    )


def week_start(day: Column) -> Column:
    """Monday of the week of ``day`` as a date."""
    return F.trunc(day, "week")


def weeks_between(first: Column, last: Column) -> Column:
    """Number of Monday boundaries crossed from ``first`` to ``last``."""
    return (F.datediff(week_start(last), week_start(first)) / 7).cast("long")
