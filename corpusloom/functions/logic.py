"""Three-valued applicability and dotted versions.

States are the strings applicable, unresolved and excluded. They differ from SQL's null logic in the empty cases: all of nothing
is applicable, any of nothing is excluded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

APPLICABLE, UNRESOLVED, EXCLUDED = "applicable", "unresolved", "excluded"


def all_of(states: Column) -> Column:
    """excluded over unresolved over applicable."""
    return F.when(F.array_contains(states, EXCLUDED), EXCLUDED).when(F.array_contains(states, UNRESOLVED), UNRESOLVED).otherwise(APPLICABLE)


def any_of(states: Column) -> Column:
    """applicable over unresolved over excluded."""
    return F.when(F.array_contains(states, APPLICABLE), APPLICABLE).when(F.array_contains(states, UNRESOLVED), UNRESOLVED).otherwise(EXCLUDED)


def axis(observed: Column, asked: Column) -> Column:
    """An unobserved axis applies; an unasked one leaves it open; otherwise equality decides."""
    return F.when(observed.isNull(), APPLICABLE).when(asked.isNull(), UNRESOLVED).when(observed == asked, APPLICABLE).otherwise(EXCLUDED)


def choice(scope: Column, asked: Column, legal: tuple[str, ...]) -> Column:
    """The state of a record bound to at most one of the legal choices. scope: array of choices; empty: bound to none; null: illegal."""
    bad = scope.isNull() | (F.size(scope) > 1) | F.exists(scope, lambda x: ~x.isin(*legal)) | (asked.isNotNull() & ~asked.isin(*legal))
    return (
        F.when(F.coalesce(bad, F.lit(True)), EXCLUDED)
        .when(F.size(scope) == 0, APPLICABLE)
        .when(asked.isNull(), UNRESOLVED)
        .when(F.array_contains(scope, asked), APPLICABLE)
        .otherwise(EXCLUDED)
    )


def version_key(version: Column) -> Column:
    """Integers of a dotted version without zero parts beyond the second; null if it is none."""
    parts = F.transform(F.split(F.regexp_replace(version, r"^(\d+\.\d+(?:\.\d+)*?)(?:\.0+)+$", "$1"), r"\."), lambda x: x.try_cast("int"))
    return F.when(version.rlike(r"^\d+(\.\d+)+$"), parts)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once a row, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def version_order(left: Column, right: Column) -> Column:
    """-1, 0 or 1 by parts, missing ones as 0; null if one is no version."""

    def order(keys: Column) -> Column:
        a, b = keys["a"], keys["b"]
        size = F.greatest(F.size(a), F.size(b))

        def padded(key: Column) -> Column:
            return F.concat(key, F.array_repeat(F.lit(0), size - F.size(key)))

        return F.when(a.isNull() | b.isNull(), None).when(padded(a) < padded(b), -1).when(padded(a) > padded(b), 1).otherwise(0)

    return bound(F.struct(version_key(left).alias("a"), version_key(right).alias("b")), order)


def in_version_range(version: Column, lower: Column, upper: Column) -> Column:
    """lower <= version < upper, where a null bound is open; null if a comparison cannot be made."""
    above = F.when(lower.isNull(), F.lit(True)).otherwise(version_order(version, lower) >= 0)
    below = F.when(upper.isNull(), F.lit(True)).otherwise(version_order(version, upper) < 0)
    return bound(above, lambda x: F.when(~x, F.lit(False)).when(x.isNull(), None).otherwise(below))


def version_state(version: Column, introduced: Column, until: Column) -> Column:
    """The range test as a state: no asked version leaves bounded records open."""
    state = bound(in_version_range(version, introduced, until), lambda x: F.when(version.isNull() | x.isNull(), UNRESOLVED).when(x, APPLICABLE).otherwise(EXCLUDED))
    return F.when(introduced.isNull() & until.isNull(), APPLICABLE).otherwise(state)


def at_boundary(position: Column, event: Column, start_event: Column, end_event: Column) -> Column:
    """Whether (event, before / at / after) lies in [start, end): the start counts from `at`, the end until `before`; a null bound is open."""
    after_start = start_event.isNull() | ((event == start_event) & position.isin("at", "after")) | (event != start_event)
    before_end = end_event.isNull() | ((event == end_event) & (position == "before")) | (event != end_event)
    return F.coalesce(after_start & before_end, F.lit(False))


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]), lambda x: x.isNotNull())


def decided(states: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The first state whose condition holds."""
    return reduce(lambda done, pair: done.when(*pair), states[1:], F.when(*states[0])).otherwise(F.lit(otherwise))
