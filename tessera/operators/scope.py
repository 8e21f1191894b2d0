"""Ownership scopes: five text columns, '' where a dimension is not set."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("base", "sc_user", "sc_agent", "sc_session", "sc_app")


class ScopeError(ValueError):
    """A scope that is empty, unknown or in conflict."""


def checked(scope: dict[str, str | None]) -> dict[str, str]:
    """All five dimensions, '' for None; unknown names and values that are no text raise."""
    for k, v in scope.items():
        if k not in DIMENSIONS:
            raise ScopeError(f"unknown dimension {k}")
        if v is not None and not isinstance(v, str):
            raise ScopeError(f"{k} is no text")
    return {d: scope.get(d) or "" for d in DIMENSIONS}


def guarded(scope: dict[str, str | None], all_scopes: bool = False) -> dict[str, str]:
    """The scope, unless it is empty and not all scopes are asked for."""
    out = checked(scope)
    if not any(out.values()) and not all_scopes:
        raise ScopeError("an empty scope needs all_scopes=True")
    return out


def with_base(scope: dict[str, str | None], base: str) -> dict[str, str]:
    out = checked(scope)
    if out["base"] not in ("", base):
        raise ScopeError(f"base is {out['base']}, not {base}")
    return out | {"base": base}


def overlaid(own: dict[str, str | None], inherited: dict[str, str | None], names: tuple[str, ...]) -> dict[str, str]:
    """`own` with the named dimensions of `inherited`; base can't be inherited, and a conflict raises."""
    out, other = checked(own), checked(inherited)
    for d in names:
        if d == "base":
            raise ScopeError("base is not inherited")
        if out[d] and other[d] and out[d] != other[d]:
            raise ScopeError(f"{d}: {out[d]} and {other[d]}")
        out[d] = out[d] or other[d]
    return out


def child_agent(agent: Column, name: str) -> Column:
    return F.concat(agent, F.lit(f"::{name}"))


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def in_range(scope: dict[str, str | None]) -> Column:
    """Equal in every dimension that the scope sets; true for an empty scope."""
    return _all([F.col(d) == v for d, v in checked(scope).items() if v])


def exactly(scope: dict[str, str | None]) -> Column:
    """Equal in all five dimensions."""
    return _all([F.col(d) == v for d, v in checked(scope).items()])


def ancestor_of(scope: dict[str, str | None]) -> Column:
    """Rows whose scope is the given one or contains it: each dimension is '' or equal."""
    return _all([(F.col(d) == "") | (F.col(d) == v) if v else F.col(d) == "" for d, v in checked(scope).items()])


def scoped(df: DataFrame, **columns: Column | str) -> DataFrame:
    """`df` with the five dimensions, from the given columns or texts, '' for the rest and for nulls."""
    for d in DIMENSIONS:
        value = columns.get(d, "")
        value = F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit(""))
        df = df.withColumn(d, value)
    return df


def footprints(df: DataFrame) -> DataFrame:
    """The distinct scopes of a table."""
    return df.select(*DIMENSIONS).distinct()


def metadata_is(key: str, value: object, declared: tuple[str, ...]) -> Column:
    """A declared metadata column equals the value's text; a missing one is ''."""
    if key not in declared:
        raise KeyError(f"{key} is not declared")
    if value is None:
        raise ValueError("a metadata filter needs a value")
    return F.coalesce(F.col(f"md_{key}"), F.lit("")) == str(value)


def metadata_in(key: str, values: list[object], declared: tuple[str, ...]) -> Column:
    if key not in declared:
        raise KeyError(f"{key} is not declared")
    if not values:
        raise ValueError("a metadata filter needs values")
    return F.coalesce(F.col(f"md_{key}"), F.lit("")).isin(*map(str, values))
