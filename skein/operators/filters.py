"""Metadata filters: documents of operators compiled to predicates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _in(c: Column, v: Any) -> Column:
    return F.coalesce(c.isin(*v), F.lit(False))


#: A missing field passes $ne and $nin and fails every other comparison.
OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: F.coalesce(c > v, F.lit(False)),
    "$gte": lambda c, v: F.coalesce(c >= v, F.lit(False)),
    "$lt": lambda c, v: F.coalesce(c < v, F.lit(False)),
    "$lte": lambda c, v: F.coalesce(c <= v, F.lit(False)),
    "$in": _in,
    "$nin": lambda c, v: ~_in(c, v),
    "$contains": lambda c, v: F.coalesce(F.contains(c, F.lit(v)), F.lit(False)),
    "$has": lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False)),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def validate(spec: Mapping[str, Any]) -> None:
    """Raise for filters that aren't mappings of fields to values or operators."""
    if not isinstance(spec, Mapping):
        raise TypeError("a filter is a mapping")
    for field, want in spec.items():
        if not isinstance(field, str) or not field:
            raise ValueError("field names are non-empty strings")
        for op, v in want.items() if isinstance(want, Mapping) else ():
            if op in ("$in", "$nin") and not isinstance(v, (list, tuple, set)):
                raise TypeError(f"{op} takes a list")


def compile_filter(spec: Mapping[str, Any], field: Callable[[str], Column] = F.col) -> Column:
    """The conjunction of all conditions; an unknown operator is false. ``field`` maps dotted paths to columns."""
    validate(spec)
    terms = []
    for name, want in spec.items():
        if isinstance(want, Mapping):
            terms += [OPERATORS[op](field(name), v) if op in OPERATORS else F.lit(False) for op, v in want.items()]
        else:
            terms.append(field(name).eqNullSafe(F.lit(want)))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def json_field(column: str) -> Callable[[str], Column]:
    """Fields read by dotted path out of a JSON text column."""
    return lambda path: F.get_json_object(column, "$." + path)


def map_equals(column: str, want: Mapping[str, str]) -> Column:
    """Every key has its value in a map column; a missing key fails."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.try_element_at(F.col(column), F.lit(k)) == v, F.lit(False)) for k, v in want.items()], F.lit(True))


def safe_where(df: DataFrame, allowed: Mapping[str, Sequence[str]], name: str, conditions: Mapping[str, Any]) -> DataFrame:
    """Rows of the table ``name`` that equal all conditions; a table or column that isn't allowed raises. Values are bound as literals, never as text of a query."""
    if name not in allowed:
        raise ValueError(f"table {name!r} is not allowed")
    if not isinstance(conditions, Mapping) or not conditions:
        raise ValueError("conditions are a mapping of at least one column")
    for column in conditions:
        if column not in allowed[name]:
            raise ValueError(f"column {column!r} of {name!r} is not allowed")
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in conditions.items()]))


def valid_filter(spec: Column) -> Column:
    """Whether a JSON text is a filter: an object whose ``$in`` and ``$nin`` take arrays."""
    fields = F.from_json(spec, "map<string,string>")
    lists = lambda ops: F.forall(F.map_entries(ops), lambda e: ~e["key"].isin("$in", "$nin") | e["value"].startswith("["))
    told = F.forall(F.map_values(fields), lambda v: ~v.startswith("{") | F.coalesce(lists(F.from_json(v, "map<string,string>")), F.lit(False)))
    return F.coalesce(F.trim(spec).startswith("{") & told, F.lit(False))
