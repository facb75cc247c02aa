"""The record filter language: nested dictionaries compiled to one Catalyst predicate.

A node holds one operator: ``and``, ``or``, ``not``, ``eq``, ``in``, ``range``,
``like`` or ``contains``; of several the first in that order counts, and an
unknown or empty node is true. The body of ``eq``, ``in`` and ``like`` is
``[field, value]`` or ``{field: value, ...}``, that of ``range`` ``{field:
[low, high]}``. Two modes exist. ``sql`` compares attribute values as text
under three-valued logic. ``typed`` compares numbers as numbers under
two-valued logic, and ``like`` is a plain substring test there. A value that
isn't of the other side's kind is no match and no error, in either mode.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Resolver = Callable[[str], Column]
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


@dataclass
class Filter:
    expr: dict = field(default_factory=dict)
    order_by: list[tuple[str, str]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


def json_path(path: str) -> str:
    return json_path_of(path.split("."))


def json_path_of(parts: Iterable[str]) -> str:
    return "$" + "".join(f"['{part}']" for part in parts)


@dataclass(frozen=True)
class Fields:
    """Where fields are: columns by name, anything else by its dotted path in the JSON column ``attributes``."""

    kinds: dict[str, str]
    attributes: str | None = None

    def _name(self, name: str) -> str:
        name = name.removeprefix("attributes.")
        return "ts" if name == "timestamp" and "ts" in self.kinds and "timestamp" not in self.kinds else name

    def __call__(self, name: str) -> Column:
        name = self._name(name)
        if name in self.kinds or not self.attributes:
            return F.col(f"`{name}`")
        return F.get_json_object(F.col(self.attributes), json_path(name)) if name else F.col(self.attributes)

    def kind(self, name: str) -> str:
        """The column's type, or json for a path."""
        return self.kinds.get(self._name(name), "json")


def variant_text(value: Column) -> Column:
    """The text of a VARIANT value as its JSON had it; of a fraction without digits behind the point, one zero stays.

    VARIANT drops a fraction's trailing zeros and tells 3.0 from 3 by its type,
    a decimal of scale 0; whole numbers of 19 digits and more have that type too
    and keep their text.
    """
    whole_fraction = F.schema_of_variant(value).rlike(r"^DECIMAL\((?:[0-9]|1[0-8]),0\)$")
    text = F.try_variant_get(value, "$", "string")
    return F.when(whole_fraction, F.concat(text, F.lit(".0"))).otherwise(text)


@dataclass(frozen=True)
class VariantFields(Fields):
    """As ``Fields``, with the attributes in a VARIANT column, which was parsed when it was written."""

    def value(self, name: str) -> Column:
        name = self._name(name)
        return F.try_variant_get(F.col(self.attributes), json_path(name) if name else "$", "variant")

    def __call__(self, name: str) -> Column:
        return F.col(f"`{self._name(name)}`") if self.kind(name) != "json" else variant_text(self.value(name))

    def number(self, name: str) -> Column:
        """The value as a number, also one that is told as text; null for anything else."""
        value = self.value(name)
        return F.when(F.schema_of_variant(value) != "BOOLEAN", F.try_variant_get(value, "$", "double"))

    def contains(self, path: tuple[str, ...], x: Any) -> Column:
        """Deep containment, as the filter language's node."""
        if isinstance(x, dict):
            return _all([self.contains((*path, k), v) for k, v in x.items()])
        here = F.try_variant_get(F.col(self.attributes), json_path_of(path), "variant")
        if isinstance(x, list):
            held = F.transform(F.try_variant_get(here, "$", "array<variant>"), variant_text)
            return _all([F.array_contains(held, y if isinstance(y, str) else json.dumps(y)) for y in x])
        return variant_text(here) == F.lit(x if isinstance(x, str) else json.dumps(x))


def variant_field(attributes: str = "attributes") -> VariantFields:
    """The fields of a record table whose attributes are VARIANT."""
    return VariantFields(record_field(attributes).kinds, attributes)


def record_field(attributes: str = "attributes") -> Fields:
    """The fields of a record table: id, content and ts (also as timestamp), the rest in its JSON attributes."""
    return Fields({"id": "string", "content": "string", "ts": "timestamp_ntz"}, attributes)


def table_field(df: DataFrame, attributes: str | None = None) -> Fields:
    """The columns of ``df``, and paths in a JSON column if one is named."""
    return Fields({f.name: f.dataType.simpleString() for f in df.schema.fields}, attributes)


def _as_text(x: Any) -> str:
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def compile_filter(expr: dict | None, resolve: Resolver, mode: str = "sql", attributes: str | None = "attributes") -> Column:
    """The predicate of a filter expression."""
    typed = mode == "typed"
    whole = lambda c: F.coalesce(c, F.lit(False)) if typed else c
    kind_of = getattr(resolve, "kind", lambda name: "json")
    as_number = getattr(resolve, "number", None)
    contains = getattr(resolve, "contains", None) or (lambda path, x: _contains(attributes, path, x))

    def number_of(name: str) -> Column:
        return as_number(name) if as_number and kind_of(name) == "json" else resolve(name).try_cast("double")

    def sides(name: str, x: Any) -> tuple[Column, Column]:
        """Both sides of a comparison, of one type, null where a value isn't of it."""
        column, kind = resolve(name), kind_of(name)
        if kind in ("json", "string"):
            if typed and kind == "json" and _is_number(x):
                return number_of(name), F.lit(float(x))
            return column, F.lit(None if x is None else x if hasattr(x, "isoformat") else _as_text(x)).cast("string")
        if kind.startswith(NUMBERS):
            return (column, F.lit(x)) if _is_number(x) else (column, F.lit(None if x is None else _as_text(x)).try_cast(kind))
        return column, F.lit(x).try_cast(kind) if isinstance(x, str) else F.lit(x)

    def between(name: str, low: Any, high: Any) -> Column:
        column, kind = resolve(name), kind_of(name)
        if kind in ("json", "string") and _is_number(low) and _is_number(high):
            return number_of(name).between(F.lit(float(low)), F.lit(float(high)))
        return column.between(sides(name, low)[1], sides(name, high)[1])

    def leaf(op: str, body: Any) -> Column:
        if op == "contains":
            return _all([contains((k,), v) for k, v in (body or {}).items()]) if attributes else F.lit(True)
        pairs = list(body.items()) if isinstance(body, dict) else [(str(body[0]), body[1])]
        if op == "range" and len(pairs) != 1:
            raise ValueError("a range node takes exactly one field")
        parts = []
        for name, x in pairs:
            if op == "eq":
                a, b = sides(name, x)
                parts.append(a.isNull() if x is None and typed else a == b)
            elif op == "in":
                parts.append(_any([a.isNull() if y is None and typed else a == b for y in x for a, b in [sides(name, y)]]))
            elif op == "range":
                parts.append(between(name, *x))
            else:
                text = resolve(name).cast("string")
                parts.append(F.contains(F.coalesce(text, F.lit("")), F.lit(_as_text(x).replace("%", ""))) if typed else text.like(_as_text(x)))
        return _all(parts)

    def node(x: dict | None) -> Column:
        for op in ("and", "or", "not", "eq", "in", "range", "like", "contains"):
            if x and op in x:
                body = x[op]
                if op == "and":
                    return _all([node(y) for y in body or []])
                if op == "or":
                    return _any([node(y) for y in body or []])
                return ~node(body) if op == "not" else whole(leaf(op, body))
        return F.lit(True)

    return node(expr)


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def _contains(attributes: str, path: tuple[str, ...], x: Any) -> Column:
    """Deep containment of a JSON value at a path: objects by their keys, arrays by their members."""
    here = F.get_json_object(F.col(attributes), json_path_of(path))
    if isinstance(x, dict):
        return _all([_contains(attributes, (*path, k), v) for k, v in x.items()])
    if isinstance(x, list):
        held = F.from_json(here, "array<string>")
        return _all([F.array_contains(held, y if isinstance(y, str) else json.dumps(y)) for y in x])
    return here == F.lit(x if isinstance(x, str) else json.dumps(x))


def apply_filter(df: DataFrame, spec: Filter, resolve: Resolver | None = None, mode: str = "sql", attributes: str | None = "attributes", tie: str = "id") -> DataFrame:
    """Rows of a filter with its order (nulls last ascending, first descending; ties by ``tie``), offset and limit."""
    resolve = resolve or table_field(df)
    out = df.where(compile_filter(spec.expr, resolve, mode, attributes))
    if spec.order_by:
        keys = [resolve(n).desc_nulls_first() if d.lower() == "desc" else resolve(n).asc_nulls_last() for n, d in spec.order_by]
        out = out.orderBy(*keys, F.col(tie))
    if spec.offset:
        out = out.offset(spec.offset)
    return out.limit(spec.limit) if spec.limit is not None else out
