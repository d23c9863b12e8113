"""Nested boolean filters over columns, JSON paths and arrays, compiled to native columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirplake.functions.arrays import split_path
from chirplake.schema import JSON_COLUMNS

COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$lt": lambda c, v: c < v,
    "$gte": lambda c, v: c >= v,
    "$lte": lambda c, v: c <= v,
}
#: What a comparison gives if its left side is of the higher class: texts stand above numbers.
ABOVE = {"$eq": False, "$ne": True, "$gt": True, "$gte": True, "$lt": False, "$lte": False}
BELOW = {"$eq": False, "$ne": True, "$gt": False, "$gte": False, "$lt": True, "$lte": True}

NUMBERS = r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$"


def json_path(parts: Iterable[str]) -> str:
    return "$" + "".join(p if p.startswith("[") else f"['{p}']" if "'" not in p else f'["{p}"]' for p in parts)


#: The operator that holds where another doesn't.
OPPOSITE = {"$eq": "$ne", "$ne": "$eq", "$gt": "$lte", "$lte": "$gt", "$lt": "$gte", "$gte": "$lt"}


def _parts(path: str) -> tuple[Column, str, Column]:
    """(variant, path below it, kind) of a dotted path that starts at a JSON column."""
    first, *rest = split_path(path)
    variant, place = F.try_parse_json(F.col(f"`{first}`")), json_path(rest)
    return variant, place, F.schema_of_variant(F.try_variant_get(variant, place, "variant"))


def json_number(path: str) -> Column:
    """What a path of a JSON column holds if it is a number or a boolean, else null."""
    variant, place, kind = _parts(path)
    number = F.coalesce(F.try_variant_get(variant, place, "double"), F.try_variant_get(variant, place, "boolean").cast("double"))
    return F.when(kind.rlike(NUMBERS) | (kind == "BOOLEAN"), number)


def json_text(path: str) -> Column:
    """What a path of a JSON column holds if it is a text, an object or an array, as text; else null."""
    variant, place, kind = _parts(path)
    other = ~(kind.rlike(NUMBERS) | (kind == "BOOLEAN") | (kind == "VOID"))
    return F.when(other, F.when(kind == "STRING", F.try_variant_get(variant, place, "string")).otherwise(F.to_json(F.try_variant_get(variant, place, "variant"))))


def shredded_compare(number: Column, text: Column, op: str, value: Any) -> Column:
    """:func:`json_compare` on the typed columns of a path, as comparisons that a scan takes over.

    Holds for the same rows; where it doesn't, it may be null instead of false, so it isn't to be negated.
    """
    if value is None:
        return number.isNull() & text.isNull() if op == "$eq" else number.isNotNull() | text.isNotNull()
    if isinstance(value, (bool, int, float)):
        same, other, above = COMPARE[op](number, F.lit(float(value))), text, ABOVE[op]
    else:
        same, other, above = COMPARE[op](text, F.lit(str(value))), number, BELOW[op]
    return same | other.isNotNull() if above else same


def json_compare(variant: Column, parts: list[str], op: str, value: Any) -> Column:
    """A comparison with what a path of a JSON column holds.

    Values are ordered across types: numbers (booleans are 0 and 1) come before texts, objects and arrays count as their
    JSON text, and '7' isn't 7. A missing path or a JSON null is null, so neither it nor its negation is selected.
    """
    path = json_path(parts)
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    number = F.coalesce(F.try_variant_get(variant, path, "double"), F.try_variant_get(variant, path, "boolean").cast("double"))
    is_number, is_null = kind.rlike(NUMBERS) | (kind == "BOOLEAN"), kind.isNull() | (kind == "VOID")
    text = F.when(kind == "STRING", F.try_variant_get(variant, path, "string")).otherwise(F.to_json(F.try_variant_get(variant, path, "variant")))
    if value is None:
        return is_null if op == "$eq" else ~is_null
    if isinstance(value, (bool, int, float)):
        same, other = COMPARE[op](number, F.lit(float(value))), ABOVE[op]
        return F.when(is_null, None).when(is_number, same).otherwise(F.lit(other))
    return F.when(is_null, None).when(is_number, F.lit(BELOW[op])).otherwise(COMPARE[op](text, F.lit(str(value))))


def plain_compare(column: Column, kind: T.DataType, op: str, value: Any) -> Column:
    """A comparison with a typed column: the literal takes the column's type if it can, else types are ordered."""
    if value is None:
        return column.isNull() if op == "$eq" else column.isNotNull()
    if isinstance(kind, T.NumericType):
        try:
            number = float(value)
        except (TypeError, ValueError):
            return F.when(column.isNotNull(), F.lit(BELOW[op]))
        return COMPARE[op](column, F.lit(int(number) if number.is_integer() and abs(number) < 2**53 else number))
    if isinstance(kind, T.StringType):
        return COMPARE[op](column, F.lit(str(int(value)) if isinstance(value, bool) else str(value)))
    if isinstance(kind, T.BooleanType) and isinstance(value, (bool, int)):
        return COMPARE[op](column, F.lit(bool(value)))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return COMPARE[op](column, F.lit(value).cast(kind))
    return COMPARE[op](column, F.lit(value))


class Compiler:
    """Compiles queries for a schema.

    ``json_columns`` hold JSON text; ``promoted`` maps dotted paths to columns that already hold their values, and
    ``shredded`` maps them to the columns of their numbers and of their texts, so that a filter on them reaches the scan.
    Negations are carried down to the comparisons.
    """

    def __init__(self, schema: T.StructType, json_columns: Iterable[str] = JSON_COLUMNS, promoted: dict[str, str] | None = None, shredded: dict[str, tuple[str, str]] | None = None):
        self.schema, self.json_columns, self.promoted, self.shredded = schema, set(json_columns), promoted or {}, shredded or {}

    def compile(self, query: dict | None, holds: bool = True) -> Column | None:
        """The column of a query, or none for no filter. Several keys, or several operators, must all hold.

        With ``holds`` false, that of rows for which the query is false; neither is for rows for which it is null.
        """
        if not query:
            return None
        if not isinstance(query, dict):
            raise ValueError("a query is a dict")
        return reduce(and_ if holds else or_, [self._item(k, v, holds) for k, v in query.items()])

    def _item(self, key: str, value: Any, holds: bool) -> Column:
        if key in ("$and", "$or"):
            if not isinstance(value, (list, tuple)) or not value:
                raise ValueError(f"{key} takes a list of queries")
            parts = [self.compile(q, holds) for q in value]
            return reduce(and_ if (key == "$and") == holds else or_, [F.lit(holds) if p is None else p for p in parts])
        if key == "$not":
            inner = self.compile(value, not holds)
            return F.lit(not holds) if inner is None else inner
        if key.startswith("$"):
            raise ValueError(f"{key} isn't supported")
        return self._field(key, value, holds)

    def _field(self, key: str, condition: Any, holds: bool) -> Column:
        if not isinstance(condition, dict):
            return self._compare(key, "$eq", condition, holds)
        if not condition:
            raise ValueError(f"the condition on {key} is empty")
        return reduce(and_ if holds else or_, [self._operator(key, op, v, holds) for op, v in condition.items()])

    def _operator(self, key: str, op: str, value: Any, holds: bool) -> Column:
        if op == "$in":
            if not isinstance(value, (list, tuple)):
                raise ValueError("$in takes a list")
            return reduce(or_ if holds else and_, [self._compare(key, "$eq", v, holds) for v in value]) if value else F.lit(not holds)
        if op == "$size":
            column, kind = self._resolve(key)
            if not isinstance(kind, T.ArrayType):
                raise ValueError(f"{key} isn't an array")
            same = F.size(column) == F.lit(int(value))
            return same if holds else ~same
        if op not in COMPARE:
            raise ValueError(f"{op} isn't supported")
        return self._compare(key, op, value, holds)

    def _compare(self, key: str, op: str, value: Any, holds: bool) -> Column:
        op = op if holds else OPPOSITE[op]
        if key in self.shredded:
            return shredded_compare(*[F.col(c) for c in self.shredded[key]], op, value)
        if key in self.promoted:
            name = self.promoted[key]
            return plain_compare(F.col(f"`{name}`"), self.schema[name].dataType, op, value)
        first, *rest = split_path(key)
        if rest and first in self.json_columns and first in self.schema.fieldNames():
            return json_compare(F.try_parse_json(F.col(f"`{first}`")), rest, op, value)
        column, kind = self._resolve(key)
        return plain_compare(column, kind, op, value)

    def _resolve(self, key: str) -> tuple[Column, T.DataType]:
        first, *rest = split_path(key)
        if key in self.schema.fieldNames():
            return F.col(f"`{key}`"), self.schema[key].dataType
        if first not in self.schema.fieldNames():
            raise ValueError(f"no column {first}")
        column, kind = F.col(f"`{first}`"), self.schema[first].dataType
        for part in rest:
            if isinstance(kind, T.ArrayType) and part.startswith("["):
                column, kind = F.get(column, F.lit(int(part[1:-1]))), kind.elementType
            elif isinstance(kind, T.StructType) and part in kind.fieldNames():
                column, kind = column.getField(part), kind[part].dataType
            else:
                raise ValueError(f"{key} has no {part}")
        return column, kind


def quoted(name: str) -> str:
    """A column's whole name, dots included."""
    return "`" + name.replace("`", "``") + "`"


def find(df: DataFrame, query: dict | None = None, where: str | None = None, orid: int | None = None, id_column: str = "orid", **options: Any) -> DataFrame:
    """Rows that satisfy everything given: a query, SQL text, an id."""
    condition = Compiler(df.schema, **options).compile(query)
    if condition is not None:
        df = df.where(condition)
    if where is not None:
        df = df.where(where)
    if orid is not None:
        df = df.where(F.col(id_column) == orid)
    return df


def in_group(df: DataFrame, group: dict[str, Any] | None) -> DataFrame:
    """Rows of one group of field values; null is a value."""
    for name, value in (group or {}).items():
        df = df.where(F.col(f"`{name}`").eqNullSafe(F.lit(value)))
    return df


def json_value(column: Column | str, path: str, kind: str = "string") -> Column:
    """What a dotted path of a JSON text holds, null if it is missing or of another type."""
    column = F.col(column) if isinstance(column, str) else column
    return F.try_variant_get(F.try_parse_json(column), json_path(split_path(path)), kind)
