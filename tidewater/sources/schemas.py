"""Schemas of runs over time: a lattice of types, unions by name, one scan per schema.

Inferred types change from run to run (an all-whole ``price`` one day, a broken one the next).
Each attempt's schema is kept as text in its audit row.  A read over many attempts groups
them by that text, scans each group with its own schema, and casts to the common one: as many
scans as there are distinct schemas, however many attempts.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    FractionalType,
    IntegerType,
    LongType,
    MapType,
    NullType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

ERROR, TEXT = "error", "string"

#: Whole-number types by width, with the decimal digits that hold them.
_WHOLE = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 20}
_MAX_DIGITS = 38


class IncompatibleSchemasError(ValueError):
    """No type holds what a column has in different runs."""


def _decimal(t: DataType) -> DecimalType | None:
    if isinstance(t, DecimalType):
        return t
    return DecimalType(_WHOLE[type(t)], 0) if type(t) in _WHOLE else None


def widest(a: DataType, b: DataType, on_conflict: str = ERROR) -> DataType | None:
    """The narrowest type that holds both, None if there is none.

    Whole numbers widen by size, and to decimal, float or double (a ``bigint`` beyond 2**53 is
    rounded there, as in Spark's own coercion); a date widens to either timestamp; the two
    timestamps do not mix; arrays, maps and structs widen inside, structs by field name.
    With ``on_conflict="string"`` other pairs of simple types are text, as CSV inference has it."""
    if a == b:
        return a
    for x, y in ((a, b), (b, a)):
        if isinstance(x, NullType):
            return y
        if isinstance(x, DateType) and isinstance(y, (TimestampType, TimestampNTZType)):
            return y
        if isinstance(x, DoubleType) and (type(y) in _WHOLE or isinstance(y, FractionalType)):
            return x
        if isinstance(x, FloatType):
            if type(y) in (ByteType, ShortType):
                return x
            if type(y) in _WHOLE or isinstance(y, DecimalType):
                return DoubleType()
    if type(a) in _WHOLE and type(b) in _WHOLE:
        return max(a, b, key=lambda t: _WHOLE[type(t)])
    da, db = _decimal(a), _decimal(b)
    if da and db:
        scale = max(da.scale, db.scale)
        digits = max(da.precision - da.scale, db.precision - db.scale) + scale
        if digits <= _MAX_DIGITS:
            return DecimalType(digits, scale)
    elif isinstance(a, ArrayType) and isinstance(b, ArrayType):
        inner = widest(a.elementType, b.elementType, on_conflict)
        return inner and ArrayType(inner, True)
    elif isinstance(a, MapType) and isinstance(b, MapType):
        key, value = (widest(x, y, on_conflict) for x, y in ((a.keyType, b.keyType), (a.valueType, b.valueType)))
        return MapType(key, value, True) if key and value else None
    elif isinstance(a, StructType) and isinstance(b, StructType):
        merged, bad = _merge([a, b], on_conflict)
        return None if bad else merged
    nested = (ArrayType, MapType, StructType)
    if on_conflict == TEXT and not isinstance(a, nested) and not isinstance(b, nested):
        return StringType()
    return None


def _merge(schemas: Sequence[StructType], on_conflict: str) -> tuple[StructType, list[str]]:
    """Union by name, ignoring case, in order of first appearance; and the names that clash."""
    names: dict[str, str] = {}
    types: dict[str, DataType | None] = {}
    for schema in schemas:
        for f in schema.fields:
            key = f.name.lower()
            if key not in names:
                names[key], types[key] = f.name, f.dataType
            elif types[key] is not None:
                types[key] = widest(types[key], f.dataType, on_conflict)
    fields = [StructField(names[k], t, True) for k, t in types.items() if t is not None]
    return StructType(fields), [names[k] for k, t in types.items() if t is None]


def unify(versions: Iterable[tuple[StructType, Sequence[str]]], on_conflict: str = ERROR,
          scans: Sequence[DataFrame] | None = None) -> StructType:
    """Common schema of ``versions``: pairs of a schema and the labels (run dates) that have it.

    Inference calls a column without any value text.  Where such a type is all that stands in
    the way and ``scans`` (one per version) shows that the column holds nothing there, it does
    not count; only columns in conflict are looked at, up to their first value.  Otherwise
    raises :class:`IncompatibleSchemasError` naming each column that no type holds, with the
    types and the dates they come from."""
    if on_conflict not in (ERROR, TEXT):
        raise ValueError(f"on_conflict is {ERROR!r} or {TEXT!r}")
    versions = list(versions)
    merged, bad = _merge([s for s, _ in versions], ERROR)
    if bad and scans is not None:
        low = {n.lower() for n in bad}
        for i, (schema, labels) in enumerate(versions):
            void = {f.name for f in schema.fields if f.name.lower() in low and f.dataType == StringType()
                    and scans[i].filter(F.col(f"`{f.name}`").isNotNull()).isEmpty()}
            versions[i] = (StructType([StructField(f.name, NullType() if f.name in void else f.dataType, True)
                                       for f in schema.fields]), labels)
        merged, bad = _merge([s for s, _ in versions], ERROR)
    if bad and on_conflict == TEXT:
        merged, bad = _merge([s for s, _ in versions], TEXT)
    if not bad:
        return merged
    told = []
    for name in bad:
        at: dict[str, list[str]] = {}
        for schema, labels in versions:
            for f in schema.fields:
                if f.name.lower() == name.lower():
                    at.setdefault(f.dataType.simpleString(), []).extend(labels)
        kinds = ", ".join(f"{kind} on {_span(labels)}" for kind, labels in at.items())
        told.append(f"{name}: {kinds}")
    raise IncompatibleSchemasError("columns change to types that do not fit together: " + "; ".join(told))


def _span(labels: Sequence[str]) -> str:
    """Dates for a message: all of up to five, else the first, the last and their number."""
    labels = sorted(set(labels))
    if len(labels) <= 5:
        return ", ".join(labels)
    return f"{labels[0]} to {labels[-1]} ({len(labels)} dates)"


def schema_text(schema: StructType) -> str:
    """Canonical text of a data schema: equal for equal names and types."""
    return json.dumps(StructType([StructField(f.name, f.dataType, True) for f in schema.fields]).jsonValue(),
                      sort_keys=True, separators=(",", ":"))


def schema_from_text(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))


def _as(col: Column, have: DataType, want: DataType) -> Column:
    """``col`` as ``want``; structs by field name, fields that are missing null."""
    if have == want:
        return col
    if isinstance(want, StructType):
        inner = {f.name.lower(): f for f in have.fields}
        parts = [(_as(col.getField(inner[f.name.lower()].name), inner[f.name.lower()].dataType, f.dataType)
                  if f.name.lower() in inner else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(want, ArrayType) and isinstance(have, ArrayType):
        return F.transform(col, lambda x: _as(x, have.elementType, want.elementType))
    if isinstance(want, MapType) and isinstance(have, MapType):
        keyed = F.transform_keys(col, lambda k, _: _as(k, have.keyType, want.keyType))
        return F.transform_values(keyed, lambda _, v: _as(v, have.valueType, want.valueType))
    return col.cast(want)


def conform(df: DataFrame, target: StructType, carry: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns of ``target``, by name; a column it lacks is null.  A column that
    has its type already stays a plain reference, so filters on it reach the scan."""
    have = {f.name.lower(): f for f in df.schema.fields}
    out = []
    for f in target.fields:
        own = have.get(f.name.lower())
        if own is None:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            out.append(_as(F.col(f"`{own.name}`"), own.dataType, f.dataType).alias(f.name))
    return df.select(*out, *carry)


def union_scans(scans: Sequence[DataFrame], target: StructType, carry: Sequence[str] = ()) -> DataFrame:
    """The scans, each made to ``target``, as one DataFrame."""
    return reduce(DataFrame.unionByName, [conform(s, target, carry) for s in scans])
