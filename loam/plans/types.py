"""Declarations of tables and views, and the errors of the engine."""

from __future__ import annotations

import ctypes
import datetime as dt
import decimal
import enum
import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LoamError(Exception):
    """Anything that this engine refuses."""


class UnsupportedExpression(LoamError):
    """A filter that can't be compiled: an unknown column, a literal of another type, an unknown kind."""


class ConcurrentModification(LoamError):
    """A file to be removed was removed by another commit meanwhile."""


class VersionExpired(LoamError):
    """The version's files were deleted by vacuum."""


class ViewIsReadOnly(LoamError):
    """Views are written by refresh alone."""


@dataclass(frozen=True)
class TableSpec:
    """A table: its columns, how files are laid out, and what is kept about them.

    primary_key names rows for delete_row and update_row; it is not enforced. partition_by columns stay in the files
    and name the folders. stats_columns get minimum, maximum and null count for each file. auto_compact_threshold:
    small files of a partition that an append joins; with auto_compact_async in a thread of its own.
    """

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    sort_within_files: tuple[str, ...] = ()
    stats_columns: tuple[str, ...] = ()
    target_file_size_mb: float = 128
    vacuum_retention_hours: float = 168
    write_buffer_ms: int | None = None
    auto_compact_threshold: int | None = None
    auto_compact_async: bool = False

    def __post_init__(self) -> None:
        if not re.fullmatch(r"\w+", self.name):
            raise ValueError(f"not a table name: {self.name!r}")
        columns = self.schema.fieldNames()
        if len({c.lower() for c in columns}) < len(columns):
            raise ValueError("column names repeat")
        for option in ("primary_key", "partition_by", "sort_within_files", "stats_columns"):
            if unknown := [c for c in getattr(self, option) if c not in columns]:
                raise ValueError(f"{option} names no column: {', '.join(unknown)}")
        for option in ("partition_by", "stats_columns"):
            nested = [c for c in getattr(self, option) if isinstance(self.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType, T.BinaryType))]
            if nested:
                raise ValueError(f"{option} can't hold nested or binary columns: {', '.join(nested)}")
        if self.target_file_size_mb <= 0 or self.vacuum_retention_hours < 0:
            raise ValueError("sizes and times are positive")

    @property
    def skippable_columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.partition_by, *self.stats_columns)))

    def options(self) -> dict[str, str]:
        """The declaration as text, by the names of its options."""
        shown = {f.name: getattr(self, f.name) for f in fields(self)}
        shown |= {"schema": self.schema.simpleString(), "skippable_columns": self.skippable_columns}
        if "sources" in shown:
            shown |= {"sources": tuple(self.sources), "functions": tuple(self.functions), "query": self.query if isinstance(self.query, str) else "(a function)"}
        return {k: ",".join(v) if isinstance(v, tuple) else "" if v is None else str(v) for k, v in shown.items()}

    def type_of(self, column: str) -> T.DataType:
        if column not in self.schema.fieldNames():
            raise UnsupportedExpression(f"{self.name} has no column {column!r}")
        return self.schema[column].dataType


@dataclass(frozen=True)
class ViewSpec(TableSpec):
    """A table whose rows a query makes from sources.

    query: Spark SQL over the aliases of sources, or a function of the refresh session. refresh: "recompute" or
    "partition_incremental", which needs partition_by columns that all sources have among theirs. functions: what the
    refresh session registers by name: UDFs of any kind (pandas and Arrow ones too, with their types), or plain Python
    functions, which return text. max_staleness: seconds after which a worker refreshes.
    """

    sources: Mapping[str, object] = field(default_factory=dict)
    query: str | Callable = ""
    refresh: str = "recompute"
    functions: Mapping[str, Callable] = field(default_factory=dict)
    max_staleness: float | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        if isinstance(self.sources, (list, tuple)):
            object.__setattr__(self, "sources", {s.spec.name: s for s in self.sources})
        if not self.sources or not self.query:
            raise ValueError("a view needs sources and a query")
        if self.refresh not in ("recompute", "partition_incremental"):
            raise ValueError(f"no refresh strategy: {self.refresh!r}")
        if self.refresh == "partition_incremental":
            self.check_alignment()

    def check_alignment(self) -> None:
        if not self.partition_by:
            raise ValueError("partition_incremental needs partition_by")
        for alias, source in self.sources.items():
            if missing := set(self.partition_by) - set(source.spec.partition_by):
                raise ValueError(f"source {alias} isn't partitioned by {', '.join(sorted(missing))}")


#: Python values that fit a column, by the column's type.
_FITS: list[tuple[tuple[type[T.DataType], ...], tuple[type, ...]]] = [
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), (int,)),
    ((T.FloatType, T.DoubleType), (int, float, decimal.Decimal)),
    ((T.DecimalType,), (int, decimal.Decimal, float)),
    ((T.BooleanType,), (bool,)),
    ((T.StringType,), (str,)),
    ((T.DateType,), (dt.date,)),
    ((T.TimestampType, T.TimestampNTZType), (dt.datetime,)),
]


#: Least and greatest values of the integer types.
_BOUNDS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def literal(value: object, kind: T.DataType) -> object:
    """A value as a column of the type holds it; what no column of the type can hold is refused.

    Enum members count by value and zoned times as UTC. A FLOAT column's value is rounded to 32 bits and a DECIMAL
    one's to its scale, half up, as Spark casts them: row predicates and file tests both use the value made here.
    """
    if isinstance(value, enum.Enum):
        value = value.value
    if value is None:
        return None
    for kinds, fits in _FITS:
        if isinstance(kind, kinds):
            if not isinstance(value, fits) or isinstance(value, bool) != isinstance(kind, T.BooleanType):
                break
            if isinstance(kind, T.DateType) and isinstance(value, dt.datetime):
                break
            if isinstance(value, dt.datetime) and value.tzinfo:
                return value.astimezone(dt.UTC).replace(tzinfo=None)
            if isinstance(kind, T.DecimalType):
                return _decimal(value, kind)
            if isinstance(kind, T.FloatType):
                return ctypes.c_float(float(value)).value
            if bits := _BOUNDS.get(type(kind)):
                if not -(1 << bits - 1) <= value < 1 << bits - 1:
                    break
                return int(value)
            return float(value) if isinstance(kind, T.DoubleType) else value
    raise UnsupportedExpression(f"{value!r} is no {kind.simpleString()}")


def _decimal(value: object, kind: T.DecimalType) -> decimal.Decimal:
    exact = decimal.Context(prec=400, rounding=decimal.ROUND_HALF_UP)
    try:
        rounded = decimal.Decimal(str(value)).quantize(decimal.Decimal(1).scaleb(-kind.scale), context=exact)
    except decimal.InvalidOperation:  # not finite
        rounded = decimal.Decimal("NaN")
    if not rounded.is_finite() or abs(rounded) >= decimal.Decimal(10) ** (kind.precision - kind.scale):
        raise UnsupportedExpression(f"{value!r} is no {kind.simpleString()}")
    return rounded


def constant(value: object, kind: T.DataType) -> Column:
    """A value as a column of the type. Times go in as text, so that no machine's time zone touches them."""
    return F.lit(value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value).cast(kind)


def encode(value: object) -> object:
    """A column value as JSON: numbers, text and booleans as such, others as text."""
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    return value if value is None or isinstance(value, (bool, int, float, str)) else value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)


def decode(value: object, kind: T.DataType) -> object:
    """encode() reversed, for a column's type."""
    if value is None:
        return None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return dt.datetime.fromisoformat(value)
    if isinstance(kind, T.DateType):
        return dt.date.fromisoformat(value)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(value))
    return float(value) if isinstance(kind, (T.FloatType, T.DoubleType)) else value
