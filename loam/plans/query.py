"""Queries over one version of a table: built step by step, planned by Spark over the files that may match."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.plans.expr import Constant, Expr, parse
from loam.plans.types import UnsupportedExpression, constant, literal

if TYPE_CHECKING:
    from loam.operators.table import Table

DIRECTIONS = {
    "asc": Column.asc_nulls_last,
    "desc": Column.desc_nulls_last,
    "asc_nils_first": Column.asc_nulls_first,
    "asc_nils_last": Column.asc_nulls_last,
    "desc_nils_first": Column.desc_nulls_first,
    "desc_nils_last": Column.desc_nulls_last,
}
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


@dataclasses.dataclass(frozen=True)
class Query:
    """An immutable query; each step returns a new one."""

    table: Table
    condition: Expr = Constant(True)
    order: tuple[tuple[str, str], ...] = ()
    most: int | None = None
    skip: int = 0
    shown: tuple[str, ...] | None = None
    version: int | None = None
    as_of: dt.datetime | None = None

    def filter(self, *parts: object, **equals: object) -> Query:
        """Narrows by filters, booleans, dicts and keyword equalities; successive calls all hold."""
        new = parse(*parts, **equals)
        condition = new if isinstance(self.condition, Constant) and self.condition.value else self.condition & new
        return dataclasses.replace(self, condition=condition)

    def sort(self, *keys: str | tuple[str, str]) -> Query:
        """Orders by columns, each with a direction (asc unless said); nulls come last unless said."""
        order = tuple((k, "asc") if isinstance(k, str) else tuple(k) for k in keys)
        for name, direction in order:
            self.table.spec.type_of(name)
            if direction not in DIRECTIONS:
                raise UnsupportedExpression(f"no direction: {direction!r}")
        return dataclasses.replace(self, order=order)

    def limit(self, most: int) -> Query:
        return dataclasses.replace(self, most=most)

    def offset(self, skip: int) -> Query:
        return dataclasses.replace(self, skip=skip)

    def select(self, *columns: str) -> Query:
        for c in columns:
            self.table.spec.type_of(c)
        return dataclasses.replace(self, shown=columns)

    def at(self, version: int | None = None, as_of: dt.datetime | None = None) -> Query:
        """Reads an old version, by number or time; the number counts if both are given."""
        return dataclasses.replace(self, version=version, as_of=as_of)

    def after(self, *values: object) -> Query:
        """Rows that come after the given values of the sort columns: keyset paging. Values aren't null."""
        if len(values) != len(self.order):
            raise UnsupportedExpression("as many values as sort columns")
        found: Column | None = None
        for k in range(len(values) - 1, -1, -1):
            name, direction = self.order[k]
            kind = self.table.spec.type_of(name)
            if literal(values[k], kind) is None:
                raise UnsupportedExpression("a page starts after values that aren't null")
            column, value = F.col(f"`{name}`"), constant(literal(values[k], kind), kind)
            beyond = column > value if direction.startswith("asc") else column < value
            if not direction.endswith("first"):
                beyond = beyond | column.isNull()
            found = beyond if found is None else beyond | (column == value) & found
        return self.filter(found) if found is not None else self

    def files(self) -> list:
        """The files that may hold matching rows."""
        return self.table.live_files(self.condition, self.version, self.as_of)

    def _rows(self) -> DataFrame:
        df = self.table.read_files(self.files())
        plain = isinstance(self.condition, Constant) and self.condition.value
        return df if plain else df.where(self.condition.column(self.table.spec))

    def df(self) -> DataFrame:
        df = self._rows()
        if self.order:
            df = df.orderBy(*[DIRECTIONS[d](F.col(f"`{c}`")) for c, d in self.order])
        if self.skip:
            df = df.offset(self.skip)
        if self.most is not None:
            df = df.limit(self.most)
        return df if self.shown is None else df.select(*[f"`{c}`" for c in self.shown])

    def stream(self) -> Iterator:
        """The rows one partition after another, never all at once."""
        return self.df().toLocalIterator()

    def aggregate(self, **named: str | tuple[str, str]) -> DataFrame:
        """One row of aggregates: name="count", or name=(kind, column) with count, sum, avg, min or max.

        Order, limit and offset don't matter. count of a column counts its values that aren't null. A plain count
        of everything is answered by the log alone.
        """
        columns, wanted = [], {n: (k, None) if isinstance(k, str) else tuple(k) for n, k in named.items()}
        for name, (kind, column) in wanted.items():
            if kind not in AGGREGATES or column is None and kind != "count":
                raise UnsupportedExpression(f"no aggregate: {kind!r} of {column!r}")
            if column is not None:
                self.table.spec.type_of(column)
            columns.append(AGGREGATES[kind](F.lit(1) if column is None else F.col(f"`{column}`")).alias(name))
        if all(w == ("count", None) for w in wanted.values()) and isinstance(self.condition, Constant):
            n = sum(f.rows for f in self.files())
            return self.table.spark.createDataFrame([tuple(n for _ in wanted)], ", ".join(f"`{c}` bigint" for c in wanted))
        return self._rows().agg(*columns)

    def count(self) -> int:
        return self.aggregate(n="count").first()["n"]
