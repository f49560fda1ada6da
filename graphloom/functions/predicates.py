"""Predicates on property values, as Columns that are never null.

Every atom is false on an absent value, negated or not: `neq` and `without` need the value to exist. Range atoms are false on NaN. Negation is
pushed to the atoms, so an absent value stays false under NOT too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class P:
    """A predicate and its negation, each a function of (column, type name)."""

    test: Callable[[Column, str], Column]
    name: str = "custom"
    inverse: Callable[[], P] | None = None

    def column(self, col: Column, kind: str = "string") -> Column:
        return F.coalesce(self.test(col, kind), F.lit(False))

    def negate(self) -> P:
        if self.inverse is None:
            return P(lambda c, k: c.isNotNull() & ~self.column(c, k), f"not {self.name}", lambda: self)
        return self.inverse()

    def and_(self, other: P) -> P:
        return both(self, other)

    def or_(self, other: P) -> P:
        return either(self, other)

    __and__, __or__, __invert__ = and_, or_, negate

    # Factories, named as users of traversals know them.
    @staticmethod
    def eq(v):
        return eq(v)

    @staticmethod
    def neq(v):
        return neq(v)

    @staticmethod
    def lt(v):
        return _ordered("lt", v)

    @staticmethod
    def lte(v):
        return _ordered("lte", v)

    @staticmethod
    def gt(v):
        return _ordered("gt", v)

    @staticmethod
    def gte(v):
        return _ordered("gte", v)

    @staticmethod
    def within(*v):
        return within(v[0] if len(v) == 1 and isinstance(v[0], (list, tuple, set)) else v)

    @staticmethod
    def without(*v):
        return without(v[0] if len(v) == 1 and isinstance(v[0], (list, tuple, set)) else v)

    @staticmethod
    def inside(a, b):
        return both(P.gt(a), P.lt(b))

    @staticmethod
    def between(a, b):
        return both(P.gte(a), P.lt(b))

    @staticmethod
    def outside(a, b):
        return either(P.lt(a), P.gt(b))

    @staticmethod
    def not_(p):
        return p.negate()

    @staticmethod
    def starting_with(s):
        return P(lambda c, k: c.startswith(s), "startingWith")

    @staticmethod
    def ending_with(s):
        return P(lambda c, k: c.endswith(s), "endingWith")

    @staticmethod
    def containing(s):
        return P(lambda c, k: c.contains(s), "containing")


def literal(v, kind: str):
    """A literal in the column's type where that loses nothing."""
    if isinstance(v, Column):
        return v
    if kind == "string" and not isinstance(v, str):
        return F.lit(str(v))
    if kind in ("timestamp", "date") or kind.startswith("array"):
        return F.lit(v).cast(kind)
    return F.lit(v)


def eq(v) -> P:
    """Null asks for absence."""
    if v is None:
        return P(lambda c, k: c.isNull(), "eq", lambda: neq(None))
    return P(lambda c, k: c == literal(v, k), "eq", lambda: neq(v))


def neq(v) -> P:
    """Null asks for presence."""
    if v is None:
        return P(lambda c, k: c.isNotNull(), "neq", lambda: eq(None))
    return P(lambda c, k: c.isNotNull() & (c != literal(v, k)), "neq", lambda: eq(v))


_OPPOSITE = {"lt": "gte", "gte": "lt", "gt": "lte", "lte": "gt"}
_COMPARE = {"lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__}


def _ordered(op: str, v) -> P:
    def test(c: Column, kind: str) -> Column:
        x = _COMPARE[op](c, literal(v, kind))
        return x & ~F.isnan(c) if kind in ("double", "float") else x

    return P(test, op, lambda: _ordered(_OPPOSITE[op], v))


def within(values) -> P:
    """Nothing is within an empty list."""
    values = list(values)
    return P(lambda c, k: c.isin([literal(v, k) for v in values]) if values else F.lit(False), "within", lambda: without(values))


def without(values) -> P:
    """Without an empty list: whatever exists."""
    values = list(values)
    return P(lambda c, k: c.isNotNull() & (~c.isin([literal(v, k) for v in values]) if values else F.lit(True)), "without", lambda: within(values))


def both(a: P, b: P) -> P:
    return P(lambda c, k: a.column(c, k) & b.column(c, k), "and", lambda: either(a.negate(), b.negate()))


def either(a: P, b: P) -> P:
    return P(lambda c, k: a.column(c, k) | b.column(c, k), "or", lambda: both(a.negate(), b.negate()))


def as_predicate(v) -> P:
    return v if isinstance(v, P) else eq(v)
