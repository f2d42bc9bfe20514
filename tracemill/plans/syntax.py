"""Syntax trees. Equal trees are equal values, which is how aggregates and group keys are recognised again."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: int | float | str | bool | None


@dataclass(frozen=True)
class Interval(Expr):
    ns: int


@dataclass(frozen=True)
class Name(Expr):
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # - not
    x: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str  # + - * / % || = != < <= > >= and or
    a: Expr
    b: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    x: Expr


@dataclass(frozen=True)
class Between(Expr):
    x: Expr
    low: Expr
    high: Expr


@dataclass(frozen=True)
class In(Expr):
    x: Expr
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Like(Expr):
    x: Expr
    pattern: str


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Case(Expr):
    """The value of the first condition that holds, else the last value."""

    whens: tuple[tuple[Expr, Expr], ...]
    other: Expr


@dataclass(frozen=True)
class Cast(Expr):
    x: Expr
    to: str


@dataclass(frozen=True)
class Over(Expr):
    """A function over the rows around each row."""

    call: Call
    partition: tuple[Expr, ...]
    order: tuple["Order", ...]
    #: Rows before and after, None without bound; no frame: the usual one.
    frame: tuple[int | None, int | None] | None = None


@dataclass(frozen=True)
class Sets(Expr):
    """Group keys in several combinations; cube and rollup name theirs."""

    kind: str  # cube rollup sets
    keys: tuple[Expr, ...]
    sets: tuple[tuple[Expr, ...], ...] = ()


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    table: str
    alias: str | None = None
    #: A statement in place of a table.
    query: "Select | Compound | None" = None

    @property
    def name(self) -> str:
        return self.alias or self.table


@dataclass(frozen=True)
class Join:
    how: str  # inner left right full cross left_semi left_anti
    source: Source
    on: Expr | None
    using: tuple[str, ...] = ()


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: Source
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Compound:
    """Two statements put together, by place of their columns."""

    op: str  # union intersect except
    all: bool
    a: "Select | Compound"
    b: "Select | Compound"
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class With:
    """A statement with statements that have names."""

    named: tuple[tuple[str, "Select | Compound"], ...]
    query: "Select | Compound"


def children(e: Expr) -> tuple[Expr, ...]:
    if isinstance(e, (Unary, IsNull, Like)):
        return (e.x,)
    if isinstance(e, Cast):
        return (e.x,)
    if isinstance(e, Case):
        return (*(x for w in e.whens for x in w), e.other)
    if isinstance(e, Over):
        return (*e.call.args, *((e.call.where,) if e.call.where is not None else ()), *e.partition, *(o.expr for o in e.order))
    if isinstance(e, Sets):
        return (*e.keys, *(x for w in e.sets for x in w))
    if isinstance(e, Binary):
        return (e.a, e.b)
    if isinstance(e, Between):
        return (e.x, e.low, e.high)
    if isinstance(e, In):
        return (e.x, *e.items)
    if isinstance(e, Call):
        return (*e.args, *((e.where,) if e.where is not None else ()))
    return ()
