"""Statements and expressions."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Name:
    table: str | None
    column: str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Sign:
    op: str
    item: object


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class Op:
    """Arithmetic, comparison, AND, OR."""

    op: str
    left: object
    right: object


@dataclass(frozen=True)
class IsNull:
    item: object
    negated: bool


@dataclass(frozen=True)
class Between:
    item: object
    low: object
    high: object
    negated: bool


@dataclass(frozen=True)
class In:
    item: object
    options: tuple
    negated: bool


@dataclass(frozen=True)
class Like:
    item: object
    pattern: object
    negated: bool


@dataclass(frozen=True)
class Aggregate:
    """``item`` is None for COUNT(*)."""

    function: str
    item: object
    distinct: bool


def children(e) -> tuple:
    match e:
        case Op(_, a, b) | Like(a, b, _):
            return (a, b)
        case Sign(_, a) | Not(a) | IsNull(a, _):
            return (a,)
        case Between(a, b, c, _):
            return (a, b, c)
        case In(a, options, _):
            return (a, *options)
        case Aggregate(_, a, _):
            return () if a is None else (a,)
    return ()


def walk(e):
    yield e
    for c in children(e):
        yield from walk(c)


def aggregates(e) -> list[Aggregate]:
    return [x for x in walk(e) if isinstance(x, Aggregate)]


@dataclass
class Item:
    expr: object
    label: str
    alias: str | None = None


@dataclass
class Source:
    table: str
    alias: str


@dataclass
class Join:
    how: str
    source: Source
    on: object


@dataclass
class Order:
    expr: object
    descending: bool


@dataclass
class Select:
    items: list[Item]
    source: Source
    distinct: bool = False
    joins: list[Join] = field(default_factory=list)
    where: object = None
    group: list = field(default_factory=list)
    having: object = None
    order: list[Order] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list]


@dataclass
class Update:
    table: str
    sets: list[tuple[str, object]]
    where: object = None


@dataclass
class Delete:
    table: str
    where: object = None


@dataclass
class ColumnDef:
    name: str
    type: str
    pk: bool = False


@dataclass
class CreateTable:
    table: str
    columns: list[ColumnDef]


@dataclass
class DropTable:
    table: str


@dataclass
class CreateIndex:
    name: str
    table: str
    column: str


@dataclass
class DropIndex:
    name: str


@dataclass
class Transaction:
    verb: str


@dataclass
class Explain:
    select: Select
