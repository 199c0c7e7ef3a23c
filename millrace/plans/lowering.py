"""Scopes, static types, and lowering of parsed statements to DataFrames and Columns.

Types are known before anything is lowered, since division, equality and the
errors of ill-typed operands depend on them. Every source column gets a unique
internal name, so that equal names of joined tables never clash; the labels come
back with the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import CompileError, ExecutionError
from millrace.functions import between, divide, equals, first_of_group, int_divide, is_in, like, not_equals
from millrace.plans import ast
from millrace.types import BOOL, FLOAT, INT, NULL, NUMBERS, OTHER, TEXT, kind_of

ROWID = "__rowid"


@dataclass
class Bound:
    """A source in scope: its alias, and for each column (in order) the internal name and the kind."""

    alias: str
    columns: dict[str, tuple[str, str]]
    rowid: str


class Scope:
    """Names to typed columns. ``known`` maps whole expressions, such as group keys and aggregates, to columns made earlier."""

    def __init__(self, sources: list[Bound], known: dict | None = None, aliases: dict[str, object] | None = None):
        self.sources, self.known, self.aliases = sources, known, aliases or {}

    def find(self, name: ast.Name) -> tuple[str, str] | None:
        """(internal name, kind); None if no source has the column."""
        if name.table is not None:
            for s in self.sources:
                if s.alias == name.table:
                    if name.column in s.columns:
                        return s.columns[name.column]
                    raise ExecutionError(f"unknown column {name.table}.{name.column}")
            raise ExecutionError(f"unknown table or alias {name.table}")
        found = [s.columns[name.column] for s in self.sources if name.column in s.columns]
        if len(found) > 1:
            raise ExecutionError(f"ambiguous column {name.column}")
        return found[0] if found else None

    def lower(self, e) -> tuple[Column, str]:
        if self.known is not None and e in self.known:
            return self.known[e]
        match e:
            case ast.Lit(value):
                return self.literal(value)
            case ast.Name():
                return self.name(e)
            case ast.Sign(op, item):
                c, k = self.lower(item)
                number(k, op)
                return (-c if op == "-" else c), k
            case ast.Not(item):
                return ~self.truth(item), BOOL
            case ast.Op("AND", a, b):
                return self.truth(a) & self.truth(b), BOOL
            case ast.Op("OR", a, b):
                return self.truth(a) | self.truth(b), BOOL
            case ast.Op(op, a, b) if op in "+-*/":
                return self.arithmetic(op, self.lower(a), self.lower(b))
            case ast.Op(op, a, b):
                return self.comparison(op, self.lower(a), self.lower(b)), BOOL
            case ast.IsNull(item, negated):
                c, _ = self.lower(item)
                return (c.isNotNull() if negated else c.isNull()), BOOL
            case ast.Between(item, low, high, negated):
                (c, k), (lo, lk), (hi, hk) = self.lower(item), self.lower(low), self.lower(high)
                ordered(k, lk)
                ordered(k, hk)
                return between(c, lo, hi, negated), BOOL
            case ast.In(item, options, negated):
                c, k = self.lower(item)
                made = [(o, comparable(k, ok)) for o, ok in map(self.lower, options)]
                return is_in(c, made, negated), BOOL
            case ast.Like(item, pattern, negated):
                (c, _), (p, pk) = self.lower(item), self.lower(pattern)
                if pk not in (TEXT, NULL):
                    raise CompileError("LIKE needs a text pattern")
                return like(c, p, negated), BOOL
            case ast.Aggregate(f, _, _):
                raise ExecutionError(f"{f} is not allowed here")
            case ast.Star():
                raise ExecutionError("* stands for columns only in a select list")
        raise ExecutionError(f"can't evaluate {e}")

    def literal(self, value) -> tuple[Column, str]:
        if value is None:
            return F.lit(None), NULL
        if isinstance(value, int):
            if not -(2**63) <= value < 2**63:
                raise CompileError(f"{value} does not fit 64 bits")
            return F.lit(value).cast("long"), INT
        return F.lit(value), FLOAT if isinstance(value, float) else TEXT

    def name(self, e: ast.Name) -> tuple[Column, str]:
        if found := self.find(e):
            return F.col(found[0]), found[1]
        if e.table is None and e.column in self.aliases:
            return self.lower(self.aliases[e.column])
        raise ExecutionError(f"unknown column {e.column}")

    def truth(self, e) -> Column:
        c, k = self.lower(e)
        if k == NULL:
            return c.cast("boolean")
        if k != BOOL:
            raise CompileError(f"a condition is needed, not {k}")
        return c

    def arithmetic(self, op: str, a: tuple[Column, str], b: tuple[Column, str]) -> tuple[Column, str]:
        (x, xk), (y, yk) = a, b
        if OTHER not in (xk, yk):
            number(xk, op)
            number(yk, op)
        whole = {xk, yk} <= {INT, NULL}
        if whole:
            x, y = x.cast("long"), y.cast("long")
        if op == "/":
            return (int_divide(x, y), INT) if whole else (divide(x, y), FLOAT)
        made = {"+": x.__add__, "-": x.__sub__, "*": x.__mul__}[op](y)
        return made, INT if whole else OTHER if OTHER in (xk, yk) else FLOAT

    def comparison(self, op: str, a: tuple[Column, str], b: tuple[Column, str]) -> Column:
        (x, xk), (y, yk) = a, b
        if op == "=":
            return equals(x, y, comparable(xk, yk))
        if op == "<>":
            return not_equals(x, y, comparable(xk, yk))
        ordered(xk, yk)
        return {"<": x.__lt__, "<=": x.__le__, ">": x.__gt__, ">=": x.__ge__}[op](y)


def number(kind: str, op: str) -> None:
    if kind not in NUMBERS:
        raise CompileError(f"{op} needs numbers, not {kind}")


def comparable(a: str, b: str) -> bool:
    return a == b or {a, b} <= set(NUMBERS) or NULL in (a, b) or OTHER in (a, b)


def ordered(a: str, b: str) -> None:
    if not comparable(a, b):
        raise CompileError(f"cannot order {a} and {b}")


def file_place(df: DataFrame) -> Column:
    """A row's file and place in it, which filters can pass on their way to the scan; a running number where no files are read."""
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    try:
        _ = df.select(place).schema
    except AnalysisException:
        return F.monotonically_increasing_id()
    return place


def bind(df: DataFrame, alias: str, place: int, with_rowid: bool) -> tuple[DataFrame, Bound]:
    """A table's DataFrame under internal names; a row id is kept, or made for files that have none, where needed."""
    rowid, columns, picks = f"r{place}", {}, []
    for f in df.schema.fields:
        if f.name == ROWID:
            continue
        inner = f"c{place}_{len(columns)}"
        columns[f.name.lower()] = (inner, kind_of(f.dataType))
        picks.append(F.col(f"`{f.name}`").alias(inner))
    if with_rowid:
        picks.append((F.col(ROWID) if ROWID in df.columns else file_place(df)).alias(rowid))
    return df.select(*picks), Bound(alias, columns, rowid)


#: The largest LIMIT or OFFSET of one plan node.
MOST = 2**31 - 1


@dataclass
class Lowered:
    df: DataFrame
    labels: list[str]


def bare_names(e, keys) -> list[ast.Name]:
    """Column references outside aggregates and group keys."""
    if e in keys or isinstance(e, ast.Aggregate):
        return []
    if isinstance(e, ast.Name):
        return [e]
    return [n for c in ast.children(e) for n in bare_names(c, keys)]


def lower_select(s: ast.Select, open_table: Callable[[str], DataFrame]) -> Lowered:
    """The DataFrame of a SELECT, its columns named o0, o1 ... under ``labels``."""
    grouped = bool(s.group or s.having is not None or any(ast.aggregates(x) for x in [i.expr for i in s.items] + [o.expr for o in s.order]))
    if s.having is not None and not s.group and not any(ast.aggregates(x) for x in [s.having] + [i.expr for i in s.items]):
        raise ExecutionError("HAVING needs GROUP BY or an aggregate")
    star = any(isinstance(i.expr, ast.Star) for i in s.items)
    named = {i.alias for i in s.items if i.alias and isinstance(i.expr, ast.Aggregate)}
    loose = grouped and (star or any(n.table or n.column not in named for x in [i.expr for i in s.items] + [o.expr for o in s.order] + ([s.having] if s.having is not None else []) for n in bare_names(x, set(s.group))))
    paged = s.limit is not None or s.offset > 0
    with_rowid = paged or loose or (s.distinct and bool(s.order))

    aliases = [s.source.alias, *(j.source.alias for j in s.joins)]
    if len(set(aliases)) < len(aliases):
        raise ExecutionError("an alias is used twice")
    df, first = bind(open_table(s.source.table), s.source.alias, 0, with_rowid)
    sources = [first]
    for place, j in enumerate(s.joins, 1):
        right, bound = bind(open_table(j.source.table), j.source.alias, place, with_rowid)
        sources.append(bound)
        df = df.join(right, Scope(sources).truth(j.on), j.how)
    scope = Scope(sources)
    if s.where is not None:
        df = df.where(scope.truth(s.where))
    rowids = [F.col(b.rowid) for b in sources] if with_rowid else []

    items: list[tuple[object, str]] = []
    for i in s.items:
        if isinstance(i.expr, ast.Star):
            items += [(ast.Name(b.alias, c), c) for b in sources for c in b.columns]
        else:
            items.append((i.expr, i.label))
    if grouped:
        df, scope, rowids = _group(s, df, scope, [e for e, _ in items], rowids)
        if s.having is not None:
            df = df.where(scope.truth(s.having))

    outputs = [scope.lower(e)[0].alias(f"o{n}") for n, (e, _) in enumerate(items)]
    names, labels = [f"o{n}" for n in range(len(items))], [text for _, text in items]
    keys, directions = [], []
    for o in s.order:
        keys.append(_order_key(o.expr, labels, scope))
        directions.append(o.descending)
    if s.distinct:
        df = _distinct(df, outputs, names, keys, rowids)
        rowids = [F.col("__first")] if rowids else []
    else:
        df = df.select(*outputs, *[k.alias(f"k{n}") for n, k in enumerate(keys) if not isinstance(k, str)], *rowids)
    if keys or paged:
        by = [F.col(k if isinstance(k, str) else f"k{n}") for n, k in enumerate(keys)]
        by = [c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in zip(by, directions, strict=True)]
        df = df.orderBy(*by, *(rowids if paged else []))
    left = s.offset
    while left > 0:  # offsets add up
        df = df.offset(min(left, MOST))
        left -= MOST
    if s.limit is not None and s.limit <= MOST:
        df = df.limit(s.limit)
    elif s.limit is not None and df.count() > s.limit:
        raise ExecutionError(f"LIMIT above {MOST} can't cut more rows than that")
    return Lowered(df.select(*names), labels)


def _order_key(e, labels: list[str], scope: Scope) -> Column | str:
    """An output's name, or a column over the input."""
    if isinstance(e, ast.Lit) and isinstance(e.value, int):
        if not 1 <= e.value <= len(labels):
            raise ExecutionError(f"ORDER BY position {e.value} is not in the select list")
        return f"o{e.value - 1}"
    if isinstance(e, ast.Name):
        text = f"{e.table}.{e.column}" if e.table else e.column
        if text in labels:
            return f"o{labels.index(text)}"
    return scope.lower(e)[0]


def _distinct(df: DataFrame, outputs: list[Column], names: list[str], keys: list, rowids: list[Column]) -> DataFrame:
    """Distinct outputs; sort keys that are not outputs, and places, are those of the first row."""
    hidden = [(f"k{n}", k) for n, k in enumerate(keys) if not isinstance(k, str)]
    wide = df.select(*outputs, *[k.alias(n) for n, k in hidden], *([F.struct(*rowids).alias("__at")] if rowids else []))
    if not rowids:
        return wide.select(*names).distinct()
    return wide.groupBy(*names).agg(*[F.min_by(n, "__at").alias(n) for n, _ in hidden], F.min("__at").alias("__first"))


def _group(s: ast.Select, df: DataFrame, scope: Scope, items: list, rowids: list[Column]) -> tuple[DataFrame, Scope, list[Column]]:
    """Group by keys; aggregates, and columns that are neither, become columns of the result."""
    used = [*items, *(o.expr for o in s.order), *([s.having] if s.having is not None else [])]
    by_alias = {i.alias: i.expr for i in s.items if i.alias and isinstance(i.expr, ast.Aggregate)}
    keys = dict.fromkeys(s.group)
    for k in keys:
        if ast.aggregates(k):
            raise ExecutionError("an aggregate can't be grouped by")
    wanted = dict.fromkeys(a for e in used for a in ast.aggregates(e))
    columns: list[Column] = []
    known: dict = {}
    for n, k in enumerate(keys):
        c, kind = scope.lower(k)
        columns.append(c.alias(f"g{n}"))
        known[k] = (F.col(f"g{n}"), kind)
    made: list[Column] = []
    for n, a in enumerate(wanted):
        if a.item is None:
            made.append(F.count(F.lit(1)).alias(f"a{n}"))
            known[a] = (F.col(f"a{n}"), INT)
            continue
        if ast.aggregates(a.item):
            raise ExecutionError("aggregates can't be nested")
        c, kind = scope.lower(a.item)
        if a.function in ("SUM", "AVG"):
            number(kind, a.function)
            c = c.cast("long" if kind == INT and a.function == "SUM" else "double")
        columns.append(c.alias(f"v{n}"))
        made.append(F.expr(f"{a.function}({'DISTINCT ' * a.distinct}`v{n}`)").alias(f"a{n}"))
        known[a] = (F.col(f"a{n}"), INT if a.function == "COUNT" else FLOAT if a.function == "AVG" else FLOAT if kind == NULL else kind)
    loose = dict.fromkeys(x for e in used for x in bare_names(e, keys) if scope.find(x) or x.column not in by_alias)
    for n, x in enumerate(loose):
        c, kind = scope.lower(x)
        columns.append(c.alias(f"b{n}"))
        made.append(first_of_group(F.col(f"b{n}"), *rowids).alias(f"b{n}"))
        known[x] = (F.col(f"b{n}"), kind)
    if rowids:
        made.append(F.min(F.struct(*rowids)).alias("__at"))
    narrow = df.select(*columns, *rowids) if columns or rowids else df
    names = [f"g{n}" for n in range(len(keys))]
    if not made:
        out = narrow.select(*names).distinct()
    else:
        out = narrow.groupBy(*names).agg(*made) if names else narrow.agg(*made)
    # HAVING and ORDER BY see aliases of aggregates, unless a column has the name
    return out, Scope(scope.sources, known, by_alias), [F.col("__at")] if rowids else []
