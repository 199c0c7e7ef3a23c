"""INSERT, UPDATE and DELETE on versioned tables, copy-on-write by file.

Each takes a table's state and gives the next one; nothing is visible until the
state is committed. Only files that hold a matching row are rewritten.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ExecutionError
from millrace.plans.lowering import ROWID, Scope, bind
from millrace.sources.store import Store, Table
from millrace.types import coerce, coerce_column

#: Rows from the driver whose keys are looked up by a pushed-down filter; more keys are joined.
LOOKUP = 1000
#: A bulk row's task and place in it, and the number that it gets.
PLACE, NUMBER, TASK = "__place", "__number", "__task"


def insert_rows(store: Store, name: str, t: Table, columns: list[str] | None, rows: list) -> Table:
    """Append Python rows: missing columns are null, missing keys are numbered on."""
    columns = [c.lower() for c in columns] if columns else t.names
    if len(set(columns)) < len(columns):
        raise ExecutionError("a column is named twice")
    for c in columns:
        if c not in t.names:
            raise ExecutionError(f"unknown column {c}")
    kinds, place, made, seen, following = dict(t.columns), {c: i for i, c in enumerate(columns)}, [], set(), t.next_rowid
    for row in rows:
        if len(row) != len(columns):
            raise ExecutionError(f"{len(columns)} values are needed, not {len(row)}")
        values = {c: coerce(row[place[c]], kinds[c], c) if c in place else None for c in t.names}
        key = following if t.pk is None or values[t.pk] is None else values[t.pk]
        if t.pk is not None:
            values[t.pk] = key
            if key in seen:
                raise ExecutionError(f"UNIQUE constraint failed: {name}.{t.pk} ({key})")
            seen.add(key)
        following = max(following, key + 1)
        made.append((*values.values(), key))
    if not made:
        return t
    if seen and t.files:
        have = store.read(t).select(ROWID)
        if len(seen) <= LOOKUP:
            clash = have.where(F.col(ROWID).between(min(seen), max(seen)) & F.col(ROWID).isin(list(seen)))
        else:
            clash = have.join(store.spark.createDataFrame([(k,) for k in seen], T.StructType([T.StructField(ROWID, T.LongType())])), ROWID, "left_semi")
        if found := clash.first():
            raise ExecutionError(f"UNIQUE constraint failed: {name}.{t.pk} ({found[0]})")
    files = store.write(name, t, store.spark.createDataFrame(made, t.schema).coalesce(1 + len(made) // 100_000))
    return replace(t, files=t.files + files, rows=t.rows + len(made), next_rowid=following)


def _numbered(rows: DataFrame, counts: list, start: int, dense: bool) -> DataFrame:
    """Rows with contiguous numbers from ``start`` on, by task and place."""
    if not counts:
        return rows.withColumn(NUMBER, F.lit(None).cast("long"))
    begins, at = {}, start
    for r in counts:
        begins[r.task] = at - (r.low if dense else 0)
        at += r.n
    task = F.shiftright(PLACE, 33)
    begin = rows.sparkSession.createDataFrame(list(begins.items()), f"{TASK} long, {NUMBER} long")  # one row a task
    tagged = rows.withColumn(TASK, task).join(F.broadcast(begin), TASK)
    if dense:
        return tagged.withColumn(NUMBER, F.col(NUMBER) + F.col(PLACE)).drop(TASK)
    place = F.row_number().over(Window.partitionBy(TASK).orderBy(PLACE))  # only where rows with and without keys are mixed in a task
    return tagged.withColumn(NUMBER, F.col(NUMBER) + place - 1).drop(TASK)


def insert_frame(store: Store, name: str, t: Table, rows: DataFrame) -> Table:
    """Append a DataFrame of any size; it has the table's columns, and may lack the key or hold null keys."""
    _, bound = bind(rows, name, 0, False)
    for c in bound.columns:
        if c not in t.names:
            raise ExecutionError(f"unknown column {c}")
    picks = [coerce_column(F.col(f"`{c}`"), bound.columns[c][1], k, c).alias(c) if c in bound.columns else F.lit(None).cast(t.schema[c].dataType).alias(c) for c, k in t.columns]
    # the input is read once: its rows are written with their places, and get their numbers from there
    raw = store.stage(rows.select(*picks, F.monotonically_increasing_id().alias(PLACE)))
    rows, start, key = store.staged(raw), t.next_rowid, t.pk
    if key is not None and key in bound.columns:
        top = rows.agg(F.max(key)).first()[0]
        start = max(start, (top if top is not None else 0) + 1)
    without = rows if key is None else rows.where(F.col(key).isNull())
    task = F.shiftright(PLACE, 33)
    counts = sorted(without.groupBy(task.alias("task")).agg(F.min(PLACE).alias("low"), F.max(PLACE).alias("high"), F.count(F.lit(1)).alias("n")).collect())  # one row a task of the input
    numbered = _numbered(without, counts, start, all(r.high - r.low + 1 == r.n for r in counts))
    if key is None:
        made = numbered.withColumnRenamed(NUMBER, ROWID)
    else:
        given = rows.where(F.col(key).isNotNull()).withColumn(ROWID, F.col(key))
        made = given.unionByName(numbered.withColumn(key, F.col(NUMBER)).withColumnRenamed(NUMBER, ROWID))
    files = store.write(name, t, made)
    store.delete(raw)
    added = replace(t, files=files, rows=0)
    new = store.read(added)
    if t.pk is not None:
        twice = new.groupBy(ROWID).count().where("count > 1").first()
        clash = twice or (store.read(t).select(ROWID).join(new.select(ROWID), ROWID, "left_semi").first() if t.files else None)
        if clash:
            raise ExecutionError(f"UNIQUE constraint failed: {name}.{t.pk} ({clash[0]})")
    count, top = new.agg(F.count(F.lit(1)), F.max(ROWID)).first()
    return replace(t, files=t.files + files, rows=t.rows + count, next_rowid=max(t.next_rowid, (top if top is not None else 0) + 1))


def _condition(t: Table, name: str, rows: DataFrame, where) -> tuple[Column, Scope]:
    """The predicate over a table's own columns: only TRUE counts."""
    _, bound = bind(rows, name, 0, False)
    bound.columns = {c: (c, k) for c, (_, k) in bound.columns.items()}
    scope = Scope([bound])
    return (F.lit(True) if where is None else F.coalesce(scope.truth(where), F.lit(False))), scope


def update(store: Store, name: str, t: Table, sets: list[tuple[str, object]], where) -> tuple[Table, int]:
    """Set columns of matching rows; every expression sees the old row."""
    kinds = dict(t.columns)
    for c, _ in sets:
        if c not in kinds:
            raise ExecutionError(f"unknown column {c}")
        if c == t.pk:
            raise ExecutionError(f"the primary key {c} can't be updated")
    rows = store.read(t)
    hit, scope = _condition(t, name, rows, where)
    new = {}
    for c, e in sets:
        value, kind = scope.lower(e)
        new[c] = coerce_column(value, kind, kinds[c], c)
    if not t.files:
        return t, 0
    matched = rows.where(hit)
    count = matched.count()
    if not count:
        return t, 0
    old = store.touched(t, matched)
    changed = store.read(replace(t, files=old)).select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in t.names], ROWID)
    files = store.write(name, t, changed)
    return replace(t, files=tuple(f for f in t.files if f not in old) + files), count


def delete(store: Store, name: str, t: Table, where) -> tuple[Table, int]:
    """Drop rows for which the predicate is TRUE; without one, all."""
    rows = store.read(t)
    hit, _ = _condition(t, name, rows, where)
    if where is None:
        return replace(t, files=(), rows=0), t.rows
    if not t.files:
        return t, 0
    matched = rows.where(hit)
    count = matched.count()
    if not count:
        return t, 0
    old = store.touched(t, matched)
    files = store.write(name, t, store.read(replace(t, files=old)).where(~hit))
    return replace(t, files=tuple(f for f in t.files if f not in old) + files, rows=t.rows - count), count
