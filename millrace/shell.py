"""Text tables and the interactive shell."""

from __future__ import annotations

import sys
import time

from millrace.errors import SQLError
from millrace.session import Database, Result

HELP = """Statements end with ; and may run over lines.
.tables .schema [TABLE] .layout TABLE .check TABLE .explain SELECT .stats .benchmark SELECT .vacuum TABLE .help .quit"""


def cell(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".") if abs(value) < 1e15 else repr(value)
    return str(value)


def format_table(cols: list[str], rows: list[tuple]) -> str:
    """Columns under headings; numbers to the right."""
    text = [[cell(v) for v in r] for r in rows]
    width = [max([len(c), *(len(r[i]) for r in text)]) for i, c in enumerate(cols)]
    right = [bool(rows) and all(r[i] is None or isinstance(r[i], (int, float)) for r in rows) for i in range(len(cols))]
    line = lambda cells: " | ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, width, right, strict=True)).rstrip()
    return "\n".join([line(cols), "-+-".join("-" * w for w in width), *map(line, text)])


def show(result: Result) -> str:
    if not result.cols:
        return result.message
    return f"{format_table(result.cols, result.rows)}\n({len(result.rows)} row(s), {result.elapsed_ms:.1f} ms)"


def command(db: Database, line: str) -> str | None:
    """The answer to a dot command; None ends the shell."""
    name, _, rest = line.strip().partition(" ")
    rest = rest.strip().rstrip(";")
    match name:
        case ".quit" | ".exit":
            return None
        case ".help":
            return HELP
        case ".tables":
            return "\n".join(t["name"] for t in db.tables())
        case ".schema":
            chosen = [t for t in db.tables() if not rest or t["name"] == rest.lower()]
            return "\n".join(f"CREATE TABLE {t['name']} (" + ", ".join(c["name"] + " " + c["type"] + " PRIMARY KEY" * c["pk"] for c in t["columns"]) + ");" for t in chosen)
        case ".layout":
            got = db.layout(rest)
            return format_table(["file", "rows", "low", "high"], [tuple(f.values()) for f in got["files"]])
        case ".check":
            return "\n".join(db.check(rest)) or "ok"
        case ".explain":
            return show(db.execute(f"EXPLAIN {rest}"))
        case ".stats":
            return "\n".join(f"{k}: {v}" for k, v in db.stats().items())
        case ".benchmark":
            times = []
            for _ in range(5):
                began = time.perf_counter()
                _ = db.execute(rest).rows
                times.append((time.perf_counter() - began) * 1000)
            return f"best {min(times):.1f} ms, worst {max(times):.1f} ms of {len(times)}"
        case ".vacuum":
            return db.vacuum(rest)
    return f"no such command: {name}\n{HELP}"


def answer(db: Database, text: str) -> str | None:
    """The answer to a dot command or a script; errors are told, not raised."""
    try:
        if text.lstrip().startswith("."):
            return command(db, text)
        return "\n".join(show(r) for r in db.execute_script(text))
    except SQLError as e:
        return f"{type(e).__name__}: {e}"


def main(path: str, lines=None, write=print) -> None:
    """Read statements until the end of the input or .quit."""
    with Database(path) as db:
        held = ""
        for line in lines or sys.stdin:
            if not held and line.lstrip().startswith("."):
                out = answer(db, line)
                if out is None:
                    return
                write(out)
                continue
            held += line
            if held.rstrip().endswith(";"):
                write(answer(db, held))
                held = ""
        if held.strip():
            write(answer(db, held))
