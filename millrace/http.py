"""A JSON interface over HTTP: tables, layout, statistics and statements.

GET /api/tables, /api/layout/<table> (also as /api/btree/<table>, with its files as the
leaves of one level), /api/stats; POST /api/query {"sql": ...}. An answer holds all rows of
a statement, so page with LIMIT and OFFSET where they are many.
A statement's error is an answer, {"ok": false, "error": "Kind: text"}, with status 200.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from millrace.errors import SQLError
from millrace.session import Database

PAGE = b"""<!doctype html><meta charset=utf-8><title>millrace</title><textarea id=q rows=6 cols=80></textarea><br><button onclick="fetch('/api/query',{method:'POST',body:JSON.stringify({sql:q.value})}).then(r=>r.json()).then(r=>o.textContent=JSON.stringify(r,null,1))">Run</button><pre id=o></pre>"""


def run_query(db: Database, sql: str) -> dict:
    try:
        if not sql.strip():
            return {"ok": False, "error": "empty query"}
        results = [{"cols": r.cols, "columns": r.cols, "rows": [list(x) for x in r.rows], "message": r.message, "plan": r.plan, "elapsed_ms": r.elapsed_ms} for r in db.execute_script(sql)]
        return {"ok": True, "results": results}
    except SQLError as e:
        return {"ok": False, "error": f"{type(e).__name__}: {e}"}


def levels(layout: dict) -> dict:
    """A layout as a tree: a root over the files, if there are several, and the files as leaves."""
    files = layout["files"]
    leaves = [{"kind": "leaf", "count": f["rows"], "first": f["low"], "last": f["high"], "file": f["file"]} for f in files]
    root = [{"kind": "internal", "keys": [f["low"] for f in files[1:]], "children": list(range(len(files)))}]
    return {"table": layout["table"], "levels": [root, leaves] if len(files) > 1 else [leaves]}


def make_server(db: Database, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server with a thread a request; they take turns on the one session."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_) -> None:
            pass

        def send(self, body, status: int = 200, kind: str = "application/json") -> None:
            data = body if isinstance(body, bytes) else json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            try:
                if self.path == "/":
                    return self.send(PAGE, kind="text/html")
                if self.path == "/api/tables":
                    return self.send({"tables": db.tables()})
                if self.path == "/api/stats":
                    return self.send(db.stats() | {"pager": db.storage(), "wal_bytes": db.log_bytes()})
                if self.path.startswith("/api/layout/"):
                    return self.send(db.layout(self.path.rpartition("/")[2]))
                if self.path.startswith("/api/btree/"):
                    return self.send(levels(db.layout(self.path.rpartition("/")[2])))
            except SQLError as e:
                return self.send({"error": f"{type(e).__name__}: {e}"}, 404)
            self.send({"error": "not found"}, 404)

        def do_POST(self) -> None:
            if self.path != "/api/query":
                return self.send({"error": "not found"}, 404)
            try:
                sql = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))["sql"]
            except (ValueError, KeyError, TypeError):
                return self.send({"ok": False, "error": "a JSON object with sql is needed"}, 400)
            self.send(run_query(db, sql))

    return ThreadingHTTPServer((host, port), Handler)
