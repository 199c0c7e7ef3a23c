"""A journal on the command line: add TEXT, list, find WORD, close NUMBER. JOURNAL names its folder."""

import os
import sys

from millrace.session import Database


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def run(db: Database, verb: str, *args: str) -> list[str]:
    if "journal" not in [t["name"] for t in db.tables()]:
        db.execute_script("CREATE TABLE journal (id INT PRIMARY KEY, entry TEXT, closed INT); CREATE INDEX by_state ON journal(closed)")
    match verb, args:
        case "add", [text]:
            return [db.execute(f"INSERT INTO journal (entry, closed) VALUES ({quoted(text)}, 0)").message]
        case "list", []:
            found = db.execute("SELECT id, entry FROM journal WHERE closed = 0 ORDER BY id").rows
            return [f"{i}: {entry}" for i, entry in found] or ["nothing open"]
        case "find", [word]:
            found = db.execute(f"SELECT id, entry, closed FROM journal WHERE entry LIKE {quoted(f'%{word}%')} ORDER BY id").rows
            return [f"{i}: {entry}{' (closed)' if closed else ''}" for i, entry, closed in found]
        case "close", [number]:
            return [db.execute(f"UPDATE journal SET closed = 1 WHERE id = {int(number)}").message]
    return [__doc__]


if __name__ == "__main__":
    with Database(os.environ.get("JOURNAL", "journal")) as db:
        print("\n".join(run(db, *(sys.argv[1:] or ["help"]))))
