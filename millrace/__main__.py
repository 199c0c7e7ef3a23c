"""python -m millrace FOLDER [--http PORT]: the shell, or the JSON interface, on a database folder."""

import argparse

from millrace import http, shell
from millrace.session import Database


def main() -> None:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    p.add_argument("folder")
    p.add_argument("--http", type=int, metavar="PORT")
    args = p.parse_args()
    if args.http is None:
        shell.main(args.folder)
        return
    with Database(args.folder) as db:
        http.make_server(db, port=args.http).serve_forever()


if __name__ == "__main__":
    main()
