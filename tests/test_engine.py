"""End-to-end statements, and the same queries against SQLite."""

import json
import random
import sqlite3
import threading
import urllib.request

import pytest

from millrace import http, shell
from millrace.errors import CatalogError, CompileError, ExecutionError, SQLError, TransactionError
from millrace.session import Database
from millrace.types import TypeMismatch


@pytest.fixture
def db(spark, tmp_path):
    with Database(str(tmp_path / "db"), spark) as d:
        yield d


def q(db, sql):
    return db.execute(sql).rows


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    """A star catalogue in the engine and in SQLite: few faint ones lack a distance, a third lack spots."""
    r = random.Random(404)
    kinds = [(10, "red", 3), (20, "blue", 9), (30, "dark", 1), (40, "white", 6)]
    stars = []
    for i in range(7, 260, 3):
        mag = round(r.gauss(6, 2.5), 2)
        stars.append((i, f"{'NGC' if i % 2 else 'hd'}{i * 37 % 1000}", None if mag > 9 else 4 + int(r.expovariate(1 / 300)), mag, kinds[i % 3][1], ["north", "south"][i % 5 == 0], r.choice([0, 1, 1, 2, 3, 5, 8, 13, 21, None, None, None, None, None])))
    shots = [(1000 + k, r.randrange(0, 300), None if k % 11 == 0 else 2 ** r.randrange(10)) for k in range(220)]
    db = Database(str(tmp_path_factory.mktemp("pair") / "db"), spark)
    lite = sqlite3.connect(":memory:")
    for name, columns, rows in (
        ("star", "id INT PRIMARY KEY, name TEXT, dist INT, mag FLOAT, kind TEXT, sky TEXT, spots INT", stars),
        ("kind", "id INT PRIMARY KEY, code TEXT, heat INT", kinds),
        ("shot", "id INT PRIMARY KEY, star_id INT, secs INT", shots),
    ):
        db.execute(f"CREATE TABLE {name} ({columns})")
        lite.execute(f"CREATE TABLE {name} ({columns})")
        db.bulk_insert(name, rows)
        lite.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    yield db, lite
    db.close()


def plain(rows, in_order=False):
    made = [tuple(round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v for v in r) for r in rows]
    return made if in_order else sorted(made, key=repr)


FIXED = """
SELECT * FROM star WHERE dist > 200 AND spots IS NOT NULL
SELECT name FROM star WHERE NOT (dist > 500 OR spots < 3)
SELECT id FROM star WHERE spots BETWEEN 2 AND 8
SELECT id FROM star WHERE spots NOT BETWEEN 2 AND NULL
SELECT id FROM star WHERE dist BETWEEN NULL AND 300
SELECT id FROM star WHERE kind IN ('red', 'dark') AND sky NOT IN ('south')
SELECT id FROM star WHERE spots IN (1, NULL, 13)
SELECT id FROM star WHERE spots NOT IN (1, NULL, 13)
SELECT id FROM star WHERE name LIKE 'ngc%_1'
SELECT id FROM star WHERE name NOT LIKE '%9%'
SELECT id FROM star WHERE dist LIKE '2%'
SELECT id, dist + spots, dist * 2 - spots, -dist, dist / 7, dist / (spots - 1), (0 - dist) / 7 FROM star
SELECT id, mag / 2.0, mag * spots, spots / 0 FROM star
SELECT id, dist IS NULL, spots > 3, kind = sky FROM star
SELECT DISTINCT kind, sky FROM star
SELECT DISTINCT spots FROM star WHERE mag < 7
SELECT COUNT(*), COUNT(dist), SUM(dist), AVG(dist), MIN(name), MAX(spots) FROM star
SELECT COUNT(*), SUM(spots), MIN(spots) FROM star WHERE id < 0
SELECT COUNT(DISTINCT kind), SUM(DISTINCT spots), AVG(DISTINCT spots), MIN(DISTINCT spots), MAX(DISTINCT spots) FROM star
SELECT kind, COUNT(*) AS n, AVG(mag) FROM star GROUP BY kind HAVING n > 20
SELECT kind, sky, SUM(dist) FROM star GROUP BY kind, sky HAVING SUM(dist) > 1500 AND COUNT(*) BETWEEN 3 AND 60
SELECT dist IS NULL, COUNT(*) FROM star GROUP BY dist IS NULL
SELECT spots / 4, COUNT(*) FROM star GROUP BY spots / 4
SELECT SUM(dist) / COUNT(*) + 1 FROM star GROUP BY kind
SELECT s.name, k.heat FROM star s JOIN kind k ON s.kind = k.code
SELECT s.name, k.heat FROM star s LEFT JOIN kind k ON s.kind = k.code AND k.heat > 2
SELECT s.name, k.heat FROM star s RIGHT JOIN kind k ON s.kind = k.code AND s.spots > 8
SELECT s.name, k.heat FROM star s FULL OUTER JOIN kind k ON s.kind = k.code AND s.spots > 8
SELECT s.id, x.id FROM star s JOIN shot x ON s.id = x.star_id WHERE x.secs > 16 AND s.spots < 5
SELECT s.id, x.id FROM star s RIGHT JOIN shot x ON s.id = x.star_id WHERE s.spots < 5
SELECT s.id, x.id FROM star s FULL JOIN shot x ON s.id = x.star_id WHERE x.secs IS NULL
SELECT s.id, COUNT(x.id), SUM(x.secs) FROM star s LEFT JOIN shot x ON x.star_id = s.id GROUP BY s.id
SELECT a.id, b.id FROM kind a JOIN kind b ON a.heat < b.heat
SELECT a.id, b.id FROM kind a LEFT JOIN kind b ON a.heat + 3 = b.heat
SELECT k.code, s.sky, COUNT(*) FROM star s JOIN kind k ON s.kind = k.code JOIN shot x ON x.star_id = s.id GROUP BY k.code, s.sky
SELECT s.id FROM star s LEFT JOIN shot x ON x.star_id = s.id WHERE x.id IS NULL
"""
ORDERED = """
SELECT id, spots FROM star ORDER BY spots, id
SELECT id, dist FROM star ORDER BY dist DESC, id DESC LIMIT 20
SELECT id, spots FROM star ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 5
SELECT kind, COUNT(*) AS n FROM star GROUP BY kind ORDER BY n DESC, kind
SELECT kind FROM star GROUP BY kind ORDER BY SUM(mag) DESC
SELECT name FROM star ORDER BY dist + spots DESC, id LIMIT 7
SELECT id, sky FROM star ORDER BY sky LIMIT 9
SELECT id FROM star LIMIT 4 OFFSET 3
SELECT DISTINCT kind, sky FROM star ORDER BY sky DESC, kind LIMIT 5
SELECT s.name AS who, x.secs FROM star s JOIN shot x ON x.star_id = s.id ORDER BY x.secs DESC, x.id LIMIT 12
"""


@pytest.mark.parametrize("sql", FIXED.strip().split("\n"))
def test_against_sqlite(pair, sql):
    db, lite = pair
    assert plain(q(db, sql)) == plain(lite.execute(sql).fetchall())


@pytest.mark.parametrize("sql", ORDERED.strip().split("\n"))
def test_order_against_sqlite(pair, sql):
    db, lite = pair
    assert plain(q(db, sql), True) == plain(lite.execute(sql).fetchall(), True)


def random_predicate(r, depth=0):
    if depth < 2 and r.random() < 0.5:
        a, b = random_predicate(r, depth + 1), random_predicate(r, depth + 1)
        return r.choice([f"({a} AND {b})", f"({a} OR {b})", f"NOT ({a})"])
    c = r.choice(["dist", "spots", "mag", "id"])
    return r.choice(
        [
            f"{c} {r.choice(['=', '<>', '<', '<=', '>', '>='])} {r.randrange(0, 260)}",
            f"{c} {r.choice(['', 'NOT '])}BETWEEN {r.randrange(9)} AND {r.randrange(9, 700)}",
            f"{c} IS {r.choice(['', 'NOT '])}NULL",
            f"spots {r.choice(['', 'NOT '])}IN ({r.randrange(14)}, {r.choice(['NULL', '5'])}, {r.randrange(14)})",
            f"name {r.choice(['', 'NOT '])}LIKE '{r.choice(['n%', '%_1%', 'HD__%', '%9'])}'",
            f"spots + dist > {c} / {r.choice([0, 2, 3])}",
            f"kind = '{r.choice(['red', 'blue', 'none'])}'",
        ]
    )


def test_random_predicates_against_sqlite(pair):
    """Many predicates as columns of few statements: three-valued results are compared row by row."""
    db, lite = pair
    r = random.Random(11)
    for _ in range(5):
        items = ", ".join(f"{random_predicate(r)} AS p{i}" for i in range(30))
        sql = f"SELECT id, {items} FROM star"
        assert plain(q(db, sql)) == plain(lite.execute(sql).fetchall())


def test_random_groupings_against_sqlite(pair):
    db, lite = pair
    r = random.Random(12)
    for _ in range(12):
        key = r.choice(["kind", "sky", "kind, sky", "spots / 4", "dist IS NULL"])
        aggs = ", ".join(f"{f}({r.choice(['', 'DISTINCT '])}{r.choice(['dist', 'spots', 'id'])})" for f in r.choices(["COUNT", "SUM", "AVG", "MIN", "MAX"], k=4))
        sql = f"SELECT {key}, {aggs} FROM star WHERE {random_predicate(r)} GROUP BY {key} HAVING COUNT(*) > {r.randrange(3)}"
        assert plain(q(db, sql)) == plain(lite.execute(sql).fetchall())


def test_insert_keys_and_types(db):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, v TEXT, f FLOAT)")
    assert db.execute("INSERT INTO t (v) VALUES ('a'), ('b')").message == "2 row(s) inserted into t"
    q(db, "INSERT INTO t VALUES (10, 'c', 42)")
    q(db, "INSERT INTO t (f, v) VALUES (3.14, NULL)")
    assert q(db, "SELECT * FROM t ORDER BY id") == [(1, "a", None), (2, "b", None), (10, "c", 42.0), (11, None, 3.14)]
    q(db, "INSERT INTO t (id) VALUES (20.0)")
    for sql, error in (
        ("INSERT INTO t VALUES (10, 'x', 1)", ExecutionError),
        ("INSERT INTO t VALUES (30, 'x', 1), (30, 'y', 2)", ExecutionError),
        ("INSERT INTO t VALUES (1.5, 'x', 1)", TypeError),
        ("INSERT INTO t VALUES (31, 5, 1)", TypeMismatch),
        ("INSERT INTO t VALUES (31, 'x')", ExecutionError),
        ("INSERT INTO t (id, id) VALUES (1, 2)", ExecutionError),
        ("INSERT INTO t (nope) VALUES (1)", ExecutionError),
        ("INSERT INTO nope VALUES (1)", CatalogError),
    ):
        with pytest.raises(error):
            db.execute(sql)
    assert q(db, "SELECT COUNT(*) FROM t") == [(5,)]


def test_catalog_errors(db):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, a INT)")
    for sql in ("CREATE TABLE t (x INT)", "CREATE TABLE u (x INT, x TEXT)", "CREATE TABLE u (x INT PRIMARY KEY, y INT PRIMARY KEY)", "CREATE TABLE u (x TEXT PRIMARY KEY)", "DROP TABLE u", "DROP INDEX i", "CREATE INDEX i ON t(id)", "CREATE INDEX i ON t(b)", "SELECT * FROM u"):
        with pytest.raises(CatalogError):
            db.execute(sql)
    q(db, "CREATE INDEX i ON t(a)")
    with pytest.raises(CatalogError):
        db.execute("CREATE INDEX j ON t(a)")
    q(db, "INSERT INTO t VALUES (1, 5), (2, NULL), (3, 5)")
    assert q(db, "SELECT id FROM t WHERE a = 5 ORDER BY id") == [(1,), (3,)]
    assert "INDEX SCAN" in db.execute("EXPLAIN SELECT id FROM t WHERE a = 5").rows[0][0]
    q(db, "DROP INDEX i")
    assert "SEQ SCAN" in db.execute("EXPLAIN SELECT id FROM t WHERE a = 5").rows[0][0]
    q(db, "DROP TABLE t")
    assert db.tables() == []


@pytest.mark.parametrize(
    "sql",
    ["SELECT nope FROM t", "SELECT x.a FROM t", "SELECT a + v FROM t", "SELECT a < v FROM t", "SELECT a FROM t WHERE 1", "SELECT a FROM t WHERE a", "SELECT NOT a FROM t", "SELECT a FROM t WHERE COUNT(*) > 1", "SELECT SUM(COUNT(*)) FROM t", "SELECT SUM(v) FROM t", "SELECT a FROM t ORDER BY 0", "SELECT a FROM t ORDER BY 9", "SELECT a FROM t HAVING a > 1", "SELECT id FROM t JOIN t u ON t.id = u.id", "SELECT t.id FROM t JOIN t ON t.id = 1", "SELECT a LIKE 5 FROM t", "SELECT a BETWEEN 'x' AND 2 FROM t", "SELECT -v FROM t", "SELECT a FROM t GROUP BY SUM(a)"],
)
def test_analysis_errors(spark, tmp_path_factory, sql):
    db = Database(str(tmp_path_factory.mktemp("e") / "db"), spark)
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, a INT, v TEXT)")
    with pytest.raises(SQLError):
        db.execute(sql)


def test_text_and_numbers_are_never_equal(db):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    q(db, "INSERT INTO t VALUES (1, '1'), (2, NULL)")
    assert q(db, "SELECT v = id, v <> id, v IN (1, 'x'), id = 1.0 FROM t ORDER BY id") == [(False, True, False, True), (None, None, None, False)]


def test_like_has_no_escape(db):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    q(db, "INSERT INTO t VALUES (1, 'a\\b'), (2, 'A_B'), (3, 'ab')")
    assert q(db, "SELECT id FROM t WHERE v LIKE 'A\\B'") == [(1,)]
    assert q(db, "SELECT id FROM t WHERE v LIKE 'a_b' ORDER BY id") == [(1,), (2,)]


def test_loose_columns_first_rows_and_duplicates(db):
    q(db, "CREATE TABLE t (k TEXT, n INT)")
    q(db, "INSERT INTO t VALUES ('b', NULL), ('a', 2), ('b', 3), ('a', 4), ('c', 1)")
    assert sorted(q(db, "SELECT k, n, COUNT(*) FROM t GROUP BY k")) == [("a", 2, 2), ("b", None, 2), ("c", 1, 1)]
    assert q(db, "SELECT DISTINCT k FROM t ORDER BY n DESC") == [("a",), ("c",), ("b",)]
    assert q(db, "SELECT DISTINCT k FROM t LIMIT 2") == [("b",), ("a",)]
    assert q(db, "SELECT COUNT(*) FROM t GROUP BY 1") == [(5,)]
    r = db.execute("SELECT * FROM t a JOIN t b ON a.n = b.n WHERE a.n = 4")
    assert r.cols == ["k", "n", "k", "n"] and r.rows == [("a", 4, "a", 4)]
    assert q(db, "SELECT *, n + 1 FROM t LIMIT 1") == [("b", None, None)]


def test_update_and_delete(db):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, v TEXT, n INT)")
    db.bulk_insert("t", [(i, f"v{i}", i % 5 or None) for i in range(100)])
    assert db.execute("UPDATE t SET n = n + 10, v = 'x' WHERE n > 3").message == "20 row(s) updated"
    assert q(db, "SELECT COUNT(*) FROM t WHERE n = 14 AND v = 'x'") == [(20,)]
    assert db.execute("DELETE FROM t WHERE NOT n = 14").message == "60 row(s) deleted from t"
    assert q(db, "SELECT COUNT(*), COUNT(n) FROM t") == [(40, 20)]
    assert db.execute("UPDATE t SET n = 1.0 WHERE id = 4").message == "1 row(s) updated"
    with pytest.raises(SQLError):
        db.execute("UPDATE t SET n = 'x'")
    with pytest.raises(SQLError):
        db.execute("UPDATE t SET id = 1")
    assert db.check("t") == []
    assert db.execute("DELETE FROM t").message == "40 row(s) deleted from t"
    assert db.execute("UPDATE t SET n = 1").message == "0 row(s) updated"


def test_transactions(db, spark):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    with pytest.raises(TransactionError):
        db.commit()
    db.execute_script("BEGIN; INSERT INTO t VALUES (1, 1); CREATE TABLE u (a INT);")
    with pytest.raises(TransactionError):
        db.execute("BEGIN")
    other = Database(db.store.root, spark)
    with pytest.raises(CatalogError):
        other.execute("SELECT * FROM u")
    with pytest.raises(SQLError):
        db.execute("INSERT INTO t VALUES (2, 2), (1, 9)")
    assert q(db, "SELECT * FROM t") == [(1, 1)]
    db.execute("ROLLBACK")
    assert q(db, "SELECT COUNT(*) FROM t") == [(0,)]
    db.execute_script("BEGIN; INSERT INTO t (v) VALUES (5); COMMIT")
    assert q(other, "SELECT * FROM t") == [(1, 5)]
    other.close()


def test_snapshots_and_conflicts(db, spark):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    q(db, "CREATE TABLE u (id INT PRIMARY KEY)")
    q(db, "INSERT INTO t VALUES (1, 1)")
    other = Database(db.store.root, spark)
    other.begin()
    q(db, "INSERT INTO t VALUES (2, 2)")
    assert q(other, "SELECT COUNT(*) FROM t") == [(1,)]
    other.execute("UPDATE t SET v = 9")
    with pytest.raises(TransactionError):
        other.commit()
    assert not other.in_transaction
    assert q(other, "SELECT COUNT(*), MAX(v) FROM t") == [(2, 2)]
    other.begin()
    q(db, "INSERT INTO t VALUES (3, 3)")
    other.execute("INSERT INTO u VALUES (1)")
    other.commit()
    assert q(db, "SELECT COUNT(*) FROM u") == [(1,)]
    with pytest.raises(TransactionError):
        db.checkpoint()
    other.close()
    db.checkpoint()
    assert q(db, "SELECT COUNT(*) FROM t") == [(3,)]


def test_recovery_ignores_torn_commits_and_stray_files(spark, tmp_path):
    path = str(tmp_path / "db")
    db = Database(path, spark)
    db.execute_script("CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t VALUES (1)")
    (tmp_path / "db" / "_log" / f"{3:020d}.json").write_text("123\n{\"t\": nul")
    (tmp_path / "db" / "data" / "t" / "stray").mkdir()
    again = Database(path, spark)
    assert again.execute("SELECT * FROM t").rows == [(1,)]
    again.execute("INSERT INTO t VALUES (2)")
    assert Database(path, spark).execute("SELECT COUNT(*) FROM t").rows == [(2,)]


def test_reopening_after_close(spark, tmp_path):
    path = str(tmp_path / "db")
    with Database(path, spark) as db:
        db.execute_script("CREATE TABLE t (id INT PRIMARY KEY, v FLOAT); INSERT INTO t (v) VALUES (10.5), (20.25)")
    with pytest.raises(SQLError):
        db.execute("SELECT * FROM t")
    with Database(path, spark) as db:
        assert db.execute("SELECT SUM(v) AS s FROM t").rows == [(30.75,)]
        db.execute("INSERT INTO t (v) VALUES (1)")
        assert db.execute("SELECT MAX(id) FROM t").rows == [(3,)]


def test_vacuum_bulk_frames_and_scans(db, spark):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    assert db.bulk_insert("t", spark.range(0, 1000).selectExpr("id", "id % 7 AS v")) == 1000
    assert db.bulk_insert("t", spark.range(3).selectExpr("CAST(id AS INT) AS v")) == 3
    with pytest.raises(ExecutionError):
        db.bulk_insert("t", spark.range(5, 6).selectExpr("id", "1 AS v"))
    with pytest.raises(ExecutionError):
        db.bulk_insert("t", spark.range(2).selectExpr("CAST(5000 AS BIGINT) AS id", "1 AS v"))
    q(db, "DELETE FROM t WHERE id < 500")
    files = db.stats()["files"]
    assert db.vacuum("t") == "vacuumed 503 row(s) in t"
    assert db.stats()["files"] <= files and db.check("t") == []
    assert [r.id for r in db.range_scan("t", 700, 703).collect()] == [700, 701, 702, 703]
    assert sum(f["rows"] for f in db.layout("t")["files"]) == 503


def test_concurrent_writers(db, spark):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, w INT)")
    sessions = [Database(db.store.root, spark) for _ in range(3)]
    wrong = []

    def work(n):
        try:
            for _ in range(4):
                sessions[n].execute(f"INSERT INTO t (w) VALUES ({n}), ({n})")
        except Exception as e:
            wrong.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not wrong
    assert q(db, "SELECT COUNT(*), COUNT(DISTINCT id) FROM t") == [(24, 24)]
    [s.close() for s in sessions]


def test_spark_sql_and_registered_frames(db, spark):
    db.register("nums", spark.range(5).selectExpr("id", "CAST(id AS STRING) AS s", "DATE'2024-01-01' + CAST(id AS INT) AS d"))
    assert q(db, "SELECT COUNT(*), MAX(d) FROM nums WHERE s <> '3'")[0][0] == 4
    assert db.spark_sql("SELECT id, row_number() OVER (ORDER BY id DESC) AS r FROM nums WHERE id > 2").count() == 2
    with pytest.raises(CatalogError):
        db.execute("DELETE FROM nums")


def test_explain_words(db):
    q(db, "CREATE TABLE a (id INT PRIMARY KEY, k INT)")
    q(db, "CREATE TABLE b (id INT PRIMARY KEY, k INT)")
    lines = db.execute("EXPLAIN SELECT DISTINCT a.k, COUNT(*) FROM a JOIN b ON a.k = b.k AND a.id > 1 LEFT JOIN b c ON c.k < a.k WHERE a.id = 3 AND b.k = 1 GROUP BY a.k HAVING COUNT(*) > 1 ORDER BY 1 LIMIT 5 OFFSET 2").rows
    text = "\n".join(r[0] for r in lines)
    for word in ("PK LOOKUP", "HASH JOIN", "NESTED LOOP JOIN", "PUSHDOWN FILTER", "FILTER WHERE", "GROUP AGGREGATE", "SORT", "DISTINCT", "LIMIT 5 OFFSET 2"):
        assert word in text


def test_point_lookups_from_kept_rows(db, monkeypatch):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, a INT, b TEXT)")
    db.bulk_insert("t", [(i, i * 2, "x") for i in range(10)])
    sql = ["SELECT * FROM t WHERE id = 3", "SELECT t.b, a AS z, a FROM t WHERE t.id = 3", "SELECT a FROM t WHERE id = 99", "SELECT x.a FROM t x WHERE x.id = 1", "SELECT *, a FROM t WHERE id = 0"]
    quick = [(db.execute(s).cols, q(db, s)) for s in sql]
    assert all(db.execute(s).df is None for s in sql)
    q(db, "UPDATE t SET a = 70 WHERE id = 3")
    assert q(db, sql[0]) == [(3, 70, "x")]
    q(db, "UPDATE t SET a = 6 WHERE id = 3")
    monkeypatch.setattr("millrace.session.POINT_ROWS", 0)
    assert [(db.execute(s).cols, q(db, s)) for s in sql] == quick
    with pytest.raises(ExecutionError):
        db.execute("SELECT nope FROM t WHERE id = 3")


def test_filters_reach_the_scan(db, monkeypatch):
    monkeypatch.setattr("millrace.session.POINT_ROWS", 0)
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, a INT, b TEXT)")
    db.bulk_insert("t", [(i, i, "x") for i in range(10)])
    plan = db.execute("SELECT a FROM t WHERE id = 3").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,3)" in plan and "b:string" not in plan


def test_shell(db):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, v TEXT, f FLOAT)")
    assert "1 row(s) inserted" in shell.answer(db, "INSERT INTO t VALUES (1, 'a', 2.5);")
    assert shell.format_table(["id", "v", "f"], [(1, "a", 2.5), (10, None, None)]) == "id | v    |    f\n---+------+-----\n 1 | a    |  2.5\n10 | NULL | NULL"
    assert shell.answer(db, ".tables") == "t"
    assert shell.answer(db, ".schema t") == "CREATE TABLE t (id INT PRIMARY KEY, v TEXT, f FLOAT);"
    assert shell.answer(db, ".check t") == "ok"
    assert "SEQ SCAN" in shell.answer(db, ".explain SELECT * FROM t;")
    assert shell.answer(db, "SELECT nope FROM t;").startswith("ExecutionError")
    assert "version" in shell.answer(db, ".stats") and "vacuumed 1" in shell.answer(db, ".vacuum t")
    assert "low" in shell.answer(db, ".layout t") and "no such command" in shell.answer(db, ".x")
    assert shell.answer(db, ".quit") is None


def test_http(db):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, name TEXT)")
    server = http.make_server(db)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def post(sql):
        return json.load(urllib.request.urlopen(urllib.request.Request(f"{base}/api/query", json.dumps({"sql": sql}).encode())))

    assert post("INSERT INTO t VALUES (1, 'x'); SELECT * FROM t")["results"][1]["rows"] == [[1, "x"]]
    assert post("SELECT nope FROM t") == {"ok": False, "error": "ExecutionError: unknown column nope"}
    assert json.load(urllib.request.urlopen(f"{base}/api/tables"))["tables"][0]["name"] == "t"
    assert json.load(urllib.request.urlopen(f"{base}/api/layout/t"))["rows"] == 1
    tree = json.load(urllib.request.urlopen(f"{base}/api/btree/t"))
    assert tree["table"] == "t" and [(x["kind"], x["count"]) for x in tree["levels"][0]] == [("leaf", 1)]
    stats = json.load(urllib.request.urlopen(f"{base}/api/stats"))
    assert stats["tables"] == 1 and stats["pager"]["rows"] == 1 and stats["wal_bytes"] > 0
    q(db, "CREATE INDEX by_name ON t(name)")
    assert [c["indexed"] for c in json.load(urllib.request.urlopen(f"{base}/api/tables"))["tables"][0]["columns"]] == [False, True]
    assert post(" ") == {"ok": False, "error": "empty query"}
    db.bulk_insert("t", [(i, "y") for i in range(2, 12_003)])
    answer = post("SELECT id FROM t")["results"][0]
    assert answer["cols"] == ["id"] and len(answer["rows"]) == 12_002
    assert post("SELECT id * 4611686018427387904 FROM t")["error"].startswith("ExecutionError")
    server.shutdown()


def test_bulk_rows_without_keys_are_numbered_on(db, spark):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    db.bulk_insert("t", spark.range(100, 108, 1, 4).selectExpr("id AS v"))
    assert q(db, "SELECT id, v FROM t ORDER BY id") == [(i + 1, 100 + i) for i in range(8)]
    db.bulk_insert("t", spark.range(0, 10, 1, 3).selectExpr("if(id = 4, 50, NULL) AS id", "id AS v"))
    assert [r[0] for r in q(db, "SELECT id FROM t ORDER BY id")] == [*range(1, 9), 50, *range(51, 60)]
    assert db.execute("INSERT INTO t (v) VALUES (1)").message and q(db, "SELECT MAX(id) FROM t") == [(60,)]
    q(db, "CREATE TABLE u (v INT)")
    db.bulk_insert("u", spark.range(0, 9, 1, 2).selectExpr("id AS v"))
    assert db.check("u") == [] and q(db, "SELECT COUNT(*) FROM u") == [(9,)]


def test_pages_beyond_one_plan_node(db, spark, monkeypatch, tmp_path):
    from millrace.plans import lowering

    spark.range(10).write.parquet(str(tmp_path / "n"))
    db.register_parquet("n", str(tmp_path / "n"))
    monkeypatch.setattr(lowering, "MOST", 3)
    assert q(db, "SELECT id FROM n ORDER BY id OFFSET 7") == [(7,), (8,), (9,)]
    assert len(q(db, "SELECT id FROM n LIMIT 10")) == 10
    with pytest.raises(ExecutionError):
        q(db, "SELECT id FROM n LIMIT 4")


def test_filters_reach_the_scan_under_a_limit(db, spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "n"))
    db.register_parquet("n", str(tmp_path / "n"))
    made = db.execute("SELECT id FROM n WHERE id = 5 LIMIT 3")
    plan = made.df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,5)" in plan and made.rows == [(5,)]


def test_an_index_name_is_taken_once(db):
    q(db, "CREATE TABLE t (id INT PRIMARY KEY, a INT, b INT)")
    q(db, "CREATE INDEX i ON t(a)")
    with pytest.raises(CatalogError):
        q(db, "CREATE INDEX i ON t(b)")


def test_example_journal(db):
    import runpy
    from pathlib import Path

    run = runpy.run_path(str(Path(__file__).parent.parent / "examples" / "journal.py"))["run"]

    assert run(db, "list") == ["nothing open"] and run(db, "add", "it's raining") == ["1 row(s) inserted into journal"]
    assert run(db, "find", "RAIN") == ["1: it's raining"] and run(db, "close", "1") == ["1 row(s) updated"]
    assert run(db, "list") == ["nothing open"] and run(db, "find", "it's") == ["1: it's raining (closed)"]


def test_streams(db, spark, tmp_path):
    from millrace.streaming import append_stream, windowed_counts

    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:10", "a", 1.0), (2, "2024-01-01 00:04:00", "a", 2.0), (3, "2024-01-01 00:06:00", "b", 4.0)], "id long, ts string, kind string, value double").selectExpr("id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "kind", "value")
    rows.write.parquet(source)
    got = {(r.window_start.minute, r.kind): (r.n, r.total) for r in windowed_counts(spark.read.parquet(source), "ts", ["kind"], "5 minutes").collect()}
    assert got == {(0, "a"): (2, 3.0), (5, "b"): (1, 4.0)}
    q(db, "CREATE TABLE events (id INT, value FLOAT, batch INT)")
    stream = spark.readStream.schema(rows.schema).parquet(source).select("id", "value")
    append_stream(stream, db, "events", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert q(db, "SELECT COUNT(*), SUM(value) FROM events") == [(3, 7.0)]
