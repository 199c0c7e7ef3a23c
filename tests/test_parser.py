import pytest

from millrace.errors import ParseError
from millrace.plans import ast, parse, parse_script
from millrace.plans.explain import text


def expr(sql):
    return parse(f"SELECT {sql} FROM t").items[0].expr


@pytest.mark.parametrize(
    "sql,want",
    [
        ("1 + 2 * 3", "(1 + (2 * 3))"),
        ("(1 + 2) * 3", "((1 + 2) * 3)"),
        ("a OR b AND NOT c = 1", "(a OR (b AND NOT ((c = 1))))"),
        ("-a * b", "(-a * b)"),
        ("a - b - c", "((a - b) - c)"),
        ("a + 1 BETWEEN b AND c * 2 AND d", "((a + 1) BETWEEN b AND (c * 2) AND d)"),
        ("a NOT IN (1, 'x''y', NULL)", "a NOT IN (1, 'x''y', NULL)"),
        ("x NOT LIKE 'a%'", "x NOT LIKE 'a%'"),
        ("a IS NOT NULL", "a IS NOT NULL"),
        ("COUNT(*) + SUM(DISTINCT t.a)", "(COUNT(*) + SUM(DISTINCT t.a))"),
        ("a != 2", "(a <> 2)"),
        ("+1.50", "+1.5"),
    ],
)
def test_precedence(sql, want):
    assert text(expr(sql)) == want


def test_labels_and_aliases():
    s = parse("SELECT u.name, u.name AS n, a b, COUNT(*), SUM(u.x), AVG(x + 1), 1 + 1, COUNT(DISTINCT x) FROM users u")
    assert [i.label for i in s.items] == ["u.name", "n", "b", "COUNT(*)", "SUM(u.x)", "AVG(?)", "expr", "COUNT(DISTINCT x)"]


def test_whole_select():
    s = parse("select distinct A.x from T a left outer join u on a.i = u.i full join v as w on w.i < 3 where x > 1 group by x, y + 1 having count(*) > 2 order by 1 desc, y asc limit 3 offset 4;")
    assert (s.distinct, s.limit, s.offset, [j.how for j in s.joins], [j.source.alias for j in s.joins]) == (True, 3, 4, ["left", "full"], ["u", "w"])
    assert s.order[0].descending and not s.order[1].descending and len(s.group) == 2
    assert s.source == ast.Source("t", "a")


def test_statements():
    assert parse("INSERT INTO t (a, b) VALUES (1, 'x'), (-2.5, NULL)") == ast.Insert("t", ["a", "b"], [[1, "x"], [-2.5, None]])
    assert parse("CREATE TABLE t (id INT PRIMARY KEY, count FLOAT, text TEXT)").columns == [ast.ColumnDef("id", "INT", True), ast.ColumnDef("count", "FLOAT"), ast.ColumnDef("text", "TEXT")]
    assert parse("CREATE INDEX i ON t(a)") == ast.CreateIndex("i", "t", "a")
    assert [type(s).__name__ for s in parse_script(";; BEGIN; DROP TABLE t; ; COMMIT")] == ["Transaction", "DropTable", "Transaction"]
    assert parse("DELETE FROM t") == ast.Delete("t", None)
    assert parse("UPDATE t SET a = a + 1, b = NULL WHERE a = 1").sets[1] == ("b", ast.Lit(None))


@pytest.mark.parametrize(
    "sql",
    ["", "SELECT", "SELECT a", "SELECT a FROM", "SELECT a FROM t WHERE", "SELECT a FROM t LIMIT x", "SELECT a FROM t JOIN u", "SELECT t.* FROM t", "INSERT INTO t VALUES (a)", "INSERT INTO t VALUES ()", "SELECT f(a) FROM t", "SELECT a FROM t; SELECT b FROM t", "CREATE TABLE t (a DATE)", "SELECT 'x FROM t", "SELECT a ? FROM t", "EXPLAIN DELETE FROM t", "EXPLAIN EXPLAIN SELECT a FROM t", "SELECT a NOT 1 FROM t", "SELECT a FROM (SELECT a FROM t)", "UPDATE t SET", "SELECT COUNT(DISTINCT *) FROM t", "SELECT float FROM t"],
)
def test_errors(sql):
    with pytest.raises(ParseError):
        parse(sql)
