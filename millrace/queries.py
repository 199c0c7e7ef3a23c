"""Registered relational queries and the SQL that gives the same rows.

QUERIES: (spark, sf_dir) -> DataFrame, by name. ORACLES: DuckDB SQL, by name.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import between, divide, equals, first_of_group, int_divide, is_in, like
from millrace.operators import anti_join, distinct_ordered, group, join, page, residual_join, scan

col, lit = F.col, F.lit


def n_rows():
    return F.count(lit(1))


class Tables:
    """Attribute access to the tables of a folder."""

    def __init__(self, spark, sf_dir):
        self._open = lambda name: scan(spark, sf_dir, name)

    def __getattr__(self, name):
        return self._open(name)


_BUILD: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a function of Tables under its name, with its SQL."""

    def keep(build):
        name = build.__name__
        _BUILD[name] = build
        ORACLES[name] = sql
        return build

    return keep


def ratio():
    return divide(lit(100.0), col("p_size") - 10)


# ---- filters


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def filter_gt(t):
    return t.orders.where(col("o_totalprice") > 300000).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def filter_ne_text(t):
    return t.customer.where(col("c_mktsegment") != "BUILDING").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE (p_size < 10 OR p_retailprice > 1500) AND NOT (p_brand = 'Brand#13')")
def filter_and_or_not(t):
    return t.part.where(((col("p_size") < 10) | (col("p_retailprice") > 1500)) & ~(col("p_brand") == "Brand#13")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(t):
    return t.part.where(between(col("p_size"), lit(10), lit(20))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20")
def filter_not_between(t):
    return t.part.where(between(col("p_size"), lit(10), lit(20), negated=True)).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_in(t):
    return t.orders.where(col("o_orderstatus").isin("F", "P")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F')")
def filter_not_in(t):
    return t.orders.where(~col("o_orderstatus").isin("F")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, NULL, 3)")
def filter_in_null(t):
    options = [(lit(1), True), (lit(None).cast("int"), True), (lit(3), True)]
    return t.part.where(is_in(col("p_size"), options)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size NOT IN (1, NULL)")
def filter_not_in_null(t):
    options = [(lit(1), True), (lit(None).cast("int"), True)]
    return t.part.where(is_in(col("p_size"), options, negated=True)).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'R_D %'")
def filter_like_ci(t):
    return t.part.where(like(col("p_name"), "R_D %")).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_name NOT ILIKE '%9'")
def filter_not_like_ci(t):
    return t.customer.where(like(col("c_name"), "%9", negated=True)).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) ILIKE '1%'")
def filter_like_number(t):
    return t.orders.where(like(col("o_orderkey"), "1%")).select("o_orderkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'FURNITURE' AND c_mktsegment < 'N'")
def filter_text_range(t):
    return t.customer.where((col("c_mktsegment") >= "FURNITURE") & (col("c_mktsegment") < "N")).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey FROM part WHERE NOT (100.0::DOUBLE / nullif(p_size - 10, 0) > 5.0::DOUBLE)")
def three_valued_not(t):
    return t.part.where(~(ratio() > 5.0)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE 100.0::DOUBLE / nullif(p_size - 10, 0) > 5.0::DOUBLE OR p_retailprice > 1500")
def three_valued_or(t):
    return t.part.where((ratio() > 5.0) | (col("p_retailprice") > 1500)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (100.0::DOUBLE / nullif(p_size - 10, 0)) IS NULL")
def is_null_div_zero(t):
    return t.part.where(ratio().isNull()).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (100.0::DOUBLE / nullif(p_size - 10, 0)) IS NOT NULL")
def is_not_null_div_zero(t):
    return t.part.where(ratio().isNotNull()).select("p_partkey")


# ---- projections


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0::DOUBLE - l_discount) * (1.0::DOUBLE + l_tax) AS charge, -l_quantity AS neg FROM lineitem")
def project_arith(t):
    charge = col("l_extendedprice") * (lit(1.0) - col("l_discount")) * (lit(1.0) + col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", charge.alias("charge"), (-col("l_quantity")).alias("neg"))


@query("SELECT o_orderkey, CAST(trunc((0 - o_orderkey) // 7) AS BIGINT) AS q FROM orders")
def int_division(t):
    return t.orders.select("o_orderkey", int_divide(lit(0) - col("o_orderkey"), lit(7)).alias("q"))


@query("SELECT p_partkey, p_retailprice / nullif(p_size - 10, 0) AS r FROM part")
def div_by_zero_null(t):
    return t.part.select("p_partkey", divide(col("p_retailprice"), col("p_size") - 10).alias("r"))


@query("SELECT c_custkey, CASE WHEN c_name IS NOT NULL AND c_custkey IS NOT NULL THEN FALSE END AS b FROM customer")
def mixed_type_eq_false(t):
    return t.customer.select("c_custkey", equals(col("c_name"), col("c_custkey"), comparable=False).alias("b"))


@query("SELECT p_partkey, p_size > 25 AS big FROM part")
def project_predicate_bool(t):
    return t.part.select("p_partkey", (col("p_size") > 25).alias("big"))


# ---- distinct, order, limit


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_one(t):
    return t.customer.select("c_mktsegment").distinct()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_multi(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def order_limit_offset(t):
    return page(t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"), 10, 5)


@query("SELECT p_partkey, p_retailprice / nullif(p_size - 10, 0) AS r FROM part ORDER BY r NULLS FIRST, p_partkey LIMIT 60")
def order_nulls_first_asc(t):
    made = t.part.select("p_partkey", divide(col("p_retailprice"), col("p_size") - 10).alias("r"))
    return page(made.orderBy(F.asc_nulls_first("r"), "p_partkey"), 60)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY 2 DESC, 1 LIMIT 20")
def order_ordinal(t):
    return page(t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey"), 20)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey OFFSET 20")
def offset_only(t):
    return page(t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey"), offset=20)


@query("SELECT p_partkey FROM part ORDER BY p_retailprice * p_size DESC, p_partkey LIMIT 25")
def order_by_expr(t):
    return page(t.part.orderBy((col("p_retailprice") * col("p_size")).desc(), "p_partkey"), 25).select("p_partkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 7")
def limit_without_order(t):
    return page(t.customer.orderBy("c_custkey"), 7).select("c_custkey", "c_name")


@query("SELECT c_mktsegment FROM (SELECT c_mktsegment, arg_min(c_acctbal, c_custkey) AS k FROM customer GROUP BY c_mktsegment) ORDER BY k LIMIT 3")
def distinct_order_hidden_key(t):
    return page(distinct_ordered(t.customer, ["c_mktsegment"], col("c_acctbal"), col("c_custkey")), 3)


# ---- aggregation


@query("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MIN(o_orderpriority) AS mn, MAX(o_orderkey) AS mx FROM orders")
def agg_global(t):
    price = col("o_totalprice")
    return group(t.orders, [], n_rows().alias("n"), F.sum(price).alias("s"), F.avg(price).alias("a"), F.min("o_orderpriority").alias("mn"), F.max("o_orderkey").alias("mx"))


@query("SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s FROM part WHERE p_size < 0")
def agg_empty_input(t):
    return group(t.part.where(col("p_size") < 0), [], n_rows().alias("n"), F.sum("p_size").alias("s"))


@query("SELECT COUNT(DISTINCT o_custkey) AS d FROM orders")
def agg_count_distinct(t):
    return group(t.orders, [], F.count_distinct("o_custkey").alias("d"))


@query("SELECT CAST(SUM(DISTINCT p_size) AS BIGINT) AS s, AVG(DISTINCT p_size) AS a FROM part")
def agg_sum_avg_distinct(t):
    sizes = t.part.select("p_size").distinct()
    return group(sizes, [], F.sum("p_size").alias("s"), F.avg("p_size").alias("a"))


@query("SELECT o_orderstatus, SUM(o_totalprice) / COUNT(*) AS mean, MAX(o_totalprice) - MIN(o_totalprice) AS spread FROM orders GROUP BY o_orderstatus")
def agg_arith(t):
    price = col("o_totalprice")
    return group(t.orders, [col("o_orderstatus")], divide(F.sum(price), n_rows()).alias("mean"), (F.max(price) - F.min(price)).alias("spread"))


@query("SELECT o_orderpriority, COUNT(*) AS cnt, SUM(o_totalprice) AS total FROM orders GROUP BY o_orderpriority HAVING cnt > 100")
def group_by_having_alias(t):
    return group(t.orders, [col("o_orderpriority")], n_rows().alias("cnt"), F.sum("o_totalprice").alias("total")).where("cnt > 100")


@query("SELECT p_brand, COUNT(*) AS cnt FROM part GROUP BY p_brand HAVING SUM(p_size) > 100")
def group_by_having_agg(t):
    return group(t.part, [col("p_brand")], n_rows().alias("cnt"), F.sum("p_size").alias("s")).where("s > 100").drop("s")


@query("SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING COUNT(*) BETWEEN 70 AND 85")
def having_between(t):
    return group(t.part, [col("p_brand")], n_rows().alias("n")).where(between(col("n"), lit(70), lit(85)))


@query("SELECT CAST(p_size // 10 AS BIGINT) AS bucket, COUNT(*) AS n FROM part GROUP BY p_size // 10")
def group_by_expr(t):
    return group(t.part, [int_divide(col("p_size"), lit(10)).alias("bucket")], n_rows().alias("n"))


@query("SELECT CAST(100 // nullif(p_size - 10, 0) AS BIGINT) AS k, COUNT(*) AS n FROM part GROUP BY 100 // nullif(p_size - 10, 0)")
def group_null_key(t):
    return group(t.part, [int_divide(lit(100), col("p_size") - 10).alias("k")], n_rows().alias("n"))


@query("SELECT n_regionkey, arg_min(n_name, n_nationkey) AS n_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
def group_bare_column(t):
    return group(t.nation, [col("n_regionkey")], first_of_group(col("n_name"), col("n_nationkey")).alias("n_name"), n_rows().alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, AVG(o_totalprice) AS a FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_by_two_keys(t):
    return group(t.orders, [col("o_orderstatus"), col("o_orderpriority")], n_rows().alias("n"), F.avg("o_totalprice").alias("a"))


@query("SELECT p_brand, COUNT(DISTINCT p_size) AS d FROM part GROUP BY p_brand")
def group_count_distinct(t):
    return group(t.part, [col("p_brand")], F.count_distinct("p_size").alias("d"))


@query("SELECT p_type, MIN(p_name) AS mn, MAX(p_name) AS mx, MIN(DISTINCT p_size) AS md FROM part GROUP BY p_type")
def group_min_max_text(t):
    return group(t.part, [col("p_type")], F.min("p_name").alias("mn"), F.max("p_name").alias("mx"), F.min("p_size").alias("md"))


@query("SELECT p_brand FROM part GROUP BY p_brand ORDER BY SUM(p_retailprice) DESC, p_brand LIMIT 5")
def order_by_hidden_agg(t):
    return page(group(t.part, [col("p_brand")], F.sum("p_retailprice").alias("s")).orderBy(F.desc("s"), "p_brand"), 5).select("p_brand")


# ---- joins


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_inner_hash(t):
    return join(t.orders, t.customer, col("o_custkey") == col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000")
def join_left(t):
    return residual_join(t.customer, t.orders, [("c_custkey", "o_custkey")], col("o_totalprice") > 400000, "left").select("c_custkey", "o_orderkey")


@query("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000")
def join_right(t):
    return residual_join(t.orders, t.customer, [("o_custkey", "c_custkey")], col("o_totalprice") > 400000, "right").select("o_orderkey", "c_custkey")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c FULL OUTER JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'")
def join_full_residual(t):
    return residual_join(t.customer, t.orders, [("c_custkey", "o_custkey")], col("o_orderstatus") == "F", "full").select("c_custkey", "o_orderkey")


@query("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey")
def join_theta_nlj(t):
    return join(t.supplier, t.nation, col("s_nationkey") < col("n_nationkey")).select("s_suppkey", "n_nationkey")


@query("SELECT n.n_nationkey, r.r_regionkey FROM nation n LEFT JOIN region r ON n.n_nationkey < r.r_regionkey")
def join_left_theta_nlj(t):
    return join(t.nation, t.region, col("n_nationkey") < col("r_regionkey"), "left").select("n_nationkey", "r_regionkey")


@query("SELECT n.n_name, COUNT(*) AS cnt FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
def join_three_way(t):
    two = join(t.orders, t.customer, col("o_custkey") == col("c_custkey"))
    return group(join(two, t.nation, col("c_nationkey") == col("n_nationkey")), [col("n_name")], n_rows().alias("cnt"))


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t):
    on = (col("a.n_regionkey") == col("b.n_regionkey")) & (col("a.n_nationkey") < col("b.n_nationkey"))
    return join(t.nation.alias("a"), t.nation.alias("b"), on).select(col("a.n_nationkey").alias("x"), col("b.n_nationkey").alias("y"))


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey")
def join_on_expression(t):
    on = col("a.n_nationkey") + 1 == col("b.n_nationkey")
    return join(t.nation.alias("a"), t.nation.alias("b"), on).select(col("a.n_nationkey").alias("x"), col("b.n_nationkey").alias("y"))


@query("SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NULL")
def left_join_anti_where(t):
    return anti_join(t.customer, t.orders.where("o_totalprice > 400000"), col("o_custkey") == col("c_custkey")).select("c_custkey")


@query("SELECT c.c_mktsegment, COUNT(o.o_orderkey) AS heads, COUNT(*) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000 GROUP BY c.c_mktsegment")
def left_join_count(t):
    both = residual_join(t.customer, t.orders, [("c_custkey", "o_custkey")], col("o_totalprice") > 400000, "left")
    return group(both, [col("c_mktsegment")], F.count("o_orderkey").alias("heads"), n_rows().alias("n"))


@query("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 400000")
def right_join_where_left(t):
    both = join(t.orders, t.customer, col("o_custkey") == col("c_custkey"), "right")
    return both.where("o_totalprice > 400000").select("o_orderkey", "c_custkey")


@query("SELECT r.r_name, n.n_name, s.s_suppkey FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
def join_left_chain(t):
    two = join(t.region, t.nation, col("n_regionkey") == col("r_regionkey"), "left")
    return residual_join(two, t.supplier, [("n_nationkey", "s_nationkey")], col("s_acctbal") > 5000, "left").select("r_name", "n_name", "s_suppkey")


@query("SELECT o.o_orderpriority, COUNT(*) AS n, SUM(l.l_quantity) AS q FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_discount > 0.05::DOUBLE GROUP BY o.o_orderpriority")
def join_large_group(t):
    both = join(t.lineitem.where(col("l_discount") > 0.05), t.orders, col("l_orderkey") == col("o_orderkey"))
    return group(both, [col("o_orderpriority")], n_rows().alias("n"), F.sum("l_quantity").alias("q"))


# ---- access paths


@query("SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def pk_lookup(t):
    return t.customer.where(col("c_custkey") == 42).select("c_name", "c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def index_eq_lookup(t):
    return t.orders.where(col("o_orderpriority") == "1-URGENT").select("o_orderkey")


@query("SELECT COUNT(*) AS n FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 9900")
def range_scan_count(t):
    return group(t.orders.where(between(col("o_orderkey"), lit(100), lit(9900))), [], n_rows().alias("n"))


@query("SELECT n.n_name AS city, COUNT(*) AS cnt, SUM(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY total DESC LIMIT 5")
def flagship_join_group_order(t):
    two = join(t.orders, t.customer, col("o_custkey") == col("c_custkey"))
    three = join(two, t.nation, col("c_nationkey") == col("n_nationkey"))
    made = group(three, [col("n_name").alias("city")], n_rows().alias("cnt"), F.sum("o_totalprice").alias("total"))
    return page(made.orderBy(F.desc("total")), 5)


QUERIES = {name: (lambda spark, sf_dir, build=build: build(Tables(spark, sf_dir))) for name, build in _BUILD.items()}


# ---- the same through the SQL dialect, and changes of real tables


def engine_query(sql: str, *tables: str, oracle: str | None = None):
    """Register dialect text over the folder's tables."""

    def keep(name: str) -> None:
        def run(spark, sf_dir):
            from millrace.session import Database

            with _scratch(spark) as path:
                db = Database(path, spark)
                for t in tables:
                    db.register(t, scan(spark, sf_dir, t))
                return db.execute(sql).labelled()

        QUERIES[name] = run
        ORACLES[name] = oracle or sql

    return keep


def _scratch(spark):
    """A new folder for a database: in the shared folder that the session names, or, where it names none, a temporary one."""
    import contextlib
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", "")
    return contextlib.nullcontext(f"{root.rstrip('/')}/db-{uuid.uuid4().hex}" if root else tempfile.mkdtemp(prefix="millrace-db-"))


def changed(*statements: str, table: str, source, columns: str, result: str, oracle: str):
    """Register statements on a table that is filled from a folder's table, and what is read back then."""

    def keep(name: str) -> None:
        def run(spark, sf_dir):
            from millrace.session import Database

            with _scratch(spark) as path:
                db = Database(path, spark)
                db.execute(f"CREATE TABLE {table} ({columns})")
                db.bulk_insert(table, source(Tables(spark, sf_dir)))
                for s in statements:
                    db.execute(s)
                return db.execute(result).labelled()

        QUERIES[name] = run
        ORACLES[name] = oracle

    return keep


engine_query("SELECT o_orderstatus, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders WHERE o_totalprice > 1000.0 GROUP BY o_orderstatus HAVING n > 10 ORDER BY total DESC", "orders")("sql_group_having_order")
engine_query("SELECT c.c_name, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000 WHERE c.c_name LIKE '%9'", "customer", "orders", oracle="SELECT c.c_name AS \"c.c_name\", o.o_orderkey AS \"o.o_orderkey\" FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000 WHERE c.c_name ILIKE '%9'")("sql_left_join_like")
engine_query("SELECT n_regionkey, n_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey ORDER BY n_regionkey", "nation", oracle="SELECT n_regionkey, arg_min(n_name, n_nationkey) AS n_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey")("sql_bare_column")
engine_query("SELECT p_partkey, (0 - p_partkey) / 7 AS q, p_size / (p_size - 10) AS z, p_name = p_size AS b FROM part", "part", oracle="SELECT p_partkey, CAST(trunc((0 - p_partkey) // 7) AS BIGINT) AS q, CAST(trunc(p_size // nullif(p_size - 10, 0)) AS BIGINT) AS z, CASE WHEN p_name IS NOT NULL AND p_size IS NOT NULL THEN FALSE END AS b FROM part")("sql_arithmetic")
engine_query("SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment DESC LIMIT 2 OFFSET 1", "customer")("sql_distinct_page")
engine_query("SELECT n.n_name AS city, COUNT(*) AS cnt, SUM(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY total DESC LIMIT 5", "orders", "customer", "nation")("sql_flagship")

_PART = "p_partkey INT PRIMARY KEY, p_size INT, p_retailprice FLOAT"


def _part(t):
    return t.part.select("p_partkey", "p_size", "p_retailprice")


changed("UPDATE part SET p_retailprice = p_retailprice * 2 WHERE p_size > 25", table="part", source=_part, columns=_PART, result="SELECT p_partkey, p_retailprice FROM part", oracle="SELECT p_partkey, CASE WHEN coalesce(p_size > 25, false) THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part")("dml_update_result")
changed("DELETE FROM part WHERE 100.0 / (p_size - 10) > 5.0", table="part", source=_part, columns=_PART, result="SELECT p_partkey FROM part", oracle="SELECT p_partkey FROM part WHERE (100.0::DOUBLE / nullif(p_size - 10, 0) > 5.0::DOUBLE) IS NOT TRUE")("dml_delete_result")
changed("INSERT INTO nation (n_name) VALUES ('NEW')", table="nation", source=lambda t: t.nation.select("n_nationkey", "n_name"), columns="n_nationkey INT PRIMARY KEY, n_name TEXT", result="SELECT * FROM nation", oracle="SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation UNION ALL SELECT (SELECT CAST(MAX(n_nationkey) AS BIGINT) FROM nation) + 1, 'NEW'")("dml_insert_autopk_result")
changed("BEGIN", "DELETE FROM part WHERE p_size > 3", "UPDATE part SET p_size = 0", "ROLLBACK", table="part", source=_part, columns=_PART, result="SELECT * FROM part", oracle="SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")("txn_rollback_noop")
changed("CREATE INDEX by_size ON part(p_size)", table="part", source=_part, columns=_PART, result="SELECT p_partkey FROM part WHERE p_size = 7", oracle="SELECT p_partkey FROM part WHERE p_size = 7")("index_created_lookup")
changed(table="part", source=_part, columns=_PART, result="SELECT COUNT(*) AS n FROM part", oracle="SELECT COUNT(*) AS n FROM part")("bulk_insert_count")


def snapshot_read(spark, sf_dir):
    """What a transaction sees while another session commits: the rows as of its begin."""
    from millrace.session import Database

    with _scratch(spark) as path:
        writer, reader = Database(path, spark), Database(path, spark)
        writer.execute(f"CREATE TABLE part ({_PART})")
        writer.bulk_insert("part", _part(Tables(spark, sf_dir)))
        reader.begin()
        writer.execute("DELETE FROM part WHERE p_size < 40")
        return reader.execute("SELECT p_partkey FROM part").labelled()


QUERIES["snapshot_read"] = snapshot_read
ORACLES["snapshot_read"] = "SELECT p_partkey FROM part"
