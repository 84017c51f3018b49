"""Relational coverage over the driver's tables: joins, grouping sets, set operations, ranks, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberglass.plans.base import Book

book = Book()


@book.add("""SELECT n_name, l_returnflag, grouping(n_name) AS g_nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_name, l_returnflag)""")
def rollup_revenue(spark, table):
    j = table("lineitem").join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    r = j.rollup("n_name", "l_returnflag").agg(F.grouping("n_name").cast("long").alias("g_nation"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
    return r


@book.add("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark, table):
    return table("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_price"))


@book.add("""SELECT o_custkey, o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS q, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), 4) AS step
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""")
def ranked_orders(spark, table):
    w, t = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice")), Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table("orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(t).cast("long").alias("q"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(t), 4).alias("step"))


@book.add("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, table):
    return table("customer").join(table("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@book.add("SELECT p_partkey FROM part WHERE p_size < 20 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09")
def part_sets(spark, table):
    line = table("lineitem")
    a = table("part").filter("p_size < 20").select("p_partkey")
    return a.intersect(line.filter("l_quantity > 40").select("l_partkey")).exceptAll(line.filter("l_discount > 0.09").select("l_partkey").distinct())


@book.add("SELECT coalesce(c_nationkey, s_nationkey) AS nation, customers, suppliers FROM (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal < 1000 GROUP BY 1) s ON c_nationkey = s_nationkey")
def nations_full_join(spark, table):
    c = table("customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table("supplier").filter("s_acctbal < 1000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full")


@book.add("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90")
def event_props(spark, table):
    k = F.get_json_object("props", "$.k").cast("long")
    return table("events").select("event_id", "event_type", k.alias("k")).filter("k >= 90")


@book.add("SELECT l_suppkey, l_partkey, qty FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS nth FROM lineitem GROUP BY l_suppkey, l_partkey) WHERE nth <= 3")
def top_parts_by_supplier(spark, table):
    q = table("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    nth = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("qty"), "l_partkey"))
    return q.withColumn("nth", nth).filter("nth <= 3").drop("nth")


@book.add("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_custkey")
def order_pivot(spark, table):
    p = table("orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.fillna(0)
