"""Queries that score forecasts. Orders play the states of a fire, labelled documents the scored cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberglass.operators import scoring
from emberglass.plans.base import Book

book = Book()
STATE_SQL = """s AS (SELECT o_custkey AS fire, CAST(epoch_us(o_orderdate) / 3600000000 AS DOUBLE) AS t, sum(o_totalprice) AS price, CAST(min(o_orderkey) * 37 % 360 AS DOUBLE) AS bearing FROM orders GROUP BY o_custkey, o_orderdate),
st AS (SELECT fire, t, round(sum(price) OVER (PARTITION BY fire ORDER BY t), 4) AS area, CASE WHEN bearing >= 30 THEN bearing END AS bearing FROM s),
pr AS (SELECT fire, t, area, bearing, lead(t) OVER w - t AS dt, lead(area) OVER w AS area1, lead(bearing) OVER w AS bearing1 FROM st WINDOW w AS (PARTITION BY fire ORDER BY t)),
pairs AS (SELECT * FROM pr WHERE dt > 0 AND dt <= 4000)"""
SCORED_SQL = "sc AS (SELECT l.doc_id, lang, l.toxic AS y, round((d.n_chars % 97) / 97e0, 2) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def states(table):
    o = table("orders")
    s = o.groupBy(F.col("o_custkey").alias("fire"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 3600000000).alias("t")).agg(F.sum("o_totalprice").alias("price"), (F.min("o_orderkey") * 37 % 360).cast("double").alias("b"))
    from pyspark.sql import Window

    area = F.round(F.sum("price").over(Window.partitionBy("fire").orderBy("t")), 4)
    return s.select("fire", "t", area.alias("area"), F.when(F.col("b") >= 30, F.col("b")).alias("bearing"), F.lit(None).cast("double").alias("rate"))


def scored(table):
    d = table("documents").select("doc_id", "lang", F.round((F.col("n_chars") % 97) / F.lit(97.0), 2).alias("p"))
    return table("labels").select("doc_id", F.col("toxic").alias("y")).join(d, "doc_id")


@book.add(f"WITH {STATE_SQL} SELECT fire, round(t, 6) AS t, round(dt, 6) AS dt, area, area1 FROM pairs")
def state_pairs(spark, table):
    return scoring.state_pairs(states(table), 4000).select("fire", F.round("t", 6).alias("t"), F.round("dt", 6).alias("dt"), "area", "area1")


@book.add(f"WITH {STATE_SQL}, g AS (SELECT fire, avg((area1 - area) / dt) AS growth FROM pairs GROUP BY fire) SELECT fire, round(growth, 5) AS growth, round(((SELECT sum(growth) FROM g) - growth) / ((SELECT count(*) FROM g) - 1), 5) AS others FROM g")
def loo_constant_rate(spark, table):
    return scoring.leave_one_out(scoring.group_rates(scoring.state_pairs(states(table), 4000))).select("fire", F.round("growth", 5).alias("growth"), F.round("others", 5).alias("others"))


@book.add(f"""WITH {STATE_SQL}, m AS (SELECT fire, area, area1, avg(area1) OVER (PARTITION BY fire) AS m FROM pairs)
SELECT fire, count(*) AS n, CASE WHEN count(*) > 1 AND sum(pow(area1 - m, 2)) > 0 THEN round(1 - sum(pow(area1 - area, 2)) / sum(pow(area1 - m, 2)), 6) END AS r2, round(median(CASE WHEN area1 > 0 THEN abs(area - area1) / area1 END), 6) AS mape FROM m GROUP BY fire""")
def r2_mape_by_group(spark, table):
    return scoring.r2_mape(scoring.state_pairs(states(table), 4000), ["fire"], "area1", "area").withColumns({"r2": F.round("r2", 6), "mape": F.round("mape", 6)})


@book.add(f"WITH {STATE_SQL} SELECT count(*) AS n, round(median(abs(fmod(bearing1 - bearing + 540e0, 360e0) - 180e0)), 6) AS median_error FROM pairs WHERE bearing IS NOT NULL AND bearing1 IS NOT NULL")
def bearing_error_median(spark, table):
    return scoring.bearing_errors(scoring.state_pairs(states(table), 4000)).withColumn("median_error", F.round("median_error", 6))


@book.add(f"""WITH {SCORED_SQL}, g AS (SELECT lang, p, sum(y) AS tp, count(*) AS k FROM sc GROUP BY lang, p),
w AS (SELECT *, sum(tp) OVER (PARTITION BY lang ORDER BY p DESC) AS ctp, sum(k) OVER (PARTITION BY lang ORDER BY p DESC) AS ck FROM g)
SELECT lang, CAST(sum(k) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS positives, CASE WHEN sum(tp) > 0 THEN round(sum(tp * ctp / CAST(ck AS DOUBLE)) / sum(tp), 6) END AS ap FROM w GROUP BY lang""")
def average_precision(spark, table):
    return scoring.average_precision(scored(table), ["lang"], "y", "p").withColumn("ap", F.round("ap", 6))


@book.add(f"""WITH {SCORED_SQL}, t AS (SELECT * FROM sc, (VALUES (0.1e0), (0.25e0), (0.5e0)) AS v(threshold)),
c AS (SELECT lang, threshold, count(*) FILTER (WHERE y = 1 AND p >= threshold) AS tp, count(*) FILTER (WHERE y = 0 AND p >= threshold) AS fp, count(*) FILTER (WHERE y = 1 AND p < threshold) AS fn, count(*) FILTER (WHERE y = 0 AND p < threshold) AS tn FROM t GROUP BY lang, threshold)
SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS "precision", round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1, round(tp / nullif(tp + fp + fn, 0)::DOUBLE, 6) AS csi, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr FROM c""")
def confusion_metrics(spark, table):
    c = scoring.confusion(scored(table), ["lang"], "y", "p", [0.1, 0.25, 0.5])
    return c.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1", "csi", "fpr")})


@book.add(f"WITH {SCORED_SQL} SELECT lang, CAST(least(9, floor(p * 10)) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM sc GROUP BY lang, CAST(least(9, floor(p * 10)) AS INT)")
def calibration_bins(spark, table):
    return scoring.calibration(scored(table), ["lang"], "y", "p").withColumns({"mean_p": F.round("mean_p", 6), "rate": F.round("rate", 6)})


@book.add(f"WITH {SCORED_SQL} SELECT lang, round(avg(pow(p - y, 2)), 6) AS brier, count(*) AS n FROM sc GROUP BY lang")
def brier_by_group(spark, table):
    return scoring.brier(scored(table), ["lang"], "y", "p").withColumn("brier", F.round("brier", 6))


@book.add("SELECT round(greatest(1e0, least(50e0, count(*) FILTER (WHERE toxic = 0) / CAST(count(*) FILTER (WHERE toxic = 1) AS DOUBLE))), 6) AS weight FROM labels")
def train_class_weight(spark, table):
    return scoring.class_weight(table("labels"), "toxic").withColumn("weight", F.round("weight", 6))


@book.add(f"WITH {SCORED_SQL}, q AS (SELECT doc_id, least(1 - 1e-6, greatest(1e-6, p)) AS q FROM sc) SELECT doc_id, round(1 / (1 + exp(-(0.8e0 * ln(q / (1 - q)) - 0.3e0))), 9) AS calibrated FROM q")
def calibrated_scores(spark, table):
    return scored(table).select("doc_id", F.round(scoring.calibrated(F.col("p"), 0.8, -0.3), 9).alias("calibrated"))


@book.add("""WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, ln(1 + exp(l_discount * 10 - 3)) AS a, ln(1 + exp(l_tax * 10 - 2)) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(1 - exp(-a), 9) AS p1, round(1 - exp(-a - b), 9) AS p2 FROM h""")
def monotone_horizons(spark, table):
    p = scoring.monotone(F.array(F.col("l_discount") * 10 - 3, F.col("l_tax") * 10 - 2))
    return table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", p.alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.get("p", 0), 9).alias("p1"), F.round(F.get("p", 1), 9).alias("p2"))


@book.add()
def bootstrap_ci(spark, table):
    means = scoring.brier(scored(table).withColumn("g", F.col("doc_id") % 20), ["lang", "g"], "y", "p")
    return scoring.bootstrap(means, ["lang"], "brier")


@book.add()
def convex_hull(spark, table):
    pts = table("customer").select(F.col("c_nationkey").alias("k"), (F.col("c_custkey") * 31 % 997).cast("double").alias("x"), (F.col("c_custkey") * 17 % 991).cast("double").alias("y"))
    return scoring.convex_hulls(pts, "k").select("k", F.to_json("hull").alias("hull"))


@book.add("SELECT 'negative_price' AS name, count(*) FILTER (WHERE o_totalprice < 0) AS violated FROM orders UNION ALL SELECT 'odd_status', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders")
def constraint_checks(spark, table):
    return scoring.constraints(table("orders"), {"negative_price": F.col("o_totalprice") < 0, "odd_status": ~F.col("o_orderstatus").isin("F", "O")})


@book.add("""WITH s AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS model, s_suppkey % 3 AS seed, s_suppkey % 2 = 1 AND s_suppkey < 10 AS bad FROM supplier)
SELECT model, NOT bool_or(bad) AS accepted, CASE WHEN bool_or(bad) THEN 'not above the baselines' ELSE '' END AS reasons FROM s GROUP BY model""")
def acceptance_gate(spark, table):
    k = F.col("s_suppkey")
    low = F.when((k % 2 == 1) & (k < 10), -0.1).otherwise(0.1)
    s = table("supplier").select(F.when(k % 2 == 0, "a").otherwise("b").alias("model"), (k % 3).alias("seed"), F.lit(12).alias("groups"), low.alias("low"), F.lit(0.1).alias("brier"), F.lit(0.2).alias("best_brier"), F.lit(0.0).alias("fpr"))
    return scoring.acceptance(s).withColumn("reasons", F.array_join("reasons", "; "))
