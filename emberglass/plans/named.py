"""Queries that are SQL text alone, over the library's registered functions."""

from __future__ import annotations

from emberglass.functions import sql
from emberglass.plans.base import ORIGIN_S, Book
from emberglass.plans.events import HAV

book = Book()


@book.add(f"""WITH e AS (SELECT event_id, user_id, CAST(floor((epoch_us(ts) - {ORIGIN_S}000000) / 1000000) AS BIGINT) AS at_s FROM events),
g AS (SELECT *, CASE WHEN at_s - lag(at_s) OVER w > 21600 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY at_s))
SELECT user_id, episode, count(*) AS n, min(at_s) AS start_s, max(at_s) AS end_s FROM (SELECT user_id, at_s, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY at_s) AS BIGINT) AS episode FROM g) GROUP BY ALL""")
def named_sessions(spark, table):
    sql.register(spark)
    table("events").createOrReplaceTempView("emberglass_events")
    return spark.sql(f"""
        SELECT user_id, episode, count(*) AS n, min(at_s) AS start_s, max(at_s) AS end_s
        FROM sessions(TABLE(SELECT user_id, CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) - {ORIGIN_S} AS BIGINT) AS at_s FROM emberglass_events), 'user_id', 'at_s', 21600)
        GROUP BY user_id, episode""")


@book.add(f"""WITH c AS (SELECT c_custkey, 36.5e0 + (c_custkey * 31 % 997) / 997e0 AS lat, -2.5e0 + (c_custkey * 17 % 991) / 991e0 AS lon FROM customer),
d AS (SELECT *, {HAV.format(a='lat', b='37e0', c='lon', d='-2e0')} AS km FROM c)
SELECT CAST(floor(lat / 0.25e0) AS BIGINT) AS r, CAST(floor(lon / 0.25e0) AS BIGINT) AS c, CASE WHEN km <= 1 THEN 'inside' WHEN km <= 5 THEN '5km' WHEN km <= 10 THEN '10km' WHEN km <= 20 THEN '20km' END AS ring, count(*) AS n FROM d GROUP BY ALL""")
def named_cells(spark, table):
    sql.register(spark)
    table("customer").createOrReplaceTempView("emberglass_customer")
    return spark.sql("""
        WITH c AS (SELECT 36.5D + (c_custkey * 31 % 997) / 997D AS lat, -2.5D + (c_custkey * 17 % 991) / 991D AS lon FROM emberglass_customer),
        d AS (SELECT grid_cell(lat, lon, 0.25D) AS cell, haversine_km(lat, lon, 37D, -2D) AS km FROM c)
        SELECT cell.row AS r, cell.col AS c, ring_of(km, km <= 1) AS ring, count(*) AS n FROM d GROUP BY ALL""")
