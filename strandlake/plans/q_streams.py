"""Queries of the stream operators, on the events table as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import chains
from . import domain as D

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, k""")
def event_chains(s, d):
    e = D.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return chains.sessions(e, "user_id", "ts", "2 hours").select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n")


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS total, max(value) AS largest FROM events GROUP BY ALL")
def running_totals(s, d):
    return chains.running_totals(D.table(s, d, "events"), ["user_id", "event_type"], "value").withColumn("total", F.round("total", 6))
