"""As-of joins, carried values, ranks and shifts on keys of any size; the SQL beside them uses windows."""

from pyspark.sql import functions as F

from gridwash.catalog.registry import Tables, query
from gridwash.operators import ordered as ops


@query("s3_asof_join_hot_keys", """
SELECT l.event_id, l.event_type, r.event_id AS last_view, r.value AS viewed FROM (SELECT * FROM events) l
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value
  FROM events WHERE event_type = 'view' GROUP BY user_id, ts) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof(t: Tables):
    """Every event with the latest view of its user, its own time included."""
    views = t.events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view"),
                                                          F.col("value").alias("viewed"))
    found = ops.asof_join(t.events, views, ["user_id"], "ts", "ts", ["last_view", "viewed"], ties=["last_view"])
    return found.select("event_id", "event_type", "last_view", "viewed")


@query("s3_asof_join_next_within", """
SELECT l.event_id, CASE WHEN r.ts <= l.ts + INTERVAL 1 DAY THEN r.event_id END AS next_purchase FROM events l
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) r
  ON l.user_id = r.user_id AND l.ts < r.ts""")
def asof_next(t: Tables):
    """Every event with the first later purchase of its user, if it is within a day."""
    bought = t.events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("next_purchase"))
    found = ops.asof_join(t.events, bought, ["user_id"], "ts", "ts", ["next_purchase"], ties=["next_purchase"],
                          forward=True, strict=True, within=F.expr("INTERVAL 1 DAY"))
    return found.select("event_id", "next_purchase")


@query("s3_fill_forward_hot_keys", """
SELECT event_id, last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS)
  OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_high FROM events""")
def fill(t: Tables):
    """Five keys with a fifth of the rows each."""
    high = t.events.select("event_id", "event_type", "ts", F.expr("CASE WHEN value > 50 THEN value END").alias("high"))
    return ops.fill_forward(high, ["event_type"], ["ts", "event_id"], "high", "last_high").select("event_id", "last_high")


@query("s4_ranks_hot_keys", """
SELECT event_id, CAST(rank() OVER (PARTITION BY event_type ORDER BY user_id DESC NULLS LAST) AS BIGINT) AS place,
  CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY user_id DESC NULLS LAST) AS BIGINT) AS level FROM events""")
def ranked(t: Tables):
    order = [("user_id", "desc")]
    placed = ops.ranks(t.events.select("event_id", "event_type", "user_id"), ["event_type"], order, "place")
    return ops.ranks(placed, ["event_type"], order, "level", dense=True).select("event_id", "place", "level")


@query("s4_shifted_hot_keys", """
SELECT event_id, lag(value, 3) OVER w AS third_before, lead(value, 2) OVER w AS second_after FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def shift(t: Tables):
    rows = t.events.select("event_id", "event_type", "ts", "value")
    before = ops.shifted(rows, ["event_type"], ["ts", "event_id"], "value", 3, "third_before")
    return ops.shifted(before, ["event_type"], ["ts", "event_id"], "value", -2, "second_after").select(
        "event_id", "third_before", "second_after")
