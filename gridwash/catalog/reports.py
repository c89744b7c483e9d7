"""Operational reports."""

from pyspark.sql import functions as F

from gridwash.catalog.registry import Tables, query
from gridwash.plans import limits, reports
from gridwash.plans.limits import rate_limit, requests_in_window

ACTIONS = """SELECT user_id, ts, CASE event_type WHEN 'view' THEN 'upload' WHEN 'click' THEN 'transform'
  WHEN 'purchase' THEN 'chat_request' ELSE 'other' END AS action,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS "rows" FROM events"""
ROLLUP = f"""SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS month,
  COUNT(*) FILTER (WHERE action = 'upload') AS uploads, COUNT(*) FILTER (WHERE action = 'transform') AS transforms,
  COUNT(*) FILTER (WHERE action = 'chat_request') AS chat_requests, CAST(SUM("rows") AS BIGINT) AS rows_processed
FROM ({ACTIONS}) a GROUP BY 1, 2"""


def actions(t: Tables):
    return t.events.selectExpr(
        "user_id", "ts", "CASE event_type WHEN 'view' THEN 'upload' WHEN 'click' THEN 'transform' "
        "WHEN 'purchase' THEN 'chat_request' ELSE 'other' END AS action",
        "cast(get_json_object(props, '$.k') AS bigint) AS rows")


@query("k1_usage_rollup", ROLLUP)
def k1(t: Tables):
    return reports.usage_rollup(actions(t))


@query("k2_usage_increment", ROLLUP)
def k2(t: Tables):
    """The first half of the events counted, then the second half added."""
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    first = reports.usage_rollup(actions(t).filter(F.col("ts") < middle))
    second = reports.usage_rollup(actions(t).filter(F.col("ts") >= middle))
    return reports.usage_increment(first, second)


LIMITS = {"free": {"uploads": 12, "transforms": 0, "chat_requests": 14}, "pro": {"uploads": 16, "transforms": 15}}
USERS = """SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 5000 THEN 'pro' WHEN c_acctbal < 0 THEN 'gold' ELSE 'free' END
  AS tier FROM customer"""


def users(t: Tables):
    return t.customer.selectExpr("c_custkey AS user_id", "CASE WHEN c_acctbal > 5000 THEN 'pro' WHEN c_acctbal < 0 "
                                 "THEN 'gold' ELSE 'free' END AS tier")


@query("k3_usage_status", f"""
WITH u AS ({USERS}), r AS (SELECT * FROM ({ROLLUP}) x WHERE month = DATE '2024-01-01'),
j AS (SELECT u.user_id, tier, COALESCE(uploads, 0) AS up, COALESCE(transforms, 0) AS tr, COALESCE(chat_requests, 0) AS ch
      FROM u LEFT JOIN r ON u.user_id = r.user_id),
l AS (SELECT user_id, tier, 'uploads' AS action, up AS used, CASE WHEN tier = 'pro' THEN 16 ELSE 12 END AS lim FROM j
      UNION ALL SELECT user_id, tier, 'transforms', tr, CASE WHEN tier = 'pro' THEN 15 ELSE 0 END FROM j
      UNION ALL SELECT user_id, tier, 'chat_requests', ch, CASE WHEN tier = 'pro' THEN 0 ELSE 14 END FROM j)
SELECT user_id, tier, action, used, CAST(lim AS BIGINT) AS "limit", lim > 0 AND used >= lim AS blocked FROM l""")
def k3(t: Tables):
    month = reports.usage_rollup(actions(t)).filter("month = DATE '2024-01-01'")
    return reports.usage_status(users(t), month, LIMITS)


@query("k4_usage_summary", f"""
WITH u AS ({USERS}), r AS (SELECT * FROM ({ROLLUP}) x WHERE month = DATE '2024-01-01'),
a AS (SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-01'
      AND ts < TIMESTAMP '2024-02-01' GROUP BY 1)
SELECT u.user_id, tier, COALESCE(uploads, 0) AS uploads, COALESCE(transforms, 0) AS transforms,
  COALESCE(chat_requests, 0) AS chat_requests, COALESCE(rows_processed, 0) AS rows_processed,
  COALESCE(n, 0) AS recipe_applies,
  CAST(CASE WHEN tier = 'pro' THEN 16 ELSE 12 END AS BIGINT) AS uploads_limit,
  CAST(CASE WHEN tier = 'pro' THEN 15 ELSE 0 END AS BIGINT) AS transforms_limit,
  CAST(CASE WHEN tier = 'pro' THEN NULL ELSE 14 END AS BIGINT) AS chat_requests_limit
FROM u LEFT JOIN r ON u.user_id = r.user_id LEFT JOIN a ON u.user_id = a.user_id""")
def k4(t: Tables):
    audit = t.events.selectExpr("user_id", "CASE WHEN event_type = 'error' THEN 'recipe_apply' ELSE event_type END "
                                "AS action", "ts AS created_at")
    return reports.usage_summary(users(t), reports.usage_rollup(actions(t)), audit, "2024-01-01", LIMITS)


FILES = """SELECT o_orderkey AS id, CASE WHEN o_custkey % 50 = 0 THEN 'anonymous' ELSE CAST(o_custkey AS VARCHAR) END
  AS user_id, o_orderdate AS created_at FROM orders"""


def files(t: Tables):
    return t.orders.selectExpr("o_orderkey AS id", "CASE WHEN o_custkey % 50 = 0 THEN 'anonymous' "
                               "ELSE cast(o_custkey AS string) END AS user_id", "o_orderdate AS created_at")


def transforms(t: Tables):
    return t.lineitem.selectExpr("l_orderkey AS file_id", "l_shipdate AS created_at")


@query("k5_activation_report", f"""
WITH f AS (SELECT l_orderkey AS id, MIN(l_shipdate) AS first_transform FROM lineitem GROUP BY 1),
u AS (SELECT strftime(x.created_at, '%Y-%m') AS month, user_id, COUNT(*) AS uploads, MIN(created_at) AS up,
             MIN(first_transform) AS tr FROM ({FILES}) x LEFT JOIN f ON x.id = f.id
      WHERE user_id <> 'anonymous' GROUP BY 1, 2)
SELECT month, CAST(SUM(uploads) AS BIGINT) AS uploads, COUNT(*) AS uploaders, COUNT(tr) AS activated,
       ROUND(100.0 * CAST(COUNT(tr) AS DOUBLE) / COUNT(*), 1) AS rate_pct,
       ROUND(MEDIAN((epoch_us(tr) - epoch_us(up)) / 60e6) FILTER (WHERE tr >= up), 1) AS median_minutes
FROM u GROUP BY 1 ORDER BY month DESC LIMIT 12""")
def k5(t: Tables):
    return reports.activation_report(files(t), transforms(t), 12)


@query("k6_funnel_report", f"""
WITH f AS ({FILES}), e AS (SELECT *, strftime(ts, '%Y-%m') AS month, CAST(user_id AS VARCHAR) AS u FROM events),
s AS (
  SELECT month, 'signups' AS stage, u FROM e WHERE event_type = 'signup'
  UNION SELECT strftime(created_at, '%Y-%m'), 'uploaded', user_id FROM f WHERE user_id <> 'anonymous'
  UNION SELECT strftime(l_shipdate, '%Y-%m'), 'transformed', user_id FROM lineitem JOIN f ON l_orderkey = id
        WHERE user_id <> 'anonymous'
  UNION SELECT month, 'recipe', u FROM e WHERE event_type = 'view'
  UNION SELECT month, 'paywall', u FROM e WHERE event_type = 'click'
  UNION SELECT month, 'checkout', u FROM e WHERE event_type = 'purchase'
  UNION SELECT month, 'converted', u FROM e WHERE event_type = 'error' OR value > 60)
SELECT month, """ + ", ".join(f"COUNT(*) FILTER (WHERE stage = '{s}') AS {s}" for s in reports.STAGES) + """
FROM s GROUP BY 1 ORDER BY month DESC LIMIT 40""")
def k6(t: Tables):
    ev = t.events
    signups = ev.filter("event_type = 'signup'").selectExpr("user_id AS id", "ts AS created_at")
    recipes = ev.filter("event_type = 'view'").selectExpr("user_id", "ts AS created_at")
    events = ev.selectExpr("user_id", "CASE event_type WHEN 'click' THEN 'paywall_hit' WHEN 'purchase' THEN "
                           "'checkout_started' WHEN 'error' THEN 'subscription_activated' ELSE event_type END AS event",
                           "ts AS created_at")
    subs = ev.selectExpr("user_id", "CASE WHEN value > 60 THEN 'pro' ELSE 'free' END AS tier",
                         "CASE WHEN event_id % 2 = 0 THEN ts END AS created_at", "ts AS updated_at")
    return reports.funnel_report(signups, files(t), transforms(t), recipes, events, subs, 40)


STATES = """SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'charged'
  WHEN 'purchase' THEN 'cancelled' WHEN 'signup' THEN 'created' ELSE 'halted' END AS status FROM events"""


def states(t: Tables):
    return t.events.selectExpr("user_id", "ts", "event_id", "CASE event_type WHEN 'view' THEN 'active' WHEN 'click' "
                               "THEN 'charged' WHEN 'purchase' THEN 'cancelled' WHEN 'signup' THEN 'created' "
                               "ELSE 'halted' END AS status")


@query("k7_tier_transitions", f"""
WITH s AS (SELECT *, CASE WHEN status IN ('active', 'authenticated', 'charged', 'resumed') THEN 'pro' ELSE 'free' END
           AS tier FROM ({STATES}) x),
l AS (SELECT *, lag(tier) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM s)
SELECT user_id, event_id, status FROM l WHERE tier = 'pro' AND COALESCE(prior, 'free') <> 'pro'""")
def k7(t: Tables):
    return reports.tier_transitions(states(t)).select("user_id", "event_id", "status")


@query("k8_current_tier", f"""
WITH s AS (SELECT user_id, arg_max(CASE status WHEN 'charged' THEN 'gold' WHEN 'active' THEN 'pro' ELSE 'free' END,
                  event_id) AS tier FROM ({STATES}) x GROUP BY 1)
SELECT c_custkey AS user_id, CASE WHEN tier IN ('free', 'pro') THEN tier ELSE 'free' END AS tier
FROM customer LEFT JOIN s ON c_custkey = user_id""")
def k8(t: Tables):
    tiers = states(t).withColumn("tier", F.expr(
        "CASE status WHEN 'charged' THEN 'gold' WHEN 'active' THEN 'pro' ELSE 'free' END"))
    return reports.current_tier(t.customer.select(F.col("c_custkey").alias("user_id")), tiers)


def requests(t: Tables):
    return t.events.select("user_id", reports.micros(F.col("ts")).alias("at"), F.col("event_id").alias("request_id"))


DAY = 86_400
EXACT_LIMIT = """
WITH RECURSIVE r AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
walk AS (
  SELECT user_id, rn, event_id, us, [us] AS acc, true AS accepted, CAST(NULL AS DOUBLE) AS retry_after FROM r WHERE rn = 1
  UNION ALL
  SELECT user_id, rn, event_id, us, CASE WHEN len(kept) < 3 THEN list_append(kept, us) ELSE kept END,
         len(kept) < 3, CASE WHEN len(kept) >= 3 THEN CAST(kept[1] + 86400000000 - us AS DOUBLE) / 1e6 END
  FROM (SELECT n.user_id, n.rn, n.event_id, n.us, list_filter(w.acc, lambda x: x > n.us - 86400000000) AS kept
        FROM walk w JOIN r n ON n.user_id = w.user_id AND n.rn = w.rn + 1) s)
SELECT user_id, event_id AS request_id, accepted, ROUND(retry_after, 3) AS retry_after FROM walk"""


@query("k9_rate_limit", EXACT_LIMIT)
def k9(t: Tables):
    return rate_limit(requests(t), 3, DAY).select(
        "user_id", "request_id", "accepted", F.round("retry_after", 3).alias("retry_after"))


@query("k9_requests_in_window", """
SELECT user_id, event_id AS request_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
  RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING) AS requests_before FROM events""")
def k9_bound(t: Tables):
    return requests_in_window(requests(t), DAY).select("user_id", "request_id", "requests_before")


@query("k9_download_bucket", "SELECT event_id AS request_id, true AS accepted FROM events")
def k9_quiet(t: Tables):
    """With the limits of the download action nobody in these tables is refused."""
    most, seconds = limits.BUCKETS["download"]
    return rate_limit(requests(t), most, seconds).select("request_id", "accepted")


JOBS = """SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'processing' WHEN 'view' THEN 'completed'
  WHEN 'click' THEN 'failed' ELSE 'queued' END AS status, ts AS updated_at FROM events"""


def jobs(t: Tables):
    return t.events.selectExpr("event_id AS id", "CASE event_type WHEN 'signup' THEN 'processing' WHEN 'view' THEN "
                               "'completed' WHEN 'click' THEN 'failed' ELSE 'queued' END AS status", "ts AS updated_at")


@query("k10_retention_prune", f"""
SELECT id, status FROM ({JOBS}) j
WHERE NOT (status IN ('completed', 'failed') AND updated_at < TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR)""")
def k10(t: Tables):
    return reports.retention_prune(jobs(t), F.lit("2024-01-20").cast("timestamp")).select("id", "status")


@query("k11_stalled_work", f"""
WITH live AS (SELECT event_id AS id FROM events WHERE value > 10)
SELECT id, CASE WHEN status = 'processing' AND id NOT IN (SELECT id FROM live) THEN 'failed' ELSE status END AS status,
       CASE WHEN status = 'processing' AND id NOT IN (SELECT id FROM live) THEN 'interrupted by restart' END AS error
FROM ({JOBS}) j""")
def k11(t: Tables):
    live = t.events.filter("value > 10").select(F.col("event_id").alias("id"))
    return reports.stalled_work(jobs(t), live).select("id", "status", "error")


@query("k12_conversation_context", """
WITH m AS (SELECT *, CASE WHEN turn % 3 = 1 THEN 'SELECT ' || conv_id END AS q,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'User: ' || text
        WHEN role = 'assistant' AND q IS NOT NULL THEN 'Assistant: [executed SQL: ' || q || ']'
        WHEN role = 'assistant' THEN 'Assistant: ' || text END AS line FROM m WHERE rn <= 4)
SELECT conv_id, COALESCE(string_agg(line, chr(10) ORDER BY turn), '') AS context FROM l GROUP BY 1""")
def k12(t: Tables):
    messages = t.conversations.withColumn("sql", F.expr("CASE WHEN turn % 3 = 1 THEN concat('SELECT ', conv_id) END"))
    return reports.conversation_context(messages, 4)
