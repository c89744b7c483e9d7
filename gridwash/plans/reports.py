"""Usage, activation, funnel, tiers and conversation reports over the operations tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwash.functions.values import month_of
from gridwash.operators.segments import exact_median, previous_value
from gridwash.session import frozen

COUNTERS = ["uploads", "transforms", "chat_requests", "rows_processed"]
METERED = ["uploads", "transforms", "chat_requests"]
ANONYMOUS = "anonymous"
STAGES = ["signups", "uploaded", "transformed", "recipe", "paywall", "checkout", "converted"]
# Subscription states that count as paying.
ACTIVE_STATUSES = ["active", "authenticated", "charged", "resumed"]
TIERS = ["free", "pro"]


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def usage_rollup(actions: DataFrame) -> DataFrame:
    """Counters per user and UTC month from ``(user_id, ts, action, rows)``."""
    def tally(action: str) -> Column:
        return F.count_if(F.col("action") == action)

    return (actions.groupBy("user_id", F.trunc("ts", "month").alias("month"))
                   .agg(tally("upload").alias("uploads"), tally("transform").alias("transforms"),
                        tally("chat_request").alias("chat_requests"),
                        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows_processed")))


def usage_increment(counters: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add deltas to the counters; a new (user, month) starts at its delta."""
    both = counters.select("user_id", "month", *COUNTERS).unionByName(deltas.select("user_id", "month", *COUNTERS))
    return both.groupBy("user_id", "month").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTERS])


def _limit_of(limits: Mapping[str, Mapping[str, int]], tier: Column, action: Column) -> Column:
    """Limit from configuration; unknown tiers have the free limits, unknown actions none."""
    known = F.when(tier.isin(list(limits)), tier).otherwise(F.lit("free"))
    table = F.create_map(*[F.lit(x) for t, acts in limits.items() for a, n in acts.items() for x in (f"{t}/{a}", n)])
    return F.try_element_at(table, F.concat(known, F.lit("/"), action))


def usage_status(users: DataFrame, usage: DataFrame, limits: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Per user ``(user_id, tier)`` and metered action: used, limit and whether the next one is blocked."""
    counts = users.join(usage.select("user_id", *METERED), "user_id", "left")
    long = counts.select("user_id", "tier", F.inline(F.array(*[
        F.struct(F.lit(a).alias("action"), F.coalesce(a, F.lit(0)).cast("bigint").alias("used")) for a in METERED])))
    limit = F.coalesce(_limit_of(limits, F.col("tier"), F.col("action")), F.lit(0)).cast("bigint")
    return (long.withColumn("limit", limit)
                .withColumn("blocked", (F.col("limit") > 0) & (F.col("used") >= F.col("limit"))))


def usage_summary(users: DataFrame, usage: DataFrame, audit: DataFrame, month: str,
                  limits: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Counters of one month, limits, and recipe applies from ``audit(user_id, action, created_at)``."""
    first = F.lit(month).cast("date")
    within = (F.col("created_at") >= first) & (F.col("created_at") < F.add_months(first, 1))
    applies = (audit.filter((F.col("action") == "recipe_apply") & within)
                    .groupBy("user_id").agg(F.count(F.lit(1)).alias("recipe_applies")))
    current = usage.filter(F.col("month") == first).drop("month")
    out = users.join(current, "user_id", "left").join(applies, "user_id", "left")
    filled = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in [*COUNTERS, "recipe_applies"]}
    capped = {f"{a}_limit": _limit_of(limits, F.col("tier"), F.lit(a)).cast("bigint") for a in METERED}
    return out.withColumns(filled).withColumns(capped)


def _since(months: int, *sources: DataFrame):
    """The earliest of the latest ``months`` months of ``created_at`` in any source, None if there are not so many.

    A literal, so that files and partitions of earlier rows are never read. As many dates as are asked for reach the driver.
    """
    found = reduce(lambda a, b: a.unionByName(b), [
        s.select(F.trunc("created_at", "month").alias("month")).filter("month IS NOT NULL").distinct() for s in sources])
    latest = [r.month for r in found.distinct().orderBy(F.col("month").desc()).limit(months).collect()]
    return latest[-1] if len(latest) == months else None


def _from(df: DataFrame, since) -> DataFrame:
    return df if since is None else df.filter(F.col("created_at") >= F.lit(since))


def activation_report(files: DataFrame, transforms: DataFrame, months: int = 3) -> DataFrame:
    """Per month of upload: uploaders, activated users, rate and median minutes to the first transform.

    ``files(id, user_id, created_at)``, ``transforms(file_id, created_at)``.
    Transforms shrink to one row per file before the join.
    """
    first = transforms.groupBy(F.col("file_id").alias("id")).agg(F.min("created_at").alias("first_transform"))
    named = files.filter(F.col("user_id").cast("string") != ANONYMOUS)
    named = _from(named, _since(months, named))
    per_user = frozen(named.join(first, "id", "left")
                      .groupBy(F.trunc("created_at", "month").alias("month"), "user_id")
                      .agg(F.count(F.lit(1)).alias("uploads"), F.min("created_at").alias("first_upload"),
                           F.min("first_transform").alias("first_transform")), "activation")
    counts = per_user.groupBy("month").agg(
        F.sum("uploads").cast("bigint").alias("uploads"), F.count(F.lit(1)).alias("uploaders"),
        F.count("first_transform").alias("activated"))
    latest = counts.orderBy(F.col("month").desc()).limit(months)
    waits = (per_user.filter("first_transform >= first_upload")
             .select("month", ((micros(F.col("first_transform")) - micros(F.col("first_upload"))) / F.lit(60e6))
                     .alias("minutes")))
    medians = exact_median(waits, ["month"], "minutes", "median_minutes")
    return (latest.join(medians, "month", "left")
                  .select(month_of(F.col("month")).alias("month"), "uploads", "uploaders", "activated",
                          F.round(F.lit(100.0) * F.col("activated") / F.col("uploaders"), 1).alias("rate_pct"),
                          F.round("median_minutes", 1).alias("median_minutes")))


def funnel_report(signups: DataFrame, files: DataFrame, transforms: DataFrame, recipes: DataFrame,
                  events: DataFrame, subscriptions: DataFrame, months: int = 3) -> DataFrame:
    """Distinct users per month and stage.

    Every source is cut to distinct (month, stage, user) before anything is
    counted, so a user or file with very many rows is one row from then on.
    """
    month = F.trunc("created_at", "month").alias("month")  # a date until the end: cheaper to shuffle than text

    def tagged(df: DataFrame, stage: str | Column, user: str = "user_id") -> DataFrame:
        label = F.lit(stage) if isinstance(stage, str) else stage
        return df.select(month, label.alias("stage"), F.col(user).cast("string").alias("user_id"))

    def named(df: DataFrame) -> DataFrame:
        return df.filter(F.col("user_id").cast("string") != ANONYMOUS)

    # Months that only transforms have can but move the cut to later; without them it is early enough.
    since = subscriptions.withColumn("created_at", F.coalesce("created_at", "updated_at")).filter("tier = 'pro'")
    named_events = events.filter(F.col("event").isin(["paywall_hit", "checkout_started", "subscription_activated"]))
    cut = _since(months, signups, named(files), named(recipes), named_events, since)
    touched = _from(transforms, cut).select("file_id", month).distinct()
    owners = named(files).select(F.col("id").alias("file_id"), F.col("user_id").cast("string").alias("user_id"))
    transformed = touched.join(owners, "file_id").select("month", F.lit("transformed").alias("stage"), "user_id")
    from_events = {"paywall_hit": "paywall", "checkout_started": "checkout", "subscription_activated": "converted"}
    stage_of = F.create_map(*[F.lit(x) for pair in from_events.items() for x in pair])
    steps = (tagged(_from(signups, cut), "signups", "id")
             .unionByName(tagged(_from(named(files), cut), "uploaded")).unionByName(transformed)
             .unionByName(tagged(_from(named(recipes), cut), "recipe"))
             .unionByName(tagged(_from(named_events, cut), stage_of[F.col("event")]))
             .unionByName(tagged(_from(since, cut), "converted")))
    table = (steps.filter("month IS NOT NULL").distinct()
                  .groupBy("month").agg(*[F.count_if(F.col("stage") == s).alias(s) for s in STAGES]))
    latest = table.orderBy(F.col("month").desc()).limit(months)
    return latest.withColumn("month", month_of(F.col("month")))


def tier_of(status: Column) -> Column:
    return F.when(status.isin(ACTIVE_STATUSES), "pro").otherwise("free")


def tier_transitions(states: DataFrame) -> DataFrame:
    """Rows of ``(user_id, ts, event_id, status)`` where a user turns from free, or nothing, to pro."""
    tiers = states.withColumn("tier", tier_of(F.col("status")))
    prior = previous_value(tiers, ["user_id"], ["ts", "event_id"], "tier", "prior_tier")
    return prior.filter("tier = 'pro' AND coalesce(prior_tier, 'free') <> 'pro'").drop("prior_tier")


def current_tier(users: DataFrame, states: DataFrame) -> DataFrame:
    """Latest tier per user of ``users(user_id)``; free without a state or with an unknown tier."""
    latest = states.groupBy("user_id").agg(F.max_by("tier", F.struct("ts", "event_id")).alias("tier"))
    known = F.when(F.col("tier").isin(TIERS), F.col("tier")).otherwise("free")
    return users.join(latest, "user_id", "left").select("user_id", known.alias("tier"))


def retention_prune(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Jobs to keep: all but those completed or failed longer than ``hours`` ago."""
    old = F.col("status").isin("completed", "failed") & (micros(F.col("updated_at")) < micros(now) - hours * 3_600_000_000)
    return jobs.filter(~F.coalesce(old, F.lit(False)))


def stalled_work(jobs: DataFrame, live: DataFrame, reason: str = "interrupted by restart") -> DataFrame:
    """Processing jobs without a live worker become failed, with the reason; all jobs are returned."""
    alive = live.select(F.col("id").alias("_id")).distinct().withColumn("_alive", F.lit(True))
    joined = jobs.join(alive, jobs["id"] == alive["_id"], "left").drop("_id")
    dead = (F.col("status") == "processing") & F.col("_alive").isNull()
    return (joined.withColumn("error", F.when(dead, F.lit(reason)).otherwise(F.col("error") if "error" in jobs.columns
                                                                           else F.lit(None).cast("string")))
                  .withColumn("status", F.when(dead, F.lit("failed")).otherwise(F.col("status"))).drop("_alive"))


def conversation_context(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n turns of each ``(conv_id, turn, role, text, sql)`` conversation as one text.

    Only n rows per conversation leave any task, however long the conversation.
    """
    latest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    line = (F.when(F.col("role") == "user", F.concat(F.lit("User: "), F.coalesce("text", F.lit(""))))
             .when((F.col("role") == "assistant") & (F.coalesce("sql", F.lit("")) != ""),
                   F.concat(F.lit("Assistant: [executed SQL: "), F.col("sql"), F.lit("]")))
             .when(F.col("role") == "assistant", F.concat(F.lit("Assistant: "), F.coalesce("text", F.lit("")))))
    last = messages.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= n)
    turns = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("turn", line.alias("line")))))
    return (last.groupBy("conv_id").agg(turns.alias("t"))
                .select("conv_id", F.array_join(F.col("t.line"), "\n").alias("context")))
