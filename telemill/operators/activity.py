"""Activity by day and week: churn, lifetimes, persistence and survival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.exprs import lifetime_class, monday


def daily_activity(events: DataFrame) -> DataFrame:
    """(day, source_ip, honeypot): events, logins, sessions, first and last event."""
    rows = events.filter("source_ip IS NOT NULL").withColumn("day", F.to_date("event_time"))
    return rows.groupBy("day", "source_ip", "honeypot").agg(
        F.count("*").alias("event_count"), F.count_if(F.col("event_type").startswith("login")).alias("login_attempts"), F.countDistinct("session_id").alias("unique_sessions"),
        F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"),
    )


def days_to_do(activity: DataFrame, today, first_run_days: int = 7) -> DataFrame:
    """Days (day) after the last that the activity table has, through yesterday; without any, the last ``first_run_days``."""
    last = activity.agg(F.coalesce(F.date_add(F.max("day"), 1), F.date_sub(F.lit(today).cast("date"), first_run_days)).alias("start"))
    end = F.date_sub(F.lit(today).cast("date"), 1)
    return last.filter(F.col("start") <= end).select(F.explode(F.sequence("start", end)).alias("day"))


def catch_up(events: DataFrame, activity: DataFrame, today, first_run_days: int = 7) -> DataFrame:
    """daily_activity() of the days to do; the range reaches the scan as a filter on event_time."""
    span = days_to_do(activity, today, first_run_days).agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if span["a"] is None:
        return daily_activity(events.limit(0))
    return daily_activity(events.filter((F.col("event_time") >= F.lit(span["a"])) & (F.col("event_time") < F.date_add(F.lit(span["b"]), 1))))


def active_days(events: DataFrame) -> DataFrame:
    return events.filter("source_ip IS NOT NULL").select("source_ip", F.to_date("event_time").alias("day")).distinct()


def arrivals(events: DataFrame, quiet_days: int = 7) -> DataFrame:
    """(source_ip, day) of days on which an address is back after more than ``quiet_days`` days, or new.

    The day before is taken by a window over the distinct days of an address: no range join.
    """
    w = Window.partitionBy("source_ip").orderBy("day")
    days = active_days(events).withColumn("before", F.lag("day").over(w))
    return days.filter(F.col("before").isNull() | (F.datediff("day", "before") > quiet_days)).select("source_ip", "day")


def weekly_churn(events: DataFrame) -> DataFrame:
    """Active and new addresses of each week and the new ones' percentage."""
    active = active_days(events).groupBy(monday("day").alias("week_start")).agg(F.countDistinct("source_ip").alias("active_ips"))
    new = arrivals(events).groupBy(monday("day").alias("week_start")).agg(F.countDistinct("source_ip").alias("new_ips"))
    return active.join(new, "week_start").withColumn("churn_pct", F.round(F.lit(100.0) * F.col("new_ips") / F.nullif(F.col("active_ips"), F.lit(0)), 1))


def lifetimes(events: DataFrame) -> DataFrame:
    """First and last day, active days and lifetime in days of each address."""
    rows = active_days(events).groupBy("source_ip").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("active_days"))
    rows = rows.withColumn("lifetime_days", F.datediff("last_day", "first_day"))
    return rows.withColumn("lifetime_class", lifetime_class(F.col("lifetime_days")))


def survival_curve(events: DataFrame) -> DataFrame:
    """Kaplan-Meier estimate over lifetimes; addresses seen on the last day of all are censored.

    (t, at_risk, ended, survival), a row for each lifetime with an end. The product is taken over one row per
    distinct lifetime in days, so its window is small.
    """
    rows = lifetimes(events)
    last = active_days(events).agg(F.max("day").alias("end"))
    rows = rows.crossJoin(F.broadcast(last)).select("lifetime_days", (F.col("last_day") < F.col("end")).alias("ended"))
    by = rows.groupBy(F.col("lifetime_days").alias("t")).agg(F.count_if("ended").alias("ended"), F.count("*").alias("n"))
    after = Window.orderBy(F.desc("t"))
    by = by.withColumn("at_risk", F.sum("n").over(after)).filter("ended > 0")
    step = F.when(F.col("ended") < F.col("at_risk"), F.ln(1 - F.col("ended") / F.col("at_risk")))
    upto = Window.orderBy("t")
    whole = F.when(F.max((F.col("ended") >= F.col("at_risk")).cast("int")).over(upto) == 1, F.lit(0.0)).otherwise(F.exp(F.sum(step).over(upto)))
    return by.withColumn("survival", whole).select("t", "at_risk", "ended", "survival")


def return_gaps(events: DataFrame) -> DataFrame:
    """Days between successive active days of an address: (gap, n)."""
    w = Window.partitionBy("source_ip").orderBy("day")
    return active_days(events).withColumn("gap", F.datediff("day", F.lag("day").over(w))).filter("gap IS NOT NULL").groupBy("gap").agg(F.count("*").alias("n"))


def growth(counts: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """counts with the percentage that ``value`` grew by since the row before."""
    w = Window.partitionBy(*group).orderBy(order)
    before = F.lag(value).over(w)
    return counts.withColumn("growth_pct", F.round(F.lit(100.0) * (F.col(value) - before) / F.nullif(before, F.lit(0)), 1))
