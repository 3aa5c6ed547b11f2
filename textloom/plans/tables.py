"""Events and the star schema: sessions, interval and as-of joins, windows, roll-ups (extras beside the corpus operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.plans.registry import Registry
from textloom.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

SESSIONS = """
g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as new from events),
n as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g),
s as (select user_id, session, min(ts) as start, max(ts) as stop, count(*) as n_events from n group by all)
"""


def sessions(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.col("ts") > F.lag("ts").over(w) + F.expr("interval 30 minutes")).cast("int"), F.lit(1))
    numbered = events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n_events"))


@R.query(f"with {SESSIONS} select user_id, count(*) as n_sessions, max(n_events) as longest from s group by user_id")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n_events").alias("longest"))


@R.query(
    f"""
with {SESSIONS}, p as (select event_id, user_id, ts from events where event_type = 'purchase')
select event_id, min(session) as session from p join s on p.user_id = s.user_id and p.ts between s.start - interval 5 second and s.stop group by event_id"""
)
def event_sessions_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval join within the user's sessions: an equi-join on the user with a range condition; the first session wins."""
    s = sessions(table(spark, d, "events")).select("user_id", "session", "start", "stop")
    p = table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    joined = p.join(s, "user_id").where(F.expr("ts between start - interval 5 seconds and stop"))
    return joined.groupBy("event_id").agg(F.min("session").alias("session"))


@R.query("select user_id, n, rank from (select user_id, count(*) as n, row_number() over (order by count(*) desc, user_id) as rank from events group by user_id) where rank <= 10")
def event_top_users(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "user_id")).cast("long"))


@R.query(
    """
select event_id, (select arg_max(v.event_id, (v.ts, v.event_id)) from events v where v.user_id = e.user_id and v.event_type = 'view' and (v.ts, v.event_id) < (e.ts, e.event_id)) as last_view
from events e where event_type = 'purchase'"""
)
def event_as_of(spark: SparkSession, d: str) -> DataFrame:
    """As-of join: the user's last view before each purchase, by one window over both."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, d, "events").withColumn("last_view", seen).where("event_type = 'purchase'").select("event_id", "last_view")


@R.query("select event_type, date_trunc('hour', ts) as hour, count(*) as n, round(sum(value), 6) as total from events group by all")
def event_hourly(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


@R.query("select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by all")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= date '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.count("*").alias("n"))


@R.query("select n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
