"""Registered queries over time and whole tables: as-of and overlap joins, trailing frames, ranks, grouping sets, sketches and table functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyframe.functions import tables
from tallyframe.operators import ranks, reporting, sketches, temporal
from tallyframe.operators.graph import shared_folder
from tallyframe.plans import views as W
from tallyframe.plans.queries import query
from tallyframe.streaming import windows

# ---- joins by time

#: Orders as versions that are published in the month of the events.
_PUBLISHED = "pub as (select o_orderkey as ord, o_custkey as owner, o_orderkey % 4 as p, timestamp '2024-01-01' + to_days((date_diff('day', date '1995-01-01', o_orderdate::date) % 30)::int) + to_seconds(o_orderkey % 86400) as since from orders)"


def _published(spark, d):
    days = F.pmod(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")), F.lit(30))
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days, F.lit(0), F.lit(0), (F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    return W.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 4).alias("p"), at.alias("at"))


@query(f"""with {_PUBLISHED}, r as (select owner, since, max(ord) as ord from pub group by all)
select event_id, r.ord as version, epoch_us(r.since) as published from events e asof left join r on e.user_id = r.owner and e.ts >= r.since""")
def versions_as_of(spark, d):
    """The newest version of its owner that was there when an event happened."""
    events = W.table(spark, d, "events").select("event_id", F.col("user_id").alias("owner"), "ts")
    found = temporal.as_of(events, _published(spark, d), ["owner"], "ts", "at", order=("ord",))
    return found.select("event_id", F.col("as_of.ord").alias("version"), F.unix_micros(F.col("as_of.at").cast("timestamp")).alias("published"))


@query(f"""with {_PUBLISHED}, r as (select p, since, max(ord) as ord from pub group by all)
select event_id, r.ord as version from (select *, user_id % 4 as p from events) e asof left join r on e.p = r.p and e.ts >= r.since""")
def provider_versions_as_of(spark, d):
    """The same by provider, of which there are four, whatever the size of the table."""
    events = W.table(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("p"), "ts")
    return temporal.as_of(events, _published(spark, d), ["p"], "ts", "at", order=("ord",)).select("event_id", F.col("as_of.ord").alias("version"))


_SESSIONS = """b as (select *, coalesce(ts - lag(ts) over w >= interval 6 hours, true) as fresh from events where event_type in ('click', 'view') window w as (partition by user_id, event_type order by ts)),
n as (select *, sum(fresh::int) over (partition by user_id, event_type order by ts, event_id) as k from b),
s as (select user_id, event_type, min(ts) as start, max(ts) + interval 6 hours as stop from n group by user_id, event_type, k)"""


@query(f"""with {_SESSIONS} select c.user_id, epoch_us(c.start) as click_start, epoch_us(v.start) as view_start, epoch_us(least(c.stop, v.stop)) - epoch_us(greatest(c.start, v.start)) as shared
from s c join s v on c.user_id = v.user_id and c.event_type = 'click' and v.event_type = 'view' and c.start < v.stop and v.start < c.stop""")
def session_overlaps(spark, d):
    """Sessions of clicks and of views of one user that share a moment."""
    e = W.table(spark, d, "events")
    click, view = (windows.sessions(e.where(F.col("event_type") == t), "6 hours") for t in ("click", "view"))
    us = lambda c: F.unix_micros(F.col(c))
    pairs = temporal.overlapping(click, view, ["user_id"])
    return pairs.select("left.user_id", us("left.start").alias("click_start"), us("right.start").alias("view_start"), (F.least(us("left.end"), us("right.end")) - F.greatest(us("left.start"), us("right.start"))).alias("shared"))


@query("""select event_id, count(*) over w as n, round(sum(value) over w, 4) as total from events window w as (partition by user_id order by ts range between interval 7 days preceding and current row)""")
def weekly_activity(spark, d):
    e = W.table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    found = temporal.trailing(e, ["user_id"], "ts", 7 * 86400, {"n": F.count("*"), "total": F.sum("value")})
    return found.select("event_id", "n", F.round("total", 4).alias("total"))


# ---- the whole table


@query("""select o_orderkey, rank() over w as rank, dense_rank() over w as dense_rank, ntile(100) over (order by o_orderdate, o_orderkey) as tile, round(percent_rank() over w, 9) as percent_rank from orders window w as (order by o_orderdate)""")
def order_ranks(spark, d):
    rows = W.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    found = ranks.ranked(rows, ["o_orderdate"], ["o_orderkey"], tiles=100)
    return found.select("o_orderkey", "rank", "dense_rank", "tile", F.round("percent_rank", 9).alias("percent_rank"))


@query("""select provider, mime_type, day, count(*) as n, sum(size)::bigint as bytes, grouping(provider, mime_type, day)::bigint as level from (select *, substr(modified_at, 1, 10) as day from file_instance)
group by grouping sets ((provider, mime_type, day), (provider, mime_type), (provider, day), (provider), ())""")
def inventory_totals(spark, d):
    rows = W.file_instance(spark, d).select("provider", "mime_type", F.substring("modified_at", 1, 10).alias("day"), "size")
    sets = [["provider", "mime_type", "day"], ["provider", "mime_type"], ["provider", "day"], ["provider"], []]
    return reporting.totals(rows, sets, F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("select event_type, count(*) as n, count(distinct user_id) as users, true as users_close, true as median_close from events group by 1")
def sketch_errors(spark, d):
    """Sketches kept by day in two batches and merged by type, held against exact counts: distinct users within 5 %, the median's rank within 2 %."""
    e, folder = W.table(spark, d, "events"), f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for k in (0, 1):
        sketches.add(sketches.states(e.where(F.col("event_id") % 2 == k), F.to_date("ts"), ["event_type"], "user_id", "value"), folder, k)
    found = sketches.estimates(sketches.read(spark, folder, ["event_type"]))
    told = F.broadcast(found.select("event_type", "n", "distinct", F.col("quantiles")[0].alias("median")))  # a row for each type
    exact = e.join(told, "event_type").groupBy("event_type", "n", "distinct").agg(F.count_distinct("user_id").alias("users"), F.count(F.when(F.col("value") <= F.col("median"), 1)).alias("below"), F.count("value").alias("known"))
    return exact.select("event_type", "n", "users", (F.abs(F.col("distinct") - F.col("users")) <= 1 + 0.05 * F.col("users")).alias("users_close"), (F.abs(F.col("below") / F.col("known") - 0.5) <= 0.02 + 1 / F.col("known")).alias("median_close"))


@query("""with b as (select *, coalesce(ts - lag(ts) over w >= interval 6 hours, true) as fresh from events window w as (partition by user_id order by ts)),
n as (select *, sum(fresh::int) over (partition by user_id order by ts, event_id) as k from b) select user_id, epoch_us(min(ts)) as start, epoch_us(max(ts)) as stop, count(*) as n from n group by user_id, k""")
def split_sessions(spark, d):
    """A user's events cut where six hours pass without one, by a table function."""
    runs = tables.split_at_gaps(W.table(spark, d, "events"), "user_id", "ts", 6 * 3600)
    return runs.select(F.col("key").cast("long").alias("user_id"), F.unix_micros("start").alias("start"), F.unix_micros("end").alias("stop"), "n")
