"""Streaming jobs over the event table; the check SQL is the plain batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import Tables
from brickline.catalog.registry import add_ctes, query, rounded
from brickline.streaming import jobs, upsert

add_ctes(
    {
        "b_events": "select *, 'NATION_' || (user_id % 25) as city from events",
    }
)


@query(
    "stream_daily_sentiment",
    """select date, city, s as sentiment_score, case when s > 0.05 then 'POS' when s < -0.05 then 'NEG' else 'NEU' end as sentiment_label from
         (select cast(ts as date) as date, city, round(avg(value / 10 - 0.5), 2) as s from b_events group by 1, 2)""",
)
def _(t: Tables) -> DataFrame:
    return jobs.closed_table(t.spark, t.folder, jobs.daily_sentiment_stream, "daily-sentiment")


@query(
    "stream_rolling_mean",
    """select cast(d as date) as first_day, city, round(avg(value), 4) as mean_value, count(*) as n from
         (select *, unnest([cast(ts as date), cast(ts as date) - 1, cast(ts as date) - 2]) as d from b_events) group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return rounded(jobs.closed_table(t.spark, t.folder, jobs.rolling_mean_stream, "rolling"), "mean_value", digits=4)


@query(
    "stream_sessions",
    """select user_id, date_trunc('milliseconds', min(ts)) as session_start, count(*) as n_events, round(sum(value), 4) as total from
         (select *, sum(case when prev is null or ts >= prev + interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) as s
          from (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from b_events))
       group by user_id, s""",
)
def _(t: Tables) -> DataFrame:
    out = jobs.closed_table(t.spark, t.folder, jobs.sessions_stream, "sessions")
    ms = F.date_trunc("millisecond", "session_start").cast("timestamp_ntz")
    return rounded(out.withColumn("session_start", ms), "total", digits=4)


@query(
    "stream_upsert",
    """select event_id, user_id, event_type, value, city from b_events
       qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""",
)
def _(t: Tables) -> DataFrame:
    out = upsert.upsert_table(t.spark, jobs.event_stream(t.spark, t.folder))
    return out.select("event_id", "user_id", "event_type", "value", "city")


@query("stream_dedupe", "select distinct event_id, user_id, event_type, value from events")
def _(t: Tables) -> DataFrame:
    events = jobs.event_stream(t.spark, t.folder)
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = jobs.to_table(t.spark, jobs.dedupe_stream(twice, ["event_id"]), "dedupe")
    return out.select("event_id", "user_id", "event_type", "value")
