"""Newest rows, sentiment and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import Tables
from brickline.catalog.registry import add_ctes, query, rounded
from brickline.operators.aggregates import daily_sentiment
from brickline.plans import anomalies, sentiment, serve
from brickline.plans.baselines import forecast_drift

add_ctes(
    {
        "b_zscore": """select city, target, ds as detect_date, y as value, abs((y - avg(y) over w) / nullif(stddev_pop(y) over w, 0)) as anomaly_score
            from b_series window w as (partition by city, target)""",
        "b_signals": "select *, coalesce(anomaly_score > 2, false) as is_anomaly, 'zscore' as model_name from b_zscore",
        "b_lexicon": "select * from (values " + ", ".join(f"('{w}', {v}::double)" for w, v in sentiment.LEXICON.items()) + ") l(word, weight)",
        "b_degree": "select * from (values " + ", ".join(f"('{w}', {v}::double)" for w, v in sentiment.DEGREES.items()) + ") l(word, degree)",
        "b_negation": "select * from (values " + ", ".join(f"(\'{w.replace(chr(39), chr(39) * 2)}\')" for w in sentiment.NEGATIONS) + ") l(word)",
        "b_words": f"""select id, place, word as shown, lower(word) as word,
            lag(lower(word), 1) over w as p1, lag(lower(word), 2) over w as p2, lag(lower(word), 3) over w as p3,
            max(case when lower(word) = 'but' then place end) over (partition by id) as turn,
            bool_or(word <> upper(word)) over (partition by id) as mixed
            from (select id, unnest(words) as word, generate_subscripts(words, 1) as place from
              (select id, regexp_extract_all(title, '{sentiment.WORD.replace(chr(39), chr(39) * 2)}') as words from b_news))
            window w as (partition by id order by place)""",
        "b_valence": """select id, place, turn, sign(weight) * (abs(weight)
              + case when length(shown) > 1 and shown = upper(shown) and mixed then 0.733 else 0 end
              + coalesce(d1.degree, 0) + 0.95 * coalesce(d2.degree, 0) + 0.9 * coalesce(d3.degree, 0))
              * case when p1 in (from b_negation) or p2 in (from b_negation) or p3 in (from b_negation) then -0.74 else 1 end as v
            from b_words join b_lexicon using (word) left join b_degree d1 on p1 = d1.word left join b_degree d2 on p2 = d2.word
            left join b_degree d3 on p3 = d3.word""",
        "b_folded": """select id, sum(v * case when turn is null then 1 when place < turn then 0.5 else 1.5 end) as v from b_valence group by id""",
        "b_marked": """select id, date, city, coalesce(v, 0) as v, length(title) - length(replace(title, '!', '')) as shouts,
            length(title) - length(replace(title, '?', '')) as asked from b_news left join b_folded using (id)""",
        "b_scored": """select id, date, city, s, round(s / sqrt(s * s + 15), 2) as sentiment_score from (
            select id, date, city, case when abs(v) < 1e-12 then 0 else v + sign(v) * (least(shouts, 4) * 0.292
              + case when asked < 2 then 0 when asked <= 3 then asked * 0.18 else 0.96 end) end as s from b_marked)""",
    }
)

LABEL = "case when sentiment_score > 0.05 then 'POS' when sentiment_score < -0.05 then 'NEG' else 'NEU' end"


@query("lexicon_sentiment", f"select id, date, city, sentiment_score, {LABEL} as sentiment_label from b_scored")
def _(t: Tables) -> DataFrame:
    return sentiment.lexicon_scores(t.news)


@query(
    "daily_sentiment",
    f"""select date, city, sentiment_score, {LABEL} as sentiment_label from
        (select date, city, round(avg(sentiment_score), 2) as sentiment_score from b_scored group by 1, 2)""",
)
def _(t: Tables) -> DataFrame:
    return daily_sentiment(sentiment.lexicon_scores(t.news))


@query(
    "detect_anomalies_zscore",
    "select city, target, detect_date, round(value, 4) as value, round(anomaly_score, 6) as anomaly_score, is_anomaly, model_name from b_signals",
)
def _(t: Tables) -> DataFrame:
    return rounded(rounded(anomalies.detect_zscore(t.series), "value", digits=4), "anomaly_score")


@query(
    "detect_anomalies_mad",
    """select city, target, detect_date, round(value, 4) as value, round(score, 6) as anomaly_score, coalesce(score > 3.5, false) as is_anomaly, 'mad' as model_name from (
         select city, target, ds as detect_date, y as value, 0.6745 * dev / nullif(median(dev) over w, 0) as score from
           (select *, abs(y - median(y) over (partition by city, target)) as dev from b_series) window w as (partition by city, target))""",
)
def _(t: Tables) -> DataFrame:
    return rounded(rounded(anomalies.detect_mad(t.series), "value", digits=4), "anomaly_score")


@query(
    "detect_anomalies_on_forecast",
    """select city, target, horizon, predict_date as detect_date, round(yhat, 4) as value, round(score, 6) as anomaly_score,
         coalesce(score > 1.5, false) as is_anomaly, 'zscore' as model_name from
         (select *, abs((yhat - avg(yhat) over w) / nullif(stddev_pop(yhat) over w, 0)) as score
          from b_drift_long, (select unnest([12, 24, 60, 120]) as horizon) where horizon_months <= horizon window w as (partition by city, target, horizon))""",
)
def _(t: Tables) -> DataFrame:
    out = anomalies.detect_on_forecast(forecast_drift(t.series, 120), [12, 24, 60, 120])
    return rounded(rounded(out, "value", digits=4), "anomaly_score")


@query("detect_anomalies_forest")
def _(t: Tables) -> DataFrame:
    return anomalies.detect_forest(t.series)


@query(
    "top3_anomalies",
    """select city, target, detect_date, round(value, 4) as value, rank from (select *, row_number() over (partition by city order by detect_date desc, target) as rank
       from b_signals where is_anomaly) where rank <= 3""",
)
def _(t: Tables) -> DataFrame:
    top = serve.top3_anomalies(anomalies.detect_zscore(t.series))
    return rounded(top.select("city", "target", "detect_date", "value", "rank"), "value", digits=4)


@query(
    "latest3_headlines",
    "select id, date, city, title, url, rank from (select *, row_number() over (partition by city order by date desc, id desc) as rank from b_news) where rank <= 3",
)
def _(t: Tables) -> DataFrame:
    return serve.latest3_headlines(t.news)


@query(
    "latest_forecast",
    """select city, target, predict_date, model_name, horizon_months, round(yhat, 4) as yhat from b_backtests
       qualify row_number() over (partition by city, target order by predict_date desc, model_name desc) = 1""",
)
def _(t: Tables) -> DataFrame:
    from brickline.plans.baselines import all_backtests

    return rounded(serve.latest_forecast(all_backtests(t.series_dense)), "yhat", digits=4)


@query("ordered_series", "select city, date, round(y, 4) as y from b_rent order by city, date")
def _(t: Tables) -> DataFrame:
    return rounded(t.rent_panel, "y", digits=4).orderBy("city", "date")
