"""SQL twins of newsignal.plans.series."""

from __future__ import annotations

from oracle.tables import sql, z

ENERGY_ROUTING = """case
  when regexp_matches(t, 'lng|natural gas|liquefied|jkm|henry hub|ttf|nbp|regasification|gas price|spot gas|lng terminal') then 'Oman'
  when regexp_matches(t, 'wti|west texas|cushing|shale|permian|eagle ford|bakken|us crude|gulf coast|usgc|houston|midland') then 'WTI'
  when regexp_matches(t, 'brent|north sea|dated brent|forties|oseberg|ekofisk|europe|urals|russia|norway|uk crude|rotterdam|mediterranean') then 'Brent'
  else 'Dubai' end"""
DESK_ROUTING = """case
  when contains(t, 'eaux') or contains(t, 'ique') then 'Oman'
  when contains(t, 'nterti') or contains(t, 'thorr') then 'WTI'
  when contains(t, 'ing') or contains(t, 'schen') then 'Brent'
  else 'Dubai' end"""

THRESHOLDS = """
thresholds as (
  select *, case when n >= 30 then greatest(p33, 0.3) else 1.0 end as thresh_low,
         case when n >= 30 then greatest(p67, greatest(p33, 0.3) + 0.3) else 3.0 end as thresh_high
  from (select *, count(a) over w as n, quantile_cont(a, 0.33) over w as p33,
               quantile_cont(a, 0.67) over w as p67
        from (select *, case when pct_change_24h is not null then least(abs(pct_change_24h), 20.0) end as a from prices)
        window w as (partition by symbol order by date
                     range between interval 90 days preceding and current row)))"""

ALIGNED = """
aligned as (
  select a.*, (select min(p.date) from (select distinct date from prices) p
               where p.date between a.published_at and a.published_at + interval 3 days) as aligned_date
  from articles a)"""


def labelled(routing: str, noise: str, thresholds: str = THRESHOLDS) -> str:
    return f"""with {thresholds.strip()},
aligned as (
  select a.*, c.aligned_date
  from (select *, {routing} as routed
        from (select *, lower(coalesce(headline, '') || ' ' || body_text) as t
              from articles where coalesce(report_name, '') not in ({noise}))) a
  join (select d.published_at, min(p.date) as aligned_date
        from (select distinct published_at from articles) d
        join (select distinct date from prices) p
          on p.date between d.published_at and d.published_at + interval 3 days
        group by 1) c using (published_at)),
labelled as (
  select id, headline, body_text, source, published_at, url, aligned_date,
         round(pct, 4) as price_change,
         case when least(abs(pct), 20.0) >= thresh_high then 'HIGH'
              when least(abs(pct), 20.0) >= thresh_low then 'MEDIUM' else 'LOW' end as label,
         price_symbol
  from (select a.*, case when r.symbol is null then 'Dubai' else r.symbol end as price_symbol,
               case when r.symbol is null then d.pct_change_24h else r.pct_change_24h end as pct,
               case when r.symbol is null then d.thresh_low else r.thresh_low end as thresh_low,
               case when r.symbol is null then d.thresh_high else r.thresh_high end as thresh_high
        from aligned a
        left join thresholds r on r.symbol = a.routed and r.date = a.aligned_date
        left join thresholds d on d.symbol = 'Dubai' and d.date = a.aligned_date)
  where pct is not null)"""


DESK = labelled(DESK_ROUTING, "'src3'")
LABEL_COLUMNS = "select id, aligned_date, price_change, label, price_symbol from labelled"

FEATURES = """
features as (
  select p.date, coalesce((p.price / lag(p.price, 5) over w - 1) * 100, 0.0) as mom_5d,
         coalesce((p.price / lag(p.price, 10) over w - 1) * 100, 0.0) as mom_10d,
         cast(isodow(p.date) = 1 as double) as dow_mon, cast(isodow(p.date) = 2 as double) as dow_tue,
         cast(isodow(p.date) = 3 as double) as dow_wed, cast(isodow(p.date) = 4 as double) as dow_thu,
         cast(isodow(p.date) = 5 as double) as dow_fri,
         coalesce(cast(c.n as double), 0.0) as article_count
  from prices p left join (select published_at, count(*) as n from articles group by 1) c
    on c.published_at = p.date
  where p.symbol = 'Dubai' window w as (order by p.date))"""

CONFIG = """(values ('Dubai Crude (PCAAT00)', 'Dubai', 'CL=F'), ('Brent Dated (PCAAS00)', 'Brent', 'BZ=F'),
  ('WTI (PCACG00)', 'WTI', 'CL=F'), ('LNG / Nat Gas (JKM)', 'LNG', 'NG=F'), ('Dubai Crude', 'Dubai', 'CL=F'))
  c(commodity, price_symbol, ticker_yf)"""


def two_tier(prefix: str, low: int, high1: int, high2: int) -> str:
    return f"""
select p.id, coalesce(t1.price, t2.price) as {prefix}_price,
       case when t1.price is not null then 'platts' when t2.price is not null then 'yfinance' end as {prefix}_price_source,
       coalesce(t1.d, t2.d) as {prefix}_date,
       case when t1.price is not null then c.price_symbol when t2.price is not null then c.ticker_yf end as {prefix}_symbol
from predictions p left join {CONFIG} using (commodity)
left join (select q.id, arg_min(s.price, s.date) as price, min(s.date) as d
           from predictions q join {CONFIG} using (commodity)
           join prices s on s.symbol = c.price_symbol
            and s.date between q.prediction_date + {low} and q.prediction_date + {high1}
           group by 1) t1 on t1.id = p.id
left join (select q.id, arg_min(s.price, s.date) as price, min(s.date) as d
           from predictions q join {CONFIG} using (commodity)
           join market s on s.ticker = c.ticker_yf
            and s.date between q.prediction_date + {low} and q.prediction_date + {high2}
           group by 1) t2 on t2.id = p.id"""


PAIRS = f"""select id, commodity, (case expected_move when '>3%' then 3.5 when '1-3%' then 2.0 else 0.5 end)::double
  as predicted_move, {z('actual_move')} as actual_move from settled where actual_move is not null"""
ROUND_FEATURES = """round(mom_5d, 6) as mom_5d, round(mom_10d, 6) as mom_10d, dow_mon, dow_tue, dow_wed,
  dow_thu, dow_fri, article_count"""

ORACLES = {
    "label_articles": sql("articles prices", f"{DESK} {LABEL_COLUMNS}"),
    "label_articles_energy": sql("articles prices", f"{labelled(ENERGY_ROUTING, chr(39) + chr(39) + ' , ' + repr('Bunkerwire'))} {LABEL_COLUMNS}"),
    "label_articles_fixed": sql("articles prices", labelled(
        "'Dubai'", "'Bunkerwire'",
        "thresholds as (select *, 1.0 as thresh_low, 3.0 as thresh_high from prices)")
        + " select id, aligned_date, price_change, label from labelled"),
    "label_distribution": sql("articles prices", f"""{DESK}
        select label, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 1) as share_pct
        from labelled group by label"""),
    "label_crosstab": sql("articles prices", f"""{DESK}
        select price_symbol, count(*) filter (label = 'HIGH') as "HIGH",
               count(*) filter (label = 'LOW') as "LOW", count(*) filter (label = 'MEDIUM') as "MEDIUM"
        from labelled group by 1"""),
    "rolling_thresholds": sql("prices", f"""with {THRESHOLDS}
        select date, symbol, round(thresh_low, 6) as thresh_low, round(thresh_high, 6) as thresh_high,
               case when pct_change_24h is null then null
                    when least(abs(pct_change_24h), 20.0) >= thresh_high then 'HIGH'
                    when least(abs(pct_change_24h), 20.0) >= thresh_low then 'MEDIUM' else 'LOW' end as rolling_label,
               case when abs(pct_change_24h) >= 3 then 'HIGH' when abs(pct_change_24h) >= 1 then 'MEDIUM'
                    when abs(pct_change_24h) < 1 then 'LOW' end as fixed_label
        from thresholds"""),
    "trading_day_alignment": sql("articles prices", """
        select a.id, a.published_at as probe_date, min(p.date) as aligned_date
        from articles a left join (select distinct date from prices) p
          on p.date between a.published_at and a.published_at + interval 3 days
        group by 1, 2"""),
    "closing_price": sql("predictions prices market", two_tier("entry", 0, 6, 4)),
    "next_close": sql("predictions prices market", two_tier("exit", 1, 7, 7)),
    "fill_missing_change": sql("prices", """
        with holes as (select date, symbol, price, case when day(date) % 3 <> 0 then pct_change_24h end as pct
                       from prices)
        select date, symbol,
               round(coalesce(pct, (lead(price) over w / price - 1) * 100), 6) as next_day_pct,
               round(coalesce(pct, (price / lag(price) over w - 1) * 100), 6) as own_day_pct
        from holes window w as (partition by symbol order by date)"""),
    "momentum": sql("prices", """
        select date, symbol, round(coalesce((price / lag(price, 5) over w - 1) * 100, 0.0), 6) as mom_5d,
               round(coalesce((price / lag(price, 10) over w - 1) * 100, 0.0), 6) as mom_10d
        from prices window w as (partition by symbol order by date)"""),
    "latest_momentum": sql("prices", """
        with r as (select *, row_number() over (partition by symbol order by date desc) as k from prices),
        a as (select symbol, max(date) as as_of, count(*) as n, max(price) filter (k = 1) as p0,
                     max(price) filter (k = 6) as p5, arg_max(price, k) as po from r where k <= 11 group by 1)
        select symbol, as_of, round(case when n >= 6 then (p0 - p5) / p5 * 100 else 0.0 end, 6) as mom_5d,
               round(case when n >= 6 then (p0 - po) / po * 100 else 0.0 end, 6) as mom_10d from a"""),
    "daily_features": sql("articles prices", f"with {FEATURES} select date, {ROUND_FEATURES} from features"),
    "article_features": sql("articles prices", f"""{DESK}, {FEATURES}
        select l.id, l.aligned_date, l.label, round(coalesce(mom_5d, 0), 6) as mom_5d,
               round(coalesce(mom_10d, 0), 6) as mom_10d, coalesce(dow_mon, 0) as dow_mon,
               coalesce(dow_tue, 0) as dow_tue, coalesce(dow_wed, 0) as dow_wed,
               coalesce(dow_thu, 0) as dow_thu, coalesce(dow_fri, 0) as dow_fri,
               coalesce(article_count, 0) as article_count
        from labelled l left join features f on f.date = l.aligned_date"""),
    "articles_per_day": sql("feed", "select published_at as date, count(*) as article_count from feed group by 1"),
    "weekday_flags": sql("prices", """
        select distinct date, cast(isodow(date) = 1 as double) as dow_mon,
               cast(isodow(date) = 2 as double) as dow_tue, cast(isodow(date) = 3 as double) as dow_wed,
               cast(isodow(date) = 4 as double) as dow_thu, cast(isodow(date) = 5 as double) as dow_fri
        from prices"""),
    "symbol_summary": sql("prices", """select symbol, count(*) as n_days, min(date) as first_date,
        max(date) as last_date from prices group by 1"""),
    "trading_dates": sql("prices", "select distinct date from prices"),
    "priced_symbols": sql("prices", "select distinct symbol from prices where pct_change_24h is not null"),
    "entry_exit_series": sql("settled", """select id, prediction_date, commodity, signal, entry_price,
        exit_price from settled where prediction_date >= date '1998-01-01'"""),
    "predicted_actual_pairs": sql("settled", PAIRS),
    "identity_line": sql("settled", f"""select min(least(predicted_move, actual_move)) as low,
        max(greatest(predicted_move, actual_move)) as high from ({PAIRS})"""),
    "same_day_shared_price": sql("priced", """
        select b.id, b.commodity, b.prediction_date, b.entry_price, count(*) as n_matches
        from priced b join priced d on b.prediction_date = d.prediction_date
         and abs(b.entry_price - d.entry_price) < 0.0001
        where b.commodity like '%Brent%' and d.commodity like '%Dubai%'
        group by all"""),
}
