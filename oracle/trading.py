"""SQL twins of newsignal.plans.trading."""

from __future__ import annotations

from oracle.tables import sql, z


SGN = ("(case when direction in ('bullish', 'rise') then 1 when direction in ('bearish', 'fall') then -1 "
       "else 0 end)")
MOVE = "(case expected_move when '>3%' then 3.5 when '1-3%' then 2.0 else 0.5 end)"
LOW_EVENTS = "('routine_report', 'analyst_comment', 'price_movement', 'general_market')"
SIDE = "(case when sgn = 1 then 'Bullish' when sgn = -1 then 'Bearish' else 'Neutral' end)"
CONFIG = """(values ('Dubai Crude (PCAAT00)', 'Dubai', 'CL=F', 1.5), ('Brent Dated (PCAAS00)', 'Brent', 'BZ=F', 1.5),
  ('WTI (PCACG00)', 'WTI', 'CL=F', 1.5), ('LNG / Nat Gas (JKM)', 'LNG', 'NG=F', 2.0),
  ('Dubai Crude', 'Dubai', 'CL=F', 1.5)) c(commodity, price_symbol, ticker_yf, stop_pct)"""

DECISIONS = f"""
q as (select *, {SGN} as sgn, strftime(prediction_date, '%Y-%m') as m,
             signal = 'HIGH' and confidence >= 0.55 and {MOVE} >= 1 and event_type not in {LOW_EVENTS} as ok
      from predictions),
r as (select *, count(*) filter (ok) over (partition by m order by prediction_date, commodity, id
                rows between unbounded preceding and current row) as k,
             coalesce(count(*) filter (ok) over (partition by m order by prediction_date, commodity, id
                rows between unbounded preceding and 1 preceding), 0) as before
      from q)"""

RESULT = """
trade as (
  select *, case when side = 1 then 'Bullish' when side = -1 then 'Bearish' else 'Hold' end as trade_direction,
         (exit_price - entry_price) / entry_price * 100 as raw,
         coalesce((side = 1 and exit_price < cut_loss_price) or (side = -1 and exit_price > cut_loss_price), false) as stopped,
         entry_price is not null and exit_price is not null as ready
  from base),
result as (
  select *, case when side = 0 or not ready then 0.0
                 when stopped then round((cut_loss_price - entry_price) * side * 1000, 2)
                 else round((exit_price - entry_price) * side * 1000, 2) end as p,
         case when side = 0 or not ready then 0.0 else round(raw, 4) end as ret,
         case when side = 0 then 'hold' when not ready then 'pending' when stopped then 'cut-loss'
              when abs(raw * side) < 0.2 then 'neutral' when raw * side > 0 then 'win'
              when raw * side <= -2 then 'cut-loss' else 'loss' end as res
  from trade)"""

TRADED = f"""
capped as (
  select id from (select id, row_number() over (partition by strftime(prediction_date, '%Y-%m')
                     order by confidence desc, prediction_date, id) as k
                  from settled where coalesce(trade_status, '') <> 'TRADE' and signal = 'HIGH'
                    and entry_price is not null) where k <= 8),
base as (
  select *, case when (coalesce(trade_status, '') = 'TRADE' or id in (select id from capped))
                   and signal = 'HIGH' and confidence * 100 >= 0.55 * 100 then sgn else 0 end as side
  from settled),
{RESULT.strip()},
traded as (
  select * exclude (direction, pnl_usd),
         case sgn when 1 then 'bullish' when -1 then 'bearish' else 'neutral' end as direction,
         case when ready then ret else 0.0 end as return_pct,
         case when ready then res else 'pending' end as trade_outcome,
         case when side = 0 then pnl_usd when ready then p else 0.0 end as pnl_usd
  from result)"""

RESOLVED = "trade_direction in ('Bullish', 'Bearish') and trade_outcome in ('win', 'loss', 'cut-loss', 'neutral')"

EVALUATED = """
evaluated as (
  select *, case sgn when 1 then 'rise' when -1 then 'fall' else 'flat' end as predicted_direction,
         case when return_pct > 1 then 'rise' when return_pct < -1 then 'fall'
              when return_pct is not null then 'flat' end as actual_direction,
         case sgn when 1 then 'rise' when -1 then 'fall' else 'flat' end =
         case when return_pct > 1 then 'rise' when return_pct < -1 then 'fall'
              when return_pct is not null then 'flat' end as is_correct,
         case when return_pct is not null then 'evaluated' else 'pending' end as status
  from (select *, coalesce(round((exit_price - entry_price) / entry_price * 100, 4), actual_move) as return_pct
        from settled))"""

TRACKER = f"""{TRADED.strip()},
costed as (
  select *, coalesce(trade_outcome, outcome) as final_outcome, coalesce(trade_status, 'HOLD') as final_status,
         case when prediction_date >= date '2001-01-01' then 'LIVE' else 'BACKTEST' end as signal_type,
         entry_price * 0.0015 as slip, case when sgn = 1 then 1 else -1 end as ls,
         case commodity when 'Brent Dated (PCAAS00)' then 0.04 when 'WTI (PCACG00)' then 0.04
              when 'LNG / Nat Gas (JKM)' then 0.02 else 0.05 end as spread
  from traded),
tracker as (
  select *, round((spread * 2 + slip * 2) * 1000, 4) as cost_usd,
         round(((exit_price - slip * ls) - (entry_price + slip * ls)) * ls * 1000 - (spread * 2 + slip * 2) * 1000, 2) as pnl_net,
         round(((exit_price - slip * ls) - (entry_price + slip * ls)) * ls / (entry_price + slip * ls) * 100, 4) as return_net
  from costed),
closed as (select * from tracker where final_status = 'TRADE'
             and final_outcome in ('win', 'loss', 'cut-loss', 'neutral')),
curve as (
  select *, max(equity) over (order by prediction_date, id rows unbounded preceding) as peak
  from (select *, sum(coalesce(pnl_net, 0)) over (order by prediction_date, id rows unbounded preceding) as equity
        from closed))"""


def summary(where: str, mixed: str) -> str:
    tracker = TRACKER.replace("'neutral')),\ncurve", f"'neutral') and {where}),\ncurve")
    return f"""with {tracker}
  select count(*) as n_trades, count(*) filter (signal_type = 'LIVE') as n_live,
         count(*) filter (signal_type = 'BACKTEST') as n_backtest,
         coalesce(round(count(*) filter (final_outcome = 'win') * 100.0 / nullif(count(*) filter (final_outcome <> 'neutral'), 0), 1), 0) as win_rate_pct,
         count(*) filter (final_outcome <> 'neutral') < 30 as win_rate_low_sample,
         case when abs(coalesce(sum(pnl_net) filter (final_outcome in ('loss', 'cut-loss')), 0)) > 0
              then round(coalesce(sum(pnl_net) filter (final_outcome = 'win'), 0)
                   / abs(sum(pnl_net) filter (final_outcome in ('loss', 'cut-loss'))), 2)
              else 'infinity'::double end as profit_factor,
         count(*) < 30 as profit_factor_low_sample,
         coalesce(round(avg(return_net) filter (final_outcome = 'win'), 4), 0) as avg_win_pct,
         coalesce(round(avg(return_net) filter (final_outcome in ('loss', 'cut-loss')), 4), 0) as avg_loss_pct,
         coalesce(round(sum(pnl_net), 2), 0) as total_pnl_usd, {mixed} as mixed_warning,
         (select {z('round(min(equity - peak), 2)')} from curve) as max_drawdown_usd
  from closed"""


def ratios(name: str, table: str, pnl: str, entry: str, spread: str, periods: int) -> str:
    return f"""
  select '{name}' as variant, count(*) as n_returns,
         case when count(*) >= 5 and {spread}(x) > 0 then round(avg(x) / {spread}(x) * sqrt({periods}), 2) end as sharpe_ratio,
         case when count(*) >= 5 and count(*) filter (x < 0) > 1
              then round(avg(x) / {spread}(x) filter (x < 0) * sqrt({periods}), 2) end as sortino_ratio,
         count(*) < 30 as low_sample
  from (select {pnl} / ((select avg({entry}) from {table}) * 1000) * 100 - 0.05 / 252 as x
        from {table} where {pnl} is not null)"""


SETUPS = f"""
rates as (select commodity, signal, sgn, round(count(*) filter (outcome = 'correct') * 1.0 / count(*), 3) as rate
          from settled where outcome in ('correct', 'incorrect') group by all having count(*) >= 5),
zones as (select commodity, least(greatest(avg(abs(actual_move)) / 100 * 0.3, 0.001), 0.01) as zone
          from (select *, row_number() over (partition by commodity order by prediction_date desc, id desc) as k
                from settled where actual_move is not null) where k <= 10 group by 1),
s1 as (select p.*, confidence * 100 as scaled_conf, confidence * 100 / 100 as c, coalesce(zone, 0.003) as zone_pct,
              coalesce(rate, 0.55) as win_rate
       from settled p left join zones using (commodity) left join rates using (commodity, signal, sgn)
       where entry_price is not null and signal = 'HIGH' and sgn <> 0 and confidence * 100 / 100 >= 0.5),
s2 as (select *, 2.0 + (4.0 - 2.0) * least((c - 0.5) / 0.5, 1.0) as mv,
              round(entry_price * (1 - sgn * 0.01), 4) as stop_loss from s1),
s3 as (select *, round(entry_price * (1 + sgn * mv / 100), 4) as target_price from s2),
s4 as (select *, round(abs(entry_price - stop_loss) * 1000, 2) as risk_usd,
              round(abs(target_price - entry_price) * 1000, 2) as reward_usd from s3),
s5 as (select *, round(reward_usd / risk_usd, 2) as risk_reward,
              round(win_rate * reward_usd - (1 - win_rate) * risk_usd, 2) as expected_value from s4),
setups as (select *, case when sgn = 1 then 'Bullish' else 'Bearish' end as trade_direction,
              case when c >= 0.8 and risk_reward >= 2 then 'strong' when c >= 0.65 and risk_reward >= 1.5 then 'moderate'
                   else 'cautious' end as rating,
              risk_reward >= 1.5 and expected_value > 0 as is_best from s5)"""

BY_COUNT = "case when n = 0 then 'PASS' when n < 5 then 'WARN' else 'FAIL' end"
QUALITY = f"""
k1 as (select count(*) as total, count(*) filter (entry_price_source is null) as u,
              count(*) filter (entry_price_source = 'platts') as a, count(*) filter (entry_price_source = 'yfinance') as b
       from settled where entry_price is not null),
k4 as (select conf, n, sum(n) over () as total from (select round(confidence, 2) as conf, count(*) as n from settled group by 1)
       order by n desc, conf limit 1),
k5 as (select direction, n, sum(n) over () as total from (select direction, count(*) as n from settled group by 1)
       order by n desc, direction limit 1),
k6 as (select case when confidence >= 0.7 then 'high (>=0.7)' when confidence >= 0.5 then 'medium (0.5-0.7)' else 'low (<0.5)' end as band,
              count(*) as total, count(*) filter (outcome = 'correct') as wins,
              round(count(*) filter (outcome = 'correct') * 100.0 / count(*), 1) as win_rate_pct
       from settled where outcome is not null and confidence is not null group by 1),
report as (
  select 1 as check_id, 'Price Source Audit' as name,
         case when u = 0 then 'PASS' when u / greatest(total, 1) < 0.8 then 'WARN' else 'FAIL' end as status,
         'platts=' || a || ', yfinance=' || b || ', unknown=' || u || ' (total with price=' || total || ')' as detail,
         u as affected_rows from k1
  union all select 2, 'Same-Day Price Check', {BY_COUNT}, n || ' rows with entry_price == exit_price', n
    from (select count(*) as n from settled where abs(exit_price - entry_price) < 0.0001)
  union all select 3, 'Shared Price Check', {BY_COUNT}, n || ' Brent rows sharing the Dubai entry price', n
    from (select count(*) as n from settled b join settled d on b.prediction_date = d.prediction_date
           and abs(b.entry_price - d.entry_price) < 0.0001
          where b.commodity like '%Brent%' and d.commodity like '%Dubai%')
  union all select 4, 'Confidence Clustering', case when n * 100.0 / total < 60 then 'PASS' when n * 100.0 / total < 80 then 'WARN' else 'FAIL' end,
         'Top confidence value ' || conf || ' appears in ' || n || '/' || total || ' rows (' || cast(round(n * 100.0 / total) as int) || '%)',
         case when n * 100.0 / total >= 60 then n else 0 end from k4
  union all select 5, 'Direction Bias', case when n * 100.0 / total < 70 then 'PASS' when n * 100.0 / total < 85 then 'WARN' else 'FAIL' end,
         '''' || direction || ''' is ' || cast(round(n * 100.0 / total) as int) || '% of all predictions', 0 from k5
  union all select 6, 'Win Rate by Confidence', 'PASS',
         string_agg(band || ': ' || cast(round(win_rate_pct) as int) || '% win rate (' || wins || '/' || total || ')', ' | ' order by band), 0 from k6
  union all select 7, 'P&L Sign Consistency', {BY_COUNT}, n || ' rows where P&L sign contradicts outcome label', n
    from (select count(*) as n from settled where (outcome = 'correct' and pnl_usd < 0) or (outcome = 'incorrect' and pnl_usd > 0)))"""


def settled_rows(condition: str, table: str) -> str:
    """Rows with both lookups attached, for rows that meet the condition."""
    return f"""
  select p.*, c.stop_pct, n1.price as t1, m1.price as t2, n2.price as x1, m2.price as x2
  from {table} p left join {CONFIG} using (commodity)
  left join near1 n1 on n1.id = p.id left join near2 m1 on m1.id = p.id
  left join next1 n2 on n2.id = p.id left join next2 m2 on m2.id = p.id
  where {condition}"""


def lookup(name: str, table: str, key: str, probe: str, low: int, high: int) -> str:
    return f"""{name} as (select q.id, arg_min(s.price, s.date) as price
      from predictions q join {CONFIG} using (commodity)
      join {table} s on s.{key} = c.{probe} and s.date between q.prediction_date + {low} and q.prediction_date + {high}
      group by 1)"""


LOOKUPS = ",\n".join([
    lookup("near1", "prices", "symbol", "price_symbol", 0, 6),
    lookup("near2", "market", "ticker", "ticker_yf", 0, 4),
    lookup("next1", "prices", "symbol", "price_symbol", 1, 7),
    lookup("next2", "market", "ticker", "ticker_yf", 1, 7)])

ORACLES = {
    "trade_decisions": sql("predictions", f"""with {DECISIONS.strip()}
        select id, case when signal <> 'HIGH' then 'HOLD' when ok and k <= 8 then 'TRADE' else 'WATCH' end as trade_status,
               case when signal <> 'HIGH' then 'Signal is ' || signal || ' — only HIGH signals qualify for fundamental trades'
                    when confidence < 0.55 then 'Confidence ' || cast(round(confidence * 100) as int) || '% below 55% threshold — monitor but do not act'
                    when {MOVE} < 1 then 'Expected move ' || expected_move || ' too small for a fundamental trade'
                    when event_type in {LOW_EVENTS} then 'Event type "' || event_type || '" is not a market-moving fundamental catalyst'
                    when k > 8 then 'Monthly trade budget reached (8 trades). Review existing positions.'
                    else 'HIGH-impact ' || {SIDE} || ' signal with ' || cast(round(confidence * 100) as int)
                         || '% confidence. Expected move: ' || expected_move || '.' end as reason,
               case when ok and k <= 8 then k end as trade_number,
               greatest(8 - before, 0) - case when ok and k <= 8 then 1 else 0 end as remaining_budget
        from r"""),
    "trade_decisions_simple": sql("predictions", """select id, case when signal = 'HIGH' and confidence >= 0.55
        then 'TRADE' else 'HOLD' end as trade_status from predictions"""),
    "trades_this_month": sql("predictions", """select count(distinct (prediction_date, commodity)) as trades_this_month
        from predictions where trade_status = 'TRADE' and prediction_date >= date '2001-07-01'"""),
    "trades_per_month": sql("predictions", """select strftime(prediction_date, '%Y-%m') as month,
        count(distinct (prediction_date, commodity)) as n_trades from predictions where trade_status = 'TRADE' group by 1"""),
    "canonical_direction": sql("predictions", f"""select direction, case {SGN} when 1 then 'bullish' when -1 then 'bearish'
        else 'neutral' end as canonical, count(*) as n from predictions group by all"""),
    "trade_sides": sql("predictions", f"""select id, case when signal = 'HIGH' and confidence * 100 >= 0.55 * 100 and {SGN} = 1 then 'Bullish'
        when signal = 'HIGH' and confidence * 100 >= 0.55 * 100 and {SGN} = -1 then 'Bearish' else 'Hold' end as trade_direction
        from predictions"""),
    "trade_results": sql("priced", f"""with base as (select *, {SGN} as side from priced), {RESULT.strip()}
        select id, {z('p')} as pnl_usd, {z('ret')} as return_pct, res as trade_outcome from result"""),
    "cut_loss_levels": sql("priced", "select id, cut_loss_price from priced"),
    "outcomes": sql("settled", f"select id, {z('actual_move')} as actual_move, outcome, {z('pnl_usd')} as pnl_usd from settled"),
    "monthly_cap": sql("priced", """
        select id, signal, confidence from priced where signal <> 'HIGH' or entry_price is null
        union all
        select id, signal, confidence from (select *, row_number() over (partition by strftime(prediction_date, '%Y-%m')
               order by confidence desc, prediction_date, id) as k from priced
               where signal = 'HIGH' and entry_price is not null) where k <= 8"""),
    "recompute_trades": sql("settled", f"""with {TRADED.strip()}
        select id, direction, trade_direction, {z('return_pct')} as return_pct, trade_outcome, {z('pnl_usd')} as pnl_usd from traded"""),
    "settle_predictions": sql("priced prices market", f"""with {LOOKUPS},
        start as (select *, case when id % 37 = 0 then 'correct' end as outcome0, {SGN} as sgn from priced),
        opened as ({settled_rows('p.prediction_date <= date ' + chr(39) + '2001-07-31' + chr(39) + ' and (outcome0 is null or entry_price is null or exit_price is null)', 'start')}),
        s1 as (select *, coalesce(entry_price, t1, t2) as e, coalesce(exit_price, x1, x2) as x,
                      case when entry_price is null and coalesce(t1, t2) is not null and sgn <> 0
                           then round(coalesce(t1, t2) * (1 - sgn * stop_pct / 100), 4) else cut_loss_price end as lvl from opened),
        s2 as (select *, coalesce(abs(x - e) < 0.0001, false) as same, e is not null and x is not null and abs(x - e) >= 0.0001 as done,
                      round((x - e) / e * 100, 2) as mv from s1)
        select id, e as entry_price,
               case when entry_price is null then case when t1 is not null then 'platts' when t2 is not null then 'yfinance' else entry_price_source end
                    else entry_price_source end as entry_price_source,
               case when not same then x end as exit_price,
               case when exit_price is null then case when x1 is not null then 'platts' when x2 is not null then 'yfinance' end end as exit_price_source,
               lvl as cut_loss_price, {z('case when done then mv end')} as actual_move,
               coalesce(outcome0, case when not done then null
                    when (sgn = 1 and x <= lvl) or (sgn = -1 and x >= lvl) then 'cut-loss'
                    when (sgn = 1 and mv > 0) or (sgn = -1 and mv < 0) or (sgn = 0 and abs(mv) < 1) then 'correct' else 'incorrect' end) as outcome,
               {z('case when done then round((x - e) * 1000 * sgn, 2) end')} as pnl_usd,
               case when same then 'same_day_price_error' when e is null or x is null then 'price_fetch_failed' else 'ok' end as data_quality
        from s2
        union all
        select id, entry_price, entry_price_source, exit_price, null, cut_loss_price, null, outcome0, null, null
        from start where not (prediction_date <= date '2001-07-31' and (outcome0 is null or entry_price is null or exit_price is null))"""),
    "repair_prices": sql("settled prices market", f"""with {LOOKUPS},
        fix1 as (
          select * replace (case when bad and ok then e when bad then null else entry_price end as entry_price,
                            case when bad and ok then x when bad then null else exit_price end as exit_price,
                            case when bad then st else data_quality end as data_quality),
                 case when bad then 'same_day' end as reason
          from (select *, coalesce(abs(exit_price - entry_price) < 0.0001, false) as bad, coalesce(t1, t2) as e, coalesce(x1, x2) as x,
                       coalesce(abs(coalesce(x1, x2) - coalesce(t1, t2)) >= 0.0001, false) as ok,
                       case when coalesce(t1, t2) is null or coalesce(x1, x2) is null then 'repair_fetch_failed'
                            when abs(coalesce(x1, x2) - coalesce(t1, t2)) < 0.0001 then 'repair_still_same_price' else 'repaired_ok' end as st
                from ({settled_rows('true', 'settled')}))),
        shared as (select distinct b.id from fix1 b join fix1 d on b.prediction_date = d.prediction_date
                     and abs(b.entry_price - d.entry_price) < 0.0001
                   where b.commodity like '%Brent%' and d.commodity like '%Dubai%' and coalesce(b.data_quality, '') <> 'repaired_ok'),
        fix2 as (
          select * replace (case when sh and ok then e when sh then null else entry_price end as entry_price,
                            case when sh and ok then x when sh then null else exit_price end as exit_price,
                            case when sh then st else data_quality end as data_quality,
                            case when sh then 'shared_dubai_price' else reason end as reason)
          from (select *, id in (select id from shared) as sh from fix1)),
        fixed as (select *, case when data_quality = 'repaired_ok' then round((exit_price - entry_price) / entry_price * 100, 2) end as mv from fix2)
        select id, reason as repair_reason, entry_price, exit_price, {z('mv')} as actual_move,
               case when mv is null then null when (sgn = 1 and mv > 0) or (sgn = -1 and mv < 0) or (sgn = 0 and abs(mv) < 1)
                    then 'correct' else 'incorrect' end as outcome,
               {z("case when data_quality = 'repaired_ok' then round((exit_price - entry_price) * 1000 * sgn, 2) end")} as pnl_usd,
               data_quality
        from fixed where reason is not null"""),
    "evaluation_rows": sql("settled", f"""with {EVALUATED.strip()}
        select id, {z('return_pct')} as return_pct, predicted_direction, actual_direction, is_correct, status from evaluated"""),
    "accuracy_summary": sql("settled", f"""with {EVALUATED.strip()}
        select count(*) filter (status = 'evaluated') as total_evaluated, count(*) filter (status = 'pending') as total_pending,
               round(count(*) filter (is_correct) * 100.0 / count(*) filter (status = 'evaluated'), 1) as accuracy_pct,
               round(count(*) filter (is_correct and signal = 'HIGH') * 100.0
                     / count(*) filter (status = 'evaluated' and signal = 'HIGH'), 1) as high_precision_pct,
               round(count(*) filter (abs(return_pct) > 3 and signal = 'HIGH') * 100.0
                     / count(*) filter (abs(return_pct) > 3), 1) as high_recall_pct from evaluated"""),
    "accuracy_breakdown": sql("settled", f"""with {EVALUATED.strip()}
        select case when grouping(commodity) = 0 then 'commodity' else 'signal' end as dimension,
               coalesce(commodity, signal) as value, count(*) filter (is_correct) as correct, count(*) as total,
               round(count(*) filter (is_correct) * 100.0 / count(*), 1) as accuracy_pct
        from evaluated where status = 'evaluated' group by grouping sets ((commodity), (signal))"""),
    "confusion_matrix": sql("settled", f"""with {EVALUATED.strip()}
        select a.l as actual, p.l as predicted, count(e.id) as n
        from (values ('rise'), ('flat'), ('fall')) a(l), (values ('rise'), ('flat'), ('fall')) p(l)
        left join evaluated e on e.actual_direction = a.l and e.predicted_direction = p.l
        group by 1, 2"""),
    "trading_metrics": sql("settled", f"""with {TRADED.strip()},
        t as (select *, {RESOLVED} as done, return_pct * case when trade_direction = 'Bearish' then -1 else 1 end as adj from traded)
        select count(*) as total_predictions, count(*) filter (trade_direction <> 'Hold') as total_trades,
               count(*) filter (done and trade_outcome = 'win') as wins,
               count(*) filter (done and trade_outcome in ('loss', 'cut-loss')) as losses,
               count(*) filter (done and trade_outcome = 'cut-loss') as cut_losses,
               count(*) filter (done and trade_outcome = 'neutral') as neutrals,
               count(*) filter (trade_direction = 'Hold') as holds, count(*) filter (trade_outcome = 'pending') as pending,
               round(count(*) filter (done and trade_outcome = 'win') * 100.0
                     / count(*) filter (done and trade_outcome <> 'neutral'), 1) as win_rate,
               round(sum(pnl_usd) filter (done), 2) as total_pnl, round(avg(pnl_usd) filter (done), 2) as avg_pnl_usd,
               round(avg(adj) filter (done and trade_outcome = 'win'), 4) as avg_win_pct,
               round(avg(adj) filter (done and trade_outcome in ('loss', 'cut-loss')), 4) as avg_loss_pct,
               round(max(pnl_usd) filter (done), 2) as best_trade_pnl, round(min(pnl_usd) filter (done), 2) as worst_trade_pnl,
               round(sum(pnl_usd) filter (done and trade_outcome = 'win')
                     / abs(sum(pnl_usd) filter (done and trade_outcome in ('loss', 'cut-loss'))), 2) as profit_factor,
               round(count(*) filter (done) * 1.0
                     / count(distinct strftime(prediction_date, '%Y-%m')) filter (done), 1) as avg_trades_per_month
        from t"""),
    "value_at_risk": sql("settled", f"""with {TRADED.strip()}
        select count(pnl_usd) as n, case when count(pnl_usd) >= 5 then round(quantile_cont(pnl_usd, 0.05), 2) end as value_at_risk_95
        from traded where {RESOLVED}"""),
    "risk_ratios": sql("settled", f"""with {TRADED.strip()},
        v1 as (select * from traded where {RESOLVED}),
        v2 as (select round(pnl_usd) as pnl_usd, round(entry_price, 3) as entry_price from settled
               where outcome in ('correct', 'incorrect', 'cut-loss'))
        {ratios('trades', 'v1', 'pnl_usd', 'entry_price', 'stddev_samp', 252)}
        union all {ratios('history', 'v2', 'pnl_usd', 'entry_price', 'stddev_samp', 104)}
        union all {ratios('report', 'settled', 'pnl_usd', 'entry_price', 'stddev_pop', 252)}"""),
    "payoff": sql("settled", """
        select count(*) filter (pnl_usd > 0) as n_win, count(*) filter (pnl_usd < 0) as n_loss,
               round(avg(pnl_usd) filter (pnl_usd > 0) / abs(avg(pnl_usd) filter (pnl_usd < 0)), 2) as win_loss_ratio,
               round((sum(pnl_usd) filter (pnl_usd > 0) + sum(pnl_usd) filter (pnl_usd < 0))
                     / count(*) filter (pnl_usd <> 0), 2) as expectancy
        from settled"""),
    "tracker_rows": sql("settled", f"""with {TRACKER.strip()}
        select id, final_outcome as outcome, final_status as trade_status, signal_type,
               case when final_status = 'HOLD' then 'HOLD' when sgn = 1 then 'BUY' when sgn = -1 then 'SELL' else 'HOLD' end as signal_label,
               round(confidence * 100, 1) as confidence_pct, cost_usd, {z('pnl_net')} as pnl_net, {z('return_net')} as return_net
        from tracker""").replace("cost_usd, (case", "case when exit_price is not null then cost_usd end as cost_usd, (case"),
    "tracker_summary": sql("settled", summary(
        "true", "count(*) filter (signal_type = 'LIVE') > 0 and count(*) filter (signal_type = 'BACKTEST') > 0")),
    "tracker_summary_live": sql("settled", summary("signal_type = 'LIVE'", "false")),
    "monthly_pnl": sql("settled", f"""with {TRACKER.strip()}
        select strftime(prediction_date, '%Y-%m') as month, round(sum(pnl_net), 2) as pnl_usd from closed group by 1"""),
    "history_kpis": sql("settled", """
        with h as (select *, round(pnl_usd) as pnl, outcome in ('correct', 'incorrect', 'cut-loss') as done,
                          outcome = 'correct' as good, coalesce(trade_status = 'TRADE', false) as tr, confidence * 100 >= 50 as sure
                   from settled)
        select count(*) filter (done) as n_resolved, count(*) filter (good) as n_correct,
               count(*) filter (done and not good) as n_incorrect,
               round(count(*) filter (good) * 100.0 / count(*) filter (done), 1) as accuracy_pct,
               count(*) filter (tr) as n_trades, sum(pnl) filter (tr) as pnl_usd, sum(pnl) filter (done) as pnl_all_usd,
               round(count(*) filter (good and tr) * 100.0 / count(*) filter (done and tr), 1) as trade_accuracy_pct,
               round(count(*) filter (good and sure) * 100.0 / count(*) filter (done and sure), 1) as accuracy_high_conf_pct,
               round(count(*) filter (good and not sure) * 100.0 / count(*) filter (done and not sure), 1) as accuracy_low_conf_pct,
               round(avg(actual_move) filter (good), 2) as avg_win_move_pct,
               round(avg(actual_move) filter (done and not good), 2) as avg_loss_move_pct,
               round(count(*) filter (outcome = 'cut-loss') * 100.0 / count(*) filter (done), 0) as cut_loss_rate_pct
        from h"""),
    "period_report": sql("settled", """
        select count(*) as total, count(*) filter (outcome = 'correct') as correct, count(*) filter (outcome = 'incorrect') as incorrect,
               count(*) filter (outcome is null) as pending,
               round(count(*) filter (outcome = 'correct') * 100.0 / count(outcome), 1) as overall_pct,
               round(count(*) filter (outcome = 'correct' and signal = 'HIGH') * 100.0 / count(outcome) filter (signal = 'HIGH'), 1) as high_pct,
               round(count(*) filter (outcome = 'correct' and signal = 'MEDIUM') * 100.0 / count(outcome) filter (signal = 'MEDIUM'), 1) as medium_pct,
               round(count(*) filter (outcome = 'correct' and signal = 'LOW') * 100.0 / count(outcome) filter (signal = 'LOW'), 1) as low_pct
        from settled where prediction_date >= date '1999-01-01'"""),
    "accuracy_by_commodity": sql("settled", """select commodity,
        round(count(*) filter (outcome = 'correct') * 100.0 / count(*), 1) as accuracy_pct
        from settled where outcome is not null group by 1"""),
    "rolling_accuracy": sql("settled", """
        select id, round(case when count(*) over w >= 3 then avg(case when outcome = 'correct' then 100.0 else 0.0 end) over w end, 6) as rolling_acc
        from settled where outcome is not null
        window w as (order by prediction_date, id rows between 9 preceding and current row)"""),
    "rolling_evaluation": sql("settled", f"""with {EVALUATED.strip()}
        select id, round(avg(case when is_correct then 100.0 else 0.0 end) over (order by prediction_date, id
               rows between 6 preceding and current row), 6) as rolling_acc
        from evaluated where status = 'evaluated'"""),
    "cumulative_pnl": sql("settled", f"""
        with daily as (select commodity, prediction_date, sum(pnl_usd) as s from settled where pnl_usd is not null group by all
                       union all select 'Combined', prediction_date, sum(pnl_usd) from settled where pnl_usd is not null group by all)
        select commodity, prediction_date, {z('round(sum(s) over (partition by commodity order by prediction_date rows unbounded preceding), 2)')} as cum_pnl
        from daily"""),
    "drawdown_curve": sql("settled", f"""with {TRACKER.strip()}
        select id, {z('round(equity, 2)')} as equity, {z('round(peak, 2)')} as peak, {z('round(equity - peak, 2)')} as drawdown from curve"""),
    "best_worst_calls": sql("settled", f"""
        (select 'best' as side, id, commodity, {z('pnl_usd')} as pnl_usd from settled where outcome is not null and pnl_usd is not null
         order by settled.pnl_usd desc, id limit 5)
        union all
        (select 'worst', id, commodity, {z('pnl_usd')} from settled where outcome is not null and pnl_usd is not null
         order by settled.pnl_usd, id limit 5)"""),
    "win_rates": sql("settled", """
        select commodity, signal, case sgn when 1 then 'bullish' when -1 then 'bearish' else 'neutral' end as direction,
               count(*) as n, count(*) filter (outcome = 'correct') as n_correct,
               case when count(*) >= 5 then round(count(*) filter (outcome = 'correct') * 1.0 / count(*), 3)
                    else case signal when 'HIGH' then 0.55 when 'MEDIUM' then 0.48 when 'LOW' then 0.4 else 0.45 end end as win_rate
        from settled where outcome in ('correct', 'incorrect') group by commodity, signal, sgn"""),
    "recent_volatility": sql("settled", f"with {SETUPS.strip()} select commodity, round(zone, 6) as zone_pct from zones"),
    "trade_setups": sql("settled", f"""with {SETUPS.strip()}
        select id, trade_direction, round(entry_price * (1 - zone_pct), 4) as entry_low, round(entry_price * (1 + zone_pct), 4) as entry_high,
               target_price, round(mv, 2) as target_move_pct, stop_loss, risk_usd, reward_usd, risk_reward, win_rate,
               expected_value, rating, is_best,
               'HIGH impact — ' || trade_direction || ' signal at ' || cast(round(scaled_conf) as int) || '% confidence. R:R '
               || cast(cast(round(risk_reward, 1) as decimal(12,1)) as varchar) || ':1'
               || case rating when 'cautious' then '. Proceed with reduced position size.'
                  else ', ' || cast(floor(win_rate * 100) as int) || '% historical win rate. '
                       || case rating when 'strong' then 'Strong fundamental setup.' else 'Acceptable setup.' end end as rationale
        from setups"""),
    "priced_setups": sql("settled prices market", f"""with {LOOKUPS},
        repriced as (select s.* exclude (entry_price, entry_price_source), round(coalesce(a.price, b.price), 4) as entry_price,
                            case when a.price is not null then 'platts' when b.price is not null then 'yfinance' end as entry_price_source
                     from settled s left join near1 a on a.id = s.id left join near2 b on b.id = s.id),
        {SETUPS.strip().replace("from settled p", "from repriced p")}
        select id, entry_price, entry_price_source, trade_direction, target_price, stop_loss, risk_usd, reward_usd, risk_reward, win_rate,
               expected_value, rating, is_best from setups"""),
    "setup_summary": sql("settled", f"""with {SETUPS.strip()}
        select count(*) as total, count(*) filter (is_best) as best_count, round(avg(risk_reward), 2) as avg_rr,
               round(avg(expected_value), 2) as avg_ev, round(count(*) filter (scaled_conf >= 70) * 100.0 / count(*), 0) as high_conf_pct,
               round(avg(win_rate) * 100, 1) as avg_win_rate from setups"""),
    "top_setups": sql("settled", f"""with {SETUPS.strip()}
        select id, expected_value, risk_reward from setups where is_best
        order by expected_value desc, prediction_date, commodity, id limit 20"""),
    "historical_setups": sql("settled", """
        with h as (select *, round(entry_price * (1 + sgn * case signal when 'HIGH' then 3.0 when 'MEDIUM' then 1.5 else 0.5 end / 100), 4) as target_price,
                          round(entry_price * (1 - sgn * case signal when 'HIGH' then 1.0 when 'MEDIUM' then 0.8 else 0.5 end / 100), 4) as stop_loss
                   from settled where prediction_date >= date '2001-08-01' - 2000 and entry_price is not null and sgn <> 0)
        select id, target_price, stop_loss, round(abs(entry_price - stop_loss) * 1000, 2) as risk_usd,
               round(abs(target_price - entry_price) * 1000, 2) as reward_usd,
               round(abs(target_price - entry_price) * 1000 / nullif(abs(entry_price - stop_loss) * 1000, 0), 2) as risk_reward,
               round(confidence * 100, 1) as confidence_pct from h"""),
    "quality_report": sql("settled", f"with {QUALITY.strip()} select * from report"),
    "quality_totals": sql("settled", f"""with {QUALITY.strip()}
        select count(*) filter (status = 'PASS') as n_pass, count(*) filter (status = 'WARN') as n_warn,
               count(*) filter (status = 'FAIL') as n_fail from report"""),
    "price_source_breakdown": sql("settled", """select coalesce(entry_price_source, 'unknown') as source, count(*) as n
        from settled where entry_price is not null group by 1"""),
    "win_rate_by_band": sql("settled", f"with {QUALITY.strip()} select * from k6"),
    "violation_sample": sql("settled", """
        with v as (select id from settled where abs(exit_price - entry_price) < 0.0001)
        select (select count(*) from v) as n_rows, count(*) as n_sample, string_agg(id, ',' order by id) as sample_ids
        from (select id from v order by id limit 20)"""),
    "history_table": sql("settled", """
        select id, prediction_date, commodity, signal,
               case sgn when 1 then '▲ Bullish' when -1 then '▼ Bearish' else '→ Neutral' end as direction_text,
               cast(cast(round(confidence * 100, 1) as decimal(8,1)) as varchar) || '%' as confidence_text,
               coalesce(case when actual_move > 0 then '▲ ' when actual_move < 0 then '▼ ' else '→ ' end
                        || case when actual_move >= 0 then '+' else '-' end
                        || cast(cast(abs(actual_move) as decimal(18,2)) as varchar) || '%', '—') as move_text,
               coalesce('$' || case when round(pnl_usd) >= 0 then '+' else '-' end || cast(abs(round(pnl_usd)) as bigint), '—') as pnl_text,
               coalesce('$' || cast(cast(round(entry_price, 3) as decimal(18,3)) as varchar), '—') as entry_text,
               coalesce('$' || cast(cast(round(exit_price, 3) as decimal(18,3)) as varchar), '—') as exit_text,
               case when outcome = 'correct' then '✓ Correct' when outcome = 'cut-loss' then '✗ Cut-Loss'
                    when outcome = 'incorrect' then '✗ Incorrect'
                    when prediction_date = date '2001-08-01' then '⏳ Today — awaiting close'
                    when isodow(prediction_date) = 6 then '📅 Saturday — no market'
                    when isodow(prediction_date) = 7 then '📅 Sunday — no market'
                    when data_quality = 'holiday' then '📅 Holiday — no market'
                    when data_quality = 'price_fetch_failed' then '⚠ Price unavailable' else '⏳ Pending' end as outcome_text,
               case when length(headline) > 90 then substring(headline, 1, 90) || '…' else headline end as headline_text
        from settled"""),
    "filtered_predictions": sql("settled", f"""with {EVALUATED.strip()}
        select 'pending' as filter, id from evaluated where outcome is null and prediction_date >= date '1996-01-01'
        union all select 'brent cut-loss', id from evaluated where commodity = 'Brent Dated (PCAAS00)' and outcome = 'cut-loss'
        union all select 'wrong high', id from evaluated where signal = 'HIGH' and is_correct = false
           and prediction_date <= date '1999-12-31'"""),
}
