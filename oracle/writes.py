"""SQL twins of newsignal.plans.writes."""

from __future__ import annotations

from oracle.news import EVENT, REGION, impact
from oracle.tables import COMMODITY, SYMBOL, any_of, sql, strip
from oracle.texts import EXTRACT, SECTION, cleaned
from newsignal import fixed_values as fv

VERSIONS = """versions as (
  select cast(l_shipdate as date) as date, case l_linenumber % 3 when 0 then 'Dubai' when 1 then 'Brent' else 'LNG' end as symbol,
         round(80 + l_extendedprice / 30000, 4) as price, l_orderkey * 10 + l_linenumber as version from lineitem),
last as (select date, symbol, price from versions
         qualify row_number() over (partition by date, symbol order by version desc, price desc) = 1)"""
UPSERTED = f"""with {VERSIONS}
  select * from last union all
  select date, symbol, price from prices p
  where not exists (select 1 from last l where l.date = p.date and l.symbol = p.symbol)"""
STORED = "(select cast(doc_id as varchar) from labels)"
KIND2 = "'first part' || chr(10) || html"

ORACLES = {
    "table_scan": "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 400000",
    "insert_if_absent": sql("articles", f"select id, headline, 1 as copy from articles where id not in {STORED}"),
    "insert_status": sql("articles", f"""
        select id, c as copy, case when c = 1 and id not in {STORED} then 'inserted' else 'duplicate' end as status
        from articles, (values (1), (2)) v(c)"""),
    "insert_predictions": sql("predictions", f"""
        select min(o_orderkey) as id, d as prediction_date, c as commodity
        from (select o_orderkey, cast(o_orderdate as date) as d, {COMMODITY} as c from orders) o
        where not exists (select 1 from predictions p where p.trade_status = 'TRADE' and p.prediction_date = o.d and p.commodity = o.c)
        group by 2, 3"""),
    "replace_upsert": sql("prices", UPSERTED),
    "merge_nonempty": sql("articles", """
        with fixes as (select cast(doc_id as varchar) as id, max(quality) as q, max(toxic) as t from labels group by 1),
        m as (select a.id, a.headline as h0, md5(a.body_text) as b0, a.source, f.id is not null as hit,
                     case when q = 1 then 'Revised ' || a.id else a.headline end as h1,
                     case when t = 1 then 'new body' else md5(a.body_text) end as b1
              from articles a left join fixes f on f.id = a.id)
        select id, h1 as headline, b1 as body_text, case when h0 <> h1 or b0 <> b1 then 'desk' else source end as source,
               h0 <> h1 or b0 <> b1 as changed from m"""),
    "fill_missing": sql("priced", """
        select p.id, coalesce(p.entry_price, s.price) as entry_price, coalesce(p.exit_price, s.price + 1) as exit_price
        from priced p left join prices s on s.date = p.prediction_date and s.symbol = p.symbol"""),
    "drop_blank_keys": f"select o_orderkey, {SYMBOL} as symbol from orders where o_orderstatus <> 'P'",
    "conform_predictions": sql("predictions", """
        select id, prediction_date, null::varchar as ticker, 'USD' as price_currency, trade_status,
               null::double as entry_price, null::int as trade_number, symbol from predictions"""),
    "append_table": sql("articles", "select id, headline, 1 as copy from articles"),
    "upsert_table": sql("prices", UPSERTED),
    "json_sink": sql("reports", f"""with {EXTRACT}
        select case when kind = 0 then 'custom' else report_type end as report_type, count(*) as n_reports,
               sum((select count(*) from bench b where b.id = k.id))::bigint as n_benchmarks,
               sum(case when kind = 2 then 0 else 2 end)::bigint as n_signals from kinds k group by 1"""),
    "report_directory": sql("reports", f"""with {SECTION}
        select r.published_at as date, symbol, price from firsts f join reports r on r.id = f.id"""),
    "envelopes": sql("", f"""with {cleaned(f"select page_id as id, case when page_id % 3 = 2 then {strip(KIND2)} else {strip('html')} end as raw from pages").strip()}
        select cast(page_id as varchar) as id, 'Page ' || page_id as headline,
               case when page_id % 3 = 2 then '' else '2024-02-03T04:05:06' end as published,
               case when page_id % 3 = 2 then '' else url end as url,
               case when length(raw) > 100 then clean_text else '' end as body_text
        from pages join cleaned on cleaned.id = page_id join raw on raw.id = page_id"""),
    "landing_quarantine": """
        select problem, count(*) as n from (select case page_id % 10 when 3 then 'broken' when 5 then 'empty' when 7 then 'no object' when 9 then 'no id' end as problem from pages)
        where problem is not null group by 1""",
    "search_items": sql("landed", f"""
        select lower({strip('id')}) as id, case when length(body_text) > 1000 then 'Long' else
                 {strip("'OPEC production [' || case when length(body_text) > 500 then 'application/pdf' else 'package' end || '] ' || coalesce(strftime(published_at, '%Y-%m-%d'), '')")} end as headline,
               coalesce(strftime(published_at, '%Y-%m-%d') || 'T10:00:00', '') as published, 'u/' || id as url, 'OPEC production' as report_name
        from landed where regexp_full_match(lower({strip('id')}), '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}')
          and (published_at is null or published_at between date '1995-06-01' and date '1998-06-01')"""),
    "union_sources": sql("articles", f"select id, case when id in {STORED} then 'stored' else 'feed' end as origin from articles"),
    "kept_trades": sql("priced", """
        select id, signal, trade_status from priced where trade_status = 'TRADE'
        union all
        select id, signal, trade_status from (
          select *, row_number() over (partition by strftime(prediction_date, '%Y-%m') order by confidence desc, prediction_date, id) as k
          from priced where coalesce(trade_status, '') <> 'TRADE' and signal = 'HIGH' and entry_price is not null) where k <= 8"""),
    "neighbour_prices": sql("priced", """
        select b.id, count(*) as n_matches from priced b join priced d on b.prediction_date = d.prediction_date
         and abs(b.entry_price - d.entry_price) < 0.05
        where b.commodity like '%Brent%' and d.commodity like '%Dubai%' group by 1"""),
    "stream_ingest": "select cast(doc_id as varchar) as id, source from documents",
    "stream_entities": f"""with a as (select cast(doc_id as varchar) as article_id, lower(text) as t from documents),
        e as (select *, {EVENT} as event_type from a)
        select article_id, event_type, {REGION} as region, cast({any_of('t', fv.SUPPLY_IMPACT_WORDS)} as int) as supply_impact,
               {impact('event_type')} as impact_score from e""",
    "stream_daily_counts": """select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2""",
}
ORACLES["landing_articles"] = f"select * from ({ORACLES['envelopes']}) where cast(id as bigint) % 10 not in (3, 5, 7, 9)"
