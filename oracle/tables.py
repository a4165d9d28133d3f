"""Common table expressions that derive the news-desk tables in SQL."""

from __future__ import annotations

EVENTS = [
    "opec_decision", "sanctions", "force_majeure", "pipeline_outage", "supply_disruption",
    "geopolitical", "demand_shock", "lng_outage", "inventory_data", "production_change",
    "refinery_maintenance", "shipping_disruption", "demand_change", "analyst_comment",
    "routine_report", "price_movement", "general_market", "other",
]
EVENT_LIST = "[" + ", ".join(f"'{e}'" for e in EVENTS) + "]"

SYMBOL = ("case o_orderpriority when '2-HIGH' then 'Brent' when '3-MEDIUM' then 'WTI' "
          "when '4-NOT SPECIFIED' then 'Oman' else 'Dubai' end")
COMMODITY = ("case o_orderpriority when '1-URGENT' then 'Dubai Crude (PCAAT00)' "
             "when '2-HIGH' then 'Brent Dated (PCAAS00)' when '3-MEDIUM' then 'WTI (PCACG00)' "
             "when '4-NOT SPECIFIED' then 'LNG / Nat Gas (JKM)' else 'Dubai Crude' end")

CTES = {
    "prices": ([], f"""
        select date, symbol, price,
               (price / lag(price) over (partition by symbol order by date) - 1) * 100 as pct_change_24h
        from (select cast(o_orderdate as date) as date, {SYMBOL} as symbol,
                     round(80 + avg(o_totalprice) / 100000, 4) as price
              from orders group by 1, 2)"""),
    "market": ([], """
        select cast(l_shipdate as date) as date,
               case l_linenumber % 3 when 0 then 'CL=F' when 1 then 'BZ=F' else 'NG=F' end as ticker,
               round(80 + avg(l_extendedprice) / 30000, 4) as price
        from lineitem group by 1, 2"""),
    "articles": ([], """
        select cast(doc_id as varchar) as id, doc_id as seq, split_part(text, chr(10), 1) as headline,
               text as body_text, source, source as report_name,
               cast(date '1995-01-01' + cast((doc_id * 7) % 2400 as int) as date) as published_at,
               'https://desk.example/' || doc_id as url
        from documents"""),
    "feed": ([], """
        select cast(doc_id as varchar) as id, doc_id as seq, split_part(text, chr(10), 1) as headline,
               text as body_text, source, source as report_name,
               cast(date '1995-01-01' + cast((doc_id * 7) % 60 as int) as date) as published_at,
               'https://desk.example/' || doc_id as url
        from documents"""),
    "predictions": ([], f"""
        select o_orderkey as id, prediction_date, commodity, symbol,
               case o_orderkey % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as signal,
               case when o_orderstatus = 'O' then case when o_orderkey % 2 = 0 then 'bullish' else 'rise' end
                    when o_orderstatus = 'F' then case when o_orderkey % 2 = 0 then 'bearish' else 'fall' end
                    else 'neutral' end as direction,
               cast((o_orderkey * 37) % 100 as double) / 100 as confidence,
               case o_custkey % 4 when 0 then '<1%' when 1 then '1-3%' else '>3%' end as expected_move,
               ({EVENT_LIST})[cast(o_custkey % 18 as int) + 1] as event_type,
               'Desk note ' || o_orderkey || ' on ' || commodity
                   || case when o_orderkey % 5 = 0 then repeat(' update', 12) else '' end as headline,
               case when o_orderkey % 7 = 0 then null when o_orderkey % 7 < 3 then 'TRADE'
                    when o_orderkey % 7 = 3 then 'WATCH' else 'HOLD' end as trade_status
        from (select *, cast(o_orderdate as date) as prediction_date, {COMMODITY} as commodity,
                     {SYMBOL} as symbol,
                     row_number() over (partition by cast(o_orderdate as date), o_orderpriority
                                        order by o_orderkey desc) as rn from orders)
        where rn = 1"""),
    "priced": (["prices", "predictions"], """
        select p.* exclude (x), case when id % 13 = 0 then null when id % 17 = 0 then entry_price else x end as exit_price,
               case when entry_price is null or id % 23 = 0 then null
                    when id % 4 = 0 then 'yfinance' else 'platts' end as entry_price_source,
               case when direction in ('bullish', 'rise')
                    then round(entry_price * (1 - case when commodity like 'LNG%' then 0.02 else 0.015 end), 4)
                    when direction in ('bearish', 'fall')
                    then round(entry_price * (1 + case when commodity like 'LNG%' then 0.02 else 0.015 end), 4)
               end as cut_loss_price
        from (select p.*, n.x,
                     case when id % 11 = 0 then null
                          when id % 19 = 0 and p.symbol = 'Brent' then coalesce(d.price, n.price)
                          else n.price end as entry_price
              from predictions p
              left join (select symbol, date, price,
                                case when lead(date) over w - date <= 7 then lead(price) over w end as x
                         from prices window w as (partition by symbol order by date)) n
                     on n.symbol = p.symbol and n.date = p.prediction_date
              left join prices d on d.symbol = 'Dubai' and d.date = p.prediction_date) p"""),
    "settled": (["priced"], """
        select *, case when entry_price > 0 and ((sgn = 1 and exit_price <= cut_loss_price)
                              or (sgn = -1 and exit_price >= cut_loss_price)) then 'cut-loss'
                       when (sgn = 1 and actual_move > 0) or (sgn = -1 and actual_move < 0)
                            or (sgn = 0 and abs(actual_move) < 1.0) then 'correct'
                       when actual_move is not null then 'incorrect' end as outcome,
               round((exit_price - entry_price) * 1000 * sgn, 2) as pnl_usd,
               cast(id % 10 as int) as impact_score,
               case when id % 29 = 0 then 'price_fetch_failed' when id % 31 = 0 then 'holiday'
                    else 'ok' end as data_quality
        from (select *, case when direction in ('bullish', 'rise') then 1
                             when direction in ('bearish', 'fall') then -1 else 0 end as sgn,
                     round((exit_price - entry_price) / entry_price * 100, 2) as actual_move
              from priced)"""),
    "scores": ([], """
        select article_id, model, class, p / sum(p) over (partition by article_id, model) as p
        from (select cast(doc_id as varchar) as article_id, m.model, c.class,
                     cast((doc_id * 13 + m.n * 29 + c.n * 41) % 97 + 1 as double) as p
              from documents,
                   (values (0, 'general'), (1, 'dubai'), (2, 'embedding')) m(n, model),
                   (values (0, 'HIGH'), (1, 'MEDIUM'), (2, 'LOW')) c(n, class))"""),
    "scored": (["feed"], """
        select id, seq, headline, published_at as day, high_prob,
               (1 - high_prob) * 0.6 as medium_prob, 1 - high_prob - (1 - high_prob) * 0.6 as low_prob,
               direction_vote
        from (select *, cast((seq * 31) % 89 as double) / 100 as high_prob,
                     case when seq % 5 <> 0 then
                          (['bullish', 'bearish', 'neutral'])[cast((seq * 11) % 3 as int) + 1] end
                     as direction_vote from feed)"""),
    "landed": ([], r"""
        select case when doc_id % 7 = 0 then h when doc_id % 7 = 1 then ' ' || upper(u) || chr(10) else u end as id,
               split_part(text, chr(10), 1) as headline,
               case when n_chars % 3 = 0 then '  ' || chr(10) else text end as body_text,
               case when doc_id % 11 <> 0 then cast(date '1995-01-01' + cast((doc_id * 7) % 2400 as int) as date) end as published_at
        from (select *, md5(cast(doc_id as varchar)) as h,
                     regexp_replace(md5(cast(doc_id as varchar)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') as u
              from documents)"""),
    "lexicon": ([], r"""
        select word, cast((length(word) * 37) % 21 - 10 as double) / 10 as polarity
        from (select distinct unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}')) as word from benchmark)"""),
    "reports": (["prices"], """
        select strftime(date, '%Y%m%d') as id, date as published_at,
               case day(date) % 3 when 0 then 'Crude Oil Marketwire ' when 1 then 'Arab Gulf Marketscan '
                    else 'Desk report ' end || strftime(date, '%Y-%m-%d') as report_name,
               concat_ws(chr(10), 'Daily oil report', 'Dubai (May) PCAAT00 1.0 2.0', 'Key benchmarks',
                         'Bid Ask Mid Change', 'Dubai swap DBDAA00 11.0 0.5',
                         'Oman spread vs Dubai PCABX00 0.75 0.1',
                         max(case symbol when 'Dubai' then concat_ws(' ', 'Dubai (May) PCAAT00', lo || '-' || hi, p, c) end),
                         max(case symbol when 'Brent' then concat_ws(' ', 'Brent (Dated) PCAAS00', p, c) end),
                         max(case symbol when 'WTI' then concat_ws(' ', 'WTI FOB USGC PCACG00', lo || '–' || hi, p) end),
                         max(case symbol when 'Oman' then concat_ws(' ', 'Oman (May) PCABS00', lo, hi, p, c) end),
                         'Dubai (Jun) PCAAU00 55.0 0.1', 'Market commentary',
                         'Supply of crude stays tight as refiners return from maintenance.',
                         'Brent (Dated) PCAAS00 3.0 4.0') as body_text
        from (select date, symbol, cast(cast(price as decimal(12,4)) as varchar) as p,
                     cast(cast(price - 0.02 as decimal(12,4)) as varchar) as lo,
                     cast(cast(price + 0.02 as decimal(12,4)) as varchar) as hi,
                     cast(cast(price - lag(price) over (partition by symbol order by date)
                               as decimal(12,4)) as varchar) as c
              from prices)
        group by date"""),
}



def needed(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for dependency in CTES[name][0]:
            visit(dependency)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


def sql(names: str, body: str) -> str:
    """A statement over the named derived tables; ``body`` may start with further CTEs after 'with'."""
    tables = [f"{name} as ({CTES[name][1]})" for name in needed(names.split())]
    text = body.strip()
    if text.lower().startswith("with "):
        own = text[5:].strip()
        return "with " + ",\n".join([*tables, own])
    return ("with " + ",\n".join(tables) + "\n" + text) if tables else text


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def hits(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"cast(contains({column}, {quoted(w)}) as int)" for w in words) + ")"


def first_rule(column: str, rules: list, default: str) -> str:
    arms = " ".join(f"when {any_of(column, words)} then {quoted(value)}" for value, words in rules)
    return f"case {arms} else {quoted(default)} end"


def lookup(column: str, mapping: dict, default) -> str:
    arms = " ".join(f"when {quoted(k)} then {quoted(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"case {column} {arms} else {default} end"


def z(expression: str) -> str:
    """Keep a rounded zero positive."""
    return f"(case when ({expression}) = 0 then 0.0 else ({expression}) end)"


SPACES = r"[\s\p{Z}\x{85}\x0B\x1C-\x1F]"


def strip(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACES}+|{SPACES}+$', '', 'g')"
