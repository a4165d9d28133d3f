"""SQL twins of newsignal.plans.news."""

from __future__ import annotations

from newsignal import fixed_values as fv
from oracle.series import DESK, DESK_ROUTING, ENERGY_ROUTING
from oracle.tables import any_of, first_rule, hits, lookup, quoted, sql, strip, z

DESK_KEYWORDS = [("Dubai Crude (PCAAT00)", ["tion", "eau"]), ("Brent Dated (PCAAS00)", ["ing", "sch"]),
                 ("WTI (PCACG00)", ["nter", "ther"]), ("LNG / Nat Gas (JKM)", ["lng", "jkm"])]

QUICK_EVENT = f"""case when contains(t, 'opec') then 'opec_decision' when contains(t, 'sanction') then 'sanctions'
  when contains(t, 'refinery') and (contains(t, 'outage') or contains(t, 'maintenance')) then 'refinery_maintenance'
  when {any_of('t', fv.QUICK_PIPELINE)} then 'pipeline_outage'
  when {any_of('t', fv.QUICK_SHIPPING)} then 'shipping_disruption'
  when {any_of('t', fv.QUICK_DEMAND)} then 'demand_change' else 'other' end"""
QUICK_REGION = first_rule("t", fv.QUICK_REGIONS, "global")
QUICK_SENTIMENT = (f"case when {any_of('t', fv.QUICK_TIGHT)} then 0.35::double "
                   f"when {any_of('t', fv.QUICK_LOOSE)} then -0.25::double else 0.0::double end")
SUPPLY = f"{QUICK_EVENT} in ('sanctions', 'pipeline_outage')"
EVENT = first_rule("t", fv.EVENT_RULES, "other")
REGION = first_rule("t", fv.REGION_RULES, "global")


def impact(column: str) -> str:
    return lookup(column, fv.IMPACT_SCORES, 2)


MAGNITUDE = "case when {p} >= 0.30 then 'HIGH' when {p} >= 0.15 then 'MEDIUM' else 'LOW' end"
BUCKET = "case {s} when 'HIGH' then '>3%' when 'MEDIUM' then '1-3%' else '<1%' end"
LIVE = ("round(least(greatest(case when {p} < 0.40 then 35 + {p} / 0.40 * 14 when {p} < 0.60 then 50 + ({p} - 0.40) / 0.20 * 20 "
        "else 70 + ({p} - 0.60) / 0.40 * 25 end, 35.0), 95.0), 1)")
HISTORY = ("least(greatest({p} * 4.5 * (case {s} when 'HIGH' then 1.4 when 'MEDIUM' then 1.2 else 1.0 end)::double "
           "* (case {d} when 'neutral' then 0.6 else 1.0 end)::double * (0.7 + least({n} / 15.0, 1.0) * 0.3)::double, 35.0), 95.0)")

STRENGTH = ("case when direction <> 'neutral' and scaled_conf >= 70 then 'Strong' "
            "when direction <> 'neutral' and scaled_conf >= 50 then 'Moderate' else 'Weak' end")
BIAS = """case when direction = 'bullish' and scaled_conf >= 50 then 'Bullish — Consider Long'
  when direction = 'bullish' then 'Bullish lean — Low confidence, monitor only'
  when direction = 'bearish' and scaled_conf >= 50 then 'Bearish — Consider Short'
  when direction = 'bearish' then 'Bearish lean — Low confidence, monitor only' else 'Neutral — Hold' end"""


def signal_tables(keywords: list, days: str) -> str:
    """Pools of articles per day and commodity, in the straightforward way."""
    values = ", ".join(f"({n}, {quoted(name)})" for n, (name, _) in enumerate(keywords))
    match = " or ".join(f"(c.n = {n} and {any_of('t', words)})" for n, (_, words) in enumerate(keywords))
    return f"""
arts as (select *, lower(coalesce(headline, '')) as t from scored),
flags as (select *, {hits('t', fv.BULL_WORDS)} as bull, {hits('t', fv.BEAR_WORDS)} as bear,
                 cast({SUPPLY} as int) as supply from arts),
comms as (select * from (values {values}) c(n, commodity)),
days as ({days}),
related as (select c.commodity, a.* from comms c join flags a on ({match})),
n_rel as (select commodity, day, count(*) as n_relevant from related group by all),
grid as (select d.day, c.commodity, coalesce(r.n_relevant, 0) as n_relevant
         from days d, comms c left join n_rel r on r.day = d.day and r.commodity = c.commodity),
pool as (select g.day, g.commodity, r.id, r.seq, r.headline, r.high_prob, r.direction_vote, r.bull, r.bear, r.supply
         from grid g join related r on r.day = g.day and r.commodity = g.commodity where g.n_relevant > 0
         union all
         select g.day, g.commodity, f.id, f.seq, f.headline, f.high_prob, f.direction_vote, f.bull, f.bear, f.supply
         from grid g join flags f on f.day = g.day where g.n_relevant = 0),
ranked as (select *, row_number() over (partition by day, commodity order by high_prob desc, seq) as k from pool),
sums as (select day, commodity, avg(high_prob) as mean_prob, avg(high_prob) filter (k <= 5) as top_prob,
                sum(bull) + 2 * sum(supply) as bull, sum(bear) as bear,
                max(headline) filter (k = 1) as lead_headline, arg_min(headline, seq) as first_headline
         from ranked group by 1, 2),
votes as (select day, commodity, direction_vote as side from (
            select day, commodity, direction_vote, row_number() over (partition by day, commodity
                     order by count(*) desc, min(seq)) as k
            from pool where direction_vote is not null group by 1, 2, 3) where k = 1),
totals as (select day, count(*) as n_articles from arts group by 1),
joined as (select g.day, g.commodity, g.n_relevant, coalesce(t.n_articles, 0) as n_articles, s.* exclude (day, commodity), v.side
           from grid g left join sums s on s.day = g.day and s.commodity = g.commodity
           left join votes v on v.day = g.day and v.commodity = g.commodity
           left join totals t on t.day = g.day)"""


def live(keywords: list, days: str) -> str:
    return f"""with {signal_tables(keywords, days).strip()},
l1 as (select *, case when mean_prob is null then 'LOW' else {MAGNITUDE.format(p='top_prob')} end as signal,
              case when mean_prob is null then 'neutral' when side is not null then side
                   when bull > bear * 1.3 then 'bullish' when bear > bull * 1.3 then 'bearish' else 'neutral' end as direction,
              case when mean_prob is null then 35.0 else {LIVE.format(p='top_prob')} end as scaled_conf,
              lower(coalesce(lead_headline, '')) as t from joined),
l2 as (select *, case when mean_prob is null then 'other' else {EVENT} end as event_type from l1),
live as (
  select day, commodity, signal, direction, case when mean_prob is null then 'Weak' else {STRENGTH} end as strength,
         case when mean_prob is null then 'Hold' else {BIAS} end as bias, scaled_conf, {BUCKET.format(s='signal')} as expected_move,
         n_relevant, n_articles, top_prob as high_prob,
         case when mean_prob is null then '' when n_relevant > 0 then lead_headline else first_headline end as top_headline,
         event_type, {impact('event_type')} as impact_score from l2)"""


LIVE_DESK = live(DESK_KEYWORDS, "select distinct date as day from prices")
HISTORY_DESK = f"""with {signal_tables(DESK_KEYWORDS, 'select distinct day from arts').strip()},
h1 as (select *, {MAGNITUDE.format(p='mean_prob')} as signal, coalesce(side, 'neutral') as direction,
              lower(coalesce(lead_headline, '')) as t from joined where n_articles >= 5),
h2 as (select *, {EVENT} as event_type from h1),
history as (
  select day, commodity, signal, direction, mean_prob as high_prob,
         {HISTORY.format(p='mean_prob', s='signal', d='direction', n='n_relevant')} as scaled_conf,
         {BUCKET.format(s='signal')} as expected_move, n_relevant, n_articles, lead_headline as top_headline,
         event_type, {impact('event_type')} as impact_score from h2)"""

WEIGHTS = f"""
weights as (
  select model, arg_max(weight, commodity) as weight from (
    select {lookup('commodity', {row[0]: row[9] for row in fv.COMMODITIES}, 'null')} as model, commodity,
           round(count(*) filter (outcome = 'correct') * 1.0 / count(*), 3) as weight
    from settled where outcome in ('correct', 'incorrect') group by commodity having count(*) >= 10) group by 1)"""
ENSEMBLE = f"""{WEIGHTS.strip()},
mixed as (
  select article_id, class, sum(w * p) / sum(w) as p
  from (select s.*, case when s.model = 'embedding' then 1.5 else coalesce(weight, 1.0) end as w
        from scores s left join weights using (model)) group by 1, 2),
ensemble as (
  select article_id, max(p) filter (class = 'HIGH') as high_prob, max(p) filter (class = 'MEDIUM') as medium_prob,
         max(p) filter (class = 'LOW') as low_prob, max(p) as score,
         (arg_max(class, (p, -ascii(class) * 1000 - ascii(substring(class, 2, 1))))) as label
  from mixed group by 1)"""

TOKENS = r"unnest(regexp_extract_all(strip_accents(lower({c})), '[\p{{L}}\p{{N}}_]{{2,}}'))"


def sentiment(table: str, column: str) -> str:
    return f"""(select a.id, coalesce({z('round(m, 4)')}, 0.0) as sentiment from {table} a left join (
      select id, avg(polarity) as m from (select id, {TOKENS.format(c=column)} as word from {table}) join lexicon using (word)
      group by 1) s on s.id = a.id)"""


ORACLES = {
    "feed_health": sql("feed", """
        select count(*) filter (published_at = date '1995-03-01') as n_today, max(published_at) as latest,
               case when count(*) filter (published_at = date '1995-03-01') = 0 then 'CRITICAL'
                    when count(*) filter (published_at = date '1995-03-01') < 5 then 'ERROR'
                    when count(*) filter (published_at = date '1995-03-01') < 20 then 'WARNING' else 'OK' end as status
        from feed"""),
    "dates_needing_signals": sql("feed predictions", """
        select published_at as day, count(*) as n_articles from feed
        where published_at between date '1995-01-05' and date '1995-02-20'
          and published_at not in (select prediction_date from predictions where trade_status = 'TRADE')
        group by 1 having count(*) >= 5"""),
    "recent_article_count": sql("feed", """
        with c as (select published_at as day, count(*) as n from feed
                   where published_at between date '1995-03-04' - 7 and date '1995-03-04' group by 1),
        e as (select max(day) as day from c where n >= 5)
        select day, coalesce((select n from c where c.day = e.day), (select n from c where c.day = date '1995-03-03'), 0) as n_articles from e"""),
    "fallback_articles": sql("feed", """
        with r as (select *, length(coalesce(body_text, '')) > 500 as rich from feed),
        d as (select coalesce(
                (select max(published_at) from (select published_at from r where rich and published_at between date '1995-03-04' - 13 and date '1995-03-04' group by 1 having count(*) >= 2)),
                null) as rich_day,
                (select max(published_at) from (select published_at from r where published_at between date '1995-03-04' - 7 and date '1995-03-04' group by 1 having count(*) >= 5)) as any_day)
        select id, day, by_body from (
          select r.id, r.headline, r.published_at as day, rich_day is not null as by_body,
                 row_number() over (order by case when rich_day is not null then length(body_text) end desc, id) as k
          from r, d where published_at = coalesce(rich_day, any_day) and (rich_day is null or rich))
        where k <= case when by_body then 30 else 50 end and trim(headline) <> ''"""),
    "ensemble_weights": sql("settled", f"with {WEIGHTS.strip()} select * from weights"),
    "ensemble_scores": sql("settled scores", f"""with {ENSEMBLE}
        select article_id, label, round(score, 6) as score, round(high_prob, 6) as high_prob,
               round(medium_prob, 6) as medium_prob, round(low_prob, 6) as low_prob from ensemble"""),
    "batch_scoring": sql("settled scores feed", f"""with {ENSEMBLE},
        f as (select *, lower(coalesce(headline, '')) as t from feed
              where published_at in (select published_at from feed group by 1 having count(*) >= 5)),
        q as (select *, {QUICK_EVENT} as event_type, {QUICK_REGION} as region, {QUICK_SENTIMENT} as sentiment from f)
        select q.id, e.label, round(e.score, 6) as score, event_type, region, sentiment,
               event_type in ('sanctions', 'pipeline_outage') as supply_impact,
               'This article describes a ' || replace(event_type, '_', ' ') || ' event in ' || region
               || ', which historically triggers ' || case when sentiment >= 0 then 'bullish' else 'bearish' end
               || ' price reactions in energy markets. The ML model assigned ' || label || ' impact ('
               || cast(round(score * 100) as int) || '% confidence) based on similar '
               || case when event_type in ('sanctions', 'pipeline_outage') then 'supply disruption' else 'market development' end
               || ' patterns in the training data.' as explanation
        from q join ensemble e on e.article_id = q.id"""),
    "direction_votes": sql("scored", """
        select day, direction_vote, n_votes from (
          select day, direction_vote, count(*) as n_votes,
                 row_number() over (partition by day order by count(*) desc, min(seq)) as k
          from scored where direction_vote is not null group by 1, 2) where k = 1"""),
    "live_signals": sql("scored prices", f"{LIVE_DESK} select * replace (round(high_prob, 6) as high_prob) from live"),
    "live_signals_energy": sql("scored", f"""{live(fv.SIGNAL_KEYWORDS, 'select distinct day from arts')}
        select day, commodity, signal, direction, scaled_conf, n_relevant, event_type, impact_score from live"""),
    "signal_view": sql("scored prices", f"""{LIVE_DESK}
        select day, commodity, case when scaled_conf >= 70 then 'High' when scaled_conf >= 50 then 'Medium' else 'Low — monitor only' end as confidence_band,
               case when n_relevant >= 15 then 'good' when n_relevant >= 5 then 'thin' else 'unreliable' end as article_band,
               scaled_conf < 50 as muted,
               case when direction = 'neutral' then 'Neutral' else upper(direction[1]) || direction[2:] || case when scaled_conf < 50 then ' Lean' else '' end end as direction_label,
               case direction when 'bullish' then '+' || expected_move when 'bearish' then '-' || expected_move else '<1%' end as move_label,
               case when signal = 'HIGH' and direction <> 'neutral' and scaled_conf >= 50
                    then 'price moves >' || case when commodity like 'LNG%' then '2.0' else '1.5' end || '% against position' end as invalidation
        from live"""),
    "history_signals": sql("scored", f"""{HISTORY_DESK}
        select * replace (round(high_prob, 6) as high_prob, round(scaled_conf, 4) as scaled_conf) from history"""),
    "assembled_predictions": sql("scored predictions prices market", f"""{HISTORY_DESK},
        conf as (select h.*, case when high_prob <> 0 then high_prob else scaled_conf / 100 end as confidence from history h where n_articles >= 5),
        good as (select *, signal = 'HIGH' and confidence >= 0.55 and event_type not in ('routine_report', 'analyst_comment', 'price_movement', 'general_market')
                        and expected_move <> '<1%' as ok, strftime(day, '%Y-%m') as m from conf),
        taken as (select strftime(prediction_date, '%Y-%m') as m, count(distinct (prediction_date, commodity)) as n
                  from predictions where trade_status = 'TRADE' group by 1),
        num as (select g.*, coalesce(t.n, 0) as n_taken, count(*) filter (ok) over (partition by m order by day, commodity rows unbounded preceding) as k
                from good g left join taken t using (m)),
        priced as (select n.*, c.ticker, c.ticker_yf, c.unit, c.stop_pct,
                     (select arg_min(p.price, p.date) from prices p where p.symbol = c.price_symbol and p.date between n.day and n.day + 6) as t1,
                     (select arg_min(p.price, p.date) from market p where p.ticker = c.ticker_yf and p.date between n.day and n.day + 4) as t2
                   from num n join (values {', '.join(f"({quoted(r[0])}, {quoted(r[2])}, {quoted(r[4])}, {quoted(r[5])}, {quoted(r[7])}, {r[8]})" for r in fv.COMMODITIES[:4])})
                     c(commodity, ticker, ticker_yf, unit, price_symbol, stop_pct) using (commodity))
        select day as prediction_date, commodity, ticker, ticker_yf, signal, direction, round(confidence, 6) as confidence, expected_move,
               coalesce(t1, t2) as entry_price, case when t1 is not null then 'platts' when t2 is not null then 'yfinance' end as entry_price_source,
               'USD' as price_currency, unit as price_unit, 'ok' as data_quality,
               case when signal <> 'HIGH' then 'HOLD' when ok and k <= greatest(8 - n_taken, 0) then 'TRADE' else 'WATCH' end as trade_status,
               case when ok and k <= greatest(8 - n_taken, 0) then n_taken + k end as trade_number, event_type,
               case direction when 'bullish' then round(coalesce(t1, t2) * (1 - stop_pct / 100), 4)
                    when 'bearish' then round(coalesce(t1, t2) * (1 + stop_pct / 100), 4) end as cut_loss_price, impact_score
        from priced x
        where not exists (select 1 from predictions p where p.trade_status = 'TRADE' and p.prediction_date = x.day and p.commodity = x.commodity)"""),
    "scaled_confidence": sql("scored", f"""
        with s as (select *, {MAGNITUDE.format(p='high_prob')} as label, coalesce(direction_vote, 'neutral') as d from scored)
        select id, {LIVE.format(p='high_prob')} as live_conf,
               round({HISTORY.format(p='high_prob', s='label', d='d', n='(seq % 20)')}, 6) as history_conf, label,
               {BUCKET.format(s='label')} as expected_move from s"""),
    "key_articles": sql("scored", f"""
        with h as (select *, row_number() over (partition by day order by seq) as k, lower(headline) as t from scored),
        e as (select *, {EVENT} as event_type from h where k <= 20),
        w as (select *, {impact('event_type')} as impact_score from e),
        r as (select *, row_number() over (partition by day order by high_prob + 0.05 * impact_score desc, seq) as position from w)
        select day, position, id, high_prob, impact_score, round(high_prob + 0.05 * impact_score, 4) as rank_score from r where position <= 8"""),
    "context_panels": sql("feed", " union all ".join(f"""
        select {quoted(name)} as panel, position, id, substring(headline, 1, 90) as headline from (
          select *, row_number() over (order by seq) as position from feed where {any_of("lower(headline)", words)}) where position <= 5"""
        for name, words in fv.CONTEXT_PANELS)),
    "desk_panels": sql("feed", " union all ".join(f"""
        select {quoted(name)} as panel, position, id, substring(headline, 1, 90) as headline from (
          select *, row_number() over (order by seq) as position from feed where {any_of("lower(headline)", words)}) where position <= 5"""
        for name, words in [("first", ["tion", "eau"]), ("second", ["ing", "sch"]), ("third", ["ther"])])),
    "article_entities": sql("articles lexicon", f"""
        with a as (select *, lower(headline) as t from articles), e as (select *, {EVENT} as event_type from a)
        select e.id as article_id, event_type, {REGION} as region, s.sentiment,
               cast({any_of('t', fv.SUPPLY_IMPACT_WORDS)} as int) as supply_impact, {impact('event_type')} as impact_score
        from e join {sentiment('articles', 'headline')} s on s.id = e.id"""),
    "lexicon_sentiment": sql("articles lexicon", f"select id, sentiment from {sentiment('articles', 'body_text')}"),
    "quick_entities": sql("articles", f"""with a as (select id, lower(body_text) as t from articles)
        select id, {QUICK_EVENT} as event_type, {QUICK_REGION} as region, {QUICK_SENTIMENT} as sentiment, {SUPPLY} as supply_impact from a"""),
    "word_balance": sql("articles", f"""with a as (select id, lower(body_text) as t from articles)
        select id, {hits('t', fv.BULL_WORDS)} as bull_hits, {hits('t', fv.BEAR_WORDS)} as bear_hits from a"""),
    "body_rules": sql("articles", f"""with a as (select id, lower(body_text) as t from articles),
        e as (select *, {EVENT} as event_type, {', '.join(f"{hits('t', w)} as g{n}" for n, (_, w) in enumerate(fv.GROUP_KEYWORDS))} from a)
        select id, event_type, {REGION} as region,
               case when greatest(g0, g1, g2, g3) = 0 then 'general' when g0 = greatest(g0, g1, g2, g3) then 'dubai'
                    when g1 = greatest(g0, g1, g2, g3) then 'brent' when g2 = greatest(g0, g1, g2, g3) then 'wti' else 'lng' end as commodity_group,
               cast({any_of('t', fv.SUPPLY_IMPACT_WORDS)} as int) as supply_impact, {impact('event_type')} as impact_score from e"""),
    "rule_table_routing": sql("articles", f"""select id, {first_rule('t', [("Oman", ["eaux", "ique"]), ("WTI", ["nterti", "thorr"]),
        ("Brent", ["ing", "schen"]), ("Dubai", ["tion", "der"])], "Dubai")} as matched
        from (select id, lower(headline || ' ' || body_text) as t from articles)"""),
    "article_routing": sql("articles", f"""select id, {DESK_ROUTING} as desk_symbol, {ENERGY_ROUTING} as energy_symbol
        from (select id, lower(headline || ' ' || body_text) as t from articles)"""),
    "unprocessed_articles": sql("articles prices", f"""{DESK}
        select id from labelled where id not in (select cast(doc_id as varchar) from labels)"""),
    "labelled_with_entities": sql("articles prices", f"""{DESK},
        e as (select id, t, {EVENT} as event_type from (select id, lower(headline) as t from articles)
              where id in (select cast(doc_id as varchar) from labels))
        select l.id, l.aligned_date, l.label, e.event_type, case when e.id is not null then {REGION} end as region,
               case when e.id is not null then cast({any_of('t', fv.SUPPLY_IMPACT_WORDS)} as int) end as supply_impact,
               case when e.id is not null then {impact('event_type')} end as impact_score
        from labelled l left join e on e.id = l.id"""),
    "bodies_by_id": "select cast(l.doc_id as varchar) as id, coalesce(length(d.text), 0) as body_chars from labels l left join documents d using (doc_id)",
    "web_articles": "select 'web-' || substring(md5(url), 1, 16) as id, url, min(page_id) as page_id from pages group by url",
    "feed_listing": sql("articles prices", f"{DESK} select id, published_at, label from labelled order by published_at desc, id desc limit 50"),
    "report_listing": sql("articles", """select id, published_at, report_name, null::varchar as content_id from articles
        where lower(report_name) = 'src5' order by published_at desc, id desc limit 50"""),
    "noise_filtered": sql("articles", "select report_name, count(*) as n from articles where report_name <> 'src3' group by 1"),
    "body_counts": sql("landed", f"""select count(*) filter ({strip('body_text')} = '') as n_empty,
        count(*) filter ({strip('body_text')} <> '') as n_filled from landed"""),
    "date_window": sql("landed", """select id, published_at from landed where published_at is null
        or published_at between date '1996-01-01' and date '1997-12-31'"""),
    "uuid_ids": sql("landed", f"""select lower({strip('id')}) as id,
        regexp_full_match(lower({strip('id')}), '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') as is_uuid from landed"""),
    "headline_filters": sql("articles", f"""
        with a as (select *, {strip('lower(headline)')} as t from articles)
        select id, {any_of('t', fv.GENERIC_HEADLINES)} or length(t) < 10 as is_generic,
               length(body_text) > 500 or (length(t) > 40 and not {any_of('t', fv.NEWS_NOISE_NAMES)}) as is_real_news from a"""),
    "quality_articles": sql("feed", f"""select id, published_at from feed where length(body_text) > 500
        and published_at >= date '1995-03-01' - 7 and not {any_of('lower(headline)', fv.QUALITY_EXCLUDED_WORDS)}
        order by published_at desc, id desc limit 10"""),
    "empty_body_worklist": sql("landed", f"""select id, published_at from landed where {strip('body_text')} = ''
        and regexp_full_match(lower({strip('id')}), '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}')
        and {any_of('lower(headline)', ['tion', 'eau'])}"""),
    "commodity_lookup": sql("predictions", f"""select distinct p.commodity, c.* exclude (commodity) from predictions p join (values {', '.join(
        '(' + ', '.join(quoted(v) if isinstance(v, str) else str(v) + '::double' for v in row) + ')' for row in fv.COMMODITIES)})
        c({', '.join(fv.COMMODITY_FIELDS)}) on c.commodity = p.commodity"""),
}
