"""SQL twins of newsignal.plans.job_queries."""

from __future__ import annotations

from newsignal import fixed_values as fv
from oracle.news import EVENT, REGION, impact
from oracle.news import ORACLES as NEWS
from oracle.series import ENERGY_ROUTING, labelled
from oracle.series import ORACLES as SERIES
from oracle.tables import any_of, sql
from oracle.texts import ORACLES as TEXTS
from oracle.trading import ORACLES as TRADING

ENERGY = labelled(ENERGY_ROUTING, "'','Bunkerwire'")
FEED = ENERGY.replace("with thresholds", "with articles as (select * from feed), thresholds", 1)
STATUS = "(select case when n = 0 then 'CRITICAL' when n < 5 then 'ERROR' when n < 20 then 'WARNING' else 'OK' end from (select count(*) as n from feed where published_at = date '1995-03-01'))"

# the assembled predictions of the days that need signals, beside the few stored ones
_ASSEMBLED = NEWS["assembled_predictions"]


def _signals() -> str:
    start, body = _ASSEMBLED.split("conf as (", 1)
    body = body.replace("from history h where", "from history h join todo using (day) where", 1).replace("from predictions", "from stored")
    return (start + "stored as (select * from predictions where trade_status = 'TRADE' and id % 11 = 0),\n"
            + "todo as (select published_at as day from feed where published_at between date '1995-01-05' and date '1995-02-20' "
            + "and published_at not in (select prediction_date from stored) group by 1 having count(*) >= 5),\nconf as (" + body)


ORACLES = {
    "job_prices": TEXTS["extracted_prices"],
    "job_labels": SERIES["label_articles_energy"],
    "job_entities": sql("articles prices", f"""{ENERGY},
        e as (select id, lower(headline) as t from labelled), f as (select *, {EVENT} as event_type from e)
        select id as article_id, event_type, {REGION} as region, cast({any_of('t', fv.SUPPLY_IMPACT_WORDS)} as int) as supply_impact,
               {impact('event_type')} as impact_score from f"""),
    "job_catch_up": sql("articles", """
        select id, length(case when seq % 3 = 1 then substring(body_text, 1, 50) else body_text end) as body_chars, count(*) over () as n_filled from articles"""),
    "job_signals": f"""select prediction_date, commodity, ticker, signal, direction, confidence, expected_move, entry_price, entry_price_source,
        trade_status, trade_number, event_type, cut_loss_price from ({_signals()})""",
    "job_settlement": f"select * exclude (pnl_usd) from ({TRADING['settle_predictions']})",
    "job_daily": sql("feed prices", f"""{FEED}
        select {STATUS} as status, (select count(*) from feed) as n_articles,
               case when {STATUS} in ('CRITICAL', 'ERROR') then 0 else (select count(*) from labelled) end as n_labelled_articles,
               case when {STATUS} in ('CRITICAL', 'ERROR') then 0 else (select count(*) from labelled) end as n_entities"""),
}
ORACLES["job_resumed"] = f"""
    with d as ({ORACLES['job_daily'].replace("1995-03-01", "1995-01-06")}), steps as (select unnest(['ingest', 'feed', 'label', 'entities', 'settle']) as step)
    select step, 1 as n_finished, d.* from steps, d where d.status not in ('CRITICAL', 'ERROR') or step in ('ingest', 'feed')"""
