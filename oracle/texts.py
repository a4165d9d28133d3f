"""SQL twins of newsignal.plans.texts: one row per line, window functions for the section state."""

from __future__ import annotations

from newsignal import fixed_values as fv
from oracle.tables import SPACES, any_of, quoted, sql, strip

INNER = SPACES[1:-1]


def markup(column: str) -> str:
    text = f"regexp_replace({column}, '<[^>]+>', ' ', 'g')"
    for entity, plain in fv.HTML_ENTITIES:
        text = f"replace({text}, {quoted(entity)}, {quoted(plain)})"
    return text


BOILERPLATE = quoted("(?i)" + "|".join(f"(?:{p})" for p in fv.BOILERPLATE_PATTERNS))
HEADER = quoted("(?i)" + fv.TABLE_HEADERS)
MARKER = quoted("(?i)" + fv.NARRATIVE_MARKERS)
ROW = quoted(rf"^[\p{{L}}\p{{N}}_{INNER}()/\-.]*{SPACES}+[A-Za-z0-9]{{4,8}}{SPACES}+[\p{{Nd}}.\-+{INNER}/–]+$")
PRICE_LINE = f"""(length(l) between 1 and 300 and (not regexp_matches(l, '[a-zA-Z]')
  or (length(l) > 10 and length(regexp_replace(l, '\\P{{Nd}}+', '', 'g')) * 1.0::double / length(l) > 0.45)
  or (length(l) <= 150 and regexp_matches(l, {ROW}))))"""


def alpha(column: str) -> str:
    return f"(length(regexp_replace({column}, '\\P{{L}}+', '', 'g')) * 1.0::double / nullif(length({column}), 0))"


def split_lines(text: str) -> str:
    return f"string_split(replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"


def cleaned(source: str) -> str:
    """CTEs from ``source`` (id, raw) to ``lines`` (kept lines) and ``cleaned`` (id, clean_text)."""
    return f"""
raw as ({source}),
cut as (select id, unnest(ls) as l0, generate_subscripts(ls, 1) as pos
        from (select id, {split_lines(markup('raw'))} as ls from raw)),
stripped as (select id, pos, {strip('l0')} as l from cut),
plain as (select * from stripped where not regexp_matches(l, {BOILERPLATE})),
state as (select *, coalesce(last_value(case when l = '' then null when regexp_matches(l, {HEADER}) then 1
                                             when regexp_matches(l, {MARKER}) then 0 end ignore nulls)
                    over (partition by id order by pos rows between unbounded preceding and current row), 0) as skipping
          from plain),
kept as (select id, pos, l from state where l = '' or (skipping = 0 and not {PRICE_LINE})),
collapsed as (select id, pos, l from (select *, lag(l) over (partition by id order by pos) as before from kept)
              where l <> '' or before <> ''),
cleaned as (select raw.id, coalesce(t, '') as clean_text
            from raw left join (select id, {strip("string_agg(l, chr(10) order by pos)")} as t from collapsed group by id) c
              on c.id = raw.id),
narrated as (select raw.id, coalesce(t, '') as narrative
             from raw left join (select id, string_agg(l, ' ' order by pos) as t from kept
                                 where l <> '' and {alpha('l')} >= 0.40
                                   and len(regexp_split_to_array(l, '{SPACES}+')) >= 5 group by id) n on n.id = raw.id)"""


DOCS = "select doc_id as id, text as raw from documents"
CAPPED = "select id, body_text as raw from articles"
TRAINING = f"""{cleaned(CAPPED).strip()},
snips as (select a.id, a.headline, case when length(r.raw) >= 50 and {alpha('r.raw')} >= 0.40
                              then n.narrative else '' end as snippet
          from articles a join raw r on r.id = a.id join narrated n on n.id = a.id),
training as (select id, headline, snippet, case when snippet <> '' then {strip(f"{strip('snippet')} || ' ' || {strip('headline')}")}
                                 else {strip('headline')} end as text from snips)"""

NORMAL = f"""regexp_replace(regexp_replace(translate(body_text, chr(13) || '–—−', chr(10) || '---'), '[ \\t]+', ' ', 'g'), '\\n{{2,}}', chr(10), 'g')"""
LINES = f"""
cut as (select id, unnest(ls) as l, generate_subscripts(ls, 1) - 1 as pos
        from (select id, list_filter(list_transform(string_split({NORMAL}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') as ls
              from reports))"""
N = r"[+-]?\d+(?:\.\d+)?"
HEAD = r"^(.+?) ([A-Z0-9]{6,8}) "
SHAPES = [(rf"{HEAD}{N}\s*-\s*{N} ({N}) ({N})$", True), (rf"{HEAD}({N}) ({N})$", True),
          (rf"{HEAD}{N}\s*-\s*{N} ({N})$", False), (rf"{HEAD}({N})$", False)]
QUOTE = HEAD + " ".join([r"(-?\d+(?:\.\d+)?)"] * 4) + "$"


def part(group: int) -> str:
    arms = " ".join(
        f"when regexp_matches(c, {quoted(p)}) then " + (f"regexp_extract(c, {quoted(p)}, {group})"
                                                        if group < 4 or change else "null")
        for p, change in SHAPES)
    return f"case {arms} end"


def alias_rule(aliases) -> str:
    return " ".join(f"when {any_of('name', words)} then {quoted(symbol)}" for symbol, words in aliases)


PARSED = f"""{LINES.strip()},
parsed as (select * from (
  select id, pos, l, {part(1)} as label, {part(2)} as code, {part(3)} as mid, {part(4)} as change
  from (select *, regexp_replace(l, '{SPACES}+', ' ', 'g') as c from cut)) where label is not null),
symbols as (select *, case when code like 'DBD%' or contains(name, 'spread vs dubai') then null {alias_rule(fv.SYMBOL_ALIASES)} end as symbol,
                   cast(mid as double) as price, cast(change as double) as chg
            from (select *, lower(label) as name from parsed))"""
SECTION = f"""{PARSED},
marks as (select id, min(pos) filter ({any_of('lower(l)', fv.SECTION_START)}) as p0 from cut group by 1),
ends as (select c.id, min(c.pos) as p1 from cut c join marks m on m.id = c.id
         where c.pos > m.p0 and {any_of('lower(l)', fv.SECTION_END)} and not {any_of('lower(l)', fv.SECTION_START)} group by 1),
inside as (select c.id, c.pos from cut c join marks m on m.id = c.id left join ends e on e.id = c.id
           where c.pos > m.p0 and c.pos < coalesce(e.p1, 1000000) and not {any_of('lower(l)', fv.SECTION_START)}
             and lower(l) not in ({', '.join(quoted(x) for x in fv.SECTION_HEADER_LINES)})),
relevant as (select c.* from cut c where exists (select 1 from inside i where i.id = c.id and i.pos = c.pos)
             or not exists (select 1 from inside i where i.id = c.id)),
firsts as (select s.* from symbols s join relevant r on r.id = s.id and r.pos = s.pos where s.symbol is not null
           qualify row_number() over (partition by s.id, s.symbol order by s.pos) = 1)"""
EXACT = " ".join(f"when name in ({', '.join(quoted(w) for w in [symbol.lower(), *words])}) then {quoted(symbol)}"
                 for symbol, words in fv.PAYLOAD_ALIASES)
QUOTES = f"""{LINES.strip()},
quotes as (select id, pos, l, case {EXACT} end as symbol, price, change_abs
           from (select *, lower(regexp_extract(c, {quoted(QUOTE)}, 1)) as name,
                        cast(regexp_extract(c, {quoted(QUOTE)}, 5) as double) as price,
                        cast(regexp_extract(c, {quoted(QUOTE)}, 6) as double) as change_abs
                 from (select *, regexp_replace(l, '{SPACES}+', ' ', 'g') as c from cut) where regexp_matches(c, {quoted(QUOTE)}))),
quote_rows as (select id, symbol, price, change_abs, substring(l, 1, 160) as evidence from quotes where symbol is not null
               qualify row_number() over (partition by id, symbol order by pos) = 1)"""
TYPE = """case when contains(lower(report_name), 'marketscan') or contains(lower(report_name), 'arab gulf') then 'marketscan'
  when contains(lower(report_name), 'marketwire') or contains(lower(report_name), 'crude oil') or contains(lower(report_name), 'world oil')
  then 'marketwire' else 'generic' end"""
EXTRACT = f"""{QUOTES},
kinds as (select r.id, r.published_at, day(r.published_at) % 3 as kind, {TYPE} as report_type,
                 max(price) filter (symbol = 'Dubai') as dubai, max(price) filter (symbol = 'Brent') as brent
          from reports r join prices p on p.date = r.published_at group by all),
bench as (
  select id, 'Dubai' as symbol, cast('1' || cast(cast(dubai as decimal(12,4)) as varchar) as double) as price, -2.5::double as change_abs, 'row' as evidence
  from kinds where kind = 0 and dubai is not null
  union all select id, 'Brent', case when brent is not null then brent else 9.9::double end, null, '' from kinds where kind = 0
  union all select q.* from quote_rows q join kinds k on k.id = q.id where k.kind <> 0)"""

ORACLES = {
    "clean_documents": sql("", f"with {cleaned(DOCS).strip()} select id as doc_id, clean_text from cleaned"),
    "clean_pages": sql("", f"with {cleaned('select page_id as id, html as raw from pages').strip()} select id as page_id, clean_text from cleaned"),
    "clean_reports": sql("reports", f"with {cleaned('select id, body_text as raw from reports').strip()} select id, clean_text from cleaned"),
    "strip_markup": f"select page_id, {markup('html')} as plain from pages",
    "narrative": sql("", f"""with {cleaned(DOCS).strip()}
        select n.id as doc_id, narrative, length(raw) >= 50 and {alpha('raw')} >= 0.40 as is_narrative,
               round(coalesce({alpha('raw')}, 0.0), 6) as alpha_share from narrated n join raw on raw.id = n.id"""),
    "line_rules": sql("", f"""with cut as (select doc_id, {strip('unnest(' + split_lines('text') + ')')} as l from documents)
        select doc_id, count(*) as n_lines, count(*) filter (l = '') as n_blank,
               count(*) filter (regexp_matches(l, {BOILERPLATE})) as n_boilerplate, count(*) filter ({PRICE_LINE}) as n_price_lines,
               count(*) filter (regexp_matches(l, {MARKER})) as n_markers from cut group by 1"""),
    "training_text": sql("articles", f"with {TRAINING} select id, snippet, text from training"),
    "training_filter": sql("articles", f"""with {TRAINING}
        select id from (select *, {strip('lower(headline)')} as t from training)
        where (length(snippet) > 200 or not ({any_of('t', fv.GENERIC_HEADLINES)} or length(t) < 10)) and text <> ''"""),
    "normalized_lines": sql("reports", f"with {LINES.strip()} select id, pos, l as line from cut"),
    "relevant_lines": sql("reports", f"""with {SECTION}
        select id, row_number() over (partition by id order by pos) - 1 as pos, l as line from relevant"""),
    "benchmark_rows": sql("reports", f"""with {SECTION}
        select id, symbol, label, code, price, round(chg / nullif(price - chg, 0) * 100, 6) as pct_change_24h from firsts"""),
    "quote_rows": sql("reports", f"with {QUOTES} select * from quote_rows"),
    "row_symbols": sql("reports", f"with {PARSED} select id, pos, code, symbol from symbols"),
    "report_types": sql("reports", f"select id, {TYPE} as report_type from reports"),
    "extracted_prices": sql("reports", f"""with {SECTION}
        select r.published_at as date, symbol, price,
               round(coalesce(chg / nullif(price - chg, 0) * 100,
                     (lead(price) over (partition by symbol order by r.published_at) / price - 1) * 100), 6) as pct_change_24h
        from firsts f join reports r on r.id = f.id"""),
    "extraction_benchmarks": sql("reports", f"""with {EXTRACT}
        select k.id, case when kind = 1 then date '2000-01-01' else published_at end as report_date,
               case when kind = 0 then 'custom' else report_type end as report_type, symbol, price, change_abs,
               round(change_abs / nullif(price - change_abs, 0) * 100, 6) as pct_change_24h, evidence
        from kinds k join bench b on b.id = k.id"""),
    "extraction_signals": sql("reports", f"""with {EXTRACT}
        select id, category, signal, impact from kinds, (values ('Supply', 'Cargo delays', 'bullish'),
               ('Other', 'Flat demand', 'neutral')) s(category, signal, impact) where kind <> 2"""),
    "serialised_extractions": sql("reports", """
        select id, case when day(published_at) % 3 = 2 then '[]' else
               '[{"category":"Supply","signal":"Cargo delays","impact":"bullish"},{"category":"Other","signal":"Flat demand","impact":"neutral"}]'
               end as signal_json, case when day(published_at) % 3 = 2 then 0 else 2 end as n_signals from reports"""),
}
