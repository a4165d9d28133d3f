"""SQL twins of newsignal.plans.models. Of fitted models they know the rows, the folds and what must hold for any fit."""

from __future__ import annotations

from newsignal import fixed_values as fv
from oracle.news import EVENT, REGION
from oracle.series import DESK, FEATURES
from oracle.tables import any_of, hits, sql, strip, z
from oracle.texts import TRAINING

TERMS = r"""
words as (select id, ws, unnest(range(1, len(ws) + 1)) as i
          from (select doc_id as id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') as ws from documents)),
terms as (select id, ws[i] as term from words union all
          select id, ws[i] || ' ' || ws[i + 1] from words where i < len(ws)),
counts as (select id, term, count(*) as tf from terms group by 1, 2),
vocab as (select *, ln((1 + (select count(*) from documents)) / (1 + df)) + 1 as idf
          from (select term, count(*) as df, sum(tf)::bigint as total from counts group by 1 having count(*) >= 2)),
raw as (select id, term, (1 + ln(tf)) * idf as w from counts join vocab using (term)),
weights as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as weight from raw)"""
DOC_LABEL = "case when n_chars > 3000 then 'HIGH' when n_chars > 1000 then 'MEDIUM' else 'LOW' end"
GROUP_WORDS = [("dubai", ["tion", "eau"]), ("brent", ["ing", "sch"]), ("wti", ["nter", "ther"]), ("lng", ["lng"])]
BEST = "greatest(g0, g1, g2, g3)"
TRAIN_SET = f"""{DESK},
{TRAINING.replace('with ', '', 1) if TRAINING.startswith('with ') else TRAINING},
{FEATURES.strip()},
final as (
  select t.id, l.aligned_date, l.label, l.price_change, f.mom_5d, f.mom_10d, f.article_count,
         case when {BEST} = 0 then 'general' when g0 = {BEST} then 'dubai' when g1 = {BEST} then 'brent'
              when g2 = {BEST} then 'wti' else 'lng' end as commodity_group
  from (select *, {strip('lower(headline)')} as t,
               {', '.join(f"{hits('lower(headline)', w)} as g{n}" for n, (_, w) in enumerate(GROUP_WORDS))} from training) t
  join labelled l on l.id = t.id left join features f on f.date = l.aligned_date
  where (length(snippet) > 200 or not ({any_of('t', fv.GENERIC_HEADLINES)} or length(t) < 10)) and text <> '')"""

BOUNDS = f"""{DESK},
days as (select d, row_number() over (order by d) - 1 as k, count(*) over () as n
         from (select distinct aligned_date as d from labelled)),
bounds as (select f.fold, min(d) filter (k = least(f.fold * (n // 5), n - 1)) as train_cutoff,
                  min(d) filter (k = least((f.fold + 1) * (n // 5), n - 1)) as test_end
           from days, (values (1), (2), (3), (4)) f(fold) group by 1 having max(n) >= 5)"""
SIZES = f"""{BOUNDS},
sizes as (select fold, count(*) filter (aligned_date <= train_cutoff) as train_size,
                 count(*) filter (aligned_date > train_cutoff) as test_size,
                 count(distinct label) filter (aligned_date <= train_cutoff) as train_classes,
                 count(distinct label) filter (aligned_date > train_cutoff) as test_classes
          from labelled join bounds on aligned_date <= test_end group by 1)"""

FOLDS = """,
rows_ as (select id, aligned_date, {label} as label from final),
fold_days as (select d, row_number() over (order by d) - 1 as k, count(*) over () as n from (select distinct aligned_date as d from rows_)),
fold_ends as (select f.fold, min(d) filter (k = least(f.fold * (n // 5), n - 1)) as train_cutoff,
                     min(d) filter (k = least((f.fold + 1) * (n // 5), n - 1)) as test_end
              from fold_days, (values (1), (2), (3), (4)) f(fold) group by 1 having max(n) >= 5),
folds as (select fold, train_cutoff, test_end, count(*) filter (aligned_date <= train_cutoff) as train_size,
                 count(*) filter (aligned_date > train_cutoff) as test_size
          from rows_ join fold_ends on aligned_date <= test_end group by 1, 2, 3
          having count(*) filter (aligned_date <= train_cutoff) >= 50 and count(*) filter (aligned_date > train_cutoff) >= 20
             and count(distinct label) filter (aligned_date <= train_cutoff) >= 2 and count(distinct label) filter (aligned_date > train_cutoff) >= 2)"""

NEAREST = """
        with {more} asked as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 50 = 0),
        scored as (select query_id, e.vec_id{columns},
                     round(list_dot_product(q, e.embedding::double[]) / sqrt(list_dot_product(q, q))
                       / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])), 12) as s from asked, {rows} e)
        select query_id, vec_id{columns}, round(s, 3) as similarity, position from (
          select *, row_number() over (partition by query_id order by s desc, vec_id) as position from scored) where position <= 3"""
UPSERTED = """changed as (
          select vec_id, list_transform(embedding, lambda x: -x) as embedding, label + 100 as label from embeddings where vec_id % 10 = 0
          union all select -vec_id, embedding, label + 200 from embeddings where vec_id % 100 = 1),
        stored as (select vec_id, embedding, label from embeddings where vec_id not in (select vec_id from changed) union all select * from changed)"""

ORACLES = {
    "tfidf_vocabulary": sql("", f"with {TERMS.strip()} select term, df, total, round(idf, 6) as idf from vocab"),
    "tfidf_weights": sql("", f"""with {TERMS.strip()} select id, term, round(weight, 5) as weight from weights"""),
    "chi2_terms": sql("", f"""with {TERMS.strip()},
        lab as (select doc_id as id, {DOC_LABEL} as label from documents),
        mass as (select term, label, sum(weight) as m from weights join lab using (id) group by 1, 2),
        share as (select label, count(*) * 1.0::double / sum(count(*)) over () as p from lab group by 1),
        exp as (select t.term, s.label, t.m * s.p as e from (select term, sum(m) as m from mass group by 1) t, share s)
        select term, chi2, row_number() over (order by term) - 1 as idx
        from (select term, round(sum((coalesce(m, 0) - e) * (coalesce(m, 0) - e) / e), 5) as chi2
              from exp left join mass using (term, label) group by 1 order by chi2 desc, term limit 500)"""),
    "label_index": f"select label, row_number() over (order by label) - 1 as idx from (select distinct {DOC_LABEL} as label from documents)",
    "class_weights": f"""select label, count(*) as n, round(sum(count(*)) over () * 1.0::double / (count(*) over () * count(*)), 6) as weight
        from (select {DOC_LABEL} as label from documents) group by 1""",
    "training_set": sql("articles prices", f"""{TRAIN_SET}
        select id, aligned_date, label, commodity_group, round(coalesce(mom_5d, 0), 6) as mom_5d,
               coalesce(article_count, 0) as article_count from final"""),
    "training_set_direction": sql("articles prices", f"""{TRAIN_SET}
        select id, case when price_change > 1 then 'rise' when price_change < -1 then 'fall' else 'flat' end as label from final"""),
    "numeric_scaling": sql("articles prices", f"""{TRAIN_SET},
        f as (select id, coalesce(mom_5d, 0) as a, coalesce(mom_10d, 0) as b, coalesce(article_count, 0) as c from final)
        select id, {z('round((a - avg(a) over ()) / coalesce(nullif(stddev_pop(a) over (), 0), 1), 5)')} as mom_5d,
               {z('round((b - avg(b) over ()) / coalesce(nullif(stddev_pop(b) over (), 0), 1), 5)')} as mom_10d,
               {z('round((c - avg(c) over ()) / coalesce(nullif(stddev_pop(c) over (), 0), 1), 5)')} as article_count from f"""),
    "fold_bounds": sql("articles prices", f"{BOUNDS} select * from bounds"),
    "fold_sizes": sql("articles prices", f"""{SIZES}
        select *, train_size >= 50 and test_size >= 20 and train_classes >= 2 and test_classes >= 2 as usable from sizes"""),
    "chronological_split": sql("articles prices", f"""{DESK}
        select id, case when row_number() over (order by aligned_date, id) <= floor(count(*) over () * 0.8) then 'train' else 'test' end as part
        from labelled"""),
    "group_training_sets": sql("articles prices", f"""{TRAIN_SET}
        select g.g as commodity_group, count(*) filter (commodity_group in (g.g, 'general')) as n
        from final, (values ('dubai'), ('brent'), ('wti'), ('lng')) g(g) group by 1"""),
    "class_report": """
        select c.c as class, round(count(*) filter (quality = c.k and toxic = c.k) * 100.0 / nullif(count(*) filter (toxic = c.k), 0), 4) as precision_pct,
               round(count(*) filter (quality = c.k and toxic = c.k) * 100.0 / nullif(count(*) filter (quality = c.k), 0), 4) as recall_pct,
               count(*) filter (quality = c.k) as support, round(count(*) filter (quality = toxic) * 100.0 / count(*), 4) as accuracy_pct
        from labels, (values ('0', 0), ('1', 1)) c(c, k) group by 1, c.k""",
    "model_view": sql("articles prices", f"""{TRAIN_SET}{FOLDS.format(label="case when price_change > 1 then 'rise' when price_change < -1 then 'fall' else 'flat' end")}
        select 'logistic' as model_type, 'direction' as label_type, count(*) as n_folds, max(train_size) as train_samples,
               sum(test_size)::bigint as test_samples, true as metrics_are_percentages from folds having count(*) > 0"""),
    "walk_forward": sql("articles prices", f"""{TRAIN_SET}{FOLDS.format(label="label")}
        select 'logistic' as model_type, 'magnitude' as label_type, fold, train_size, test_size, train_cutoff, test_end,
               true as metrics_are_shares from folds"""),
    "logistic_scores": sql("articles prices", f"{TRAIN_SET} select id, label, true as sums_to_one, true as is_most_probable from final"),
    "tree_scores": sql("articles prices", f"{TRAIN_SET} select id, label, true as sums_to_one, true as is_most_probable from final"),
    "embedding_tree_scores": sql("articles prices", f"{TRAIN_SET} select id, label, true as sums_to_one, true as is_most_probable from final"),
    "group_model_scores": sql("articles prices", f"""{TRAIN_SET}
        select id as article_id, (select count(*) from (values ('dubai'), ('brent'), ('wti'), ('lng')) g(g)
                 where (select count(*) from final where commodity_group in (g.g, 'general')) >= {fv.MIN_SAMPLES}) as n_models,
               true as sums_to_one, true as is_most_probable from final"""),
    "stored_model_scores": sql("articles prices feed", f"""{TRAIN_SET}
        select id as article_id, case when id in (select id from final) then 2 else 0 end as n_models,
               true as sums_to_one, true as is_most_probable from feed"""),
    "similar_articles": NEAREST.format(rows="embeddings", columns="", more=""),
    "index_recall": """
        select count(*) * least(3, (select count(*) from embeddings)) as n_exact, true as recall_reached from embeddings where vec_id % 50 = 0""",
    "upserted_vectors": f"""with {UPSERTED}
        select vec_id, label, round(embedding[1]::double, 5) as first_component from stored""",
    "indexed_articles": NEAREST.format(rows="stored", columns=", label", more=f"{UPSERTED},"),
    "corpus_metadata": sql("articles prices", f"""{DESK}, e as (select *, lower(coalesce(headline, '')) as t from labelled)
        select id, substring(headline, 1, 300) as headline, cast(aligned_date as varchar) as date, lower(label) as label, price_change,
               {EVENT} as event_type, {REGION} as region from e"""),
}
