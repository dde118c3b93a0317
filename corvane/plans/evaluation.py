"""Queries of evaluation statistics, outliers and reviews."""

from pyspark.sql import functions as F

from corvane.operators import evaluation as V
from corvane.operators import outliers as O
from corvane.sources.tables import table


def _pred(spark, sf):
    """Two models over labelled documents: a length score, and a hash score."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    rows = docs.join(table(spark, sf, "labels"), "doc_id")
    score = F.least(F.col("n_chars") / 4000.0, F.lit(1.0))
    return rows.select("doc_id", "source", "lang", F.col("quality").alias("label"), score.alias("score"), (score >= 0.5).cast("int").alias("pred"), (F.col("doc_id") % 5).alias("fold"), (F.col("doc_id") * 37 % 101 / 100.0).alias("other"))


def auc_total(spark, sf):
    return V.auc(_pred(spark, sf), "score", "label").select("n", F.round("auc", 9).alias("auc"))


def auc_by_source(spark, sf):
    return V.auc(_pred(spark, sf), "score", "label", ["source"]).select("source", "n", F.round("auc", 9).alias("auc"))


def branch_auc(spark, sf):
    """Per language over the sources that have both classes, then the mean over languages."""
    rows = _pred(spark, sf)
    good = rows.groupBy("source").agg(F.countDistinct("label").alias("k")).where("k = 2").select("source")
    by = V.auc(rows.join(good, "source"), "score", "label", ["lang"])
    return by.select("lang", "n", F.round("auc", 9).alias("auc")).union(by.agg(F.lit("mean"), F.sum("n"), F.round(F.avg("auc"), 9)))


def confusion_by_source(spark, sf):
    c = V.class_metrics(V.confusion(_pred(spark, sf), "pred", "label", ["source"]))
    return c.select("source", "tn", "fp", "fn", "tp", *[F.round(m, 9).alias(m) for m in ("accuracy", "sensitivity", "specificity", "precision", "f1")])


def bias_by_lang(spark, sf):
    c = V.confusion(_pred(spark, sf), "pred", "label", ["lang"])
    fpr, fnr = F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), F.try_divide(F.col("fn"), F.col("fn") + F.col("tp"))
    return c.select("lang", F.round(fpr, 9).alias("fpr"), F.round(fnr, 9).alias("fnr"), V.bias_verdict(fpr, fnr).alias("verdict"))


def fold_mean_std(spark, sf):
    rows = _pred(spark, sf)
    folds = V.class_metrics(V.confusion(rows, "pred", "label", ["fold"])).join(V.auc(rows, "score", "label", ["fold"]), "fold")
    out = V.fold_summary(folds, [], ["accuracy", "sensitivity", "specificity", "auc"])
    return out.select("metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def late_fusion(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_discount") > 0.02).alias("present"), F.col("l_tax").alias("w"), (F.col("l_quantity") / 50.0).alias("logit"))
    return V.late_fusion(li, "l_orderkey", "present", "w", "logit").select("l_orderkey", F.round("fused", 9).alias("fused"))


def zscore_outliers(spark, sf):
    docs = table(spark, sf, "documents").withColumn("words", F.size(F.split("text", " ")))
    out = O.zscore_outliers(docs, "doc_id", "lang", ["n_chars", "words"], 3.0)
    return out.select("doc_id", "lang", F.round("max_abs_z", 6).alias("max_abs_z"), "reasons")


def review_upsert(spark, sf):
    events = table(spark, sf, "events")
    review = events.where("event_id % 7 = 0").select("event_id", F.lit("keep").alias("decision"))
    flagged = O.zscore_outliers(events, "event_id", "event_type", ["value"], 2.0).select("event_id", "reasons")
    return O.review_upsert(review, flagged, "event_id").select("event_id", "decision", (F.col("reasons").isNotNull()).alias("flagged"))


def delong_paired(spark, sf):
    out = V.delong(_pred(spark, sf), "label", "score", "other")
    return out.select(*[F.round(c, 8).alias(c) for c in ("auc_a", "auc_b", "variance", "z")])


def bootstrap_delta(spark, sf):
    """Twenty replicates over whole sources."""
    out = V.bootstrap_auc_delta(_pred(spark, sf), "source", "label", "score", "other", 20, 42)
    return out.select("replicate", F.round("delta", 8).alias("delta"))


_P = "(select d.doc_id, source, lang, quality as label, least(n_chars / 4000.0::double, 1.0::double) as score, (d.doc_id * 37 % 101) / 100.0::double as other, (least(n_chars / 4000.0::double, 1.0::double) >= 0.5)::int as pred, doc_id % 5 as fold from documents d join labels using (doc_id))"


def _auc(by="", rel=_P):
    part, cols = (f"partition by {by}", f"{by}, ") if by else ("", "")
    w = f"select {cols}label, rank() over ({part} order by score) + (count(*) over (partition by {cols}score) - 1) / 2.0::double as r from {rel}"
    return f"select {cols}count(*) as n, round((sum(case when label = 1 then r end) - sum(label) * (sum(label) + 1) / 2.0::double) / nullif(sum(label)::double * sum(1 - label)::double, 0), 9) as auc from ({w}){' group by ' + by if by else ''}"


_CONF = "count(*) filter (label = 0 and pred = 0) as tn, count(*) filter (label = 0 and pred = 1) as fp, count(*) filter (label = 1 and pred = 0) as fn, count(*) filter (label = 1 and pred = 1) as tp"
_MET = "round((tp + tn) / nullif(tp + tn + fp + fn, 0)::double, 9) as accuracy, round(tp / nullif(tp + fn, 0)::double, 9) as sensitivity, round(tn / nullif(tn + fp, 0)::double, 9) as specificity, coalesce(round(tp / nullif(tp + fp, 0)::double, 9), 0.0::double) as precision, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 9), 0.0::double) as f1"
_Z = "select {key}, {by}, {m}, avg({m}) over (partition by {by}) as av, stddev_pop({m}) over (partition by {by}) as sd from {rel}"
_PLACE = "select *, (rank() over (order by {s}) - 1 - (rank() over (partition by label order by {s}) - 1) + (count(*) over (partition by {s}) - count(*) over (partition by {s}, label)) / 2.0::double) as below, count(*) over () - count(*) over (partition by label) as others from {rel}"
_DELONG = f"with x as ({_PLACE.format(s='score', rel=_P)}), y as ({_PLACE.format(s='other', rel='(select * exclude (below, others), below / others as va from x)')}), g as (select label, case when label = 1 then va else 1 - va end as va, case when label = 1 then below / others else 1 - below / others end as vb from y), r as (select avg(va) filter (label = 1) as auc_a, avg(vb) filter (label = 1) as auc_b, var_samp(va - vb) filter (label = 1) / count(*) filter (label = 1) + var_samp(va - vb) filter (label = 0) / count(*) filter (label = 0) as variance from g) select round(auc_a, 8) as auc_a, round(auc_b, 8) as auc_b, round(variance, 8) as variance, round((auc_a - auc_b) / sqrt(variance), 8) as z from r"
_BOOT = f"with p as (select * from {_P}), g as (select source, row_number() over (order by md5(concat_ws(':', '42', source)), source) - 1 as r, count(*) over () as n from (select distinct source from p)), w as (select e as replicate, ('0x' || substr(md5(concat_ws(':', '42', cast(e as varchar), cast(r as varchar))), 1, 12))::bigint % n as r, count(*) as w from g, range(1, 21) t(e) group by all), s as (select replicate, w, label, m, v from p join g using (source) join w using (r), lateral (select 'a' as m, score as v union all select 'b', other) z), c as (select replicate, m, v, sum(case when label = 1 then w else 0 end)::double as p, sum(case when label = 0 then w else 0 end)::double as q from s group by all), d as (select *, p * (coalesce(sum(q) over (partition by replicate, m order by v rows between unbounded preceding and 1 preceding), 0) + q / 2) as won from c), u as (select replicate, m, sum(won) / nullif(sum(p) * sum(q), 0) as auc from d group by all) select cast(replicate as integer) as replicate, round(max(auc) filter (m = 'a') - max(auc) filter (m = 'b'), 8) as delta from u group by 1 having delta is not null"
SQL = {
    "delong_paired": _DELONG,
    "bootstrap_delta": _BOOT,
    "auc_total": _auc(),
    "auc_by_source": _auc("source"),
    "branch_auc": f"with good as (select source from {_P} group by 1 having count(distinct label) = 2), a as ({_auc('lang', '(select * from ' + _P + ' where source in (select source from good))')}) select * from a union all select 'mean', cast(sum(n) as bigint), round(avg(auc), 9) from a",
    "confusion_by_source": f"select source, tn, fp, fn, tp, {_MET} from (select source, {_CONF} from {_P} group by 1)",
    "bias_by_lang": f"select lang, round(fpr, 9) as fpr, round(fnr, 9) as fnr, case when fpr > fnr then 'false_positive_leaning' when fnr > fpr then 'false_negative_leaning' else 'balanced' end as verdict from (select lang, fp / nullif(fp + tn, 0)::double as fpr, fn / nullif(fn + tp, 0)::double as fnr from (select lang, {_CONF} from {_P} group by 1))",
    "fold_mean_std": f"with c as (select fold, {_MET} from (select fold, {_CONF} from {_P} group by 1)), a as ({_auc('fold')}), m as (select * from c join a using (fold)), u as (select 'accuracy' as metric, accuracy as v from m union all select 'sensitivity', sensitivity from m union all select 'specificity', specificity from m union all select 'auc', auc from m) select metric, round(avg(v), 9) as mean, round(stddev_pop(v), 9) as std from u group by 1",
    "late_fusion": "select l_orderkey, round(sum(exp(l_tax) * (l_quantity / 50.0::double)) / sum(exp(l_tax)), 9) as fused from lineitem where l_discount > 0.02 group by 1",
    "review_upsert": f"with z as ({_Z.format(key='event_id', by='event_type', m='value', rel='events')}), f as (select event_id from z where abs((value - av) / nullif(sd, 0)) > 2.0) select event_id, 'keep' as decision, false as flagged from events where event_id % 7 = 0 union all select event_id, null, true from f where event_id % 7 <> 0",
    "zscore_outliers": "with d as (select doc_id, lang, n_chars, len(string_split(text, ' ')) as words from documents), z as (select doc_id, lang, (n_chars - avg(n_chars) over w) / stddev_pop(n_chars) over w as p, (words - avg(words) over w) / stddev_pop(words) over w as q from d window w as (partition by lang)) select doc_id, lang, round(greatest(abs(q), abs(p)), 6) as max_abs_z, concat_ws(',', case when abs(p) > 3 then format('n_chars(z={:+.1f})', p) end, case when abs(q) > 3 then format('words(z={:+.1f})', q) end) as reasons from z where greatest(abs(q), abs(p)) > 3",
}
QUERIES = {f.__name__: f for f in (auc_total, auc_by_source, branch_auc, confusion_by_source, bias_by_lang, fold_mean_std, late_fusion, zscore_outliers, review_upsert, delong_paired, bootstrap_delta)}
