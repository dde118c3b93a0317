"""Queries of splits, folds, weights and samples."""

from pyspark.sql import functions as F

from corvane.operators import splits as S
from corvane.sources.tables import table

KEY = "md5(concat_ws(':', '42', cast({} as varchar)))"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source")


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", (F.col("label") % 3).alias("branch"), (F.col("vec_id") % 40).alias("patient"))


def holdout_group(spark, sf):
    return S.group_holdout(_docs(spark, sf), "source", 42, 0.2)


def holdout_stratified(spark, sf):
    return S.stratified_holdout(_docs(spark, sf), "doc_id", "lang", 42, 0.2)


def stratified_70_15_15(spark, sf):
    return S.three_way_stratified(_docs(spark, sf), "doc_id", "lang", 42, 0.15, 0.15)


def group_folds(spark, sf):
    return S.group_folds(_emb(spark, sf), "patient", "label", "vec_id", 5, 42)


def group_kfold(spark, sf):
    return S.group_kfold(_emb(spark, sf), "patient", "label", "vec_id", 5, 42, 2, 0.2)


def official_kfold(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 5 + 1).alias("fold"))
    return S.official_kfold(o, "fold", "o_custkey", 3, 42, 0.2)


def fixed_test_kfold(spark, sf):
    return S.fixed_test_kfold(_emb(spark, sf), F.col("patient") >= 32, "patient", "label", "vec_id", 4, 42, 1)


def nested_three_way(spark, sf):
    return S.nested_three_way(_docs(spark, sf), "source", 42, 0.15, 0.1)


def block_groups(spark, sf):
    return S.block_groups(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 10)


def balanced_weights(spark, sf):
    return S.balanced_weights(_emb(spark, sf), "branch", "label", "patient").select("vec_id", F.round("weight", 9).alias("weight"))


def class_weights(spark, sf):
    return S.class_weights(table(spark, sf, "embeddings"), "label", 12).select("label", F.round("weight", 9).alias("weight"))


def split_checks(spark, sf):
    """Both must be 0: groups on two sides of the group hold-out, rows it lost."""
    docs = _docs(spark, sf)
    split = S.group_holdout(docs, "source", 42, 0.2)
    bad = S.overlapping_groups(split, "source", "split").agg(F.count("*").alias("overlapping"))
    lost = docs.join(split.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("lost"))
    return bad.crossJoin(lost)


def sample_per_label(spark, sf):
    return S.sample_per(table(spark, sf, "embeddings").select("vec_id", "label"), ["label"], "vec_id", 5, 42)


def k_per_group_epoch(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return S.samples_per(o, ["o_custkey"], "o_orderkey", 2, [42, 43, 44])


def ood_holdout(spark, sf):
    """Source src0 is out of distribution; the rest, rows without a source included, is folded by source."""
    return S.out_of_distribution(_docs(spark, sf), "source", ["src0"], "source", "lang", "doc_id", 4, 42).select("doc_id", "source", "part")


def _groups(rel, group, seed="42"):
    return f"select g, row_number() over (order by md5(concat_ws(':', '{seed}', cast(g as varchar))), g) - 1 as r, count(*) over () as n from (select distinct {group} as g from {rel})"


_E = "(select vec_id, label, label % 3 as branch, vec_id % 40 as patient from embeddings)"
_FOLD = "select g, cast((row_number() over (partition by l order by md5(concat_ws(':', '42', cast(g as varchar))), g) - 1) % {k} + 1 as integer) as fold from (select {group} as g, arg_min({label}, {order}) as l from {rel} group by 1)"

SQL = {
    "holdout_group": f"select doc_id, lang, source, case when r >= n - greatest(1, floor(n * 0.2)) then 'val' else 'train' end as split from documents join ({_groups('documents', 'source')}) on source = g",
    "holdout_stratified": f"select doc_id, lang, source, case when r >= n - greatest(1, floor(n * 0.2)) then 'val' else 'train' end as split from (select doc_id, lang, source, row_number() over (partition by lang order by {KEY.format('doc_id')}, doc_id) - 1 as r, count(*) over (partition by lang) as n from documents)",
    "stratified_70_15_15": f"select doc_id, lang, source, case when r < s then 'val' when r < 2 * s then 'test' else 'train' end as split from (select *, greatest(1, round_even(n * 0.15, 0)) as s from (select doc_id, lang, source, row_number() over (partition by lang order by {KEY.format('doc_id')}, doc_id) - 1 as r, count(*) over (partition by lang) as n from documents))",
    "group_folds": f"select vec_id, label, branch, patient, fold from {_E} join ({_FOLD.format(k=5, group='patient', label='label', order='vec_id', rel=_E)}) on patient = g",
    "group_kfold": f"with f as (select vec_id, label, branch, patient, fold from {_E} join ({_FOLD.format(k=5, group='patient', label='label', order='vec_id', rel=_E)}) on patient = g), p as ({_groups('(select * from f where fold <> 2)', 'patient')}) select vec_id, label, branch, patient, case when fold = 2 then 'test' when r >= n - greatest(1, floor(n * 0.2)) then 'val' else 'train' end as split from f left join p on patient = g and fold <> 2",
    "official_kfold": f"with o as (select o_orderkey, o_custkey, o_orderkey % 5 + 1 as fold from orders), t as (select distinct o_custkey as c from o where fold = 3), p as ({_groups('(select * from o where o_custkey not in (select c from t))', 'o_custkey')}) select o_orderkey, o_custkey, fold, case when g is null then 'test' when r < greatest(1, floor(n * 0.2)) then 'val' else 'train' end as split from o left join p on o_custkey = g",
    "fixed_test_kfold": f"with f as ({_FOLD.format(k=4, group='patient', label='label', order='vec_id', rel='(select * from ' + _E + ' where patient < 32)')}) select vec_id, label, branch, patient, case when patient >= 32 then 'test' when fold = 1 then 'val' else 'train' end as split from {_E} left join f on patient = g",
    "nested_three_way": f"with a as ({_groups('documents', 'source')}), b as (select source, case when r >= n - greatest(1, floor(n * 0.15)) then 1 else 0 end as held from (select g as source, r, n from a)), c as ({_groups('(select * from b where held = 0)', 'source', '43')}) select doc_id, lang, source, case when g is null then 'test' when r >= n - greatest(1, floor(n * 0.1)) then 'val' else 'train' end as split from documents left join c on source = g",
    "block_groups": "select o_orderkey, cast(floor((o_orderkey - 1) / 10) as bigint) as block from orders",
    "balanced_weights": f"with e as (select * from {_E}), n as (select branch, label, patient, count(*) n from e group by all), l as (select branch, label, count(*) l from n group by all), s as (select branch, count(*) s from l group by all) select vec_id, round(1.0::double / ((select count(*) from s) * s * l * n), 9) as weight from e join n using (branch, label, patient) join l using (branch, label) join s using (branch)",
    "class_weights": "select cast(i as integer) as label, round((select count(*) from embeddings) / (12.0::double * coalesce(n, 1)), 9) as weight from range(12) t(i) left join (select label, count(*) n from embeddings group by 1) on i = label",
    "sample_per_label": f"select vec_id, label from (select vec_id, label, row_number() over (partition by label order by {KEY.format('vec_id')}, vec_id) r from embeddings) where r <= 5",
    "k_per_group_epoch": "select o_orderkey, o_custkey, cast(e as integer) as epoch from (select o_orderkey, o_custkey, e, row_number() over (partition by e, o_custkey order by md5(concat_ws(':', cast(42 + e as varchar), cast(o_orderkey as varchar))), o_orderkey) r from orders, range(3) t(e)) where r <= 2",
    "ood_holdout": f"with f as ({_FOLD.format(k=4, group='source', label='lang', order='doc_id', rel='(select * from documents where source is distinct from ' + chr(39) + 'src0' + chr(39) + ')')}) select doc_id, source, coalesce(cast(fold as varchar), 'ood') as part from documents left join f on source is not distinct from g",
}
SQL["split_checks"] = f"with h as ({SQL['holdout_group']}) select (select count(*) from (select source from h group by source having count(distinct split) > 1)) as overlapping, (select count(*) from documents where doc_id not in (select doc_id from h)) as lost"
QUERIES = {f.__name__: f for f in (holdout_group, holdout_stratified, stratified_70_15_15, group_folds, group_kfold, official_kfold, fixed_test_kfold, nested_three_way, block_groups, balanced_weights, class_weights, split_checks, sample_per_label, k_per_group_epoch, ood_holdout)}
