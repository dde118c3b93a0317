"""Queries of replicate vectors and of averages over ordered series, each with SQL of its own."""

from pyspark.sql import functions as F

from corvane.operators import resampling as B
from corvane.operators import series as R
from corvane.sources.tables import table

DRAWS, SEED = 40, 7


def _scored(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rows.select("doc_id", "source", "lang", "quality", "n_chars", F.floor(F.col("n_chars") / 500).alias("coarse"))


def _rounded(df, keys):
    return df.select(*keys, *[F.round(c, 9).alias(c) for c in df.columns if c not in keys])


def auc_replicates(spark, sf):
    """AUCs of two scores in each replicate; whole groups of one length weigh alike."""
    return _rounded(B.auc_replicates(_scored(spark, sf), "doc_id", "quality", ["n_chars", "coarse"], DRAWS, SEED), ["replicate"])


def auc_replicates_by_language(spark, sf):
    return _rounded(B.auc_replicates(_scored(spark, sf), "source", "quality", ["n_chars"], DRAWS, SEED, ["lang"]), ["lang", "replicate"])


def paired_bootstrap(spark, sf):
    """Intervals of two AUCs and their difference."""
    return _rounded(B.paired_bootstrap(_scored(spark, sf), "doc_id", "quality", "n_chars", "coarse", DRAWS, SEED), ["draws"])


def fold_mean_bootstrap(spark, sf):
    return _rounded(B.fold_mean_bootstrap(_scored(spark, sf), "lang", "doc_id", "quality", "n_chars", "coarse", DRAWS, SEED), ["draws"])


def fold_mean_bootstrap_shared(spark, sf):
    return _rounded(B.fold_mean_bootstrap(_scored(spark, sf), "lang", "doc_id", "quality", "n_chars", "coarse", DRAWS, SEED, True), ["draws"])


def user_moving_average(spark, sf):
    """Averages of each user's values in order; values of every fifth event are missing."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return R.moving_average(e, ["user_id"], "event_id", "value").select("user_id", "event_id", F.round("ema", 6).alias("ema"))


def event_moving_average(spark, sf):
    """One series of all events."""
    return R.moving_average(table(spark, sf, "events"), [], "event_id", "value").select("event_id", F.round("ema", 6).alias("ema"))


_SCORED = "scored as (select d.doc_id, source, lang, quality, n_chars::double as n_chars, floor(n_chars / 500)::double as coarse from documents d join labels l on d.doc_id = l.doc_id where quality in (0, 1))"
_WORD = "18446744073709551616::uhugeint"


def _mixed(z: str) -> str:
    step = lambda x, shift, factor: f"(xor({x}, {x} // {1 << shift}::uhugeint) * {factor}::uhugeint) % {_WORD}"
    return f"(select xor(z2, z2 // {1 << 31}::uhugeint) // 2048::uhugeint from (select {step('z1', 27, 0x94D049BB133111EB)} as z2 from (select {step('z0', 30, 0xBF58476D1CE4E5B9)} as z1 from (select {z} as z0))))"


def _weights(key: str) -> str:
    """k, replicate, w for each value of key."""
    cuts = " + ".join(f"(u >= {int(c)}::uhugeint)::int" for c in B.CUTS if int(c) < 1 << B.UNIFORM)
    z = f"(h + r::uhugeint * {0x9E3779B97F4A7C15}::uhugeint) % {_WORD}"
    return f"weights as (select k, r as replicate, {cuts} as w from (select k, r, {_mixed(z)} as u from (select k, ('0x' || substr(md5('{SEED}:' || k), 1, 15))::bigint::uhugeint as h from (select distinct {key} as k from scored)), range(1, {DRAWS + 1}) t(r)))"


def _aucs(key: str, by: str = "") -> str:
    """by, replicate, m, auc: wins over all pairs of rows."""
    own = f"x.{by}, " if by else ""
    return (
        f"facts as (select {by + ', ' if by else ''}{key} as k, quality as y, m, s from (select *, unnest(['n_chars', 'coarse']) as m, unnest([n_chars, coarse]) as s from scored)),"
        f" ties as (select {by + ', ' if by else ''}m, s, replicate, sum(w) filter (y = 1) as p, sum(w) filter (y = 0) as q from facts f join weights v on f.k = v.k group by all),"
        f" aucs as (select {own}x.m, x.replicate, sum(coalesce(x.p, 0) * coalesce(z.q, 0) * case when x.s > z.s then 1.0 when x.s = z.s then 0.5 else 0.0 end::double) / nullif(sum(coalesce(x.p, 0) * coalesce(z.q, 0)), 0)::double as auc from ties x join ties z on x.m = z.m and x.replicate = z.replicate{f' and x.{by} = z.{by}' if by else ''} group by all)"
    )


_PLAIN = f"with {_SCORED}, {_weights('doc_id::varchar')}, {_aucs('doc_id::varchar')}, draws as (select replicate, max(auc) filter (m = 'n_chars') as a, max(auc) filter (m = 'coarse') as b from aucs group by replicate)"
_LANG_SOURCE = "lang || ':' || source"
_OF_LANG = f"with {_SCORED}, {_weights(_LANG_SOURCE)}, {_aucs(_LANG_SOURCE, "lang")}"
_BOTH = "round(quantile_cont({0}, 0.025), 9) as {1}_lower, round(quantile_cont({0}, 0.975), 9) as {1}_upper"


def _folds(key: str) -> str:
    return (
        f"with {_SCORED}, {_weights(key)}, {_aucs(key, 'lang')}, each as (select lang, replicate, max(auc) filter (m = 'n_chars') - max(auc) filter (m = 'coarse') as delta from aucs group by all),"
        " draws as (select replicate, avg(delta) as delta from each group by replicate having count(delta) = (select count(distinct lang) from documents d join labels l on d.doc_id = l.doc_id))"
        f" select {_BOTH.format('delta', 'delta')}, round(least(1.0, 2 * least(avg((delta <= 0)::int), avg((delta >= 0)::int))), 9) as p, count(*) as draws from draws"
    )


_FOLD = "list_reduce(vs[2:], lambda e, x: e * 0.95::double + x * 0.05::double, vs[1])"


def _averages(by: str, value: str) -> str:
    over = f"over ({f'partition by {by} ' if by else ''}order by event_id)"
    return f"select {by + ', ' if by else ''}event_id, round(case when len(vs) > 0 then {_FOLD} end, 6) as ema from (select {by + ', ' if by else ''}event_id, list({value}) filter ({value} is not null) {over} as vs from events)"


SQL = {
    "auc_replicates": f"{_PLAIN} select replicate, round(a, 9) as auc_n_chars, round(b, 9) as auc_coarse from draws",
    "auc_replicates_by_language": f"{_OF_LANG} select lang, replicate, round(auc, 9) as auc_n_chars from aucs where m = 'n_chars'",
    "paired_bootstrap": f"{_PLAIN}, held as (select a, b, a - b as delta from draws where a is not null and b is not null) select {_BOTH.format('a', 'auc_a')}, {_BOTH.format('b', 'auc_b')}, {_BOTH.format('delta', 'delta')}, round(avg((delta <= 0)::int), 9) as p_not_better, count(*) as draws from held",
    "fold_mean_bootstrap": _folds("lang || ':' || doc_id"),
    "fold_mean_bootstrap_shared": _folds("doc_id::varchar"),
    "user_moving_average": _averages("user_id", "case when event_id % 5 <> 0 then value end"),
}
QUERIES = {f.__name__: f for f in (auc_replicates, auc_replicates_by_language, paired_bootstrap, fold_mean_bootstrap, fold_mean_bootstrap_shared, user_moving_average, event_moving_average)}
SQL["event_moving_average"] = "with recursive e as (select event_id, value, row_number() over (order by event_id) as k from events), w as (select k, event_id, value::double as ema from e where k = 1 union all select e.k, e.event_id, w.ema * 0.95::double + e.value * 0.05::double from w join e on e.k = w.k + 1) select event_id, round(ema, 6) as ema from w"
