"""Queries of summaries, series, matching, labels and model comparison, each with SQL of its own."""

from pyspark.sql import functions as F

from corvane.operators import comparison as C
from corvane.operators import hashing as H
from corvane.operators import labels as L
from corvane.operators import matching as M
from corvane.operators import series as R
from corvane.operators import splits as S
from corvane.operators import summary as Y
from corvane.sources.tables import table


def _labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")


def value_counts(spark, sf):
    return Y.value_counts(table(spark, sf, "documents"), ["lang", "source"])


def rows_per_user(spark, sf):
    return Y.group_sizes(table(spark, sf, "events"), "user_id").select("groups", "least", F.col("middle").cast("double").alias("middle"), "most")


def source_summary(spark, sf):
    df = _labelled(spark, sf).withColumn("toxic_flag", F.col("toxic") == 1).withColumn("good", F.col("quality") == 1)
    return Y.dataset_summary(df, "source", "lang", "good", [], ["lang", "quality"], ["toxic_flag"]).withColumn("middle", F.col("middle").cast("double"))


def flag_case_stats(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("dear", F.col("l_extendedprice") > 30000)
    out = Y.case_summary(li, ["l_returnflag"], ["l_quantity"], ["dear"], "l_linenumber")
    return out.select("l_returnflag", "n", *[F.col(f"l_quantity_{s}").cast("double").alias(s) for s in ("min", "median", "max")], "dear", F.round("gb", 12).alias("gb"))


def source_label_shares(spark, sf):
    return Y.label_table(_labelled(spark, sf), "source", "quality", {"bad": 0, "good": 1}, ("bad", "good"), ["n_chars"], ["n_chars"])


def customer_order_scores(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return Y.rollup_scores(rows, "o_custkey", "o_orderkey", "l_discount", "y").withColumn("l_discount", F.round("l_discount", 9))


def user_mean_scores(spark, sf):
    return Y.mean_scores(table(spark, sf, "events"), "user_id", "value", "event_type", ["ts", "event_id"]).withColumn("value", F.round("value", 6))


def sample_deviations(spark, sf):
    df = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")).otherwise(F.lit(float("nan"))))
    out = Y.mean_and_sample_std(df, ["event_type"], ["v"])
    return out.select("event_type", "metric", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def level_histogram(spark, sf):
    px = table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("v")).select("label", F.floor((F.col("v").cast("double") + 1) * 16).cast("int").alias("level"), F.lit(1).alias("n"))
    return Y.full_histogram(px, "label", "level", "n", 32)


def order_facts(spark, sf):
    o = table(spark, sf, "orders")
    return Y.facts(o, {"orders": F.count("*"), "largest": F.max("o_totalprice"), "share_large": F.avg((F.col("o_totalprice") > 200000).cast("double"))}).withColumn("value", F.round("value", 9))


def length_density(spark, sf):
    return Y.density(_labelled(spark, sf), "n_chars", "quality", 0.0, 4000.0, 40).withColumn("density", F.round("density", 12))


def length_log_bins(spark, sf):
    return Y.log_bins(table(spark, sf, "documents"), "n_chars", 1.0, 65536.0, 8)


def unit_grid(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") / 64.0).alias("x"), (F.col("l_discount") * 10.0 + 0.05).alias("y"))
    return Y.grid_counts(li, "x", "y", ["l_returnflag"], 8)


def price_boxes(spark, sf):
    out = Y.box_statistics(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", "n", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75", "low", "high")])


def event_flags(spark, sf):
    e = table(spark, sf, "events").withColumn("high", F.col("value") > 100).withColumn("odd", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3 == 1))
    return Y.flag_percent(e, "event_type", ["high", "odd"]).withColumn("percent", F.round("percent", 9))


def customer_rate(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return Y.group_rate(o, "o_custkey", "y", F.col("o_totalprice") > 50000).withColumn("rate", F.round("rate", 9))


def coded_splits(spark, sf):
    return Y.named_splits(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", {"2-HIGH": "val", "5-LOW": "test"})


def known_sizes(spark, sf):
    d = table(spark, sf, "documents").withColumn("size", F.when((F.col("doc_id") % 50 != 0) | (F.col("lang") == "en"), F.col("n_chars")))
    return Y.size_totals(d, ["lang"], "size")


def flag_manifest(spark, sf):
    return Y.manifest_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_linenumber", "l_orderkey")


def user_early_stop(spark, sf):
    return R.early_stop(table(spark, sf, "events"), ["user_id"], "event_id", "value", 4)


def user_best_events(spark, sf):
    e = table(spark, sf, "events").withColumn("loss", -F.col("value"))
    return R.best_epochs(e, ["user_id"], "event_id", {"value": True, "loss": False})


def order_curves(spark, sf):
    out = R.curve_facts(table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("v")), ["l_orderkey"], "l_linenumber", "v")
    return out.select("l_orderkey", "n", "peak_at", "peak", F.round("enhancement", 9).alias("enhancement"), F.round("washout", 9).alias("washout"))


def spaced_events(spark, sf):
    return R.evenly_spaced(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 9)


def largest_events(spark, sf):
    return R.largest(table(spark, sf, "events").select("event_id", "value"), "value", 36, ["event_id"])


def errors_by_source(spark, sf):
    rows = _labelled(spark, sf).withColumn("pred", (F.col("n_chars") >= 2000).cast("int"))
    return R.errors_per(rows, ["source"], "pred", "quality", "doc_id", 3, 42, (1, 0)).select("source", "doc_id")


def surest_errors(spark, sf):
    rows = _labelled(spark, sf).withColumn("prob", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)))
    return R.worst_error(rows, ["source"], "prob", "quality", "doc_id").select("source", "doc_id", F.round("confidence", 9).alias("confidence"))


def first_and_last_lines(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    keys = ["l_orderkey"]
    first = M.one_of_each(li, keys, order).withColumn("side", F.lit("first"))
    return first.unionByName(M.one_of_each(li, keys, order, last=True).withColumn("side", F.lit("last")))


def nearest_quantities(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_quantity").distinct()
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("wanted"))
    return M.nearest_value(parts, "wanted", li, "l_quantity", ["l_partkey"], []).select(F.col("l_partkey").alias("p_partkey"), "wanted", F.col("l_quantity").cast("double").alias("nearest"))


def quantity_stages(spark, sf):
    stages = table(spark, sf, "region").select(F.col("r_regionkey").alias("stage"), ((F.col("r_regionkey") + 1) * 3).alias("epochs"), F.col("r_name").alias("scope"))
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("epoch")).distinct()
    return M.stage_of(rows, "epoch", stages, "stage", "epochs", "scope")


def sources_in_pairs(spark, sf):
    labels = table(spark, sf, "labels")
    pairs = labels.where("quality = 0").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return M.share_in_pairs(table(spark, sf, "documents"), "doc_id", "source", pairs, "a", "b").withColumn("share", F.round("share", 9))


def claimed_totals(spark, sf):
    docs = table(spark, sf, "documents")
    seen = docs.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"))
    claimed = _labelled(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.when(F.max("doc_id") % 2 == 0, F.countDistinct("lang")).alias("langs"))
    return M.claimed_and_observed(claimed, seen, "source", ["n", "langs"])


def manifest_status(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.md5("o_orderstatus").alias("digest"))
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.md5(F.max("l_linestatus")).alias("digest"))
    found, verdict = M.verify_manifest(e, a)
    return found.withColumn("verdict", F.lit(verdict))


def resolve_labels(spark, sf):
    """Customers' orders as cases whose label comes from their customer's lines: side by priority, label by return flag."""
    o = table(spark, sf, "orders")
    lines = o.join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    items = lines.where("l_linenumber = 1").select(F.col("o_custkey").alias("patient"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.substring("o_orderpriority", 1, 1).alias("side"))
    cases = o.select(F.col("o_custkey").alias("patient"), "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("case_side"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderstatus") == "F").cast("int")).alias("guess"))
    return L.resolve_labels(items, cases, "patient", "label", "side", "case_side", "guess").select("o_orderkey", "label", "label_method", "guess_agrees")


def class_auc(spark, sf):
    e = table(spark, sf, "embeddings").select("label", *[F.get("embedding", k).alias(f"p{k}") for k in range(10)])
    return C.multiclass_auc(e, "label", [f"p{k}" for k in range(10)]).withColumn("auc", F.round("auc", 9))


def operating_points(spark, sf):
    out = C.operating_points(_labelled(spark, sf), "quality", "n_chars", ["lang"])
    return out.select("lang", F.round("sensitivity", 9).alias("sensitivity"), F.round("specificity", 9).alias("specificity"))


def threshold_metrics(spark, sf):
    rows = _labelled(spark, sf).withColumn("p", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)))
    out = C.threshold_metrics(rows, "quality", "p", ["lang"])
    return out.select("lang", "n", *[F.round(c, 9).alias(c) for c in ("auc", "accuracy", "sensitivity", "specificity", "precision", "f1")])


def per_class_table(spark, sf):
    rows = _labelled(spark, sf).withColumn("pred", (F.col("n_chars") >= 2000).cast("int"))
    out = C.per_class_table(rows, "pred", "quality", ["lang"])
    return out.select("lang", "cls", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def held_rows(spark, sf):
    return S.row_holdout(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 42, 0.2)


def patient_folds(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return S.patient_folds(o, "o_custkey", "y", 5, 42, 4).select("o_orderkey", "fold", "split")


def near_hashes(spark, sf):
    """Hashes of the embeddings beside copies with three or five bits flipped: pairs within four bits."""
    e = table(spark, sf, "embeddings").select("vec_id", H.average_hash(F.col("embedding")).alias("h"))
    flipped = e.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.col("h").bitwiseXOR(F.when(F.col("vec_id") % 2 == 0, F.lit(0x1000200003)).otherwise(F.lit(0x100020000B))).alias("h"))
    return H.hamming_pairs(e.union(flipped), "vec_id", "h", 4).select("a", "b", F.col("distance").cast("int").alias("distance"))


_L = "(select d.doc_id, source, lang, n_chars, quality, toxic from documents d join labels l on d.doc_id = l.doc_id)"
_BITS = "(select vec_id, list_reduce(list_transform(embedding, lambda x: case when x::double > list_avg(list_transform(embedding, lambda y: y::double)) then 1::hugeint else 0::hugeint end), lambda a, b: a * 2 + b) as u from embeddings)"
_HASHES = f"(select vec_id, u from {_BITS} union all select vec_id + 1000000000, xor(u, case when vec_id % 2 = 0 then 68721573891 else 68721573899 end::hugeint) from {_BITS})"
_RATIO = "{0} / nullif(({1})::double, 0)"


def _conf(rel, by):
    return f"(select {by}, count(*) as n, count(*) filter (y = 0 and p = 0) as tn, count(*) filter (y = 0 and p = 1) as fp, count(*) filter (y = 1 and p = 0) as fn, count(*) filter (y = 1 and p = 1) as tp from {rel} group by {by})"


SQL = {
    "value_counts": 'select \'lang\' as "column", lang as value, count(*) as n from documents group by lang union all select \'source\', source, count(*) from documents group by source',
    "rows_per_user": "select count(*) as groups, min(n) as least, median(n)::double as middle, max(n) as most from (select count(*) as n from events where user_id is not null group by user_id)",
    "source_summary": f"select source, count(*) as rows, count(*) filter (quality = 1) as used, count(distinct (lang, quality)) as sizes, count(*) filter (toxic = 1) as toxic_flag, count(distinct lang) as groups, any_value(least) as least, any_value(middle)::double as middle, any_value(most) as most from {_L} join (select source, min(n) as least, median(n) as middle, max(n) as most from (select source, lang, count(*) as n from {_L} group by all) group by source) using (source) group by source",
    "flag_case_stats": "select l_returnflag, count(*) as n, min(l_quantity)::double as min, median(l_quantity)::double as median, max(l_quantity)::double as max, count(*) filter (l_extendedprice > 30000) as dear, round(sum(l_linenumber) / 1e9, 12) as gb from lineitem group by l_returnflag",
    "source_label_shares": f"select source, count(*) as n, count(*) filter (quality = 0) as bad, count(*) filter (quality = 1) as good, round(count(*) filter (quality = 0) / count(*)::double, 3) as bad_share, round(median(n_chars), 3) as n_chars_median, round(avg(n_chars), 3) as n_chars_mean from {_L} group by source",
    "customer_order_scores": "select o_custkey, count(*) as units, round(max(s), 9) as l_discount, max(y) as y from (select o_custkey, o_orderkey, avg(l_discount) as s, max((l_returnflag = 'R')::int) as y from orders join lineitem on o_orderkey = l_orderkey group by all) group by o_custkey",
    "user_mean_scores": "select user_id, count(*) as n, round(avg(value), 6) as value, first(event_type order by ts, event_id) as event_type from events group by user_id",
    "sample_deviations": "select event_type, 'v' as metric, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std from events where event_id % 5 <> 0 group by event_type",
    "level_histogram": "with px as (select label, floor((v::double + 1) * 16)::int as level from (select label, unnest(embedding) as v from embeddings)) select l.label, g::int as level, count(px.level) as n from (select distinct label from embeddings) l cross join range(32) t(g) left join px on px.label = l.label and px.level = g group by l.label, g",
    "order_facts": "select 'orders' as name, count(*)::double as value from orders union all select 'largest', round(max(o_totalprice), 9) from orders union all select 'share_large', round(count(*) filter (o_totalprice > 200000) / count(*)::double, 9) from orders",
    "length_density": f"with b as (select quality, least(floor(n_chars / 100.0::double), 39)::int as bin, count(*) as n from {_L} where n_chars between 0 and 4000 group by all) select quality, bin, n, round(n / (sum(n) over (partition by quality) * 100.0::double), 12) as density from b",
    "length_log_bins": "select bin, count(*) as n from (select (select max(i) from range(8) t(i) where n_chars >= 4 ** i)::int as bin from documents where n_chars between 1 and 65536) group by bin",
    "unit_grid": "select l_returnflag, least(floor((l_discount * 10.0::double + 0.05::double) * 8), 7)::int as gy, least(floor(l_quantity / 64.0::double * 8), 7)::int as gx, count(*) as n from lineitem where l_discount * 10.0::double + 0.05::double between 0 and 1 and l_quantity / 64.0::double between 0 and 1 group by all",
    "price_boxes": "with q as (select o_orderpriority, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) as q from orders group by 1) select o_orderpriority, count(*) as n, round(any_value(q[1]), 6) as q25, round(any_value(q[2]), 6) as q50, round(any_value(q[3]), 6) as q75, round(min(o_totalprice) filter (o_totalprice >= q[1] - 1.5 * (q[3] - q[1])), 6) as low, round(max(o_totalprice) filter (o_totalprice <= q[3] + 1.5 * (q[3] - q[1])), 6) as high from orders join q using (o_orderpriority) group by 1",
    "event_flags": "select event_type, 'high' as flag, round(100 * count(*) filter (value > 100) / count(*)::double, 9) as percent from events group by 1 union all select event_type, 'odd', round(100 * count(*) filter (event_id % 3 = 1) / count(*)::double, 9) from events group by 1",
    "customer_rate": "select count(*) as groups, sum(y)::bigint as positive, round(sum(y) / count(*)::double, 9) as rate from (select o_custkey, max((o_orderstatus = 'F')::int) as y from orders where o_totalprice > 50000 group by o_custkey)",
    "coded_splits": "with m as (select o_orderpriority as c from orders group by 1 order by count(*) desc, 1 limit 1) select o_orderkey, o_orderpriority, case when o_orderpriority = (select c from m) then 'train' when o_orderpriority = '2-HIGH' then 'val' when o_orderpriority = '5-LOW' then 'test' end as split from orders",
    "known_sizes": "select lang, count(*) as files, count(*) filter (doc_id % 50 <> 0 or lang = 'en') as known, case when lang = 'en' or count(*) filter (doc_id % 50 = 0) = 0 then sum(n_chars)::bigint end as total from documents group by lang",
    "flag_manifest": "select l_returnflag, l_linestatus, count(*) as lesions, sum(l_linenumber)::bigint as slices, count(distinct l_orderkey) as groups from lineitem group by 1, 2 union all select l_returnflag, null, count(*), sum(l_linenumber)::bigint, count(distinct l_orderkey) from lineitem group by 1 union all select null, null, count(*), sum(l_linenumber)::bigint, count(distinct l_orderkey) from lineitem",
    "user_early_stop": "with r as (select user_id, event_id, value, max(value) over (partition by user_id order by event_id) as best from events), s as (select *, (select count(*) from r x where x.user_id = r.user_id and x.event_id <= r.event_id and x.event_id > (select min(event_id) from r y where y.user_id = r.user_id and y.value = r.best)) as stale from r), t as (select user_id, min(event_id) filter (stale >= 4) as stop_at from s group by 1) select t.user_id, stop_at, max(s.value) as best, (select min(e.event_id) from events e where e.user_id = t.user_id and e.value = max(s.value)) as best_at from t join s on s.user_id = t.user_id and (stop_at is null or s.event_id <= stop_at) group by t.user_id, stop_at",
    "user_best_events": "select user_id, first(event_id order by value desc, event_id) as best_value, first(event_id order by value desc, event_id) as best_loss from events group by user_id",
    "order_curves": "with v as (select l_orderkey, l_linenumber, min(l_extendedprice) as v from lineitem group by 1, 2), a as (select l_orderkey, list(v order by l_linenumber) as x from v group by 1) select l_orderkey, len(x)::int as n, (list_position(x, list_max(x)) - 1)::int as peak_at, list_max(x) as peak, case when len(x) >= 2 then round((list_max(x) - x[1]) / x[1], 9) end as enhancement, case when len(x) >= 2 then round((list_max(x) - x[-1]) / list_max(x), 9) end as washout from a",
    "spaced_events": "with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as r, count(*) over (partition by user_id) as n from events) select user_id, event_id, k::int as place from r join range(9) t(k) on round_even(k * (n - 1) / 8.0::double, 0) = r",
    "largest_events": "select event_id, value from events where value is not null order by abs(value) desc, event_id limit 36",
    "errors_by_source": f"select source, doc_id from (select source, doc_id, row_number() over (partition by source order by md5(concat_ws(':', '42', doc_id::varchar)), doc_id) as k from {_L} where quality = 1 and n_chars < 2000) where k <= 3",
    "surest_errors": f"select source, doc_id, round(c, 9) as confidence from (select source, doc_id, c, row_number() over (partition by source order by c desc, doc_id) as k from (select source, doc_id, case when quality = 1 then 1 - least(n_chars / 4000.0::double, 1) else least(n_chars / 4000.0::double, 1) end as c from {_L} where (least(n_chars / 4000.0::double, 1) >= 0.5)::int <> quality)) where k = 1",
    "first_and_last_lines": "with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as a, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc, l_suppkey desc, l_quantity desc) as z from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'first' as side from r where a = 1 union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'last' from r where z = 1",
    "nearest_quantities": "select p_partkey, p_size::double as wanted, (select l_quantity from lineitem where l_partkey = p_partkey order by abs(l_quantity - p_size), l_quantity limit 1)::double as nearest from part",
    "quantity_stages": "with s as (select r_name, sum((r_regionkey + 1) * 3) over (order by r_regionkey) - (r_regionkey + 1) * 3 as lo from region) select epoch, (select r_name from s where lo <= epoch order by lo desc limit 1) as scope from (select distinct l_quantity::int as epoch from lineitem)",
    "sources_in_pairs": "with e as (select doc_id as x from labels where quality = 0 union select doc_id + 1 from labels where quality = 0) select source, count(*) as n, count(x) as in_pairs, round(count(x) / count(*)::double, 9) as share from documents left join e on doc_id = x group by source",
    "claimed_totals": f"with c as (select source, count(*)::double as n, case when max(doc_id) % 2 = 0 then count(distinct lang) end::double as langs from {_L} group by source), o as (select source, count(*)::double as n, count(distinct lang)::double as langs from documents group by source), f as (select source, 'n' as fact, c.n as claimed, o.n as observed from c left join o using (source) union all select source, 'langs', c.langs, o.langs from c left join o using (source)) select *, case when claimed is null then 'not claimed' when observed is null then 'not observed' when claimed = observed then 'ok' else 'differs' end as status from f",
    "manifest_status": "with e as (select o_orderkey::varchar as path, md5(o_orderstatus) as d from orders), a as (select l_orderkey::varchar as path, md5(max(l_linestatus)) as d from lineitem group by 1) select coalesce(e.path, a.path) as path, case when a.path is null then 'missing' when e.path is null then 'new' when e.d <> a.d then 'changed' else 'ok' end as status, 'MISMATCH' as verdict from e full join a on e.path = a.path",
    "resolve_labels": "with i as (select o_custkey as p, (l_returnflag = 'R')::int as y, left(o_orderpriority, 1) as s from orders join lineitem on o_orderkey = l_orderkey where l_linenumber = 1), r as (select o_orderkey, case when o_orderkey % 2 = 0 then (o_orderstatus = 'F')::int end as guess, (select count(distinct y) from i where p = o_custkey) as ys, (select min(y) from i where p = o_custkey) as y, (select count(*) from i where p = o_custkey) as n, count(*) over (partition by o_custkey) as m, (select count(distinct y) from i where p = o_custkey and s = left(o_orderpriority, 1)) as sys, (select min(y) from i where p = o_custkey and s = left(o_orderpriority, 1)) as sy from orders), t as (select *, case when ys = 1 then 'uniform' when n <> m then 'count_mismatch' when sys = 1 then 'by_side' when sys = 0 then 'side_conflict' else 'ambiguous' end as label_method from r), u as (select *, case label_method when 'uniform' then y when 'by_side' then sy end as label from t) select o_orderkey, label, label_method, label = guess as guess_agrees from u",
    "class_auc": "with r as (select i as cls, (label = i)::int as y, embedding[i + 1] as p from embeddings, range(10) t(i)), w as (select cls, sum(case when a.p > b.p then 1.0::double when a.p = b.p then 0.5::double else 0 end) / count(*) as auc from (select cls, p from r where y = 1) a join (select cls, p from r where y = 0) b using (cls) group by cls), k as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0::double as k from r) select cls::varchar as name, round(auc, 9) as auc from w union all select 'macro', round(avg(auc), 9) from w union all select 'micro', round((sum(k) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y)::double * sum(1 - y)), 9) from k",
    "operating_points": f"with t as (select lang, n_chars as s, sum(quality) as p, sum(1 - quality) as q from {_L} group by all), c as (select lang, s, sum(q) over w / nullif(sum(q) over (partition by lang), 0)::double as x, sum(p) over w / nullif(sum(p) over (partition by lang), 0)::double as y from t window w as (partition by lang order by s desc)), z as (select lang, x, y, coalesce(lag(x) over (partition by lang order by s desc), 0) as x0, coalesce(lag(y) over (partition by lang order by s desc), 0) as y0 from c) select lang, round(max(case when x <= 1 - 0.9::double then y when x0 <= 1 - 0.9::double then y0 + (1 - 0.9::double - x0) * (y - y0) / (x - x0) end), 9) as sensitivity, round(1 - min(case when y0 >= 0.9 then x0 when y >= 0.9 then x0 + (0.9 - y0) * (x - x0) / (y - y0) end), 9) as specificity from z group by lang",
    "threshold_metrics": f"with r as (select lang, quality as y, least(n_chars / 4000.0::double, 1) as s, (least(n_chars / 4000.0::double, 1) >= 0.5)::int as p from {_L}), c as {_conf('r', 'lang')}, a as (select lang, sum(case when a.s > b.s then 1.0::double when a.s = b.s then 0.5::double else 0 end) / count(*) as auc from (select lang, s from r where y = 1) a join (select lang, s from r where y = 0) b using (lang) group by lang) select lang, n, round(auc, 9) as auc, round((tp + tn) / n::double, 9) as accuracy, round({_RATIO.format('tp', 'tp + fn')}, 9) as sensitivity, round({_RATIO.format('tn', 'tn + fp')}, 9) as specificity, round(coalesce({_RATIO.format('tp', 'tp + fp')}, 0), 9) as precision, round(coalesce({_RATIO.format('2 * tp', '2 * tp + fp + fn')}, 0), 9) as f1 from c left join a using (lang)",
    "per_class_table": f"with c as {_conf('(select lang, quality as y, (n_chars >= 2000)::int as p from ' + _L + ')', 'lang')}, h as (select lang, 0 as cls, tn as hit, fp as miss, fn as wrong from c union all select lang, 1, tp, fn, fp from c) select lang, cls, hit + miss as support, round(coalesce(hit / nullif((hit + wrong)::double, 0), 0), 9) as precision, round(coalesce(hit / nullif((hit + miss)::double, 0), 0), 9) as recall, round(coalesce(2 * hit / nullif((2 * hit + miss + wrong)::double, 0), 0), 9) as f1 from h",
    "held_rows": "select o_orderkey, case when r > n - greatest(1, floor(n * 0.2)) then 'val' else 'train' end as split from (select o_orderkey, row_number() over (order by md5(concat_ws(':', '42', o_orderkey::varchar)), o_orderkey) as r, count(*) over () as n from orders)",
    "patient_folds": "with t as (select o_custkey as g, max((o_orderstatus = 'F')::int) as y from orders group by 1), f as (select g, ((row_number() over (partition by y order by md5(concat_ws(':', '42', g::varchar)), g) - 1) % 5)::int as fold from t) select o_orderkey, fold, case fold when 4 then 'test' when 0 then 'val' else 'train' end as split from orders join f on o_custkey = g",
    "near_hashes": f"with h as (select vec_id, u from {_HASHES}) select x.vec_id as a, y.vec_id as b, bit_count(xor(x.u, y.u))::int as distance from h x join h y on x.vec_id < y.vec_id where bit_count(xor(x.u, y.u)) <= 4",
}
QUERIES = {name: globals()[name] for name in SQL}
